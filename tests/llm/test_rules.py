"""Base measures, the exact binomial tail, cutoff choice and verdicts against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quarry.llm.risk_rules import BASE, RULES, Rule, binomial_tail_sql, choose_cutoffs, judge, measures, paths, setting, verdicts

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(6)
    out = [None, "", " \n\t\x0b", "a", "a b", "a b c", "a b c a b c", "x " * 100, "é😀 <b>| #\n\n\nsame\nsame\n same\n \x0c\n", "a\x1cb c", "\x85 x"]
    for _ in range(150):
        n, k = rng.randint(1, 200), rng.choice([2, 5, 40, 1000])
        out.append(rng.choice([" ", "\n", "  ", "\r\n"]).join(rng.choice(["w", "é", "#", "wörd"]) + str(rng.randint(0, k)) for _ in range(n)))
    return out


def test_measures(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as stratum", "3 as w", "4 as h").repartition(3)
    got = {r["id"]: tuple(r[c] for c in BASE) for r in measures(docs, {"id": "doc_id"}).collect()}
    for k, t in enumerate(texts()):
        assert got[k] == brute(t), repr(t)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.2), (40, 10000, 0.004), (0, 100000, 0.01), (7, 8, 0.5)])
def test_binomial_tail(spark, k, n, p):
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    got = spark.sql(f"SELECT {binomial_tail_sql('k', 'n', p)} AS p FROM VALUES ({k}L, {n}L) AS t(k, n)").first()["p"]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-300)


SCHEMA = "id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_loud long"
TWO = (Rule("symbols", "n_symbols / n_words", (0.7, 0.5)), Rule("loud", "n_loud / n_words", (0.5,)))


def test_cutoffs_and_verdicts(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice(["en", "de", None]), 100, 500, rng.choice([0] * 99 + [60]), 0, 0, 0) for k in range(6000)]
    rows += [(10_000 + k, ["en", "de", None][k % 3], 100, 500, 90, 0, 0, 0) for k in range(30)]
    measured = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, 1) for k in range(6000)] + [(10_000 + k, 0) for k in range(30)] + [(10_000, 1), (None, 1), (3, None)], "doc_id long, quality int")
    found = {r["stratum"]: r["cutoffs"] for r in choose_cutoffs(measured, labels, TWO, alpha=0.01).collect()}
    # one in a hundred good documents is over 0.5, as many as the limit: that can't be shown to be safe; none is over 0.7
    assert found == {s: {"symbols": 0.7, "loud": 0.5} for s in ("en", "de", None)}
    few = labels.where("doc_id < 300 OR doc_id >= 10000")
    assert choose_cutoffs(measured, few, TWO, alpha=0.01).count() == 0
    assert choose_cutoffs(measured, few, TWO, alpha=0.1).count() == 3
    assert choose_cutoffs(measured, labels.where("quality = 1 AND doc_id < 6000"), TWO, alpha=0.01).count() == 0  # nothing to gain
    bad = measured.where("id = 10000")
    got = verdicts(bad, choose_cutoffs(measured, labels, TWO, alpha=0.01), TWO).first()
    assert not got["base_failed"] and not got["kept"]


def tail(k, n, p):
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_choice_is_the_brute_one(spark):
    rng = random.Random(11)
    rows = [(k, f"s{k % 3}", 100, 500, rng.choice([0, 0, 0, 30, 60, 80]) if k % 5 == 0 else rng.choice([0] * 60 + [60, 80]), 0, 0, rng.choice([0] * 30 + [70])) for k in range(3000)]
    good = {k: int(k % 5 != 0) for k in range(3000)}
    measured = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame(list(good.items()), "doc_id long, quality int")
    got = {r["stratum"]: r["cutoffs"] for r in choose_cutoffs(measured, labels, TWO, alpha=0.05).collect()}
    want = {}
    for s in ("s0", "s1", "s2"):
        own = [r for r in rows if r[1] == s]
        sound = [r for r in own if good[r[0]]]
        best = (0, None)
        for path in paths(TWO):
            for step in range(max(len(r.cutoffs) for r in path)):
                cut = setting(path, step)
                out = lambda r, cut=cut: any(v / 100 > cut.get(n, 9) for n, v in (("symbols", r[4]), ("loud", r[7])))
                if tail(sum(map(out, sound)), len(sound), 0.05) > 0.05 / (3 * len(paths(TWO))):
                    break
                gain = sum(out(r) for r in own if not good[r[0]])
                best = max(best, (gain, cut), key=lambda x: x[0])
        if best[0]:
            want[s] = best[1]
    assert got == want and want


def test_false_rejections_stay_within_the_limit(spark):
    """Many draws of a holdout from documents whose true rates are known: unsafe settings are taken in at most delta of them."""
    rng = np.random.default_rng(5)
    draws, size, alpha, delta = 400, 600, 0.02, 0.05
    symbols = rng.choice([0, 60, 80], (draws, size), p=[0.97, 0.02, 0.01])  # 3 % of the good ones are over 0.5: unsafe; 1 % over 0.7: safe
    loud = rng.choice([0, 70], (draws, size), p=[0.995, 0.005])
    rows = pd.DataFrame({"d": np.repeat(np.arange(draws), size), "symbols": symbols.ravel(), "loud": loud.ravel()})
    unsafe, on = 0, 0
    level = delta / len(paths(TWO))
    for _, own in rows.groupby("d"):
        taken = []
        for path in paths(TWO):
            for step in range(max(len(r.cutoffs) for r in path)):
                cut = setting(path, step)
                k = int(((own.symbols / 100 > cut.get("symbols", 9)) | (own.loud / 100 > cut.get("loud", 9))).sum())
                if tail(k, size, alpha) > level:
                    break
                taken.append(cut)
        on += bool(taken)
        unsafe += any(c.get("symbols") == 0.5 for c in taken)
    assert unsafe <= delta * draws and on > draws / 2
    # the operator itself, on some of the draws as strata: each is corrected for their number
    part = rows[rows.d < 40].reset_index(drop=True)
    some = [(k, f"d{d}", 100, 500, int(s), 0, 0, int(x)) for k, (d, s, x) in enumerate(zip(part.d, part.symbols, part.loud, strict=True))]
    bad = [(100_000 + k, f"d{k}", 100, 500, 90, 0, 0, 90) for k in range(40)]
    labels = [(r[0], 1) for r in some] + [(r[0], 0) for r in bad]
    found = choose_cutoffs(spark.createDataFrame(some + bad, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"), TWO, alpha, delta).collect()
    assert found and not any(r["cutoffs"].get("symbols") == 0.5 for r in found)


def test_judge_odd_rows(spark):
    docs = spark.createDataFrame([(1, "word " * 60, "en"), (None, None, None), (2, " ".join(f"w{k}" for k in range(60)), None), (2, " ".join(f"w{k}" for k in range(60)), None)], "doc_id long, text string, lang string").selectExpr("*", "true as kept", "1 as stratum")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted([(r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in judge(docs, labels).collect()], key=str)
    assert got == sorted([(1, 60, True, False), (None, 0, True, False), (2, 60, False, True), (2, 60, False, True)], key=str)
    assert judge(docs.limit(0), labels).count() == 0
    assert len({r.name for r in RULES}) == len(RULES)
