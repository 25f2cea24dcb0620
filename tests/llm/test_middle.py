"""The streaming matcher against a list of units."""

import hashlib
import random

from quarry.llm.middle import UNIT, borders, count_units, fill_in_middle, restored


def plain_way(key, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return key, n, "plain", None, None, text
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return key, n, "spm", len(prefix), len(middle), "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return key, n, "psm", len(prefix), len(middle), "<P>" + prefix + "<S>" + suffix + "<M>" + middle


def test_borders():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("ab é𝒳\n\t\x0b\x1c ") for _ in range(rng.randint(0, 30)))
        units = UNIT.findall(text)
        assert "".join(units) == text and count_units(text) == len(units)
        for _ in range(4):
            a, b = sorted(rng.randint(0, len(units)) for _ in range(2))
            assert borders(text, a, b) == (len("".join(units[:a])), len("".join(units[:b])))


def test_documents(spark):
    rng = random.Random(4)
    odd = [None, "", " ", "\n\n  ", "one", "<P>", "a <S> b", "a <<S b> <M", "< P> <P", "<", "P>x<", "𝒳 é x  ", " " * 50_000, "word " * 200_000, "x" * 300_000]
    rows = [(k, text) for k, text in enumerate(odd * 6)] + [(k, "".join(rng.choice("<>PSM ab\n") for _ in range(rng.randint(0, 12)))) for k in range(1000, 1600)]
    rows += [(None, "no id here"), (5, "again"), (5, "again"), (-3, "less than none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as output", "'x' as key").repartition(4)
    made = fill_in_middle(df)
    got = made.select("*", restored(made.output, made.form).alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((plain_way(*r) for r in rows), key=repr)
    assert sorted((r["doc_id"], r["back"]) for r in got if r["doc_id"] is not None) == sorted((k, t or "") for k, t in rows if k is not None)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).count() == 0
