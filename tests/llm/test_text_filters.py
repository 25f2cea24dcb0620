"""String tiling and line spread against brute force."""

import random
from collections import defaultdict

import numpy as np

from quarry.llm.line_spread import cleaned, remove_boilerplate
from quarry.llm.string_tiling import contamination, deciding_seeds, tile, uncontaminated


def naive_tiles(item, document, shortest):
    a, b, out = [False] * len(item), [False] * len(document), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(document)):
                k = 0
                while i + k < len(item) and j + k < len(document) and item[i + k] == document[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < shortest:
            return out
        out.append((i, j, k))
        a[i : i + k] = b[j : j + k] = [True] * k


def test_tiles_are_the_greedy_ones():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.randint(1, 6) for _ in range(rng.randint(0, 25))]
        document = [rng.randint(1, 6) for _ in range(rng.randint(0, 40))]
        got = tile(np.array(item, np.uint64), np.array(document, np.uint64), 3)
        assert got == naive_tiles(item, document, 3)


def benchmark_rows():
    rng = random.Random(9)
    return [(k, " ".join(f"t{rng.randint(0, 400)}" for _ in range(rng.randint(12, 40)))) for k in range(30)] + [(90, None), (91, ""), (92, "too short")]


def test_contamination(spark):
    rng, items = random.Random(8), benchmark_rows()
    rows = [(0, None), (1, ""), (2, "too short")]
    for k in range(3, 200):
        words = [f"t{rng.randint(0, 400)}" for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.5:
            item = rng.choice(items[:30])[1].split()
            cut = rng.randint(0, len(item))
            at = rng.randint(0, len(words))
            words[at:at] = item[cut:] + ["between"] * rng.randint(0, 2) + item[:cut]  # reordered
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = "changed"
        rows.append((k, " \n".join(words).upper() if k % 3 == 0 else " ".join(words)))
    rows.append(rows[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as item", "3 as row", "4 as coverage", "5 as item_id", "6 as contaminated", "7 as n_items", "8 as words", "9 as seeds").repartition(3)
    items_df = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for k, text in rows:
        words, found = (text or "").lower().split(), []
        for item, t in items:
            own = (t or "").split()
            share = sum(n for _, _, n in naive_tiles(own, words, 5)) / len(own) if len(own) >= 5 else 0
            if share >= 0.5:
                found.append((-share, item))
        found.sort()
        want.append((k, bool(found), len(found), found[0][1] if found else None, -found[0][0] if found else 0.0))
    got = contamination(docs, items_df).select("doc_id", "contaminated", "n_items", "item_id", "coverage").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    stay = uncontaminated(docs, items_df)
    assert stay.columns == docs.columns
    assert sorted([r["doc_id"] for r in stay.collect()]) == sorted(w[0] for w in want if not w[1])
    assert sum(w[1] for w in want) > 60
    assert contamination(docs, items_df.limit(0)).where("contaminated").count() == 0
    assert contamination(docs.limit(0), items_df).count() == 0


def test_a_window_of_all_items_is_no_key():
    shared, own = np.full(3, 7), np.arange(10, 40)
    seeds = np.concatenate([own[:15], shared, own[15:]])
    often = np.where(seeds == 7, 10_000, 1)
    keys = deciding_seeds(seeds, often, len(seeds) + 4, 5, 0.5)
    assert 7 not in keys and 0 < len(keys) < len(own)
    # the seeds left out can't cover half of the item
    covered = np.zeros(len(seeds) + 4, bool)
    for at in np.flatnonzero(~np.isin(seeds, keys)):
        covered[at : at + 5] = True
    assert covered.sum() < 0.5 * len(covered)
    assert deciding_seeds(np.full(6, 7), np.full(6, 10_000), 10, 5, 0.5).tolist() == [7]


def test_items_with_a_common_opening(spark):
    items = [(k, "answer the following question with yes or no " + " ".join(f"q{k}_{j}" for j in range(30))) for k in range(40)]
    docs = [(k, "answer the following question with yes or no " + (" ".join(f"q{k}_{j}" for j in range(30)) if k % 5 == 0 else "other words")) for k in range(40)]
    found = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(None, items[5][1])], "item_id long, text string"))
    got = {r["doc_id"]: (r["contaminated"], r["item_id"], r["n_items"]) for r in found.collect()}
    assert got == {k: (k % 5 == 0, k if k % 5 == 0 else None, (k % 5 == 0) + (k == 5)) for k in range(40)}


def test_boilerplate(spark):
    rng = random.Random(3)
    lines = [f"line {k}" for k in range(300)]
    sites = {k: rng.sample(range(40), rng.randint(1, 15)) for k in range(40)}
    rows = []
    for k in range(400):
        site = rng.randint(0, 39)
        own = [lines[rng.randint(40, 299)] + f" {k}" for _ in range(rng.randint(0, 5))] + [lines[j] for j in sites if site in sites[j] and rng.random() < 0.7]
        rng.shuffle(own)
        rows.append((k, "\n".join(own), f"site{site}"))
    rows += [(900, None, "site1"), (901, "", "site2"), (902, "\n \n", None), (903, "line 1\nline 1", None)]
    rows.append(rows[0])
    spread = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip() and site:
                spread[line].add(site)
    gone = {line for line, on in spread.items() if len(on) >= 8}
    assert 3 < len(gone) < 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as at", "2 as line", "3 as k1", "4 as n_lines", "5 as n_removed", "6 as site").repartition(3)
    got = remove_boilerplate(docs, min_sites=8).select("doc_id", "text", "source", "n_lines", "n_removed").collect()
    want = []
    for k, text, site in rows:
        own = text.split("\n") if text is not None else []
        left = [x for x in own if x not in gone]
        want.append((k, text if text is None else "\n".join(left), site, len(own), len(own) - len(left)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert remove_boilerplate(docs.limit(0)).count() == 0
    whole = cleaned(docs, min_sites=8)
    assert whole.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in whole.collect()), key=str) == sorted(((w[0], w[1], 4, 5) for w in want), key=str)
