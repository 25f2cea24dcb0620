"""The pipeline's stages in a row, each against plain Python on its own input."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from quarry.llm._tables import new_path
from quarry.llm.string_tiling import tile

SF = "/root/testdata/sf0.01"


def shingles(text: str, n: int = 5) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        tables.append(docs.toPandas())
    return tables


def test_columns(outputs):
    for t in outputs[1:-1]:
        assert list(t.columns) == list(outputs[0].columns)


def test_quality_stage(outputs):
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    stayed = set(outputs[1].doc_id)
    known = [(d in stayed, labels[d]) for d in outputs[0].doc_id if d in labels.index]
    assert sum(k for k, y in known if y == 1) / sum(y == 1 for _, y in known) > 0.98
    assert sum(k for k, y in known if y == 0) / sum(y == 0 for _, y in known) < 0.15


def test_line_stage(outputs):
    before, after = outputs[1], outputs[2]
    on = defaultdict(set)
    for text, source in zip(before.text, before.source, strict=True):
        for line in text.split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                on[line].add(source)
    want = {d: "\n".join(x for x in t.split("\n") if len(on.get(x, ())) < 10) for d, t in zip(before.doc_id, before.text, strict=True)}
    assert dict(zip(after.doc_id, after.text, strict=True)) == want
    assert (after.n_chars == after.text.str.len()).all()
    assert any(want[d] != t for d, t in zip(before.doc_id, before.text, strict=True))


def test_near_stage(outputs):
    before, after = outputs[2], set(outputs[3].doc_id)
    sets = {d: shingles(t) for d, t in zip(before.doc_id, before.text, strict=True)}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    like = defaultdict(dict)
    for d, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for e in holders[x]:
                shared[e] += 1
        for e, n in shared.items():
            if e != d:
                like[d][e] = n / (len(s) + len(sets[e]) - n)
    gone = set(before.doc_id) - after
    assert len(gone) > 20 and all(max(like[d].values()) >= 0.8 for d in gone)  # every document that went has a near copy
    both = [(d, e) for d in like for e, j in like[d].items() if j >= 0.8 and d in after and e in after]
    assert not both
    assert outputs[3].merge(before, on=list(before.columns)).shape[0] == len(outputs[3])


def test_decontamination_stage(outputs):
    """Whoever shares five words with an item is tiled with it; the tiles decide. (test_text_filters.py holds tile() against brute force.)"""
    words = lambda t: (t or "").encode().lower().split()
    numbers = defaultdict(lambda: len(numbers))
    coded = lambda t: np.array([numbers[w] for w in words(t)], np.uint64)
    items = [coded(t) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    holders = defaultdict(set)
    for k, item in enumerate(items):
        for at in range(len(item) - 4):
            holders[item[at : at + 5].tobytes()].add(k)
    before, after = outputs[3], set(outputs[4].doc_id)
    shares = {}
    for d, text in zip(before.doc_id, before.text, strict=True):
        document = coded(text)
        met = set().union(*(holders.get(document[at : at + 5].tobytes(), ()) for at in range(len(document) - 4)))
        shares[d] = max((sum(n for *_, n in tile(items[k], document, 5)) / len(items[k]) for k in met), default=0.0)
    assert {d for d, share in shares.items() if share < 0.5} == after
    assert sum(share >= 0.5 for share in shares.values()) > 5


def test_packing_stage(outputs):
    pieces = outputs[5]
    assert set(pieces.doc_id) == set(outputs[4].doc_id)
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    filled = pieces.groupby("sequence_id").length.sum()
    assert filled.max() <= 1024 and filled.sum() / (1024 * len(filled)) > 0.97


def test_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randint(0, 999)}" for _ in range(n))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, words(80), "en", None, 1), (None, words(80), None, "s", None)]
    docs = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ("key", "i", "score", "component", "n_removed", "n_lines", "contaminated", "coverage", "n_items", "item_id", "_q_key", "_q_doc", "hashes", "start", "length")
    docs = docs.selectExpr("*", *(f"{k} as {c}" for k, c in enumerate(clashing)))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, words(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert now.columns == docs.columns
                assert all(r[c] == k for r in now.collect() for k, c in enumerate(clashing))
        got = now.collect()
        assert len(got) == (0 if start is not docs else 3)
