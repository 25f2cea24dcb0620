"""The line field: exact sums on small chains, gradients by their effect, accuracy on held-out documents."""

import itertools
import time

import numpy as np
import pytest

from quarry.llm.line_crf import NAMES, Lines, Model, chain_marginals, fit, forward_backward, held_out, keep_good, line_features, marginals, score_documents, scores, train

DATA = "/root/testdata/sf0.01"


def test_marginals_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(0)
    model = Model.empty()
    model.step[:] = rng.normal(size=(2, 2))
    sizes = [3, 1, 5, 2]
    first = np.append(0, np.cumsum(sizes))
    e = rng.normal(size=first[-1])
    got, pair = forward_backward(model, e, first)
    for a, b in itertools.pairwise(first):
        total, marginal, pairs = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for labels in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(e[a + k] * y for k, y in enumerate(labels)) + sum(model.step[x, y] for x, y in itertools.pairwise(labels)))
            total += w
            marginal += w * np.array(labels)
            for k, (x, y) in enumerate(itertools.pairwise(labels)):
                pairs[k, x, y] += w
        assert np.allclose(got[a:b], marginal / total)
        assert np.allclose(pair[a : b - 1], pairs[:-1] / total)


def test_long_chains_in_blocks():
    rng = np.random.default_rng(2)
    model = Model.empty()
    model.step[:] = rng.normal(size=(2, 2))
    sizes = [3, 57, 1, 2049, 300]
    first = np.append(0, np.cumsum(sizes))
    e = rng.normal(size=first[-1]) * 3
    want = forward_backward(model, e, first)[0]
    assert np.allclose(marginals(model, e, first, most_steps=50), want)
    phi = np.stack([np.ones(57), np.exp(e[3:60])], 1)
    for block in (1, 2, 7, 57, 100):
        assert np.allclose(chain_marginals(phi / phi.sum(1, keepdims=True), np.exp(model.step), block), want[3:60])
    began = time.perf_counter()
    line_scores = scores(train(Lines(np.zeros((2, len(NAMES)), np.int8), np.ones(2), np.array([0, 1, 2])), np.array([0, 1])), line_features(np.full(500_000, 10, np.uint8), np.array([0, 500_000])))
    assert line_scores.shape == (1,) and time.perf_counter() - began < 30


def test_lines_follow_rows():
    texts = ["one two\nONE!!\n", "", "a a a\n\nb"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    got = line_features(data, offsets)
    assert got.first.tolist() == [0, 3, 4, 7]
    assert got.weight.tolist() == [8, 6, 1, 1, 6, 1, 2]
    assert got.bins[1, NAMES.index("upper")] > 0 and got.bins[0, NAMES.index("upper")] == 0
    assert got.bins[4, NAMES.index("repeated")] == 7 and got.bins[6, NAMES.index("repeated")] == 0
    line = line_features(np.frombuffer(b"x y\nx y", np.uint8), np.array([0, 7]))
    assert line.bins[:, NAMES.index("seen")].sum() == 1


@pytest.mark.parametrize("texts", [[""], ["", ""], ["x\n"], ["\n", ""]])
def test_ends_without_words(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got = line_features(data, np.append(0, np.cumsum([len(t) for t in texts])))
    assert len(got.bins) == sum(t.count("\n") + 1 for t in texts) == got.first[-1]


def test_training_separates():
    rng = np.random.default_rng(1)
    first = np.arange(0, 401, 4)
    good = rng.integers(0, 2, 100)
    bins = rng.integers(0, 8, (400, len(NAMES))).astype(np.int8)
    bins[:, 0] = np.repeat(good, 4) * 3
    model = train(Lines(bins, np.ones(400), first), good)
    assert (((forward_backward(model, model.near[0][0, bins[:, 0]], first)[0] > 0.5).reshape(-1, 4).mean(1) > 0.5) == good).all()


@pytest.mark.parametrize("sf", [DATA])
def test_held_out_accuracy(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs, fit(docs, labels)).select("doc_id", "score", held_out("doc_id").alias("held_out"))
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    assert len(rows) > 50
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) > 0.95
    assert np.mean([r.score >= 0.3 for r in rows if r.quality == 1]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here", 3), (None, None, None), (2, "", 4), (2, "", 4)], "doc_id long, text string, score int").selectExpr("*", "5 as i", "6 as label", "7 as id")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (2, 7), (2, 0), (2, 1)], "doc_id long, quality int")
    model = fit(docs, labels)
    got = score_documents(docs, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if not r["text"]}) == 1
    stay = keep_good(docs, model, 0.0)
    assert stay.columns == docs.columns and sorted(stay.collect(), key=str) == sorted(docs.collect(), key=str)
    many = spark.createDataFrame([(1, f"text {k}") for k in range(300)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    assert fit(many, labels).near.any() == fit(docs, labels).near.any()  # one text of an id is learned from
    none = fit(docs, labels.limit(0))
    assert {r["score"] for r in score_documents(docs, none).collect()} == {0.5}
    assert score_documents(docs.limit(0), model).count() == 0
