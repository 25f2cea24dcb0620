"""The pipeline's near-duplicate stage against brute force over five-word shingle sets, from a similarity of 0.8 up."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm.near_copies import shared_counts
from quarry.llm.simhash import deletion_keys, plane_bits, segments_needed

SF = "/root/testdata/sf0.01"


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))


def brute(texts: dict[int, str | None], least: float = 0.8) -> tuple[set, dict[tuple, float]]:
    """The ids that stay (the least of each component), and the pairs of a similarity of 0.5 or more."""
    sets = {d: shingles(t) for d, t in texts.items()}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    like = {}
    for d, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for e in holders[x]:
                if e > d:
                    shared[e] += 1
        like |= {(d, e): j for e, n in shared.items() if (j := n / (len(s) + len(sets[e]) - n)) >= 0.5}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (d, e), j in like.items():
        if j >= least:
            a, b = sorted((find(d), find(e)))
            root[b] = a
    return {find(d) for d in texts}, like


def stage(spark, texts: dict[int, str | None]) -> set:
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()}


def edited(seed: int, words: int, edits: range, groups: int, members: int) -> dict[int, str]:
    """Groups of a text and its edited copies, of similarities on both sides of 0.8."""
    rng = random.Random(seed)
    out = {}
    for _ in range(groups):
        base = [f"w{rng.randint(0, 99999)}" for _ in range(words)]
        out[len(out)] = " ".join(base)
        for _ in range(members - 1):
            copy = list(base)
            for _ in range(rng.choice(edits)):
                copy[rng.randrange(words)] = f"x{rng.randint(0, 99999)}"
            out[len(out)] = " ".join(copy)
    return out


def test_nothing_under_the_similarity_goes(spark):
    texts = edited(5, 300, range(4, 16), 150, 2)
    texts |= {1000: "same " * 200 + "a b c d e f", 1001: "same " * 200 + "g h i j k l", 1002: "same " * 90}  # alike to a majority of shingles, not by their sets
    want, like = brute(texts)
    assert sum(0.65 <= j < 0.8 for j in like.values()) > 30
    got = stage(spark, texts)
    assert not want - got


def test_all_at_the_similarity_go(spark):
    texts = edited(6, 300, range(1, 10), 250, 2)
    want, like = brute(texts)
    assert sum(0.8 <= j < 0.85 for j in like.values()) > 30
    got = stage(spark, texts)
    assert not got - want


@pytest.mark.parametrize(("pairs", "members"), [(50_000_000, 2048), (50_000_000, 7), (0, 2048)])
def test_large_group(spark, monkeypatch, pairs, members):
    monkeypatch.setattr("quarry.llm.near_copies.MOST_PAIRS", pairs)  # with more hubs, and without
    monkeypatch.setattr("quarry.llm.near_copies.MOST_MEMBERS", members)  # in one block, and in several
    monkeypatch.setattr("quarry.llm.near_copies.MOST_ROUNDS", 2)
    texts = edited(7, 200, range(1, 7), 3, 60)
    want, _ = brute(texts)
    assert 3 < len(want) < 150
    assert stage(spark, texts) == want


@pytest.mark.parametrize(("left", "right", "shared"), [(5, 4, 4), (9, 9, 8), (20, 16, 16), (360, 360, 320)])
def test_fingerprints_meet(left, right, shared):
    """Sets at a similarity of 0.8, large and small, have a variant in common where a segment differs by one bit at most, and only there."""
    rng = np.random.default_rng(left)
    width, segments = 18, segments_needed(18, 0.8, 1e-4)
    missed = 0
    for _ in range(200):
        hashes = rng.integers(0, 2**64, left + right - shared, dtype=np.uint64)
        x, y = (plane_bits(h, width * segments) for h in (hashes[:left], hashes[-right:]))
        kx, ky = deletion_keys(np.array([x, y]), width)
        near = ((x != y).reshape(segments, width).sum(1) <= 1).any()
        assert (len(np.intersect1d(kx, ky)) > 0) == near
        missed += not near
    assert not missed


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(30)]
    got = shared_counts(sets[:12], sets[12:], most_terms=7)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[12:]] for x in sets[:12]]
    assert shared_counts([], sets).shape == (0, 30) and shared_counts([sets[0][:0]], [sets[1]]).tolist() == [[0]]


def test_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want, _ = brute(texts)
    assert stage(spark, texts) == want


@pytest.mark.parametrize(("left", "right", "shared"), [(5, 4, 4), (20, 16, 16), (360, 360, 320)])
def test_pieces_meet(left, right, shared):
    """Sets at a similarity of 0.8 have a variant in common where a segment differs in one piece at most, and only there, with a third of the variants of single bits."""
    from quarry.llm.near_copies import PIECES, signing

    rng = np.random.default_rng(right)
    piece, segments = signing(7494, 0.8)
    width = PIECES * piece
    assert 3 * PIECES * segments < 18 * segments_needed(18, 0.8, 1e-4)
    for _ in range(200):
        hashes = rng.integers(0, 2**64, left + right - shared, dtype=np.uint64)
        x, y = (plane_bits(h, width * segments) for h in (hashes[:left], hashes[-right:]))
        kx, ky = deletion_keys(np.array([x, y]), width, piece)
        assert len(kx) == PIECES * segments
        near = ((x != y).reshape(segments, PIECES, piece).any(2).sum(1) <= 1).any()
        assert (len(np.intersect1d(kx, ky)) > 0) == near
        assert near


@pytest.mark.parametrize(("similarity", "segments"), [(0.95, 1), (0.35, 8)])
def test_groups_only_save_work(spark, monkeypatch, similarity, segments):
    monkeypatch.setattr("quarry.llm.near_copies.GROUP_SIMILARITY", similarity)  # nearly no groups, and wide ones
    monkeypatch.setattr("quarry.llm.near_copies.GROUP_SEGMENTS", segments)
    texts = edited(8, 200, range(1, 7), 3, 40)
    want, _ = brute(texts)
    assert 3 < len(want) < 100
    assert stage(spark, texts) == want


def test_rows_grow_with_texts(spark, monkeypatch):
    """A large group of near copies shares very many variants, but no table has a row for each of them."""
    from quarry.llm import near_copies

    most, write = {}, near_copies.kept

    def counted(df, label):
        out = write(df, label)
        most[label] = max(most.get(label, 0), out.count())
        return out

    monkeypatch.setattr("quarry.llm.near_copies.kept", counted)
    monkeypatch.setattr("quarry.llm.simhash.kept", counted)
    texts = edited(9, 200, range(1, 7), 1, 200)
    want, _ = brute(texts)
    assert stage(spark, texts) == want
    assert max(most.values()) < 20 * len(texts), most
