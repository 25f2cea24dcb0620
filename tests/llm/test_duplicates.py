"""SimHash, components and recompression against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.components import components
from quarry.llm.recompression import remove_repeats
from quarry.llm.simhash import PLANS, link, masks, near_duplicates, suits

WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(seed: int, n: int) -> list[str | None]:
    """Texts with copies, near copies, shared passages, long runs and odd spaces."""
    rng = random.Random(seed)
    some = lambda k: [rng.choice("abcdefgh") + rng.choice(["", "é", "x", "Zz"]) + str(rng.randint(0, 60)) for _ in range(k)]
    passages = [some(rng.randint(5, 30)) for _ in range(6)]
    out: list[str | None] = [None, "", " \n\t", "one", "same same", "run " * 90, "run " * 41, "ab cd " * 50]
    while len(out) < n:
        words = some(rng.randint(0, 70))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(words))
            words[k:k] = rng.choice(passages)
        out.append(rng.choice([" ", "  ", "\n", "\x0b"]).join(words))
        if rng.random() < 0.3:
            out.append(out[-1])
        if rng.random() < 0.4 and words:
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    return out


def brute_repeats(texts: list[str | None], width: int) -> list[tuple[int, int, str]]:
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("width", "rounds"), [(4, 1), (8, 3), (12, 4), (35, 6)])
def test_repeats(spark, width, rounds):
    texts = corpus(width, 120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).selectExpr("*", "1 as key", "'x' as places", "2 as n")
    got = remove_repeats(docs, width, rounds).withColumn("kept_text", F.sha2("kept_text", 256)).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == brute_repeats(texts, width)


def test_repeats_with_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(9))
    rows = [(1, text), (1, text), (None, text), (2, "w1 w2 w3 w4 other")]
    got = sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 4, 2).collect()), key=str)
    assert got == sorted([(1, 9, 9, ""), (1, 9, 9, ""), (None, 9, 9, ""), (2, 5, 4, "other")], key=str)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_whose_first_keys_are_equal(spark):
    rng = random.Random(8)
    rows = [(k % 37, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for k in range(60)] + [(None, None), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, remove_repeats(docs, 4, 2).collect()), key=str)
    one, text = F.lit(7).cast("long"), F.xxhash64("id", "text")
    for keys in ((one, text), (F.xxhash64("id"), text), (one, one, text), (F.abs(text) % 5, F.abs(text) % 3, text)):
        assert sorted(map(tuple, remove_repeats(docs, 4, 2, keys=keys).collect()), key=str) == want


def brute_fingerprint(text: str | None, words: int) -> int:
    parts = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(parts[k : k + words]) for k in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[int], bits: int) -> list[int]:
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(x) for x in range(len(prints))]


@pytest.mark.parametrize(("by_chance", "comparisons"), [(0.5, 20_000_000), (1e-6, 0)])
def test_near_duplicates(spark, monkeypatch, by_chance, comparisons):
    monkeypatch.setattr("quarry.llm.simhash.MOST_COMPARISONS", comparisons)  # with longer signatures and more hubs, and without
    monkeypatch.setattr("quarry.llm.simhash.MOST_BY_CHANCE", by_chance)  # signed first as few and as many fingerprints are
    texts = corpus(3, 250)
    base = " ".join(f"word{k}" for k in range(400)).split()
    for k in range(60):  # a group of near copies, linked in chains
        base[(7 * k) % 400] = f"new{k}"
        texts.append(" ".join(base).upper() if k % 2 else " ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).selectExpr("*", "1 as id", "'x' as f", "2 as node", "3 as component_id")
    prints = [brute_fingerprint(t, 4) for t in texts]
    got = sorted(map(tuple, near_duplicates(docs, words=4, most_bits=4).collect()))
    assert [g[1] % 2**64 for g in got] == prints
    assert [g[2] for g in got] == brute_components(prints, 4)


def linked(spark, prints: list[int]) -> list[int]:
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    found = {r["node"]: r["component"] for r in link(spark.createDataFrame([(p,) for p in signed], "f long"), 4).collect()}
    groups: dict[int, int] = {}
    return [groups.setdefault(found.get(p, p), k) for k, p in enumerate(signed)]


@pytest.mark.parametrize(("by_chance", "comparisons", "broadcast"), [(0.5, 20_000_000, 2_000_000), (1e-12, 0, 0)])
def test_links_of_fingerprints(spark, monkeypatch, by_chance, comparisons, broadcast):
    """Random fingerprints, edits of up to six bits, and a crowd that agrees in half its bits; members that come and go change no other link."""
    monkeypatch.setattr("quarry.llm.simhash.MOST_COMPARISONS", comparisons)
    monkeypatch.setattr("quarry.llm.simhash.MOST_BROADCAST", broadcast)  # both sides of the switch
    monkeypatch.setattr("quarry.llm.simhash.MOST_BY_CHANCE", by_chance)
    monkeypatch.setattr("quarry.llm.simhash.MOST_ROUNDS", 1)
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(150)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for p in prints]
    prints += [0xABCDEF01 << 32 | rng.getrandbits(32) for _ in range(150)]
    prints += [prints[-1] ^ sum(1 << b for b in rng.sample(range(22, 40), 2)) for _ in range(20)]
    prints = list(dict.fromkeys(prints))
    assert linked(spark, prints) == brute_components(prints, 4)
    two = [5, 5 ^ 0b11 ^ 1 << 40 ^ 1 << 63]
    assert linked(spark, two) == [0, 0]
    assert linked(spark, [*two, 5 ^ 0xFFFF << 21, 5 ^ 0xFFF0 << 30])[:2] == [0, 0]


def test_variants_of_the_same_members_are_joined_once(spark, monkeypatch):
    """Sixty fingerprints that agree in one segment share all its 22 variants."""
    joined = []
    stars = simhash._star_links
    monkeypatch.setattr(simhash, "_star_links", lambda rows, *more: joined.append(rows.count()) or stars(rows, *more))
    rng = random.Random(4)
    prints = [0x2AAAAA << 42 | rng.getrandbits(42) for _ in range(50)]
    prints += [p ^ 0b1111 << 8 * k for k, p in enumerate(prints[:5])] + [p ^ 1 << 41 for p in prints[:5]]
    assert linked(spark, prints) == brute_components(prints, 4)
    assert joined == [60]


@pytest.mark.parametrize("bits", [2, 3, 4])
def test_plans(bits):
    rng = random.Random(bits)
    for plan in PLANS:
        assert suits(plan, bits)
        assert len(set(masks(plan))) == len(masks(plan))
        for _ in range(2000):
            differing = sum(1 << b for b in rng.sample(range(64), bits))
            assert any((differing & m).bit_count() <= 1 for m in masks(plan))
    assert not suits((3, 1), 6) and not suits((2, 1), 4)


def test_near_duplicates_with_odd_rows(spark):
    docs = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "a b"), (7, None), (8, ""), (None, "alone here")], "doc_id long, text string")
    got = sorted([(r["doc_id"], r["component_id"]) for r in near_duplicates(docs, 4, 4).collect()], key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (7, 7), (8, 7), (None, None)], key=str)
    assert near_duplicates(docs.limit(0), 4, 4).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(4000, 4100)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want: dict[int, int] = {}
    for n in sorted(near):
        stack = [n]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = n
                stack += near[x]
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
