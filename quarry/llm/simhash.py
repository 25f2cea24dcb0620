"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints within k bits, cut into more than k / 2 segments, have a segment in which they differ
by one bit at most. So each segment is indexed once per bit with that bit deleted (a wildcard), and
an equality join on the variants finds every such pair; the full distance then verifies it. Many
fingerprints need longer signatures: several of more, shorter segments together, chosen so that they
too differ by one bit at most.

The equality join is an aggregation: the two or three members of a variant come out of its least, its
greatest and the exclusive or of all, and are verified where they were added up. A variant with more
members would make all pairs of them. Variants of the very same members (a segment's, where all agree in
it) have the same pairs, so one of them stands for all. Its members are first verified against one of them and the links closed
to components; what is still in several components is indexed again by longer signatures, and in the end
what lies outside a variant's largest component is compared with the rest. No link is lost on any way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._bytes import mix
from quarry.llm._tables import kept, partitions
from quarry.llm.components import components

BITS = 64
#: Ways to sign a fingerprint, from few and short variants to many and long ones: segments cut, segments taken together.
PLANS = ((3, 1), (5, 2), (6, 3), (7, 4))
#: The first way is the one by which chance alone puts no more than so many fingerprints into a variant.
MOST_BY_CHANCE = 0.5
#: Up to so many comparisons are made at once in the end; beyond, more hubs shrink the work first, in this many rounds at most.
MOST_COMPARISONS = 20_000_000
MOST_ROUNDS = 4
#: Up to so many keys of crowded variants, 8 bytes each, are broadcast; beyond, the variants are dealt out by key.
MOST_BROADCAST = 2_000_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` lower-cased words joined by one space; fewer words are one shingle, none give none."""
    import xxhash

    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only 0x20 and 0x09-0x0D split
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-1].tolist()]
    ends = (ends[words - 1 :] - 1).tolist() or [len(joined)]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, ends, strict=False)], np.uint64)


def majority(hashes: np.ndarray, block: int = 1 << 15) -> int:
    """The bits set in over half the hashes, as an unsigned integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), block):
        part = hashes[k : k + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """For docs (id, text): id and f, the fingerprint's bits as a signed long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(text.as_py(), words)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["id", "f"])

    docs = docs.select("id", "text")
    return docs.mapInArrow(task, f"id {docs.schema['id'].dataType.simpleString()}, f long")


def suits(plan: tuple[int, int], most_bits: int) -> bool:
    """Whether, wherever most_bits differing bits fall, some choice of the plan's segments has one of them at most."""
    cut, taken = plan
    return taken * (most_bits // cut) + max(0, taken - (cut - most_bits % cut)) <= 1


def masks(plan: tuple[int, int]) -> list[int]:
    """The bits of each choice of segments, as unsigned integers."""
    cut, taken = plan
    edges = [BITS * k // cut for k in range(cut + 1)]
    segments = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(segments, taken)]


def first_plan(number: int, most_bits: int) -> int:
    """The place in PLANS of the way by which so many different fingerprints are to be signed first."""
    fitting = [k for k, plan in enumerate(PLANS) if suits(plan, most_bits)]
    if not fitting:
        raise ValueError(f"no plan finds every pair within {most_bits} bits")
    return next((k for k in fitting if number / 2 ** (BITS * PLANS[k][1] // PLANS[k][0] - 1) <= MOST_BY_CHANCE), fitting[-1])


def variants(prints: DataFrame, plan: tuple[int, int]) -> DataFrame:
    """(key, f): a row for each choice of segments and each of its bits, the key being the choice, the bit and the other bits' values."""
    without = [mask & ~(1 << bit) for mask in masks(plan) for bit in range(BITS) if mask >> bit & 1]
    signed = (m - (1 << BITS) if m >> (BITS - 1) else m for m in without)
    literals = ", ".join(f"{m}L" if m > -(1 << (BITS - 1)) else f"{m + 1}L - 1L" for m in signed)
    dealt = prints.select("f").repartition(partitions(prints.sparkSession), "f")  # a row becomes dozens
    return dealt.select("f", F.posexplode(F.expr(f"array({literals})")).alias("which", "mask")).select(F.xxhash64("which", F.col("f").bitwiseAND(F.col("mask"))).alias("key"), "f")


def _close(x: Column, y: Column, most_bits: int) -> Column:
    return (F.bit_count(x.bitwiseXOR(y)) <= most_bits) & (x != y)


def _near_pairs(most_bits: int) -> Column:
    """The close pairs of a variant of two or three members, from its lo, hi and every (the exclusive or)."""
    lo, hi = F.col("lo"), F.col("hi")
    third = lo.bitwiseXOR(hi).bitwiseXOR(F.col("every"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    pairs = F.when(F.col("size") == 2, F.array(pair(lo, hi))).when(F.col("size") == 3, F.array(pair(lo, hi), pair(lo, third), pair(hi, third)))
    return F.filter(pairs, lambda p: _close(p["a"], p["b"], most_bits))


def plane_bits(hashes: np.ndarray, bits: int, block: int = 512) -> np.ndarray:
    """A fingerprint of any length, as bools: the signs of the hashes' sums, each hash having a byte's value for each bit.

    Bytes instead of a majority of bits: small sets have no ties, and bits of two sets differ as their angle says.
    """
    columns = mix(np.arange(1, -(-bits // 8) + 1, dtype=np.uint64))
    sums = np.zeros(8 * len(columns), np.int64)
    for k in range(0, len(hashes), block):
        part = mix(hashes[k : k + block, None] ^ columns).view(np.int8)
        sums += 2 * part.sum(axis=0, dtype=np.int32) + len(part)
    return sums[:bits] > 0


def segments_needed(width: int, similarity: float, most_missed: float, piece: int = 1) -> int:
    """So many segments, of pieces of so many bits, that all of them miss sets of this similarity no more often: a bit differs with their angle's share of a half turn."""
    differ = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    same, pieces = (1 - differ) ** piece, width // piece
    found = same**pieces + pieces * (1 - same) * same ** (pieces - 1)
    return int(np.ceil(np.log(most_missed) / np.log1p(-found)))


def deletion_keys(prints: np.ndarray, width: int, piece: int = 1) -> np.ndarray:
    """For fingerprints (a row of bools each): a signed key for each piece of so many bits, of the other bits of its segment of this width."""
    values = prints.reshape(len(prints), -1, width) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))
    left = values[:, :, None] & ~(np.uint64((1 << piece) - 1) << np.arange(0, width, piece, dtype=np.uint64))
    return mix(left.reshape(len(prints), -1) + mix(np.arange(1, prints.shape[1] // piece + 1, dtype=np.uint64))).view(np.int64)


def mixed(rows: DataFrame) -> DataFrame:
    """The rows (key, component, ...) of keys that hold more than one component."""
    keys = kept(rows.groupBy("key").agg((F.min("component") != F.max("component")).alias("several")).where("several").select("key"), "mixed-keys")
    return kept(rows.join(keys, "key", "left_semi"), "mixed-rows")


def distinct_groups(rows: DataFrame) -> DataFrame:
    """The rows (key, f) of one key of each set of members, with its hubs: two members that are others for each key."""
    turned = F.col("f").bitwiseXOR(F.col("key"))
    hubs = F.array(F.min(turned).bitwiseXOR(F.col("key")), F.max(turned).bitwiseXOR(F.col("key"))).alias("hubs")
    members = [F.count("*").alias("members"), F.bit_xor(F.xxhash64("f")).alias("d0"), F.bit_xor(F.xxhash64(F.lit(1), "f")).alias("d1")]
    groups = rows.groupBy("key").agg(hubs, *members).groupBy("members", "d0", "d1").agg(F.min(F.struct("key", "hubs")).alias("one"))
    return kept(rows.join(kept(groups.select("one.key", "one.hubs"), "hubs"), "key"), "distinct-groups")


def _star_links(rows: DataFrame, hubs: Column, most_bits: int) -> DataFrame:
    """(a, b) of rows (f, ...) and those of their hubs that are close."""
    near = F.filter(hubs, lambda h: _close(h, F.col("f"), most_bits))
    return rows.select("f", F.explode(near).alias("hub")).select(F.least("f", "hub").alias("a"), F.greatest("f", "hub").alias("b"))


def _remaining_links(crowd: DataFrame, major: DataFrame, most_bits: int, per_block: int = 5_000_000) -> DataFrame:
    """(a, b) of the close pairs of two components in crowd (key, f, component): all outside a key's largest component against all of the key.

    A key with many comparisons to make is cut into blocks, which go to different tasks.
    """
    blocks = F.ceil((F.col("all") - F.col("most")) * F.col("all") / per_block)
    cut = kept(major.select("key", "major", blocks.cast("int").alias("blocks")), "blocks")
    both = kept(crowd.join(cut, "key"), "crowd-in-blocks")
    x = both.where("component != major").withColumn("block", F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")).alias("x")
    y = both.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.component") != F.col("y.component"))
    met = x.join(y, apart & _close(F.col("x.f"), F.col("y.f"), most_bits))
    return met.select(F.least("x.f", "y.f").alias("a"), F.greatest("x.f", "y.f").alias("b"))


def _with_components(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components (node, component) of the links, and the rows (key, f) of keys that hold several of them, with component."""
    labels = kept(components(links), "components")
    own = rows.select("key", "f").join(labels.select(F.col("node").alias("f"), "component"), "f", "left")
    return labels, mixed(own.withColumn("component", F.coalesce("component", "f")))


def _shares(crowd: DataFrame) -> tuple[DataFrame, int]:
    """For each key of crowd its largest component, that one's size and the size of all; and the comparisons they leave."""
    sizes = crowd.groupBy("key", "component").agg(F.count("*").alias("n"))
    major = kept(sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("all")), "largest-components")
    left = major.agg(F.sum((F.col("all") - F.col("most")) * F.col("all").cast("decimal(38,0)"))).first()[0]
    return major, int(left or 0)


def link(prints: DataFrame, most_bits: int) -> DataFrame:
    """Components (node, component) of the distinct fingerprints f that have a partner within most_bits; the others have no row."""
    place = first_plan(prints.count(), most_bits)
    links = None
    while True:
        signed = variants(prints, PLANS[place])
        # least, greatest and exclusive or are one value in a row that met no other yet: the shuffle's compression takes two of them away
        groups = signed.groupBy("key").agg(F.count("*").alias("size"), F.min("f").alias("lo"), F.max("f").alias("hi"), F.bit_xor("f").alias("every")).where("size > 1")
        groups = kept(groups.withColumn("near", _near_pairs(most_bits)).where("size > 3 OR size(near) > 0"), "variant-groups")
        keys = kept(groups.where("size > 3").select("key"), "crowded-keys")
        rows = kept(signed.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys.hint("shuffle_hash"), "key", "left_semi"), "crowded-variants")
        rows = distinct_groups(rows)
        stars = _star_links(rows, F.col("hubs"), most_bits)
        found = groups.select(F.inline("near")).unionByName(stars).distinct()
        links = kept(found if links is None else links.unionByName(found).distinct(), "links")
        labels, crowd = _with_components(rows, links)
        major, left = _shares(crowd)
        last = place + 1 == len(PLANS)
        for turn in range(1, MOST_ROUNDS + 1):
            if not last or left <= MOST_COMPARISONS:
                break
            turned = F.col("f").bitwiseXOR(F.xxhash64("key", F.lit(turn)))
            hubs = kept(crowd.groupBy("key").agg(F.min_by("f", turned).alias("hub")), "more-hubs")
            links = kept(links.unionByName(_star_links(crowd.join(hubs, "key"), F.array("hub"), most_bits)).distinct(), "links")
            labels, crowd = _with_components(crowd, links)
            major, left = _shares(crowd)
        if not left:
            return labels
        if last or left <= MOST_COMPARISONS:
            more = kept(_remaining_links(crowd, major, most_bits).distinct(), "last-links")
            return labels if more.isEmpty() else components(links.unionByName(more))
        # both ends of a link not found yet stand in crowd: those fingerprints are signed again, at more length
        prints, place = kept(crowd.select("f").distinct(), "prints-to-sign-again"), place + 1


def near_duplicates(docs: DataFrame, words: int, most_bits: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, f (the fingerprint as a signed long) and component_id, the least id among the documents reachable over links.

    Texts without words have fingerprint zero and link like any other; a null id takes part but is never a component's id (null if
    the whole component has none); repeated rows each get a row; other columns are ignored; an empty table gives no rows. Texts of one
    fingerprint meet in one class before anything is paired. How many fingerprints there are decides only how they are signed.
    """
    named = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    prints = kept(fingerprints(named, words), "fingerprints")
    classes = kept(prints.groupBy("f").agg(F.min("id").alias("least")), "classes")
    linked = kept(link(classes, most_bits), "linked-classes")
    grouped = classes.join(linked.select(F.col("node").alias("f"), "component"), "f")
    grouped = kept(grouped, "grouped-classes")
    least = kept(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "least-ids")
    named_classes = kept(grouped.join(least, "component").select("f", "component_id", F.lit(True).alias("grouped")), "named-classes")
    labelled = classes.join(named_classes, "f", "left").select("f", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    rows = prints.join(kept(labelled, "labelled-classes"), "f")
    return rows.select(F.col("id").alias(id_column), "f", "component_id")
