"""Near-duplicates at an exact similarity: SimHash deletion variants find the candidates, the whole shingle sets decide.

The similarity of two texts is that of their sets of distinct shingles (Jaccard). Sets are signed as in simhash.py, but what a variant
deletes is a piece, not a bit: a fingerprint is cut into segments of three pieces, and each segment is indexed once per piece with that
piece deleted, so sets meet that differ in one piece at most of a segment. At a similarity of 0.8 bits differ with probability 0.15, many
in a segment; for the same bits left in a variant and the same pairs missed, pieces take a quarter of the variants that single bits take.
There are so many segments that all of them miss a pair at the similarity once in MOST_MISSED times. They are the longer, and the more,
the more sets there are, which keeps chance meetings rare. Every link is verified on the sets themselves; nothing below the similarity is
ever linked.

Only sets that can have a partner are signed: partners of 0.8 share that part of their SAMPLE least hashes too, give or take chance,
so a set of which less than half that part stands in any other set's sample has none (a partner is lost so once in ten million times).

Variants of two or three sets give their pairs where they are aggregated. One shared by many texts would make all pairs of them, and a
group of near copies shares very many. So groups come first: by the variants of a few segments texts meet the least one of each crowded
variant, and what is roughly alike makes a group. A variant that lies in one group has nothing to add and ends where it is aggregated; of
another crowded one only the texts outside its least group leave, and are put beside that group once, however many variants they share with it. So rows
grow with the texts, not with the variants that they share. In a group and what was put beside it, links found so far are closed to
components (where very many pairs are left, a few more are tried first), and all pairs of different components are verified: the texts
are cut into blocks, any two blocks meet in one task, and what leaves it are links, not pairs. No link between texts that share a variant is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._tables import kept, partitions
from quarry.llm.components import components
from quarry.llm.simhash import deletion_keys, mixed, plane_bits, segments_needed, shingle_hashes

#: The part of the pairs at the very similarity that no segment brings together.
MOST_MISSED = 1e-4
#: Segments are so long that chance alone puts no more than so many sets into a variant.
MOST_BY_CHANCE = 0.1
#: A segment's pieces, one of which a variant is without.
PIECES = 3
#: The variants of so many segments tell groups, of texts that meet and have this similarity, by their first bits. Groups only save work.
GROUP_SEGMENTS, GROUP_SIMILARITY = 8, 0.5
#: So many least hashes of a set tell whether it can have a partner.
SAMPLE = 32
#: A candidate's first so many bits are compared before its set: pairs at the similarity differ by the limit (eight deviations) practically never.
CHECKED_BITS = 256
#: Two hashes stand for a row's id and text.
KEY = ["k1", "k2"]
#: Up to so many keys of rows to drop or to compare, 16 or 24 bytes each, are broadcast; beyond, the rows are dealt out by key.
MOST_BROADCAST = 2_000_000
#: Beyond so many pairs left to verify, more hubs shrink the work first, in this many rounds at most.
MOST_PAIRS = 50_000_000
MOST_ROUNDS = 4
#: What a block holds on average at most: texts, and hashes of all their sets.
MOST_MEMBERS, MOST_HASHES = 2048, 1 << 20


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """For docs (id, k1, k2, text): id, k1, k2, d0 and d1 (a digest of the shingle set), n (its size) and its least hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, least = [], [], []
            for text in batch.column(3):
                hashes = np.unique(shingle_hashes(text.as_py(), words))
                digests.append(np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64))
                sizes.append(len(hashes))
                least.append(hashes[:SAMPLE].view(np.int64))
            d = np.array(digests, np.int64).reshape(-1, 2)
            columns = [*batch.columns[:3], pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sizes, pa.int64()), pa.array(least, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "k1", "k2", "d0", "d1", "n", "least"])

    docs = docs.select("id", "k1", "k2", "text")
    return docs.mapInArrow(task, f"id {docs.schema['id'].dataType.simpleString()}, k1 long, k2 long, d0 long, d1 long, n long, least array<long>")


def shingle_sets(docs: DataFrame, words: int, block: int = 256) -> DataFrame:
    """For docs (node, text): node and hashes, the distinct shingle hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, block):
                part = batch.slice(k, block)
                sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return docs.select("node", "text").mapInArrow(task, "node long, hashes array<long>")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], most_terms: int = 2048) -> np.ndarray:
    """How many hashes each of the left sets shares with each of the right ones, as a matrix."""
    values = np.concatenate([*left, *right, np.zeros(0, np.int64)])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    first = np.append(True, values[1:] != values[:-1])[: len(values)]
    term = np.cumsum(first) - 1
    on_both = np.bincount(term[row < len(left)], minlength=term[-1] + 1 if len(term) else 0).astype(bool) & np.bincount(term[row >= len(left)], minlength=term[-1] + 1 if len(term) else 0).astype(bool)
    stay = on_both[term]
    row, term = row[stay], (np.cumsum(on_both) - 1)[term[stay]]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(on_both.sum()), most_terms):
        a, b = np.searchsorted(term, [low, low + most_terms])
        table = np.zeros((len(left) + len(right), most_terms), np.float32)
        table[row[a:b], term[a:b] - low] = 1
        out += table[: len(left)] @ table[len(left) :].T
    return out


def block_links(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs of a key at the similarity or more whose components differ, in crowd (key, node, n, component); sets are (node, hashes)."""
    size = F.greatest(F.ceil(F.sum("n") / MOST_HASHES), F.ceil(F.count("*") / MOST_MEMBERS))
    cut = kept(crowd.groupBy("key").agg(size.cast("int").alias("blocks")), "blocks")
    placed = crowd.join(cut, "key").withColumn("block", F.pmod(F.xxhash64("key", "node"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = other.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component").join(sets, "node")

    def task(table: pa.Table) -> pa.Table:
        node, component, block = (table.column(c).to_numpy() for c in ("node", "component", "block"))
        hashes = table.column("hashes").combine_chunks()
        own = [hashes[k].values.to_numpy() for k in range(len(hashes))]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        both = shared_counts([own[k] for k in x], [own[k] for k in y]).astype(float)
        n = np.array([len(h) for h in own], float)
        alike = both / np.maximum(n[x][:, None] + n[y][None, :] - both, 1) >= similarity
        p, q = np.nonzero(alike & (component[x][:, None] != component[y][None, :]) & ((node[x][:, None] < node[y][None, :]) | (i != j)))
        a, b = node[x[p]], node[y[q]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(task, "a long, b long").distinct()


def _joined(docs: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """docs joined by KEY with rows that are broadcast up to a checked number, and dealt out beyond."""
    return docs.join(F.broadcast(few) if few.count() <= MOST_BROADCAST else few.hint("shuffle_hash"), KEY, how)


def with_possible_partner(classes: DataFrame, similarity: float) -> DataFrame:
    """The rows (node, n, k1, k2) of classes that share half the similarity's part of their least hashes with others."""
    rows = classes.select("node", F.explode("least").alias("hash"))
    common = rows.groupBy("hash").agg(F.count("*").alias("sets")).where("sets > 1").select("hash")
    shared = rows.join(common, "hash", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
    return classes.join(shared, "node").where(F.col("shared") >= F.least("n", F.lit(SAMPLE)) * similarity / 2).select("node", "n", *KEY)


def fingerprints_of_sets(sets: DataFrame, bits: int) -> DataFrame:
    """For sets (node, hashes): node, n and f, the fingerprint's bits as longs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(1)[k].values.to_numpy() for k in range(batch.num_rows)]
            words = [np.packbits(plane_bits(h.view(np.uint64), bits), bitorder="little").view(np.int64) for h in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in own], pa.int64()), pa.array(words, pa.list_(pa.int64()))], names=["node", "n", "f"])

    return sets.select("node", "hashes").mapInArrow(task, "node long, n long, f array<long>")


def signing(number: int, similarity: float) -> tuple[int, int]:
    """The bits of a piece and the number of segments by which so many sets are signed."""
    left = max(10, np.log2(max(number, 1) / MOST_BY_CHANCE))
    piece = int(np.ceil(left / (PIECES - 1)))
    return piece, segments_needed(PIECES * piece, similarity, MOST_MISSED, piece)


def variants(prints: DataFrame, piece: int, segments: int, block: int = 64) -> DataFrame:
    """(key, node, group) for prints (node, f, group): a row for each piece of a fingerprint's first segments, that piece deleted."""
    width = PIECES * piece

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, block):
                part = batch.slice(k, block)
                words = np.array(part.column(1).to_pylist(), np.int64).reshape(part.num_rows, -1)
                bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, : width * segments]
                keys = deletion_keys(bits.astype(bool), width, piece)
                own = [pa.array(np.repeat(part.column(c).to_numpy(), keys.shape[1])) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *own], names=["key", "node", "group"])

    dealt = prints.select("node", "f", "group").repartition(partitions(prints.sparkSession), "node")  # a row becomes hundreds
    return dealt.mapInArrow(task, "key long, node long, group long")


def link_sets(classes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Components (node, component) of classes (node, k1, k2, n, least) linked at the similarity or more; docs (k1, k2, text) hold their texts."""

    def fits(x: Column, y: Column) -> Column:
        return F.least(x, y) / F.greatest(x, y) >= similarity  # the similarity is this at most

    wanted = kept(with_possible_partner(classes, similarity), "compared-classes")
    sets = kept(shingle_sets(_joined(docs, wanted.select("node", *KEY), "inner"), words), "shingle-sets")
    number = wanted.count()
    if sets.count() > number:  # rows equal in id and text
        sets = kept(sets.dropDuplicates(["node"]), "shingle-sets")
    piece, segments = signing(number, similarity)
    prints = kept(fingerprints_of_sets(sets, -(-max(PIECES * piece * segments, CHECKED_BITS) // 64) * 64), "fingerprints")
    def bits_apart(alike: float, deviations: int) -> int:
        differ = np.arccos(2 * alike / (1 + alike)) / np.pi
        return int(np.ceil(CHECKED_BITS * differ + deviations * np.sqrt(CHECKED_BITS * differ * (1 - differ))))

    def near(pairs: DataFrame) -> DataFrame:
        checked = [F.col("f")[k].alias(f"f{k}") for k in range(CHECKED_BITS // 64)]  # the other bits stay out of the joins
        x, y = (prints.select(F.col("node").alias(end), "n", *checked) for end in ("a", "b"))
        x, y = x.alias("x"), y.alias("y")
        distance = sum((F.bit_count(F.col(f"x.f{k}").bitwiseXOR(F.col(f"y.f{k}"))) for k in range(CHECKED_BITS // 64)), F.lit(0))
        apart = pairs.join(x, "a").join(y, "b").select("a", "b", fits(F.col("x.n"), F.col("y.n")).alias("fit"), distance.alias("distance"))
        return kept(apart.where(F.col("distance") <= bits_apart(similarity, 8)), "near-pairs")

    def alike(pairs: DataFrame) -> DataFrame:
        x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
        both = F.size(F.array_intersect("x", "y"))
        enough = both / (F.size("x") + F.size("y") - both) >= similarity
        return kept(pairs.where("fit").select("a", "b").join(x, "a").join(y, "b").where(enough).select("a", "b"), "links")

    def pairs(found: DataFrame, x: str, y: str) -> DataFrame:
        return found.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    def crowded(signed: DataFrame, keys: DataFrame) -> DataFrame:
        return signed.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys.hint("shuffle_hash"), "key")

    def closed(crowd: DataFrame, links: DataFrame, tested: DataFrame) -> DataFrame:
        """The links and more, so that all pairs of a key in crowd (key, node) are linked, in one component or verified."""
        crowd = crowd.join(prints.select("node", "n"), "node")
        for turn in range(1, MOST_ROUNDS + 2):
            labels = kept(components(links), "components")
            crowd = mixed(crowd.select("key", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
            sizes = kept(crowd.groupBy("key", "component").agg(F.count("*").alias("members")), "component-sizes")
            major = sizes.groupBy("key").agg(F.max_by("component", F.struct("members", "component")).alias("major"), F.sum("members").alias("all"), F.max("members").alias("most"))
            left = major.agg(F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()[0] or 0
            if not left:
                return links
            if left <= MOST_PAIRS or turn > MOST_ROUNDS:
                return links.unionByName(kept(block_links(crowd, sets, similarity), "links"))
            order = F.xxhash64("node", F.lit(turn))
            hubs = crowd.groupBy("key").agg(*(F.min_by(c, order).alias(c) for c in ("node", "n", "component")))
            x, y = kept(hubs, "more-hubs").alias("x"), crowd.alias("y")
            apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & fits(F.col("x.n"), F.col("y.n"))
            fresh = kept(pairs(x.join(y, apart), "x.node", "y.node").join(tested, ["a", "b"], "left_anti"), "pairs")
            links, tested = links.unionByName(alike(near(fresh))), tested.unionByName(fresh)
        raise AssertionError

    first = variants(prints.withColumn("group", F.col("node")), piece, min(segments, GROUP_SEGMENTS))
    hubs = kept(first.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("hub")).where("size > 3").select("key", "hub"), "group-hubs")
    met = kept(pairs(crowded(first, hubs).where("node != hub"), "node", "hub"), "pairs")
    rough = near(met)
    grouped = kept(components(rough.where(F.col("distance") <= bits_apart(GROUP_SIMILARITY, 0))), "groups")
    links = closed(grouped.select(F.col("component").alias("key"), "node"), alike(rough), met)

    labelled = kept(prints.join(grouped, "node", "left").select("node", "f", F.coalesce("component", "node").alias("group")), "grouped-fingerprints")
    signed = variants(labelled, piece, segments)
    each = [F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor("node").alias("every"), F.min("group").alias("least")]
    groups = signed.groupBy("key").agg(*each, F.max("group").alias("greatest")).where("least != greatest")
    groups = kept(groups.drop("greatest"), "variant-groups")
    others = crowded(signed, kept(groups.where("size > 3").select("key", "least"), "crowded-keys")).where("group != least")
    others = kept(others.select(F.col("least").alias("key"), "node").distinct(), "beside-groups")
    members = labelled.select(F.col("group").alias("key"), "node").join(others.select("key").distinct(), "key", "left_semi")
    third = F.col("lo").bitwiseXOR(F.col("hi")).bitwiseXOR(F.col("every"))
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    few = F.when(F.col("size") == 2, F.array(pair(F.col("lo"), F.col("hi")))).otherwise(F.array(pair(F.col("lo"), F.col("hi")), pair(F.col("lo"), third), pair(third, F.col("hi"))))
    tested = kept(pairs(groups.where("size < 4").select(F.inline(few)).where("x != y"), "x", "y"), "pairs")
    return components(closed(members.unionByName(others), links.unionByName(alike(near(tested))), tested))


def keep_one(docs: DataFrame, words: int, similarity: float, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, as it was: the one with the least id, or, without ids, any one.

    Null and empty texts are a group of their own. Rows equal in id and text are copies: one stays. The other columns may have any names.
    """
    own = [F.col(f"`{c}`") for c in (id_column, text_column)]
    keys = [F.xxhash64(*own).alias("k1"), F.xxhash64(F.lit(1), *own).alias("k2")]
    texts = docs.select(own[0].alias("id"), *keys, own[1].alias("text"))
    prints = kept(signatures(texts, words).withColumn("row", F.monotonically_increasing_id()), "signatures")
    firsts = prints.groupBy("d0", "d1").agg(F.min_by(F.struct("row", *KEY, "n", "least"), "row").alias("f"))
    classes = kept(firsts.select("d0", "d1", F.col("f.row").alias("node"), "f.k1", "f.k2", "f.n", "f.least"), "classes")
    linked = link_sets(classes, texts.select(*KEY, "text"), words, similarity)
    labelled = classes.join(linked, "node", "left").select("d0", "d1", F.coalesce("component", "node").alias("component"))
    rows = kept(prints.select("id", *KEY, "d0", "d1").join(labelled, ["d0", "d1"]).select("id", *KEY, "component"), "labelled-rows")
    stay = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", *KEY)).alias("least")).select("least.k1", "least.k2")
    gone = kept(rows.select(*KEY).distinct().join(stay, KEY, "left_anti"), "duplicates")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("i"), *keys)
    left = _joined(packed, gone, "left_anti")
    if not rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        left = left.dropDuplicates(KEY)
    return left.select(*(F.col(f"i.`{c}`").alias(c) for c in docs.columns))
