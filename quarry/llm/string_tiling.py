"""Benchmark decontamination by greedy string tiling.

The five-word windows of documents and test items are seeds, met by an equality join. Where a document has a seed
of an item that can decide, greedy string tiling runs on the two: the longest common stretch of
unmarked words, found by running Karp-Rabin over window hashes, is marked in both, again and again
down to the shortest tile. The share of the item's words that are marked does not depend on the
tiles' order, so reordered passages are caught like plain ones.

A window that stands in very many items would make pairs of all its documents and items. An item's most frequent windows
are no join keys as long as they cover less of it than a match needs: then a match has another window too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._bytes import span_hashes, text_chunks, window_hashes, word_spans
from quarry.llm._tables import kept

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _free_windows(words: np.ndarray, marked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows without a marked word."""
    if len(words) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.append(0, np.cumsum(marked))
    at = np.flatnonzero(sums[width:] == sums[:-width])
    return at, window_hashes(words, width)[at]


def tile(item: np.ndarray, document: np.ndarray, shortest: int, apart: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (item place, document place, length), longest first; of equal ones, the first in the item, then in the document.

    apart marks words of the document that no tile may hold.
    """
    in_item = np.zeros(len(item), bool)
    in_document = np.zeros(len(document), bool) if apart is None else apart.copy()
    tiles: list[tuple[int, int, int]] = []

    def common(width: int) -> bool:
        return bool(np.isin(_free_windows(item, in_item, width)[1], _free_windows(document, in_document, width)[1]).any())

    longest = min(len(item), len(document))
    while longest >= shortest and common(shortest):
        low, high = shortest, longest
        while low < high:  # a common stretch of some length has common stretches of all lesser ones
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        longest = low
        a, ha = _free_windows(item, in_item, longest)
        b, hb = _free_windows(document, in_document, longest)
        places: dict[int, list[int]] = {}
        for at, h in zip(b[np.isin(hb, ha)].tolist(), hb[np.isin(hb, ha)].tolist(), strict=True):
            places.setdefault(h, []).append(at)
        for at, h in zip(a.tolist(), ha.tolist(), strict=True):
            if in_item[at : at + longest].any():
                continue
            for to in places.get(h, ()):
                if not in_document[to : to + longest].any() and (item[at : at + longest] == document[to : to + longest]).all():
                    in_item[at : at + longest] = in_document[to : to + longest] = True
                    tiles.append((at, to, longest))
                    break
    return tiles


def _words(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text, by its place: the hashes of its lower-cased words and those of its windows."""
    for a, b, data, offsets in text_chunks(texts):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        windows = window_hashes(words, width)
        for k in range(b - a):
            own = words[first[k] : first[k + 1]]
            yield a + k, own, windows[first[k] : max(first[k], first[k + 1] - width + 1)]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate([*values, np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(v) for v in values])), pa.int32()), pa.array(flat, kind))


def item_windows(benchmark: DataFrame, shortest: int, item_column: str, text_column: str) -> DataFrame:
    """(row, id, words, seeds) of the items of at least a tile's length: the hashes of words and of windows, in order."""
    items = benchmark.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{item_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, w.view(np.int64), s.view(np.int64)) for k, w, s in _words(batch.column(2), shortest) if len(s)]
            at = pa.array([k for k, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), _lists([w for _, w, _ in found], pa.int64()), _lists([s for _, _, s in found], pa.int64())], names=["row", "id", "words", "seeds"])

    return items.mapInArrow(task, f"row long, id {items.schema['id'].dataType.simpleString()}, words array<long>, seeds array<long>")


def deciding_seeds(seeds: np.ndarray, items_with: np.ndarray, n_words: int, width: int, coverage: float) -> np.ndarray:
    """The distinct seeds of an item without the most frequent ones, as many as together cover less of its words than coverage."""
    distinct, inverse = np.unique(seeds, return_inverse=True)
    times = np.zeros(len(distinct), np.int64)
    times[inverse] = items_with
    ends = np.cumsum(np.bincount(inverse, minlength=len(distinct)))
    places = np.split(np.argsort(inverse, kind="stable"), ends[:-1]) if len(distinct) else []
    covered, total = np.zeros(n_words + width, bool), 0
    order = np.argsort(-times, kind="stable")
    for place, k in enumerate(order):
        for at in places[k]:
            window = covered[at : at + width]
            total += width - int(window.sum())
            window[:] = True
        if total >= coverage * n_words:
            return distinct[order[place:]]
    return distinct[:0]


def seed_keys(items: DataFrame, shortest: int, coverage: float) -> DataFrame:
    """(seed, row): the seeds by which an item meets documents."""
    rows = items.select("row", F.size("words").alias("n"), F.posexplode("seeds").alias("at", "seed"))
    often = kept(rows.groupBy("seed").agg(F.count_distinct("row").alias("items_with")), "seed-frequencies")
    whole = rows.join(often, "seed").groupBy("row", "n").agg(F.array_sort(F.collect_list(F.struct("at", "seed", "items_with"))).alias("windows"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, seed = [], []
            for r, n, windows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = windows.values
                chosen = deciding_seeds(own.field("seed").to_numpy(), own.field("items_with").to_numpy(), n, shortest, coverage)
                row += [r] * len(chosen)
                seed.append(chosen)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*seed, np.zeros(0, np.int64)]), pa.int64()), pa.array(row, pa.int64())], names=["seed", "row"])

    return whole.mapInArrow(task, "seed long, row long")


def seed_bits(items: DataFrame, most_log2: int = 26) -> np.ndarray:
    """A Bloom filter of all seeds, two bits a seed: 2 ** most_log2 bits (8 MB) at most, however many seeds there are."""
    number = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    log2 = min(most_log2, max(10, int(128 * number).bit_length()))
    bit = F.explode(F.array(F.expr(f"seed & {2**log2 - 1}L"), F.expr(f"shiftrightunsigned(seed, {64 - log2})")))
    words = items.select(F.explode("seeds").alias("seed")).select(bit.alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(2**log2 // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _may_hold(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    log2 = len(bits).bit_length() + 5
    low, high = seeds & np.uint64(2**log2 - 1), seeds >> np.uint64(64 - log2)
    in_low = (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)
    return (in_low & (bits[(high >> np.uint64(6)).astype(np.int64)] >> (high & np.uint64(63)))).astype(bool)


def _keys(text: Column) -> list[Column]:
    """Two hashes stand for a text."""
    return [F.xxhash64(text).alias("_q_k1"), F.xxhash64(F.lit(1), text).alias("_q_k2")]


def hit_texts(docs: DataFrame, bits: np.ndarray, shortest: int, text_column: str) -> DataFrame:
    """(_q_k1, _q_k2, seeds, words, apart) of the texts that may hold seeds: those, and the words around them with a mark at those that keep stretches apart."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    narrow = docs.select(*_keys(F.col(f"`{text_column}`")), F.col(f"`{text_column}`").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, seeds, words, apart = [], [], [], []
            for k, own, windows in _words(batch.column(2), shortest):
                hits = np.flatnonzero(_may_hold(held.value, windows))
                if not len(hits):
                    continue
                inside = np.zeros(len(own), bool)
                for j in range(shortest):
                    inside[hits + j] = True
                near = inside.copy()
                near[1:] |= inside[:-1]  # one more word keeps stretches apart
                at.append(k)
                seeds.append(np.unique(windows[hits]).view(np.int64))
                words.append(own[near].view(np.int64))
                apart.append(~inside[near])
            which = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), _lists(seeds, pa.int64()), _lists(words, pa.int64()), _lists([x.astype(np.int8) for x in apart], pa.int8())], names=["_q_k1", "_q_k2", "seeds", "words", "apart"])

    hits = narrow.mapInArrow(task, "_q_k1 long, _q_k2 long, seeds array<long>, words array<long>, apart array<tinyint>")
    return hits.groupBy("_q_k1", "_q_k2").agg(*(F.first(c).alias(c) for c in ("seeds", "words", "apart")))  # texts that are copies are one


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, shortest: int, coverage: float, text_column: str, item_column: str, item_text_column: str) -> DataFrame:
    """(_q_k1, _q_k2, _q_n, _q_best) of the texts that cover an item: how many, and the best one as struct(less, item)."""
    items = kept(item_windows(benchmark, shortest, item_column, item_text_column), "benchmark-items")
    keys = kept(seed_keys(items, shortest, coverage), "benchmark-seeds")
    hits = kept(hit_texts(docs, seed_bits(items), shortest, text_column), "seed-hits")
    met = kept(hits.select("_q_k1", "_q_k2", F.explode("seeds").alias("seed")).join(keys, "seed").select("_q_k1", "_q_k2", "row").distinct(), "texts-and-items")
    pairs = met.join(hits.select("_q_k1", "_q_k2", "words", "apart"), ["_q_k1", "_q_k2"]).join(items.select("row", "id", F.col("words").alias("item_words")), "row")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = []
            for words, apart, item in zip(batch.column(3), batch.column(4), batch.column(5), strict=True):
                own = item.values.to_numpy().view(np.uint64)
                tiles = tile(own, words.values.to_numpy().view(np.uint64), shortest, apart.values.to_numpy(zero_copy_only=False).astype(bool))
                share.append(sum(n for _, _, n in tiles) / len(own))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(share, pa.float64())], names=["_q_k1", "_q_k2", "id", "share"])

    narrow = pairs.select("_q_k1", "_q_k2", "id", "words", "apart", "item_words")
    tiled = narrow.mapInArrow(task, f"_q_k1 long, _q_k2 long, id {items.schema['id'].dataType.simpleString()}, share double").where(F.col("share") >= coverage)
    best = F.min(F.struct((-F.col("share")).alias("less"), F.col("id").isNull().alias("unnamed"), F.col("id").alias("item")))
    return tiled.groupBy("_q_k1", "_q_k2").agg(F.count("*").alias("_q_n"), best.alias("_q_best"))


def contamination(docs: DataFrame, benchmark: DataFrame, shortest: int = 5, coverage: float = 0.5, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The documents, with contaminated (boolean), n_items, the item's id column (the best covered item, the least of equal ones) and coverage, in place of columns so named.

    Words are cut at space and 0x09-0x0D; A-Z compare as lower case. Items shorter than a tile, null and empty ones, and null or empty
    documents match nothing: false, 0, null, 0.0. Repeated rows each get a row, and so does each repeated item in n_items; an item without an id counts, and
    is the best one only where none with an id is as good. What is broadcast is the seeds' filter, 8 MB at most whatever the benchmark's size.
    """
    found = kept(contaminated_texts(docs, benchmark, shortest, coverage, text_column, item_column, item_text_column), "contaminated-texts")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("i"), *_keys(F.col(f"`{text_column}`")))
    joined = packed.join(found, ["_q_k1", "_q_k2"], "left")
    added = {"contaminated": F.col("_q_n").isNotNull(), "n_items": F.coalesce("_q_n", F.lit(0).cast("long")), item_column: F.col("_q_best.item"), "coverage": F.coalesce(-F.col("_q_best.less"), F.lit(0.0))}
    return joined.select(*(F.col(f"i.`{c}`").alias(c) for c in docs.columns if c not in added), *(c.alias(n) for n, c in added.items()))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = 5, coverage: float = 0.5, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The documents, with all their columns as they were, that contamination finds clean."""
    found = kept(contaminated_texts(docs, benchmark, shortest, coverage, text_column, item_column, item_text_column).select("_q_k1", "_q_k2"), "contaminated-texts")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("i"), *_keys(F.col(f"`{text_column}`")))
    return packed.join(found, ["_q_k1", "_q_k2"], "left_anti").select(*(F.col(f"i.`{c}`").alias(c) for c in docs.columns))
