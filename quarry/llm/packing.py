"""Sequence packing by non-negative least squares over length combinations.

Documents become token pieces: whole windows, and one tail each. The tails' length histogram (at
most `window` numbers, whatever the corpus) is fitted by repeat counts of shallow length
combinations, one to three lengths that fill the window exactly. The fitted counts are rounded to
what the histogram has; a greedy pass over the remaining lengths, longest first and best fitting
next, packs the rest. The result is a plan of rank intervals by length, so that each piece finds
its sequence from its rank among the pieces of its length, wherever it is.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._tables import kept, partitions


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """Encodes as the byte-level BPE in a tokenizers .json file does, added tokens in a text included.

    The .json's merge order is its ids' order, so its vocabulary read as ranks gives the same ids.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    return lambda text: own.encode(text, allowed_special=allowed, disallowed_special=())


def token_pieces(docs: DataFrame, vocabulary: str, window: int, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Cuts each document's ids, end_id last, into pieces of `window` ids and a tail: id, start, length, ids_crc32, doc_tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    row.append(k)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["i", "start", "length", "ids_crc32", "doc_tokens"])

    narrow = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t"))
    return narrow.mapInArrow(task, f"i {narrow.schema['i'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(window: int) -> np.ndarray:
    """All combinations of one to three lengths, in order, that fill the window; zero stands for no length."""
    a, b = np.meshgrid(np.arange(window + 1), np.arange(window + 1), indexing="ij")
    c = window - a - b
    ok = (a <= b) & (b <= c)
    return np.stack([a[ok], b[ok], c[ok]], 1)


def fit(histogram: np.ndarray, combos: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that make the combinations' lengths come nearest to the histogram (accelerated projected gradient)."""
    n = len(histogram)
    target = histogram.astype(float)
    target[0] = 0
    use = (combos > 0).astype(float)
    flat, width = combos.ravel(), len(combos)

    def lengths(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, (x[:, None] * use).ravel(), n)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[combos] * use).sum(1)

    seen = np.bincount(flat, use.ravel(), n)
    step = 1.0 / max(1.0, 3.0 * seen.max())
    x = y = np.zeros(width)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(lengths(y) - target))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def plan(histogram: dict[int, int], window: int) -> pd.DataFrame:
    """Rank intervals: pieces of `length` with low <= rank < low + n go to sequence `sequence` + rank - low, at `offset`."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    slots: list[tuple[int, int, int, int]] = []  # length, n, sequence, offset
    sequence = 0

    def use(lengths: list[int], n: int) -> None:
        nonlocal sequence
        offset = 0
        for x in lengths:
            slots.append((x, n, sequence, offset))
            left[x] -= n
            offset += x
        sequence += n

    if left[window]:
        use([window], int(left[window]))
    if left.any():
        present = np.flatnonzero(left)
        combos = combinations(window)
        there = np.zeros(window + 1, bool)
        there[present] = there[0] = True
        combos = combos[there[combos].all(1)]
        if len(combos):
            x = fit(left, combos)
            for k in np.argsort(-x, kind="stable"):
                if (n := round(float(x[k]))) < 1:
                    break
                lengths, times = np.unique(combos[k][combos[k] > 0], return_counts=True)
                if (n := min(n, *(int(left[v] // m) for v, m in zip(lengths, times, strict=True)))) > 0:
                    use([int(v) for v in combos[k] if v], n)
    while left.any():  # the residual: longest first, then whatever fits best
        lengths, room, spare = [], window, left.copy()
        while room and (fits := np.flatnonzero(spare[: room + 1])).size:
            best = int(fits[-1])
            lengths.append(best)
            spare[best] -= 1
            room -= best
        values, times = np.unique(lengths, return_counts=True)
        use(lengths, min(int(left[v] // m) for v, m in zip(values, times, strict=True)))
    out = pd.DataFrame(slots, columns=["length", "n", "sequence", "offset"], dtype="int64")
    out["low"] = out.groupby("length")["n"].cumsum() - out["n"]
    return out.sort_values(["length", "low"], ignore_index=True)


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packs every document into sequences of at most `window` ids; one row per piece.

    Columns: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each id of a document,
    end_id included, lies in one piece. A null or empty text is the single end_id; null ids, ties and
    repeated rows are documents of their own; other columns are ignored; an empty table gives no rows.

    What reaches the driver is the histogram (at most `window` rows). Ranks are counted within
    (length, salt), with the number of salts growing with the shuffle's partitions, and shifted by
    the counts of lower salts: no length, however frequent, meets in one task.
    """
    spark = docs.sparkSession
    salts = partitions(spark)
    pieces = kept(token_pieces(docs, vocabulary, window, end_id, id_column, text_column).withColumn("salt", F.pmod(F.xxhash64("i", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(salts)).cast("int")), "pieces")
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    intervals = plan(histogram, window)
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    in_salt = F.row_number().over(Window.partitionBy("length", "salt").orderBy("i", "start", "ids_crc32"))
    ranked = pieces.withColumn("k", in_salt).join(before, ["length", "salt"]).select("i", "start", "length", "ids_crc32", "doc_tokens", (F.col("k") - 1 + F.col("before")).alias("rank"))

    lengths, lows, sequences, offsets = (intervals[c].to_numpy(np.int64) for c in ("length", "low", "sequence", "offset"))
    held = spark.sparkContext.broadcast((lengths, lows, sequences, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, lows, sequences, offsets = held.value
        first = np.searchsorted(lengths, np.arange(window + 2))
        wide = lows.max(initial=0) + 1
        order = lengths.astype(object) if window * int(wide) >= 2**62 else lengths
        keys = order * wide + lows
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length.astype(keys.dtype) * wide) + np.minimum(rank, wide - 1), "right") - 1
            at = np.maximum(at, first[length])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences[at] + rank - lows[at], pa.int64()), pa.array(offsets[at], pa.int64())], names=["i", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = pieces.schema["i"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"i {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.withColumnRenamed("i", id_column)
