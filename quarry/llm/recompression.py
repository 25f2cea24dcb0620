"""Removal of long repeated passages by recompression.

Recompression rewrites each text round by round: first maximal runs of one word, then pairs of
neighbouring symbols, get names made from what they stand for. Which symbols pair is decided by a
global split of all names into left and right ones, so equal passages get equal symbols except near
their ends, in whatever texts they stand. Names are 64-bit hashes, global without a lookup.

Spark then counts every symbol of the last round over the corpus. A window of `width` words that
holds, with all it was decided by, a symbol that occurs once cannot occur twice; it is kept. The
windows left over, those made of shared symbols, are verified: their 96-bit hashes are counted, and
those that occur once are kept as well. A symbol for the whole text stands above the others: of texts
that are alike as a whole, all words go, and one of them alone is verified against the other texts.

Both counts are map-side combined and carry one place each, so a passage that very many documents
share never meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._bytes import U64, mix, span_hashes, text_chunks, window_hashes, word_spans
from quarry.llm._tables import kept

_LEFT, _RIGHT = U64(0x9DDFEA08EB382D69), U64(0xC2B2AE3D27D4EB4F)


@dataclass
class Symbols:
    """Symbols of some texts, in order: names, the words they stand for, and the words that decided them."""

    name: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray


def runs(words: np.ndarray, text: np.ndarray) -> Symbols:
    """Names maximal runs. A run, of one word too, is decided by itself and the word on either side."""
    n = len(words)
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    size = (end - start).astype(np.uint64)
    name = words[start]
    name = np.where(size > 1, mix(name * _LEFT + size), name)
    return Symbols(name, text[start], start, end, start - 1, end + 1)


def pairs(s: Symbols, seed: int) -> Symbols:
    """Names each pair of a left and a right symbol. A symbol that finds no partner is decided by the neighbour that was none, too."""
    n = len(s.name)
    if n < 2:
        return s
    right = (mix(s.name + U64(seed)) & U64(1)).astype(bool)
    same = s.text[1:] == s.text[:-1]
    first = np.zeros(n, bool)
    first[:-1] = ~right[:-1] & right[1:] & same
    second = np.zeros(n, bool)
    second[1:] = first[:-1]
    after = np.append(same, False)
    before = np.append(False, same)
    low, high = s.low.copy(), s.high.copy()
    alone_left = ~right & ~first
    alone_right = right & ~second
    high[alone_left] = np.where(after, np.append(s.high[1:], 0), s.end + 1)[alone_left]
    low[alone_right] = np.where(before, np.append(0, s.low[:-1]), s.start - 1)[alone_right]
    high = np.maximum(high, s.high)
    low = np.minimum(low, s.low)
    at = np.flatnonzero(first)
    name, end = s.name.copy(), s.end.copy()
    name[at] = mix(s.name[at] * _LEFT + mix(s.name[at + 1]) * _RIGHT)
    end[at] = s.end[at + 1]
    high[at] = np.maximum(s.high[at], s.high[at + 1])
    low[at] = np.minimum(s.low[at], s.low[at + 1])
    stay = ~second
    return Symbols(name[stay], s.text[stay], s.start[stay], end[stay], low[stay], high[stay])


def recompress(words: np.ndarray, text: np.ndarray, rounds: int) -> Symbols:
    s = runs(words, text)
    for k in range(rounds):
        s = pairs(s, 0x51ED27 * (k + 1))
    return s


@dataclass
class Words:
    """The words of a range of rows: hashes, the row of each, and each row's first word (one more entry at the end)."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        starts, ends, first = word_spans(data, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        return cls(data, offsets, starts, ends, first, row, span_hashes(data, starts, ends))

    def whole(self, width: int) -> np.ndarray:
        """For each word, whether the window that starts there ends in the same row."""
        at = np.arange(len(self.row))
        return at + width <= self.first[self.row + 1]


def symbol_rows(keyed: DataFrame, width: int, rounds: int) -> DataFrame:
    """(name, key, place) for each symbol of the last round; place is its first deciding word << 8 | their number, or -1 where they don't fit a window."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a, b, data, offsets in text_chunks(batch.column(1)):
                w = Words.of(data, offsets)
                if not len(w.row):
                    continue
                s = recompress(w.hash, w.row, rounds)
                fits = (s.high - s.low <= width) & (s.low >= w.first[s.text]) & (s.high <= w.first[s.text + 1])
                place = np.where(fits, (s.low - w.first[s.text]) << 8 | (s.high - s.low), -1)
                yield pa.RecordBatch.from_arrays([pa.array(s.name.view(np.int64)), pa.array(keys[a:b][s.text]), pa.array(place, pa.int64())], names=["name", "key", "place"])

    return keyed.select("key", "text").mapInArrow(task, "name long, key long, place long")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the number of them in each row; a null list is empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes.astype(np.int64)


def _candidates(w: Words, places: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """For each word, whether the window that starts there holds no symbol that occurs once."""
    low, high = (places >> 8) + w.first[rows], (places >> 8) + (places & 255) + w.first[rows]
    n = len(w.row)
    change = np.bincount(np.maximum(high - width, w.first[rows]), minlength=n + 1) - np.bincount(low + 1, minlength=n + 1)
    return w.whole(width) & (np.cumsum(change)[:n] == 0)


def _chunks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    """Row ranges of (key, id, text, places, copy): first row, end row, words, candidate windows, copy flags (0: no copy, 1: the one that stands for all, 2: others)."""
    places, sizes = _flat(batch.column(3))
    starts = np.append(0, np.cumsum(sizes))
    copy = batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)
    for a, b, data, offsets in text_chunks(batch.column(2)):
        w = Words.of(data, offsets)
        rows = np.repeat(np.arange(b - a), sizes[a:b])
        yield a, b, w, _candidates(w, places[starts[a] : starts[b]], rows, width), copy[a:b]


def window_rows(joined: DataFrame, width: int) -> DataFrame:
    """(h1, h2, key, at, n) for each candidate window, equal ones of a row range in one row; n is 2 where it is known to occur again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a, b, w, candidate, copy in _chunks(batch, width):
                at = np.flatnonzero(candidate & (copy[w.row] != 2)) if len(w.row) else np.zeros(0, np.int64)
                if not len(at):
                    continue
                h1 = window_hashes(w.hash, width)[at]
                h2 = window_hashes(span_hashes(w.data, w.starts, w.ends, 1), width, 1)[at].astype(np.uint32)
                n = np.where(copy[w.row[at]] == 1, 2, 1)
                _, one, back, times = np.unique(h1, return_index=True, return_inverse=True, return_counts=True)
                if (h2[one][back] == h2).all():
                    at, h1, h2, n = at[one], h1[one], h2[one], np.maximum(n[one], np.minimum(times, 2))
                row = w.row[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32)), pa.array(keys[a:b][row]), pa.array(at - w.first[row], pa.int64()), pa.array(n, pa.int32())], names=["h1", "h2", "key", "at", "n"]
                )

    return joined.mapInArrow(task, "h1 long, h2 int, key long, at long, n int")


def kept_rows(joined: DataFrame, width: int, kind: str) -> DataFrame:
    """(id, n_words, n_removed, kept_text) from (key, id, text, places, copy, once): once lists the candidate windows that occur once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once, sizes = _flat(batch.column(5))
            starts = np.append(0, np.cumsum(sizes))
            for a, b, w, repeated, copy in _chunks(batch, width):
                n = len(w.row)
                rows = np.repeat(np.arange(b - a), sizes[a:b])
                repeated[once[starts[a] : starts[b]] + w.first[rows]] = False
                repeated |= w.whole(width) & (copy[w.row] > 0) if n else False
                at = np.flatnonzero(repeated)
                change = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + width, minlength=n + 1)[: n + 1]
                removed = np.cumsum(change)[:n] > 0
                n_removed = np.diff(np.append(0, np.cumsum(removed))[w.first])
                texts, data, stay = [], w.data.tobytes(), ~removed
                for k in range(b - a):
                    words = data[w.offsets[k] : w.offsets[k + 1]].split()
                    if n_removed[k]:
                        words = [x for x, s in zip(words, stay[w.first[k] : w.first[k + 1]].tolist(), strict=True) if s]
                    texts.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(np.diff(w.first), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(task, f"id {kind}, n_words long, n_removed long, kept_text string")


def with_keys(rows: DataFrame, keys: tuple[Column, ...]) -> DataFrame:
    """Adds key, a number that tells the rows' (id, text) apart: the first of the keys, or, where rows that differ in another key share it, a later one.

    Rows that agree in all the keys are taken for equal. Only rows whose keys meet, few if any, are known by more than their first."""
    names = [f"_key{k}" for k in range(len(keys))]
    now = rows.select("*", *(c.alias(n) for c, n in zip(keys, names, strict=True)))
    number = F.col(names[0])
    for k in range(1, len(names)):
        differ = F.lit(False)
        for other in names:
            differ = differ | (F.min(other) != F.max(other))
        shared = kept(now.select(number.alias("shared"), *names).groupBy("shared").agg(differ.alias("differ")).where("differ").select("shared"), "shared-keys")
        if shared.isEmpty():
            return now.select(number.alias("key"), *rows.columns)
        number = F.when(F.col("shared").isNotNull(), F.xxhash64(number, names[k])).otherwise(number)
        now = now.join(shared, F.col(names[0]) == F.col("shared") if k == 1 else F.col("key") == F.col("shared"), "left").select(*rows.columns, *names, number.alias("key"))
        number = F.col("key")
    return now.select(number.alias("key"), *rows.columns)


def remove_repeats(docs: DataFrame, width: int = 35, rounds: int = 6, id_column: str = "doc_id", text_column: str = "text", keys: tuple[Column, ...] = ()) -> DataFrame:
    """Removes every word that lies in a window of `width` words whose sequence also starts anywhere else in the corpus.

    One row per document: the id, n_words, n_removed, kept_text (the kept words joined by one space). Windows are judged on the input.
    Null, empty and short texts keep all they have; repeated rows are copies of one another; ids may be null or repeated, for a row is
    known by id and text together, through hashes of both (`keys`, columns of id and text, where others are wanted); other columns are ignored; an empty table gives no rows.
    """
    if not 2 <= width <= 255:
        raise ValueError("width must be from 2 to 255")
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    keyed = with_keys(narrow, keys or tuple(F.xxhash64(F.lit(k), "id", "text") for k in range(3))).select("key", "id", "text")
    symbols = symbol_rows(keyed, width, rounds)
    counted = symbols.groupBy("name").agg(F.count("*").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("place").alias("place"))
    places = counted.where("n = 1 AND place >= 0").groupBy("key").agg(F.collect_list("place").alias("places"))

    alike = keyed.select("key", F.md5(F.col("text").cast("binary")).alias("digest")).where("digest IS NOT NULL")
    # a kept table, so that the join deals both sides anew and can split a group of very many copies
    groups = kept(alike.groupBy("digest").agg(F.count("*").alias("n"), F.min("key").alias("one")).where("n > 1").select("digest", "one"), "copy-groups")
    copies = alike.join(groups, "digest").groupBy("key").agg(F.min(F.when(F.col("key") == F.col("one"), 1).otherwise(2)).alias("copy"))
    known = kept(places.join(copies, "key", "full").select("key", "places", "copy"), "symbol-places")

    joined = keyed.join(known.hint("shuffle_hash"), "key", "left").select("key", "id", "text", "places", "copy")
    windows = window_rows(joined, width)
    verified = windows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("at").alias("at"))
    once = verified.where("n = 1").groupBy("key").agg(F.collect_list("at").alias("once"))
    final = joined.join(once.hint("shuffle_hash"), "key", "left").select("key", "id", "text", "places", "copy", "once")
    return kept_rows(final, width, narrow.schema["id"].dataType.simpleString()).withColumnRenamed("id", id_column)
