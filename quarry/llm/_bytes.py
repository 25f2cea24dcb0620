"""Array arithmetic over the UTF-8 bytes of many texts at once, for use inside tasks.

A word is a maximal run of bytes outside space and 0x09-0x0D. Words get 64-bit hashes by a
polynomial over a random byte table, taken from prefix sums, so no Python loop touches a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U64 = np.uint64
#: Multipliers are 3 modulo 4, so that M - 1 has a single factor of two.
_M = (U64(0x9E3779B97F4A7C17 | 3), U64(0xD1B54A32D192ED03 | 3))
_TABLE = [np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64) for seed in (11, 23)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word (a fixed 64-bit finalizer)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    m = int(_M[which])
    base = np.full(n, U64(pow(m, -1, 2**64) if inverse else m))
    if n:
        base[0] = U64(1)
    return np.multiply.accumulate(base)


def text_chunks(batch_texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts an Arrow string array into row ranges of about most_bytes: (first row, end row, bytes, offsets from 0). Null is empty."""
    texts = batch_texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (one more entry at the end)."""
    inner = ~space[data]
    start = inner.copy()
    start[1:] &= ~inner[:-1]
    end = inner.copy()
    end[:-1] &= ~inner[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    start[borders] = inner[borders]
    end[borders - 1] = inner[borders - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[which][data] * powers(n, which), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(n + 1, which, inverse=True)[starts])


def window_hashes(items: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """The hash of each run of `width` consecutive items, by first item; runs over text borders are for the caller to drop."""
    n = len(items)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(items * powers(n, which), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(n, which, inverse=True)[: n - width + 1])
