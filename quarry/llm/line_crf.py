"""Document quality by a linear-chain conditional random field over lines.

Every line gets a few shares and counts, cut into bins; a line's potential is the sum of the learned
weights of its own bins and its neighbours' bins, and neighbouring labels have weights of their own.
Forward-backward gives each line's marginal probability of being good; a document's score is their
mean, weighted by line length, on a scale fitted to the labels. Nothing but the text enters a score.

Lines have no labels of their own. Those of a labelled document take its label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._bytes import SPACE, U64, mix, span_hashes, text_chunks, word_spans

#: Byte classes whose share of a line's non-space bytes is a feature.
CLASSES = {
    "lower": [*range(ord("a"), ord("z") + 1)],
    "upper": [*range(ord("A"), ord("Z") + 1)],
    "digit": [*range(ord("0"), ord("9") + 1)],
    "high": [*range(0x80, 0x100)],
    "stop": [*b".,;:'\"()-"],
    "loud": [*b"!?"],
    "odd": [*b"#*$%&|<>{}[]\\^~=_+@/`"],
}
SHARES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6)
COUNTS = (0, 1, 3, 8, 20, 60, 200)
NAMES = (*CLASSES, "repeated", "word_length", "words", "seen")
BINS = 8
NEAR = (0, -1, 1)  # own line, line before, line after

_CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[_bytes] = _k


@dataclass
class Lines:
    """Lines of a range of rows: bins (line by feature), weights (bytes and one), and each row's first line (one more entry at the end)."""

    bins: np.ndarray
    weight: np.ndarray
    first: np.ndarray


def line_features(data: np.ndarray, offsets: np.ndarray) -> Lines:
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    per_row = np.diff(np.searchsorted(breaks, offsets)) + 1
    first = np.append(0, np.cumsum(per_row))
    n = first[-1]
    start, end = np.empty(n, np.int64), np.empty(n, np.int64)
    starts_row = np.zeros(n, bool)
    starts_row[first[:-1]] = True
    start[starts_row], start[~starts_row] = offsets[:-1], breaks + 1
    ends_row = np.zeros(n, bool)
    ends_row[first[1:] - 1] = True
    end[ends_row], end[~ends_row] = offsets[1:], breaks
    kind = _CLASS[data]

    def within(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags, dtype=np.int64))
        return sums[end] - sums[start]

    solid = np.maximum(within(~SPACE[data]), 1)
    bins = np.zeros((n, len(NAMES)), np.int8)
    for k in range(len(CLASSES)):
        bins[:, k] = np.searchsorted(SHARES, within(kind == k) / solid)
    a, b, _ = word_spans(data, offsets)
    hashes = span_hashes(data, a, b)
    first_word, last_word = np.searchsorted(a, start), np.searchsorted(a, end)
    words = last_word - first_word
    again = np.zeros(len(a), np.int64)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first_word[words > 0]] = 0
    sums = np.append(0, np.cumsum(again))
    some = np.maximum(words, 1)
    at = len(CLASSES)
    bins[:, at] = np.searchsorted(SHARES, (sums[last_word] - sums[first_word]) / some)
    bins[:, at + 1] = np.searchsorted(COUNTS, np.minimum(solid / some, 200)) * (words > 0)
    bins[:, at + 2] = np.searchsorted(COUNTS, words)
    row = np.repeat(np.arange(rows), per_row)
    key = mix(span_hashes(data, start, end) + row.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    bins[order[1:], at + 3] = (key[order[1:]] == key[order[:-1]]) & (words[order[1:]] > 0)
    return Lines(bins, (end - start + 1).astype(float), first)


@dataclass
class Model:
    """Weights for 'good' against 'bad': by neighbour, feature and bin; whether there is a line before and after; label changes."""

    near: np.ndarray
    edge: np.ndarray
    step: np.ndarray
    scale: np.ndarray
    """From the mean marginal to the score: the log-odds' intercept and slope."""

    @classmethod
    def empty(cls) -> Model:
        return cls(np.zeros((len(NEAR), len(NAMES), BINS)), np.zeros(3), np.zeros((2, 2)), np.zeros(2))


def _neighbours(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = first[-1]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[first[:-1]] = False
    after[first[1:] - 1] = False
    return before, after


def potentials(model: Model, lines: Lines) -> np.ndarray:
    before, after = _neighbours(lines.first)
    column = np.arange(len(NAMES))
    own = model.near[0][column, lines.bins].sum(1)
    left, right = model.near[1][column, lines.bins].sum(1), model.near[2][column, lines.bins].sum(1)
    return own + before * np.append(0, left[:-1]) + after * np.append(right[1:], 0) + model.edge[0] + before * model.edge[1] + after * model.edge[2]


def forward_backward(model: Model, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of 'good' for each line, and the expected label pairs (lines by 2 x 2, of a line and the next). Rows advance together."""
    n, size = len(e), np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, sizes = first[:-1][order], size[order]
    phi = np.stack([np.ones(n), np.exp(np.clip(e, -30, 30))], 1)
    phi /= phi.sum(1, keepdims=True)
    move = np.exp(model.step)
    alpha, beta, pair = np.empty((n, 2)), np.ones((n, 2)), np.zeros((n, 2, 2))
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
    for t in range(longest):
        at = begin[: active[t]] + t
        a = phi[at] if t == 0 else phi[at] * (alpha[at - 1] @ move)
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        b = (phi[at + 1] * beta[at + 1]) @ move.T
        beta[at] = b / b.sum(1, keepdims=True)
        p = alpha[at][:, :, None] * move * (phi[at + 1] * beta[at + 1])[:, None, :]
        pair[at] = p / p.sum((1, 2), keepdims=True)
    m = alpha * beta
    return m[:, 1] / m.sum(1), pair


def chain_marginals(phi: np.ndarray, move: np.ndarray, block: int = 1024) -> np.ndarray:
    """The marginal of 'good' for each line of one long chain: blocks advance together, from the vectors that the blocks around them pass on."""
    n = len(phi)
    k = -(-n // block)
    step = np.tile(np.eye(2), (k * block, 1, 1))
    step[:n] = move * phi[:, None, :]
    step[0] = np.diag(phi[0])
    step = step.reshape(k, block, 2, 2)
    whole = np.tile(np.eye(2), (k, 1, 1))
    for t in range(block):
        whole = whole @ step[:, t]
        whole /= whole.sum((1, 2), keepdims=True)
    before, after = np.ones((k, 2)), np.ones((k, 2))
    for b in range(1, k):
        v, w = before[b - 1] @ whole[b - 1], whole[k - b] @ after[k - b]
        before[b], after[k - b - 1] = v / v.sum(), w / w.sum()
    alpha, beta = np.empty((k, block, 2)), np.empty((k, block, 2))
    for t in range(block):
        before = (before[:, None, :] @ step[:, t])[:, 0]
        before /= before.sum(1, keepdims=True)
        alpha[:, t] = before
    for t in range(block - 1, -1, -1):
        beta[:, t] = after
        after = (step[:, t] @ after[:, :, None])[:, :, 0]
        after /= after.sum(1, keepdims=True)
    m = (alpha * beta).reshape(-1, 2)[:n]
    return m[:, 1] / m.sum(1)


def marginals(model: Model, e: np.ndarray, first: np.ndarray, most_steps: int = 4096) -> np.ndarray:
    """forward_backward's marginals; rows of more than most_steps lines are done block by block, each by itself."""
    size = np.diff(first)
    out = np.empty(len(e))
    for k in np.flatnonzero(size > most_steps):
        phi = np.stack([np.ones(size[k]), np.exp(np.clip(e[first[k] : first[k + 1]], -30, 30))], 1)
        out[first[k] : first[k + 1]] = chain_marginals(phi / phi.sum(1, keepdims=True), np.exp(model.step))
    rest = np.repeat(size <= most_steps, size)
    out[rest] = forward_backward(model, e[rest], np.append(0, np.cumsum(size[size <= most_steps])))[0]
    return out


def train(lines: Lines, good: np.ndarray, rounds: int = 120, rate: float = 0.1, penalty: float = 1e-3) -> Model:
    """Maximises the labelled lines' conditional log-likelihood, each document weighing the same (gradient steps with moments)."""
    model = Model.empty()
    if not len(good):
        return model
    size = np.diff(lines.first)
    label = np.repeat(good, size).astype(int)
    share = np.repeat(1.0 / size, size) / len(good)
    before, after = _neighbours(lines.first)
    parts = [model.near, model.edge, model.step]
    first_moment, second_moment = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    observed = np.zeros((2, 2))
    np.add.at(observed, (label[:-1][after[:-1]], label[1:][after[:-1]]), share[:-1][after[:-1]])
    for k in range(1, rounds + 1):
        marginal, pair = forward_backward(model, potentials(model, lines), lines.first)
        r = (label - marginal) * share
        grads = [np.zeros_like(p) for p in parts]
        for f in range(len(NAMES)):
            grads[0][0, f] = np.bincount(lines.bins[:, f], r, BINS)
            grads[0][1, f] = np.bincount(lines.bins[:-1, f], (r * before)[1:], BINS)
            grads[0][2, f] = np.bincount(lines.bins[1:, f], (r * after)[:-1], BINS)
        grads[1][:] = r.sum(), (r * before).sum(), (r * after).sum()
        grads[2][:] = observed - (pair * share[:, None, None]).sum(0)
        for p, g, m, v in zip(parts, grads, first_moment, second_moment, strict=True):
            g -= penalty * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    x = np.stack([np.ones(len(good)), mean_marginals(model, lines)], 1)
    ridge = np.diag([1e-6, 0.05])
    for _ in range(50):  # logistic regression by Newton's method
        p = 1 / (1 + np.exp(-x @ model.scale))
        model.scale += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (good - p) - ridge @ model.scale)
    return model


def mean_marginals(model: Model, lines: Lines) -> np.ndarray:
    marginal = marginals(model, potentials(model, lines), lines.first)
    return np.add.reduceat(marginal * lines.weight, lines.first[:-1]) / np.add.reduceat(lines.weight, lines.first[:-1])


def scores(model: Model, lines: Lines) -> np.ndarray:
    return 1 / (1 + np.exp(-model.scale[0] - model.scale[1] * mean_marginals(model, lines)))


def held_out(id_column: str, folds: int = 5) -> Column:
    """True for the fold that is never learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, most_documents: int = 4000, most_lines: int = 500, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Learns from labelled documents outside the held-out fold.

    The sample is bounded: the most_documents labels first in the order of a hash of their ids, one text of each id (the first by a hash, of
    those of at most most_lines lines). Labels other than 0 and 1 and null ids are ignored; of an id's different labels the lower counts. Without
    labels, every score is one half.
    """
    label, label_id = F.col(f"`{label_column}`"), F.col(f"`{id_column}`")
    usable = labels.select(label_id.alias("id"), label.alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(most_documents)
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    short = texts.join(F.broadcast(chosen), "id").where(F.length("text") - F.length(F.translate("text", "\n", "")) < most_lines)
    sample = short.groupBy("id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")).drop("id")  # combined before the shuffle

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                x = line_features(data, offsets)
                cut = [[y[x.first[k] : x.first[k + 1]].tobytes() for k in range(b - a)] for y in (x.bins, x.weight)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, pa.binary()) for c in cut)], names=["label", "bins", "weight"])

    found = sample.select(F.col("label").cast("int"), "text").mapInArrow(task, "label int, bins binary, weight binary").toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("bins", "weight", "label")), strict=True))
    bins = [np.frombuffer(b, np.int8).reshape(-1, len(NAMES)) for b, _, _ in rows]
    first = np.append(0, np.cumsum([len(b) for b in bins])).astype(int)
    weight = np.frombuffer(b"".join(w for _, w, _ in rows), float)
    return train(Lines(np.concatenate([*bins, np.zeros((0, len(NAMES)), np.int8)]), weight, first), np.array([y for _, _, y in rows], int))


def _scored(docs: DataFrame, model: Model, text_column: str) -> DataFrame:
    """i (a struct of the row's own columns) and score."""
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("i"))
    where = names.index(text_column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scores(model, line_features(data, offsets)) for _, _, data, offsets in text_chunks(batch.column(0).field(where))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*out, np.zeros(0)]))], names=["i", "score"])

    return packed.mapInArrow(task, f"i {packed.schema['i'].dataType.simpleString()}, score double")


def score_documents(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The documents with a column score (0 to 1, higher: label 1 likelier), in place of one so named.

    A null or empty text is one empty line; repeated rows score alike; other columns pass unread; an empty table gives no rows. Each text is
    scored whole where it is read, without a shuffle.
    """
    return _scored(docs, model, text_column).select(*(F.col(f"i.`{c}`").alias(c) for c in docs.columns if c != "score"), "score")


def keep_good(docs: DataFrame, model: Model, cut: float, text_column: str = "text") -> DataFrame:
    """The documents, with all their columns as they were, that score_documents gives the cut or more."""
    return _scored(docs, model, text_column).where(F.col("score") >= cut).select(*(F.col(f"i.`{c}`").alias(c) for c in docs.columns))
