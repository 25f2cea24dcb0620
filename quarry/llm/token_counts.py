"""Token counts by heap-and-linked-list byte-pair merging, with no identifiers emitted.

A vocabulary of pieces with scores drives the merging: all adjacent pairs whose join is a piece go
to a heap by rank (the score's order) and place; the best is popped again and again, its two symbols
become one in the linked list, and the two new neighbours' pairs join the heap. The count is the
number of initial symbols less the number of merges. A symbol outside the vocabulary counts as its
UTF-8 bytes.

No merge can span two neighbouring characters that stand side by side in no piece. So the text falls
apart at such places, exactly, and the parts' counts are remembered by part within a task.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = "▁"  # stands for a space inside pieces


class PieceCounter(dict):
    """Counts of space-separated parts: self[part] is the count of META + part. Bounded by `most` remembered parts."""

    def __init__(self, model_file: str, most: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        kinds = range(model.get_piece_size())
        usual = [i for i in kinds if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        order = sorted({model.get_score(i) for i in usual}, reverse=True)
        place = {s: k for k, s in enumerate(order)}
        self.rank = {model.id_to_piece(i): place[model.get_score(i)] for i in usual}
        self.beside = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.most, self.inner, self.older = most, {}, {}
        if any(a != META and b == META for a, b in self.beside):
            raise ValueError("a piece spans a word border; parts can't be counted alone")

    def __missing__(self, part: str) -> int:
        n = self.older.get(part)
        if n is None:
            if part.isalpha():
                n = self.merge(META + part)
            elif part[:-1].isalpha() and part[-2:] not in self.beside:
                return self[part[:-1]] + self.merge(part[-1])
            else:
                n = self._cut(META + part)
        if len(part) <= 64:
            if len(self) >= self.most:  # the generation before last goes
                self.older = dict(self)
                self.clear()
            self[part] = n
        return n

    def _cut(self, text: str) -> int:
        """Sums the parts between places no merge can span."""
        beside = self.beside
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in beside]
        if not cuts:
            return self.merge(text)
        total, first, inner = 0, 0, self.inner
        for k in [*cuts, len(text)]:
            part, first = text[first:k], k
            if part[0] == META and part[1:].isalpha():  # as a part of its own
                total += self[part[1:]]
                continue
            n = inner.get(part)
            if n is None:
                n = self.merge(part)
                if len(part) <= 64:
                    if len(inner) >= self.most:
                        inner.clear()
                    inner[part] = n
            total += n
        return total

    def merge(self, text: str) -> int:
        """Heap entries are one integer each: rank, left place, joined length."""
        n = len(text)
        rank = self.rank
        if n == 1:
            return 1 if text in rank else len(text.encode())
        if text in rank and n == 2:
            return 1
        look, push, pop = rank.get, heapq.heappush, heapq.heappop
        symbols = list(text)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        width = n.bit_length()
        wide, low = 2 * width, (1 << width) - 1
        heap = [r << wide | i << width | 2 for i in range(n - 1) if (r := look(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            entry = pop(heap)
            i, size = entry >> width & low, entry & low
            a, j = symbols[i], right[i]
            if not a or j >= n or len(a) + len(symbols[j]) != size:
                continue  # one of the two has been merged meanwhile
            a += symbols[j]
            symbols[i], symbols[j] = a, ""
            merges += 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := look(a + symbols[k])) is not None:
                    push(heap, r << wide | i << width | size + len(symbols[k]))
            h = left[i]
            if h >= 0 and (r := look(symbols[h] + a)) is not None:
                push(heap, r << wide | h << width | len(symbols[h]) + size)
        return n - merges + sum([len(s.encode()) - 1 for s in symbols if len(s) == 1 and s not in rank])

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or META in text or text[0] == " " or text[-1] == " ":
            return sum(map(self._cut, re.findall(f"{META}+[^{META}]*", META + text.replace(" ", META))))
        return sum(map(self.__getitem__, text.split(" ")))


def count_tokens(docs: DataFrame, model_file: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows each get a row;
    texts of any length are counted whole; other columns are ignored; an empty table gives no rows.
    No shuffle: each text is counted where it is read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_file)
        for batch in batches:
            counts = [counter.count(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["i", "n"])

    narrow = docs.select(F.struct(F.col(id_column).alias("k"), F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("b")).alias("i"), F.col(text_column).alias("t"))
    kind = narrow.schema["i"].dataType.simpleString()
    counted = narrow.mapInArrow(task, f"i {kind}, n long")
    return counted.select(F.col("i.k").alias(id_column), F.col("i.b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
