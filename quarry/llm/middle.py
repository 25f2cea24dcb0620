"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit borders.

The borders' ranks are drawn from a text's number of units, so a text is passed over twice: the first pass
counts the matches of the unit pattern, the second advances a lazy iterator over them to the two ranks and stops
there. Neither keeps a match, so besides the text itself a task needs the same few bytes for any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = re.compile("<[PSM]>")
#: A unit: a word with the white space before it, or white space at the end.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def count_units(text: str) -> int:
    return sum(1 for _ in UNIT.finditer(text))


def borders(text: str, first: int, second: int) -> tuple[int, int]:
    """Where the units of two ranks, first <= second, end; rank 0 ends at 0."""
    matches = UNIT.finditer(text)
    a = next(islice(matches, first - 1, None)).end() if first else 0
    b = next(islice(matches, second - first - 1, None)).end() if second > first else a
    return a, b


def draws(key: str, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(text: str, key: str, seed: int, percent: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix and of the middle, output) of one text."""
    n = count_units(text)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= percent or MARK.search(text):
        return n, "plain", None, None, text
    a, b = borders(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. The text of a form other than plain holds no mark, so the marks cut the output in its parts."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, suffix_first: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Draws come from the sha256 of "seed:id": two ranks, whether the text is cut (percent of them), whether the suffix comes first (suffix_first percent of those). Null texts are
    empty; empty texts, and texts that hold a mark, stay plain, with null prefix_chars and middle_chars. A null id counts as an empty one; rows of one id get the same draws.
    Other columns are ignored; an empty table gives no rows. Texts are read whole, whatever their length.
    """
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    keyed = narrow.select("id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), "text")
    kind = narrow.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [transform(text.as_py(), key.as_py(), seed, percent, suffix_first) for key, text in zip(batch.column(1), batch.column(2), strict=True)]
            columns = zip(*made, strict=True) if made else ([],) * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return keyed.mapInArrow(task, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_column)
