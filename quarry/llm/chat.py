"""Chat formatting: conversations as training text with a loss mask, assembled as columns of bytes.

A task gets its conversations' turns in order, as Arrow columns. Headers, contents and footers are segments: their
lengths give, by cumulative sums, every segment's place in the output, and scatter indices copy the bytes of all
headers and all contents into one buffer made beforehand, which then is the output column. No text is joined in Python.

Conversations of more than `part_bytes` are cut between turns into parts, which are dealt out by ranges of turns, so a
conversation of any length is the work of many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm._tables import kept, partitions

#: Fixed template: what stands before and after a turn of a role; turns of other roles carry their role's name.
TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[ROLE] ", "\n", " [/ROLE]")
#: The control strings. One in a text gets a backslash after its first character, and one more where it has some.
_REST = r"/?(?:s>|INST\]|SYS\]|ROLE\])"
ESCAPE = r"([<\[])(\\*" + _REST + ")"
UNESCAPE = re.compile(r"([<\[])\\(\\*" + _REST + ")")
OPENING = re.compile(r"\[INST\] |<s>|\[SYS\] |\[ROLE\] ")
CLOSING = re.compile(r" \[/INST\]|</s>| \[/SYS\]| \[/ROLE\]")
NAME = re.compile(r"\\(n|\\)")
#: Rows longer than this are copied as one slice.
LONG = 1 << 16
#: What a turn counts for besides its role and text, so that very many empty turns are cut into parts too.
MARKUP = 16
PARTS = "conv_id {}, part long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    roles = {opening: role for role, (opening, _) in TURNS.items()}
    at = 0
    while at < len(formatted):
        opened = OPENING.match(formatted, at)
        closed = CLOSING.search(formatted, opened.end())
        inside = formatted[opened.end() : closed.start()]
        role = roles.get(opened[0])
        if role is None:
            role, _, inside = inside.partition("\n")
            role = NAME.sub(lambda x: "\n" if x[1] == "n" else "\\", unescape(role))
        yield role, unescape(inside)
        at = closed.end()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its offsets from 0 (one more than rows)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scatter(out: np.ndarray, data: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> None:
    """Copies row k of (data, offsets) to places[k] of out."""
    sizes = np.diff(offsets)
    for k in np.flatnonzero(sizes > LONG):
        out[places[k] : places[k] + sizes[k]] = data[offsets[k] : offsets[k + 1]]
    short = np.where(sizes > LONG, 0, sizes)
    ends = np.cumsum(short)
    step = np.arange(ends[-1]) - np.repeat(ends - short, short)
    out[step + np.repeat(places, short)] = data[step + np.repeat(offsets[:-1], short)]


def assemble(role: pa.Array, text: pa.Array, first: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(formatted, loss_starts, loss_ends) of the parts that start at the turns `first` (one more entry at the end); the spans are in code points."""
    known = [pc.equal(role, r) for r in TURNS]
    names = pc.replace_substring(pc.replace_substring(role, "\\", "\\\\"), "\n", "\\n")
    names = pc.binary_join_element_wise(OTHER[0], pc.replace_substring_regex(names, ESCAPE, r"\1\\\2"), OTHER[1], "")
    of_role = pc.make_struct(*known, field_names=list(TURNS))
    headers = pc.case_when(of_role, *(pa.scalar(TURNS[r][0]) for r in TURNS), names)
    footers = pc.case_when(of_role, *(pa.scalar(TURNS[r][1]) for r in TURNS), pa.scalar(OTHER[2]))
    columns = [_bytes(headers), _bytes(pc.replace_substring_regex(text, ESCAPE, r"\1\\\2")), _bytes(footers)]
    sizes = np.stack([np.diff(offsets) for _, offsets in columns], axis=1).ravel()
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.empty(int(ends[-1]), np.uint8)
    for k, (data, offsets) in enumerate(columns):
        _scatter(out, data, offsets, starts[k::3])
    borders = np.append(0, ends)[3 * first]
    formatted = pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(borders), pa.py_buffer(out)])

    filled = np.flatnonzero(sizes)
    characters = np.zeros(len(sizes), np.int64)
    characters[filled] = np.add.reduceat(((out & 0xC0) != 0x80).view(np.int8), starts[filled], dtype=np.int64)
    until = np.append(0, np.cumsum(characters))
    lossy = np.flatnonzero(known[list(TURNS).index("assistant")].to_numpy(zero_copy_only=False))
    part = np.searchsorted(first, lossy, "right") - 1
    lists = np.searchsorted(part, np.arange(len(first))).astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(lists), pa.array(until[3 * lossy + k] - until[3 * first[part]])) for k in (1, 2)]
    return formatted, *spans


def assembled(rows: DataFrame, part_bytes: int) -> DataFrame:
    """Formats rows (conv_id, role, text) that come sorted within partitions. A part starts with a conversation, and where its turns would pass part_bytes."""

    def parts(turns: pa.Table, number: int) -> pa.RecordBatch:
        role, text = (turns.column(c).combine_chunks() for c in ("role", "text"))
        first = np.append(np.flatnonzero(turns.column("_first").to_numpy()), len(role))
        formatted, low, high = assemble(role, text, first)
        ids = turns.column("conv_id").combine_chunks().take(pa.array(first[:-1]))
        place = (TaskContext.get().partitionId() << 40) + number + np.arange(len(ids))
        return pa.RecordBatch.from_arrays([ids, pa.array(place), pa.array(np.diff(first)), formatted.cast(pa.string()), low, high], names=["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_ends"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, number = None, 0
        for batch in batches:
            turns = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not len(turns):
                continue
            owner = turns.column("conv_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            size = sum(pc.binary_length(turns.column(c)).to_numpy().astype(np.int64) for c in ("role", "text")) + MARKUP
            new = np.append(True, owner[1:] != owner[:-1])
            total = 0
            for k, more in enumerate(size.tolist()):
                new[k] |= total + more > part_bytes
                total = more if new[k] else total + more
            starts = np.flatnonzero(new)
            turns = turns.append_column("_first", pa.array(new))
            before = np.append(0, np.cumsum(size))[starts]
            low = 0
            while low < len(starts) - 1:  # about part_bytes at a time; the last part may go on in the next batch
                high = min(len(starts) - 1, max(low + 1, int(np.searchsorted(before, before[low] + part_bytes, "right")) - 1))
                yield parts(turns.slice(starts[low], starts[high] - starts[low]), number)
                number, low = number + high - low, high
            rest = turns.slice(starts[-1]).drop_columns("_first").combine_chunks().to_batches()[0]
        if rest is not None:
            yield parts(pa.Table.from_batches([rest]).append_column("_first", pa.array([True] + [False] * (len(rest) - 1))), number)

    return rows.select("conv_id", "role", "text").mapInArrow(task, PARTS.format(rows.schema["conv_id"].dataType.simpleString()))


def format_conversations(conversations: DataFrame, part_bytes: int = 1 << 20, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss_starts, loss_ends, whole): one row per conversation, or, where its turns have more than part_bytes, per part, ordered by part.

    The spans are the contents of assistant turns, in code points of formatted, starts included, ends not. Turns stand in the order of turn, those of one turn by role and text, null turns
    first; repeated rows are turns of their own. Null texts and roles are empty; rows without a conversation's id are one conversation without an id. Roles other than the template's are
    kept by name. Other columns are ignored; an empty table gives no rows. A turn's size is that of its role and text and 16 for what marks it. A turn is never cut, so a part may pass part_bytes by a turn that alone does.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.select(F.col(f"`{id_column}`").alias("conv_id"), F.col(f"`{turn_column}`").alias("turn"), text(role_column).alias("role"), text(text_column).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    sizes = rows.groupBy("conv_id").agg(F.sum(F.octet_length("role") + F.octet_length("text") + MARKUP).alias("size")).where(F.col("size") > part_bytes)
    long = kept(sizes.select(F.col("conv_id").alias("long_id")), "long-conversations")
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    whole = rows.join(long, is_long, "left_anti").repartition("conv_id").sortWithinPartitions(*order)
    # equal rows of a conversation may be dealt out too, so they need an order of their own
    cut = rows.withColumn("_row", F.monotonically_increasing_id()).join(long, is_long, "left_semi")
    cut = cut.repartitionByRange(partitions(rows.sparkSession), *order, "_row").sortWithinPartitions(*order)
    return assembled(whole, part_bytes).withColumn("whole", F.lit(True)).unionByName(assembled(cut, part_bytes).withColumn("whole", F.lit(False)))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its formatted text and spans alone.

    A digest reads its conversation from front to end; of one in parts, they pass through one task in order, which holds a part at a time.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []
        for batch in batches:
            for conv, text, low, high in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_starts", "loss_ends")), strict=True):
                if current is None or current[0] != conv:
                    if current is not None:
                        done.append(current)
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text):
                    current[1] += 1
                    current[2].update(f"{role}\n{said}\n".encode())
                for a, b in zip(low, high, strict=True):
                    learned = unescape(text[a:b])
                    current[3] += len(learned)
                    current[4].update(learned.encode())
                current[5] += len(text)
            yield rows(done)
            done = []
        if current is not None:
            yield rows([current])

    def rows(done: list) -> pa.RecordBatch:
        columns = zip(*((c, n, t.hexdigest(), k, x.hexdigest(), f) for c, n, t, k, x, f in done), strict=True) if done else ([],) * 6
        kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    id_type = to_arrow_type(formatted.schema["conv_id"].dataType)
    schema = f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    narrow = formatted.select("conv_id", "part", "formatted", "loss_starts", "loss_ends", "whole")
    in_parts = narrow.where(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return narrow.where("whole").mapInArrow(task, schema).unionByName(in_parts.mapInArrow(task, schema))
