"""WARC archives: a writer, and a reader that salvages what it can.

The writer makes one record per page, each a gzip member of its own, in files of bounded size, through
Spark's file writer. The reader walks each file record by record. Where a check fails (a member's
checksum, a header, a length, a payload's digest), it looks for the next place where a valid member or
record starts, goes on from there, and reports the bytes between as a gap. Inside a member it does the
same with the inflated bytes, and of a damaged member it keeps the records that were inflated before the damage.
Headers and members may be of any size; a large member is inflated as its records are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Generator, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._tables import kept, new_path

MAGIC, END = b"\x1f\x8b\x08", b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[0-9]\r\n")
#: Where a member or a record may start.
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[0-9]\r\n")
#: Bytes of a member's content that are held at once; of more, what the records need.
HELD = 1 << 24
#: A gzip member without content: the writer's separator between members. Readers skip it.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 0x08, 0, 0, 0, 0, 0, 0, 0xFF, 0x03, 0, 0, 0, 0, 0, 0, 0, 0, 0])
RECORD_SCHEMA = "path string, start long, length long, inner_start long, inner_length long, kind string, reason string, record_type string, page_id string, uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


class Piece(NamedTuple):
    """A record (headers and block) or, with headers None, a gap.

    start and length are bytes of the file: of the plain record, of the whole member, or of the gap; length is 0 for a record out of a
    damaged member, whose bytes are in the gap that follows. inner is the place and length in a member's content, None outside members.
    """

    start: int
    length: int
    headers: dict[str, str] | None
    block: bytes
    reason: str
    inner: tuple[int, int] | None = None


class Broken(ValueError):
    """A failed check, and the place before which no record can start that would pass it."""

    def __init__(self, reason: str, skip: int = 0):
        super().__init__(reason)
        self.skip = skip


class Content:
    """Bytes of a known number that come in chunks and are let go from the front; places are counted from the very first."""

    def __init__(self, chunks: Iterator[bytes], size: int):
        self.chunks, self.size, self.data, self.base = chunks, size, bytearray(), 0

    @classmethod
    def of(cls, data: bytes) -> Content:
        out = cls(iter(()), len(data))
        out.data = data
        return out

    def fill(self, end: int) -> None:
        end = min(end, self.size)
        while self.base + len(self.data) < end:
            self.data += next(self.chunks)

    def forget(self, before: int) -> None:
        """Lets go what is before a place, once that is most of what is held."""
        if isinstance(self.data, bytearray) and 2 * (before - self.base) > len(self.data):
            self.fill(before)
            del self.data[: before - self.base]
            self.base = before

    def bytes(self, start: int, end: int) -> bytes:
        self.fill(end)
        return bytes(self.data[start - self.base : end - self.base])

    def match(self, pattern: re.Pattern, at: int) -> int:
        """The end of a match of at most ten bytes at a place, or -1."""
        self.fill(at + 10)
        found = pattern.match(self.data, at - self.base)
        return found.end() + self.base if found else -1

    def find(self, what: bytes | re.Pattern, at: int) -> int:
        """The next place from `at` on of some bytes, or of a match of at most ten, or -1."""
        while True:
            held = self.base + len(self.data)
            if isinstance(what, bytes):
                k = self.data.find(what, at - self.base)
            else:
                found = what.search(self.data, at - self.base)
                k = found.start() if found else -1
            if k >= 0:
                return k + self.base
            if held >= self.size:
                return -1
            at = max(at, held - 9)
            self.fill(held + max(1 << 20, len(self.data)))


class Next:
    """The next zero byte after ascending places, each stretch looked through once."""

    def __init__(self, data: bytes):
        self.data, self.low, self.at = data, 0, -1

    def __call__(self, start: int) -> int:
        if not self.low <= start <= self.at:
            self.low, self.at = start, self.data.find(b"\0", start)
            if self.at < 0:
                self.at = len(self.data)
        return self.at


def _deflated(data: bytes, at: int, zero: Next) -> int:
    """Where the compressed bytes of the gzip member at a place begin."""
    flags, start = data[at + 3 : at + 4], at + 10
    if len(data) < start or flags[0] & 0xE0:
        raise Broken("member cut off" if len(data) < start else "member damaged")
    if flags[0] & 4:
        start += 2 + int.from_bytes(data[start : start + 2], "little")
    for bit in (8, 16):  # a name and a comment end with a zero byte
        if flags[0] & bit:
            start = zero(start) + 1
            if start > len(data):
                raise Broken("member damaged")
    return start + (2 if flags[0] & 2 else 0)


def _inflated(data: bytes, fed: int, step: int = 1 << 16) -> Generator[bytes, None, tuple[int, str]]:
    """The content of a gzip member whose compressed bytes begin at a place, in chunks; returns its end and what is wrong with it, such as damage after the last chunk."""
    inflate, crc, size = zlib.decompressobj(-15), 0, 0
    while not inflate.eof:
        if fed >= len(data):
            return len(data), "member cut off"
        before = inflate.copy()
        try:
            out = inflate.decompress(data[fed : fed + step])
        except zlib.error:
            some, k = [], fed
            try:
                while k < min(fed + step, len(data)):  # byte by byte to the damage
                    some.append(before.decompress(data[k : k + 1]))
                    k += 1
            except zlib.error:
                pass
            yield b"".join(some)
            return k, "member damaged"
        crc, size, fed = zlib.crc32(out, crc), size + len(out), fed + step
        yield out
    end = min(fed, len(data)) - len(inflate.unused_data)
    if data[end : end + 8] != struct.pack("<II", crc, size & 0xFFFFFFFF):
        return end, "member cut off" if end + 8 > len(data) else "member checksum wrong"
    return end + 8, ""


def _member(data: bytes, fed: int) -> tuple[Content, int, str]:
    """The content of a gzip member, its end, and what is wrong with it. Content of more than HELD bytes is measured first and inflated again as it is read."""
    chunks, size, out = [], 0, _inflated(data, fed)
    while True:
        try:
            chunk = next(out)
        except StopIteration as done:
            end, wrong = done.value
            return Content.of(b"".join(chunks)) if size <= HELD else Content(_inflated(data, fed), size), end, wrong
        size += len(chunk)
        chunks.append(chunk)
        if size > HELD:
            chunks.clear()


def _headers(content: Content, at: int) -> tuple[dict[str, str], dict[str, int], int]:
    """The header of the record at a place, line by line up to the empty one, where each name's last line begins, and where the block begins."""
    line = content.match(VERSION, at)
    if line < 0:
        raise Broken("no header")
    parts: dict[str, list[str]] = {}
    places: dict[str, int] = {}
    name = ""
    while True:
        stop = content.find(b"\r\n", line)
        if stop < 0:
            raise Broken("header damaged", line)
        if stop == line:
            return {k: " ".join(v) for k, v in parts.items()}, places, stop + 2
        try:
            text = content.bytes(line, stop).decode()
        except UnicodeDecodeError:
            raise Broken("header damaged", line) from None
        if text[0] in " \t" and name:  # goes on with the line before
            parts[name].append(text.strip())
        else:
            name, colon, value = text.partition(":")
            if not colon or text[0] in " \t":
                raise Broken("header damaged", line)
            name = name.strip().lower()
            parts[name], places[name] = [value.strip()], line
        line = stop + 2


def _record(content: Content, at: int) -> tuple[dict[str, str], bytes, int]:
    """The headers, block and end of the plain record at a place, all checks made.

    A header has no bound, and may hold version lines itself. A search that goes on inside it would read the same lines up to the same end, so a
    failed check says where one can go on that may turn out otherwise: headers that repeat a name count with the last.
    """
    headers, places, first = _headers(content, at)
    if not re.fullmatch("[0-9]{1,15}", headers.get("content-length", "")) or "warc-type" not in headers:
        raise Broken("header damaged", first)
    last = first + int(headers["content-length"])
    if last + len(END) > content.size or content.bytes(last, last + len(END)) != END:
        raise Broken("length wrong", first)
    block = content.bytes(first, last)
    digest = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response" and digest.startswith("sha256:") and digest[7:] != hashlib.sha256(payload_of(block)).hexdigest():
        raise Broken("payload digest wrong", places["warc-payload-digest"])
    return headers, block, last + len(END)


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a response's block."""
    head, end, body = block.partition(END)
    return body if end and head.startswith(b"HTTP/") else block


def salvage_plain(content: Content) -> Iterator[Piece]:
    """Records and gaps of a member's content, or of any bytes without members, in order; they cover every byte once."""
    at, lost, reason = 0, -1, ""
    while at < content.size:
        try:
            headers, block, end = _record(content, at)
        except Broken as e:
            if lost < 0:
                lost, reason = at, str(e)
            at = content.find(VERSION, max(at + 1, e.skip))
            at = content.size if at < 0 else at
            content.forget(at)
            continue
        if lost >= 0:
            yield Piece(lost, at - lost, None, b"", reason)
            lost = -1
        yield Piece(at, end - at, headers, block, "")
        at = end
        content.forget(at)
    if lost >= 0:
        yield Piece(lost, content.size - lost, None, b"", reason)


def _digest(p: Piece) -> bytes:
    return hashlib.sha256(repr(p.headers).encode() + p.block).digest()


def salvage(data: bytes) -> Iterator[Piece]:
    """Records and gaps of an archive in order; together with empty members they cover every byte.

    A whole member's records and the gaps in its content all carry the member's place. A damaged member's records before the damage
    come first, then the gap, which goes on to the next valid member or record.
    """
    at, lost, reason = 0, -1, ""
    known: set[bytes] = set()  # records out of the damaged member, which may also stand in its bytes as they are
    plain, zero, failed = Content.of(data), Next(data), set()
    while at < len(data):
        pieces: Iterator[Piece] = iter(())
        end, wrong, skip = at, "", at + 1
        try:
            if data.startswith(MAGIC, at):
                fed = _deflated(data, at, zero)
                if fed in failed:
                    raise Broken("member damaged")
                content, end, wrong = _member(data, fed)
                if wrong:
                    failed.add(fed)
                found = salvage_plain(content)
                pieces = (p._replace(start=at, length=0 if wrong else end - at, inner=(p.start, p.length)) for p in found)  # noqa: B023
            else:
                headers, block, end = _record(plain, at)
                pieces = iter([Piece(at, end - at, headers, block, "")])
        except Broken as e:
            wrong = str(e) if data.startswith(MAGIC, at) or VERSION.match(data, at) else "no member or version line"
            skip = max(skip, e.skip)
        if wrong:
            for p in pieces:
                if p.headers is not None:
                    known.add(_digest(p))
                    yield p
            if lost < 0:
                lost, reason = at, wrong
            at = plain.find(START, skip)
            at = len(data) if at < 0 else at
            continue
        first = next(pieces, None)
        if lost >= 0 and first is not None and first.headers is not None and _digest(first) in known:
            at = end  # part of the gap, and given already
            continue
        if lost >= 0:
            yield Piece(lost, at - lost, None, b"", reason)
            lost = -1
            known.clear()
        if first is not None:
            yield first
            yield from pieces
        at = end
    if lost >= 0:
        yield Piece(lost, len(data) - lost, None, b"", reason)


def _line(name: str, value: Column) -> Column:
    """A header line; line ends inside a value become spaces; null gives none."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\\r\\n]+", " "), F.lit("\r\n")), F.lit(""))


def deduplicated(pages: DataFrame, least: int = 100) -> DataFrame:
    """(id, url, html, digest, bytes, refers_to): of equal payloads of at least `least` bytes all but the least id's refer to that id."""
    html = F.coalesce("html", F.lit(""))
    full = pages.select("id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    groups = full.where(F.col("bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1 AND first IS NOT NULL")
    groups = kept(groups.select(F.col("digest").alias("of"), "first"), "payload-groups")
    joined = full.join(groups, F.col("digest") == F.col("of"), "left")
    return joined.select("id", "url", "html", "digest", "bytes", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least: int = 100, chunk_bytes: int = 1 << 22, chunks_per_file: int = 32) -> None:
    """Writes a record per page: response, or revisit of the page with the least id among those of equal payload.

    Members are put together up to chunk_bytes, a larger one alone, and a file takes chunks_per_file of these chunks: 128 MB, or more where single members are larger than a chunk.

    A null html is an empty payload; payloads under `least` bytes are always responses; a null id is never referred to, and refers to a page that
    has one; pages with the same id and payload are all responses; a null url has no target line; other columns are ignored.
    """
    narrow = pages.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{url_column}`").alias("url"), F.col(f"`{html_column}`").cast("string").alias("html"))
    rows = deduplicated(narrow, least)
    again = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("bytes")), F.lit("\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(again, F.lit("WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        _line("WARC-Record-ID", F.coalesce(name("id"), F.concat(F.lit("<urn:payload:"), F.col("digest"), F.lit(">")))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Refers-To", name("refers_to")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("X-Payload-Length", F.col("bytes")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = deflate.compress(record.as_py()) + deflate.flush()
                if chunk and size + len(member) > chunk_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(chunk)], pa.binary())], names=["chunk"])
                    chunk, size = [], 0
                chunk.append(member)
                size += len(member)
        if chunk:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(chunk)], pa.binary())], names=["chunk"])

    chunks = rows.select(F.concat(head, block, F.lit("\r\n\r\n")).cast("binary").alias("record")).mapInArrow(task, "chunk binary")
    # the text writer puts out a string's bytes unchanged, and this separator after each
    writer = chunks.select(F.col("chunk").cast("string").alias("value")).write.option("maxRecordsPerFile", chunks_per_file)
    writer.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def _rows(path: str, content: bytes, payloads: bool) -> Iterator[tuple]:
    """The rows of RECORD_SCHEMA of one archive."""
    named = re.compile("<urn:page:(.*)>")
    for p in salvage(content):
        place = (path, p.start, p.length, *(p.inner or (None, None)))
        h = p.headers
        if h is None:
            yield *place, "gap", p.reason, *[None] * 7
            continue
        response = h["warc-type"] == "response"
        body = payload_of(p.block) if response else None
        page, refers = (named.fullmatch(h.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
        size = len(body) if response else int(h["x-payload-length"]) if re.fullmatch("[0-9]{1,15}", h.get("x-payload-length", "")) else None
        digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
        yield *place, "record", None, h["warc-type"], page and page[1], h.get("warc-target-uri"), digest, size, refers and refers[1], body if payloads else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True, part_bytes: int = 1 << 24, part_rows: int = 10_000) -> DataFrame:
    """A row per record (kind 'record') and per quarantined gap (kind 'gap', with its reason), as in RECORD_SCHEMA.

    start and length are bytes of the file, inner_start and inner_length bytes of a member's content (null outside members); a record out of
    a damaged member has length 0, its bytes being part of the gap. Plain and gzipped archives are read alike. Empty files give no rows. payload is null for gaps,
    for other types than response, and unless asked for. A file is read whole and must be under 2 GB; its rows leave the task in parts.
    """
    fields = [x.split(" ") for x in RECORD_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def part(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for row in _rows(path.as_py(), content.as_py(), payloads):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if size >= part_bytes or len(rows) >= part_rows:
                        yield part(rows)
                        rows, size = [], 0
                if rows:
                    yield part(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(task, RECORD_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to new archives in the shared folder and reads those back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, payloads=False)
