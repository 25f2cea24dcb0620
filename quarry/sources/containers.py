"""Embedded tags of image files, as a long relation (path, ord, group, name, value).

Spark reads the files and deals them out; a task's part is the small walk below: find a container's EXIF,
XMP, profile and IPTC blocks, read the directories' entries, and pick XMP properties. What is damaged gives no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.sources import embedded as E
from quarry.sources.makernotes import maker_tags, named
from quarry.sources.ranged import Ranged, located, unpack
from quarry.tables import partitions

TAG_SCHEMA = "path string, ord int, group string, name string, value string"

#: EXIF entries that the catalog knows, by number.
NAMES = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "ModifyDate", 0x013B: "Artist", 0x0212: "YCbCrSubSampling", 0x8298: "Copyright",
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISO", 0x9003: "DateTimeOriginal", 0x9004: "CreateDate", 0x9204: "ExposureCompensation", 0x920A: "FocalLength", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA433: "LensMake", 0xA434: "LensModel",
}
GPS_NAMES = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude"}
#: Entry types, as struct codes and sizes.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}
EXIF_IFD, GPS_IFD, MAKER_NOTE = 0x8769, 0x8825, 0x927C
#: How TIFF files, and raw files that are TIFF but for their third and fourth byte, begin.
TIFF_LIKE = (b"II*\0", b"MM\0*", b"IIRO", b"IIRS", b"MMOR", b"IIU\0")
#: Bytes of a maker's entry that can be a text or a few numbers.
MOST_TEXT = 1 << 10

Tag = tuple[str, str, str]
Data = bytes | Ranged


def _shown(kind: int, raw: bytes, order: str) -> str:
    code, size = TYPES[kind]
    if code == "s":
        return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
    numbers = struct.unpack(order + code * (len(raw) // size), raw)
    if len(code) == 2:
        pairs = zip(numbers[::2], numbers[1::2], strict=True)
        return " ".join(("undef" if n == 0 else f"{n}/0") if d == 0 else str(n // d) if n % d == 0 else f"{n}/{d}" for n, d in pairs)
    return " ".join(f"{x:.6f}" if code in "fd" else str(x) for x in numbers)


def entries(data: Data, at: int, order: str, base: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(number, type, place, size) of a directory's entries whose values lie in the data; offsets count from base."""
    if at + 2 > len(data):
        return
    (count,) = unpack(order + "H", data, at)
    for entry in range(at + 2, min(at + 2 + 12 * count, len(data) - 11), 12):
        number, kind, n = unpack(order + "HHI", data, entry)
        if kind not in TYPES:
            continue
        size = n * TYPES[kind][1]
        place = entry + 8 if size <= 4 else base + unpack(order + "I", data, entry + 8)[0]
        if place + size <= len(data):
            yield number, kind, place, size


def _texts(data: Data, at: int, order: str, base: int) -> Iterator[tuple[int, str]]:
    """Numbers and texts of a maker's directory; tables of numbers are left out."""
    for number, kind, place, size in entries(data, at, order, base):
        if size <= MOST_TEXT:
            yield number, _shown(kind, data[place : place + size], order)


def _order(data: Data) -> str | None:
    return {b"II": "<", b"MM": ">"}.get(data[:2]) if len(data) >= 8 else None


def exif_tags(data: Data, names: dict[int, str] | None = None, group: str = "EXIF") -> Iterator[Tag]:
    """The known entries of a TIFF block: the main directory's, then those of the EXIF and GPS directories and of the maker's note."""
    order = _order(data)
    if order is None:
        return
    waiting, seen, make, note = [(unpack(order + "I", data, 4)[0], names or NAMES, group)], set(), "", None
    while waiting:
        at, names, group = waiting.pop(0)
        if at in seen:
            continue
        seen.add(at)
        for number, kind, place, size in entries(data, at, order):
            if number in (EXIF_IFD, GPS_IFD) and size == 4:
                waiting.append((unpack(order + "I", data, place)[0], NAMES if number == EXIF_IFD else GPS_NAMES, "EXIF" if number == EXIF_IFD else "GPS"))
            elif number == MAKER_NOTE and group == "EXIF":
                note = place, size
            elif number in names:
                text = _shown(kind, data[place : place + size], order)
                make = text if names[number] == "Make" else make
                yield group, names[number], text
    if note is not None:
        yield from maker_tags(data, *note, order, make, _texts)


def canon_tags(data: Data) -> Iterator[Tag]:
    """A maker's directory that is a TIFF block of its own."""
    order = _order(data)
    if order is not None:
        yield from named("Canon", _texts(data, unpack(order + "I", data, 4)[0], order, 0))


def xmp_tags(xml: str) -> Iterator[Tag]:
    """Properties of an XMP packet: attributes and simple elements, and lists joined by ', '; local names with a capital first letter."""
    from xml.sax.saxutils import unescape

    clean = lambda s: unescape(s, {"&quot;": '"', "&apos;": "'"}).strip()
    name = lambda s: s[0].upper() + s[1:]
    for block in re.findall(r"<rdf:Description\b([^>]*?)/?>", xml, re.S):
        for prefix, key, _, value in re.findall(r"""([\w-]+):([\w-]+)\s*=\s*(["'])(.*?)\3""", block, re.S):
            if prefix not in ("xmlns", "rdf"):
                yield "XMP", name(key), clean(value)
    for prefix, key, inner in re.findall(r"<(?!rdf:|x:)([\w-]+):([\w-]+)(?:\s[^>]*)?>(.*?)</\1:\2>", xml, re.S):
        items = re.findall(r"<rdf:li(?:\s[^>]*)?>(.*?)</rdf:li>", inner, re.S)
        if items:
            yield "XMP", name(key), ", ".join(clean(i) for i in items)
        elif "<" not in inner:
            yield "XMP", name(key), clean(inner)


def _jpeg(data: Data, start: int = 0) -> Iterator[tuple[str, bytes]]:
    at = start + 2
    profile: dict[int, bytes] = {}
    extended: dict[bytes, dict[int, bytes]] = {}
    yield from _jpeg_segments(data, at, profile, extended)
    if profile:
        yield "icc", E.joined_profile(profile)
    for parts in extended.values():
        yield "xmp", E.joined_profile(parts)


def _jpeg_segments(data: Data, at: int, profile: dict[int, bytes], extended: dict[bytes, dict[int, bytes]]) -> Iterator[tuple[str, bytes]]:
    """A JPEG's blocks up to its picture; what comes in parts is put into profile (by number) and extended (by packet and place)."""
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, (size,) = data[at + 1], unpack(">H", data, at + 2)
        if marker == 0xDA:
            return
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body.startswith(b"Exif\0\0"):
            yield "exif", body[6:]
        elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            yield "xmp", body[29:]
        elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xmp/extension/\0") and len(body) > 75:
            extended.setdefault(body[35:67], {})[unpack(">I", body, 71)[0]] = body[75:]
        elif marker == 0xE2 and body.startswith(b"ICC_PROFILE\0") and len(body) > 14:
            profile[body[12]] = body[14:]
        elif marker == 0xED and body.startswith(b"Photoshop 3.0\0"):
            yield "iptc", body[14:]
        elif marker in (0xC0, 0xC1, 0xC2) and len(body) >= 5:
            yield "size", struct.pack(">II", *struct.unpack(">HH", body[1:5]))
        at += 2 + size


def _png(data: Data) -> Iterator[tuple[str, bytes]]:
    at = 8
    while at + 12 <= len(data):
        (size,), kind = unpack(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size] if kind in (b"eXIf", b"iTXt", b"iCCP", b"IHDR") else b""
        if kind == b"eXIf":
            yield "exif", body
        elif kind == b"iTXt" and body.startswith(b"XML:com.adobe.xmp\0\0\0\0\0"):
            yield "xmp", body[22:]
        elif kind == b"iCCP":
            yield "icc", E.png_profile(body)
        elif kind == b"IHDR" and len(body) >= 8:
            width, height = struct.unpack(">II", body[:8])
            yield "size", struct.pack(">II", height, width)
        at += 12 + size


def _webp(data: Data) -> Iterator[tuple[str, bytes]]:
    at = 12
    sizes: list[tuple[int, int]] = []
    while at + 8 <= len(data):
        kind, (size,) = data[at : at + 4], unpack("<I", data, at + 4)
        body = data[at + 8 : at + 8 + size] if kind in (b"EXIF", b"XMP ", b"ICCP") else data[at + 8 : at + 8 + min(size, 10)]
        if kind == b"EXIF":
            yield "exif", body.removeprefix(b"Exif\0\0")
        elif kind == b"XMP ":
            yield "xmp", body
        elif kind == b"ICCP":
            yield "icc", body
        elif size_at := _webp_size(kind, body):
            sizes.append(size_at)
        at += 8 + size + size % 2
    if sizes:  # the canvas, which comes first, or else the picture
        yield "size", struct.pack(">II", *sizes[0])


def _webp_size(kind: bytes, body: bytes) -> tuple[int, int] | None:
    """Height and width that a chunk gives: of the canvas, of a lossy or of a lossless picture."""
    if len(body) < 10:
        return None
    if kind == b"VP8X":
        return int.from_bytes(body[7:10], "little") + 1, int.from_bytes(body[4:7], "little") + 1
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        width, height = unpack("<HH", body, 6)
        return height & 0x3FFF, width & 0x3FFF
    if kind == b"VP8L" and body[0] == 0x2F:
        bits = int.from_bytes(body[1:5], "little")
        return (bits >> 14 & 0x3FFF) + 1, (bits & 0x3FFF) + 1
    return None


def blocks(data: Data, sidecar: bool = False) -> Iterator[tuple[str, bytes]]:
    """The EXIF, XMP and size blocks of a file, by its first bytes; in a sidecar the packet may stand anywhere outside comments."""
    if data.startswith(b"\xff\xd8"):
        yield from _jpeg(data)
    elif data.startswith(b"\x89PNG\r\n\x1a\n"):
        yield from _png(data)
    elif data.startswith(b"RIFF") and data[8:12] == b"WEBP":
        yield from _webp(data)
    elif data[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free"):
        yield from E.iso_blocks(data)
    elif data[:4] in TIFF_LIKE:
        yield "exif", data
    elif data.startswith(b"FUJIFILMCCD-RAW"):
        start, size = unpack(">II", data, 0x54)  # of the picture inside
        if start and size and data[start : start + 2] == b"\xff\xd8":
            yield from _jpeg(data, start)
    elif data.startswith((b"GIF87a", b"GIF89a")) and len(data) >= 10:
        width, height = unpack("<HH", data, 6)
        yield "size", struct.pack(">II", height, width)
    elif data.startswith(b"BM") and len(data) >= 26:
        width, height = unpack("<ii", data, 18)
        yield "size", struct.pack(">II", abs(height), abs(width))
    elif sidecar:
        plain = re.sub(rb"<!--.*?-->", b"", data[:], flags=re.S)
        if packet := re.search(rb"<x:xmpmeta|<rdf:RDF", plain):
            yield "xmp", plain[packet.start() :]
    elif b"<x:xmpmeta" in data[:512] or b"<rdf:RDF" in data[:2048]:
        yield "xmp", data[:]


def _whole(found: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """The blocks up to where a walk meets damage."""
    try:
        yield from found
    except (struct.error, IndexError):
        return


def tags_of(data: Data, sidecar: bool = False) -> Iterator[Tag]:
    for kind, body in _whole(blocks(data, sidecar)):
        try:
            if kind == "exif":
                yield from exif_tags(body)
            elif kind == "xmp":
                yield from xmp_tags(body.decode("utf-8", "replace"))
            elif kind == "gps":
                yield from exif_tags(body, GPS_NAMES, "GPS")
            elif kind == "canon":
                yield from canon_tags(body)
            elif kind == "icc":
                yield from E.icc_tags(body)
            elif kind == "iptc":
                yield from E.iptc_tags(body)
            elif kind == "tag":
                yield body
            else:
                height, width = struct.unpack(">II", body)
                yield "File", "ImageSize", f"{width}x{height}"
        except (struct.error, IndexError):
            continue


def _rows(found: list[tuple[str, int, Tag]]) -> pa.RecordBatch:
    columns = list(zip(*((p, k, *t) for p, k, t in found), strict=True)) if found else [()] * 5
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "ord", "group", "name", "value"])


def _numbered(path: str, data: Data) -> list[tuple[str, int, Tag]]:
    return [(path, k, t) for k, t in enumerate(tags_of(data, path.lower().endswith(".xmp")))]


def tags_of_files(listing: DataFrame) -> DataFrame:
    """The tags of listed files (path): tasks open them where they are and read the ranges that hold tags, of files of any size. A file that cannot be opened has none but File:Error."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    system, inside = located(path)
                    with system.open_input_file(inside) as source:
                        rows += _numbered(path, Ranged(source, source.size()))
                except OSError as e:
                    rows.append((path, 0, ("File", "Error", f"{type(e).__name__}: {e.strerror or e}")))
            yield _rows(rows)

    return listing.select("path").mapInArrow(task, TAG_SCHEMA)


def read_tags(spark: SparkSession, path: str, pattern: str = "*", ranged: bool = True) -> DataFrame:
    """The tags of all files below a path whose names fit a pattern. Without `ranged`, for stores that only Spark reads, each file is read whole, which takes files of under 2 GB."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([row for p, data in zip(batch.column(0), batch.column(1), strict=True) for row in _numbered(p.as_py(), data.as_py())])

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    if ranged:
        return tags_of_files(reader.select("path").repartition(partitions(spark)))  # the names alone, so nothing is read here
    return reader.select("path", "content").mapInArrow(task, TAG_SCHEMA)


def exiftool_tags(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tags from ExifTool's JSON output, one object with group-prefixed keys per line (as -j -G -struct and a line per file give)."""
    from pyspark.sql import functions as F

    parsed = lines.select(F.from_json(column, "map<string,string>").alias("m")).where("m IS NOT NULL")
    each = parsed.select(F.col("m")["SourceFile"].alias("path"), F.posexplode(F.map_entries("m")).alias("ord", "e")).where("e.key != 'SourceFile'")
    return each.select("path", "ord", F.substring_index("e.key", ":", 1).alias("group"), F.substring_index("e.key", ":", -1).alias("name"), F.col("e.value").alias("value"))
