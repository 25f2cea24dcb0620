"""Blocks inside image and video files beside EXIF and XMP packets: ISO media boxes, colour profiles, IPTC records."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from quarry.sources.ranged import Ranged, unpack

Tag = tuple[str, str, str]
Data = bytes | Ranged

#: IPTC application records that the catalog knows, by number.
IPTC_NAMES = {5: "ObjectName", 25: "Keywords", 80: "By-line", 90: "City", 101: "Country-PrimaryLocationName", 105: "Headline", 116: "CopyrightNotice", 120: "Caption-Abstract"}
#: Boxes that hold boxes.
HOLDERS = (b"moov", b"trak", b"mdia", b"iprp", b"ipco")
#: The identifiers of Canon's box and of the box of an XMP packet, and what Canon's holds.
CANON, PACKET = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48"), bytes.fromhex("be7acfcb97a942e89c71999491e3afac")
CANON_BLOCKS = {b"CMT1": "exif", b"CMT2": "exif", b"CMT3": "canon", b"CMT4": "gps"}


def boxes(data: Data, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind and content (from, to) of the boxes in a range, holders before what they hold. What follows damage in a holder is left out."""
    waiting = [(start, end)]
    while waiting:
        start, end = waiting.pop()
        if start + 8 > end:
            continue
        (size,), kind, head = unpack(">I", data, start), data[start + 4 : start + 8], 8
        if size == 1 and start + 16 <= end:
            (size,), head = unpack(">Q", data, start + 8), 16
        stop = end if size == 0 else start + size
        if size and size < head or stop > end:
            continue
        yield kind, start + head, stop
        waiting.append((stop, end))
        if kind in HOLDERS:
            waiting.append((start + head, stop))
        elif kind == b"meta":
            waiting.append((start + head + 4, stop))


def quicktime_date(seconds: int) -> str:
    """Seconds since 1904 as text; zeros for none, the number itself for a time before 1970."""
    if not seconds:
        return "0000:00:00 00:00:00"
    at = datetime(1904, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)
    return at.strftime("%Y:%m:%d %H:%M:%S") if at.year >= 1970 else str(seconds)


def duration(seconds: float) -> str:
    whole = round(seconds)
    return f"{whole // 3600}:{whole // 60 % 60:02}:{whole % 60:02}" if whole >= 3600 else f"{whole // 60}:{whole % 60:02}"


def _items(data: Data, at: int, end: int) -> dict[int, bytes]:
    """Item numbers and their types (for media items the content type) of an item information box."""
    version = data[at]
    at += 6 if version == 0 else 8
    out = {}
    for kind, a, b in boxes(data, at, end):
        if kind == b"infe" and data[a] >= 2:
            wide = data[a] > 2
            (number,) = unpack(">I" if wide else ">H", data, a + 4)
            a += 10 if wide else 8
            name_end = data.find(b"\0", a + 4, b)
            out[number] = data[name_end + 1 : b].split(b"\0")[0] if data[a : a + 4] == b"mime" else data[a : a + 4]
    return out


def _places(data: Data, at: int) -> dict[int, list[tuple[int, int]]]:
    """Item numbers and their extents (place in the file, length) of an item location box."""
    version, sizes = data[at], unpack(">H", data, at + 4)[0]
    widths = [sizes >> shift & 15 for shift in (12, 8, 4, 0)]
    at += 6

    def number(width: int) -> int:
        nonlocal at
        at += width
        return int.from_bytes(data[at - width : at], "big")

    out = {}
    for _ in range(number(4 if version == 2 else 2)):
        item = number(4 if version == 2 else 2)
        method = number(2) & 15 if version else 0
        number(2)
        base = number(widths[2])
        extents = []
        for _ in range(number(2)):
            if version:
                number(widths[3])
            offset, length = number(widths[0]), number(widths[1])
            extents.append((base + offset, length))
        if method == 0:
            out[item] = extents
    return out


def iso_blocks(data: Data) -> Iterator[tuple[str, bytes | Tag]]:
    """EXIF, XMP and size blocks and QuickTime tags of an ISO media file (HEIF, AVIF, CR3, MP4, MOV)."""
    kinds: dict[int, bytes] = {}
    places: dict[int, list[tuple[int, int]]] = {}
    largest, film, movie = (0, 0), (0, 0), (0, 0)
    for kind, a, b in boxes(data, 0, len(data)):
        if kind == b"moov":
            movie = a, b
        elif kind == b"uuid" and data[a : a + 16] == PACKET:
            yield "xmp", data[a + 16 : b]
        elif kind == b"uuid" and movie[0] <= a < movie[1] and data[a : a + 16] == CANON:
            for inner, x, y in boxes(data, a + 16, b):
                if inner in CANON_BLOCKS:
                    yield CANON_BLOCKS[inner], data[x:y]
        elif kind == b"mvhd":
            made, scale, length = unpack(">Q8xIQ" if data[a] else ">I4xII", data, a + 4)
            yield "tag", ("QuickTime", "CreateDate", quicktime_date(made))
            if scale:
                yield "tag", ("QuickTime", "Duration", duration(length / scale))
        elif kind == b"tkhd" and b - a >= 84:
            width, height = (x >> 16 for x in unpack(">II", data, b - 8))
            film = max(film, (height, width), key=lambda s: s[0] * s[1])
        elif kind == b"ispe":
            width, height = unpack(">II", data, a + 4)
            largest = max(largest, (height, width), key=lambda s: s[0] * s[1])
        elif kind == b"iinf":
            kinds = _items(data, a, b)
        elif kind == b"iloc":
            places = _places(data, a)
        elif kind == b"colr" and data[a : a + 4] in (b"prof", b"rICC"):
            yield "icc", data[a + 4 : b]
    for item, kind in kinds.items():
        body = b"".join(data[x : x + n] for x, n in places.get(item, []))
        if kind == b"Exif" and len(body) > 4:
            yield "exif", body[4 + unpack(">I", body)[0] :].removeprefix(b"Exif\0\0")
        elif kind == b"application/rdf+xml":
            yield "xmp", body
    size = largest if largest[0] else film
    if size[0]:
        yield "size", struct.pack(">II", *size)


def icc_tags(data: Data) -> Iterator[Tag]:
    """A colour profile's class, colour space, connection space and description."""
    if len(data) < 132 or data[36:40] != b"acsp":
        return
    for name, at in (("ProfileClass", 12), ("ColorSpaceData", 16), ("ProfileConnectionSpace", 20)):
        yield "ICC_Profile", name, data[at : at + 4].decode("latin-1").strip()
    for k in range(min(unpack(">I", data, 128)[0], (len(data) - 132) // 12)):
        kind, at, size = unpack(">4sII", data, 132 + 12 * k)
        body = data[at : at + size]
        if kind == b"desc" and body.startswith(b"desc"):
            yield "ICC_Profile", "ProfileDescription", body[12 : 12 + unpack(">I", body, 8)[0]].split(b"\0")[0].decode("latin-1")
        elif kind == b"desc" and body.startswith(b"mluc") and unpack(">I", body, 8)[0]:
            length, offset = unpack(">II", body, 20)
            yield "ICC_Profile", "ProfileDescription", body[offset : offset + length].decode("utf-16-be", "replace").rstrip("\0")


def iptc_tags(data: Data) -> Iterator[Tag]:
    """The known records of a Photoshop resource block; repeated ones are joined by ', '."""
    found: dict[str, list[str]] = {}
    at = 0
    while data[at : at + 4] == b"8BIM" and at + 12 <= len(data):
        number, named = unpack(">HB", data, at + 4)
        start = at + 6 + (named + 2) // 2 * 2  # the name, with its length, is padded to an even number of bytes
        (size,) = unpack(">I", data, start)
        body, k = data[start + 4 : start + 4 + size], 0
        while number == 0x0404 and k + 5 <= len(body) and body[k] == 0x1C:
            record, entry, n = unpack(">BBH", body, k + 1)
            if record == 2 and entry in IPTC_NAMES and n < 0x8000:
                found.setdefault(IPTC_NAMES[entry], []).append(body[k + 5 : k + 5 + n].decode("utf-8", "replace").strip())
            k += 5 + n
        at = start + 4 + size + size % 2
    for name, values in found.items():
        yield "IPTC", name, ", ".join(values)


def joined_profile(parts: dict[int, bytes]) -> bytes:
    return b"".join(parts[k] for k in sorted(parts))


def png_profile(body: bytes) -> bytes:
    """The profile of a PNG chunk: a name, a zero, the method, then deflated bytes."""
    try:
        return zlib.decompress(body[body.index(b"\0") + 2 :])
    except (ValueError, zlib.error):
        return b""
