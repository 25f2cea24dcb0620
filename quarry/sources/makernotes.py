"""Entries of the directories that camera makers put into EXIF blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from quarry.sources.ranged import Ranged, unpack

Tag = tuple[str, str, str]


class Layout(NamedTuple):
    """How a note begins: its first bytes, where its directory is, what its offsets count from ('block': the EXIF block, 'note': the note, 'own': a block of its own there), its byte order if fixed."""

    start: bytes
    maker: str
    directory: int
    base: str
    order: str | None = None


#: The layouts, by a note's first bytes.
LAYOUTS = (
    Layout(b"SONY DSC \0\0\0", "Sony", 12, "block"),
    Layout(b"Nikon\0\2", "Nikon", 10, "own"),
    Layout(b"Nikon\0\1", "Nikon", 8, "block"),
    Layout(b"FUJIFILM", "Fujifilm", 12, "note", "<"),
    Layout(b"Panasonic\0\0\0", "Panasonic", 12, "block"),
    Layout(b"Apple iOS\0", "Apple", 14, "note", ">"),
)
#: Entries that the catalog knows, by maker and number.
NAMES = {
    "Canon": {0x06: "CanonImageType", 0x07: "CanonFirmwareVersion", 0x08: "FileNumber", 0x09: "OwnerName", 0x0C: "SerialNumber", 0x95: "LensModel", 0x96: "InternalSerialNumber"},
    "Nikon": {0x04: "Quality", 0x05: "WhiteBalance", 0x07: "FocusMode", 0x1D: "SerialNumber", 0xA7: "ShutterCount"},
    "Sony": {0x2027: "FocusLocation", 0x2037: "FocusFrameSize", 0xB021: "ColorTemperature", 0xB022: "ColorCompensationFilter", 0xB025: "DynamicRangeOptimizer", 0xB049: "ReleaseMode", 0xB04A: "SequenceNumber"},
    "Fujifilm": {0x1000: "Quality", 0x1002: "WhiteBalance", 0x1100: "AutoBracketing", 0x1101: "SequenceNumber"},
    "Panasonic": {0x2A: "BurstMode", 0x2B: "SequenceNumber", 0x51: "LensType"},
    "Apple": {0x0B: "BurstUUID", 0x11: "ContentIdentifier"},
}
#: What numbers of an entry mean.
MEANINGS = {
    ("Sony", "ReleaseMode"): {"0": "Normal", "2": "Continuous", "5": "Exposure Bracketing", "6": "White Balance Bracketing", "8": "DRO Bracketing", "65535": "n/a"},
    ("Sony", "SequenceNumber"): {"0": "Single", "65535": "n/a"},
}

Entries = Callable[[bytes | Ranged, int, str, int], Iterator[tuple[int, str]]]


def named(maker: str, found: Iterator[tuple[int, str]]) -> Iterator[Tag]:
    for number, text in found:
        name = NAMES[maker].get(number)
        if name is not None:
            yield "MakerNotes", name, MEANINGS.get((maker, name), {}).get(text, text)


def maker_tags(block: bytes | Ranged, place: int, size: int, order: str, make: str, entries: Entries) -> Iterator[Tag]:
    """The known entries of a note in an EXIF block. entries(data, directory, order, base) gives a directory's numbers and texts, offsets counted from base."""
    note = block[place : place + min(size, 16)]
    for layout in LAYOUTS:
        if not note.startswith(layout.start):
            continue
        if layout.base == "own":
            own = block[place + layout.directory : place + size]
            inner = {b"II": "<", b"MM": ">"}.get(own[:2])
            if inner is not None:
                yield from named(layout.maker, entries(own, unpack(inner + "I", own, 4)[0], inner, 0))
        else:
            yield from named(layout.maker, entries(block, place + layout.directory, layout.order or order, place if layout.base == "note" else 0))
        return
    if make.lower().startswith("canon"):  # no bytes before the directory
        yield from named("Canon", entries(block, place, order, 0))
