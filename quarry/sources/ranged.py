"""Files as bytes that are read where they are looked at."""

from __future__ import annotations

import re
import struct
from typing import Any

import pyarrow as pa
from pyarrow import fs

_URI = re.compile(r"([A-Za-z][\w+.-]*):(//[^/]*)?(/.*|)", re.S)


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI as Spark writes them, with any characters in its path."""
    scheme, authority, path = _URI.fullmatch(uri).groups() if _URI.fullmatch(uri) else ("file", None, uri)
    if scheme == "file":
        return fs.LocalFileSystem(), path
    system, inside = fs.FileSystem.from_uri(f"{scheme}:{authority or '//'}/")
    return system, inside.rstrip("/") + path


def unpack(code: str, data: bytes | Ranged, at: int = 0) -> tuple[Any, ...]:
    """struct.unpack_from for both kinds of bytes; struct.error where they end before."""
    return struct.unpack(code, data[at : at + struct.calcsize(code)])


class Ranged:
    """The bytes of an open file. A slice reads its range, and a little more for what is looked at next; nothing else is held."""

    AHEAD = 4096

    def __init__(self, source: pa.NativeFile, size: int):
        self.source, self.size, self.start, self.held, self.n_read = source, size, 0, b"", 0

    def __len__(self) -> int:
        return self.size

    def _bytes(self, a: int, b: int) -> bytes:
        if not self.start <= a <= b <= self.start + len(self.held):
            self.source.seek(a)
            self.start, self.held = a, self.source.read(min(max(b - a, self.AHEAD), self.size - a))
            self.n_read += len(self.held)
        out = self.held[a - self.start : b - self.start]
        if len(self.held) > self.AHEAD:  # a long range is the caller's
            self.held = b""
        return out

    def __getitem__(self, at: int | slice) -> int | bytes:
        if isinstance(at, int):
            if not 0 <= at < self.size:
                raise IndexError(at)
            return self._bytes(at, at + 1)[0]
        a, b, _ = at.indices(self.size)
        return self._bytes(a, b) if a < b else b""

    def startswith(self, what: bytes | tuple[bytes, ...]) -> bool:
        return self[: max(map(len, (what,) if isinstance(what, bytes) else what))].startswith(what)

    def find(self, what: bytes, a: int, b: int) -> int:
        at = self[a:b].find(what)
        return at + a if at >= 0 else -1
