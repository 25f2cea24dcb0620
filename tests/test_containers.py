"""Sidecars with long preambles, and sizes beyond 16 bits."""

import struct
import zlib

import pytest

from quarry.sources import containers
from quarry.sources.ranged import Ranged, located

XMP = b'<x:xmpmeta><rdf:RDF><rdf:Description xmp:Rating="4"></rdf:Description></rdf:RDF></x:xmpmeta>'


@pytest.mark.parametrize("preamble", [b"<!--" + b" note <xmp:Label>No</xmp:Label> <rdf:RDF" + b"." * 5000 + b"-->", b"<!DOCTYPE x [" + b" " * 3000 + b"]>", b" " * 9000])
def test_sidecar_preamble(spark, tmp_path, preamble):
    (tmp_path / "a.XMP").write_bytes(preamble + XMP)
    assert [(r["group"], r["name"], r["value"]) for r in containers.read_tags(spark, str(tmp_path)).collect()] == [("XMP", "Rating", "4")]


def test_large_sizes():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 100000, 70000) + b"\x08\x02\0\0\0" + b"\0" * 4
    bmp = b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 100000, -70000) + b"\0" * 28
    for data in (png, bmp):
        assert list(containers.tags_of(data)) == [("File", "ImageSize", "100000x70000")]


def box(kind: bytes, *body: bytes) -> bytes:
    inner = b"".join(body)
    return struct.pack(">I", 8 + len(inner)) + kind + inner


def profile() -> bytes:
    text = "sRGB ü".encode("utf-16-be")
    mluc = b"mluc" + b"\0" * 4 + struct.pack(">II", 1, 12) + b"enUS" + struct.pack(">II", len(text), 28) + text
    head = bytearray(128)
    head[12:24], head[36:40] = b"mntrRGB XYZ ", b"acsp"
    return bytes(head) + struct.pack(">I4sII", 1, b"desc", 144, len(mluc)) + mluc


def test_heif_items():
    tiff = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHI", 0x0112, 3, 1) + struct.pack("<HH", 6, 0) + b"\0" * 4
    exif = struct.pack(">I", 6) + b"Exif\0\0" + tiff
    info = lambda n, kind, rest=b"": box(b"infe", b"\2\0\0\0", struct.pack(">HH", n, 0), kind, b"\0", rest)
    iinf = box(b"iinf", b"\0" * 4, struct.pack(">H", 2), info(1, b"Exif"), info(2, b"mime", b"application/rdf+xml\0"))
    ispe = box(b"iprp", box(b"ipco", box(b"ispe", b"\0" * 4, struct.pack(">II", 160, 120)), box(b"ispe", b"\0" * 4, struct.pack(">II", 4000, 3000)), box(b"colr", b"prof", profile())))
    start = box(b"ftyp", b"heic\0\0\0\0")

    def whole(at: int) -> bytes:
        iloc = box(b"iloc", b"\0" * 4, b"\x44\0", struct.pack(">H", 2), *(struct.pack(">HHHII", n, 0, 1, place, size) for n, place, size in ((1, at, len(exif)), (2, at + len(exif), len(XMP)))))
        return start + box(b"meta", b"\0" * 4, iinf, iloc, ispe)

    data = whole(len(whole(0)) + 8) + box(b"mdat", exif, XMP)
    got = {(g, n): v for g, n, v in containers.tags_of(data)}
    assert got[("EXIF", "Orientation")] == "6" and got[("XMP", "Rating")] == "4" and got[("File", "ImageSize")] == "4000x3000"
    assert got[("ICC_Profile", "ProfileDescription")] == "sRGB ü" and got[("ICC_Profile", "ColorSpaceData")] == "RGB"
    for cut in range(0, len(data), 3):
        list(containers.tags_of(data[:cut]))


@pytest.mark.parametrize("version", [0, 1])
def test_film(version):
    made = 2082844800 + 86400
    times = struct.pack(">QQIQ", made, 0, 600, 600 * 3725) if version else struct.pack(">IIII", made, 0, 600, 600 * 3725)
    track = box(b"trak", box(b"tkhd", b"\0" * 76, struct.pack(">II", 1920 << 16, 1080 << 16)))
    data = box(b"ftyp", b"qt  ") + box(b"moov", box(b"mvhd", bytes([version, 0, 0, 0]), times), track, box(b"trak", box(b"tkhd", b"\0" * 84)))
    assert list(containers.tags_of(data)) == [("QuickTime", "CreateDate", "1970:01:02 00:00:00"), ("QuickTime", "Duration", "1:02:05"), ("File", "ImageSize", "1920x1080")]


def test_profiles_records_and_long_packets():
    segment = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    entry = lambda n, text: b"\x1c\2" + struct.pack(">BH", n, len(text)) + text
    iptc = entry(25, b"sea") + entry(120, "Küste".encode()) + entry(25, b"sky") + entry(200, b"?")
    photoshop = b"Photoshop 3.0\0" + b"8BIM\x04\x25\0\0\0\0\0\1x\0" + b"8BIM\x04\x04\x03abc" + struct.pack(">I", len(iptc)) + iptc
    icc, packet = profile(), XMP.replace(b"Rating", b"Label")
    parts = [segment(0xE2, b"ICC_PROFILE\0" + bytes([k, 2]) + p) for k, p in ((2, icc[100:]), (1, icc[:100]))]
    long = [segment(0xE1, b"http://ns.adobe.com/xmp/extension/\0" + b"G" * 32 + struct.pack(">II", len(packet), at) + packet[at:to]) for at, to in ((40, len(packet)), (0, 40))]
    data = b"\xff\xd8" + segment(0xED, photoshop) + b"".join(parts + long) + b"\xff\xda\0\2"
    got = {(g, n): v for g, n, v in containers.tags_of(data)}
    assert got[("IPTC", "Keywords")] == "sea, sky" and got[("IPTC", "Caption-Abstract")] == "Küste" and got[("XMP", "Label")] == "4"
    assert got[("ICC_Profile", "ProfileDescription")] == "sRGB ü"
    png = b"\x89PNG\r\n\x1a\n" + (lambda b: struct.pack(">I", len(b)) + b"iCCP" + b + b"\0" * 4)(b"name\0\0" + zlib.compress(icc))
    assert ("ICC_Profile", "ProfileClass", "mntr") in list(containers.tags_of(png))


def directory(order: str, entries: list[tuple[int, int, bytes]], at: int) -> bytes:
    """A directory at a place of its block, values behind it."""
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 7: 1}
    head, values = struct.pack(order + "H", len(entries)), b""
    behind = at + 2 + 12 * len(entries) + 4
    for number, kind, raw in entries:
        n = len(raw) // sizes[kind]
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", behind + len(values))
        values += raw if len(raw) > 4 else b""
        head += struct.pack(order + "HHI", number, kind, n) + place
    return head + b"\0" * 4 + values


def block(order: str, entries: list[tuple[int, int, bytes]]) -> bytes:
    return {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", 8) + directory(order, entries, 8)


def cr3() -> bytes:
    parts = [
        box(b"CMT1", block("<", [(0x010F, 2, b"Canon\0"), (0x0110, 2, b"Canon EOS R5\0")])),
        box(b"CMT2", block("<", [(0x8827, 3, struct.pack("<H", 800)), (0xA434, 2, b"RF50mm\0")])),
        box(b"CMT3", block("<", [(0x06, 2, b"Canon image\0"), (0x0C, 4, struct.pack("<I", 77)), (0x4000, 7, b"x" * 5000)])),
        box(b"CMT4", block("<", [(1, 2, b"N\0")])),
    ]
    return box(b"ftyp", b"crx \0\0\0\1") + box(b"moov", box(b"uuid", bytes.fromhex("85c0b687820f11e08111f4ce462b6a48"), *parts)) + box(b"uuid", bytes.fromhex("be7acfcb97a942e89c71999491e3afac"), XMP) + box(b"mdat", b"\0" * 100)


CR3_TAGS = [("EXIF", "Make", "Canon"), ("EXIF", "Model", "Canon EOS R5"), ("EXIF", "ISO", "800"), ("EXIF", "LensModel", "RF50mm"), ("MakerNotes", "CanonImageType", "Canon image"), ("MakerNotes", "SerialNumber", "77"), ("GPS", "GPSLatitudeRef", "N"), ("XMP", "Rating", "4")]


def test_cr3():
    data = cr3()
    assert list(containers.tags_of(data)) == CR3_TAGS
    for cut in range(0, len(data), 7):
        list(containers.tags_of(data[:cut]))
    elsewhere = box(b"ftyp", b"crx ") + box(b"mdat", box(b"uuid", bytes.fromhex("85c0b687820f11e08111f4ce462b6a48"), box(b"CMT1", block("<", [(0x010F, 2, b"Canon\0")]))))
    assert list(containers.tags_of(elsewhere)) == []


def test_raw_kinds_and_webp_sizes():
    raw = block("<", [(0x010F, 2, b"Maker\0")])
    for start in (b"IIRO", b"IIRS", b"IIU\0"):
        assert list(containers.tags_of(start + raw[4:])) == [("EXIF", "Make", "Maker")]
    segment = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    jpeg = b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + raw) + segment(0xC0, b"\x08" + struct.pack(">HH", 30, 40) + b"\0" * 4) + b"\xff\xda\0\2"
    raf = b"FUJIFILMCCD-RAW ".ljust(0x54, b"0") + struct.pack(">II", 200, len(jpeg)) + b"\0" * (200 - 0x5C) + jpeg + b"\0" * 500
    assert list(containers.tags_of(raf)) == [("EXIF", "Make", "Maker"), ("File", "ImageSize", "40x30")]
    for cut in range(0, len(raf), 9):
        list(containers.tags_of(raf[:cut]))
    riff = lambda *chunks: b"RIFF\0\0\0\0WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)
    canvas, lossy = b"\0" * 4 + (7999).to_bytes(3, "little") + (5999).to_bytes(3, "little"), b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 640, 480) + b"\0" * 90
    lossless = b"\x2f" + (319 | 199 << 14).to_bytes(4, "little") + b"\0" * 20
    for chunks, size in (((((b"VP8X"), canvas), (b"VP8 ", lossy))), "8000x6000"), (((b"VP8 ", lossy),), "640x480"), (((b"VP8L", lossless),), "320x200"):
        assert list(containers.tags_of(riff(*chunks))) == [("File", "ImageSize", size)]


@pytest.mark.parametrize("order", ["<", ">"])
def test_maker_notes(order):
    number = lambda n: struct.pack(order + "H", n)

    def whole(make: bytes, note) -> dict:
        """An EXIF block whose note is made for its place."""
        main = [(0x010F, 2, make + b"\0"), (0x8769, 4, struct.pack(order + "I", 100))]
        head = block(order, main).ljust(100, b"\0")
        place = 100 + 2 + 12 + 4
        body = note(place)
        data = head + struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x927C, 7, len(body), place) + b"\0" * 4 + body
        tags = list(containers.tags_of(data))
        for cut in range(0, len(data), 5):
            list(containers.tags_of(data[:cut]))
        return {n: v for g, n, v in tags if g == "MakerNotes"}

    sony = lambda at: b"SONY DSC \0\0\0" + directory(order, [(0x2027, 3, b"".join(map(number, (7008, 4672, 1204, 2277)))), (0xB049, 3, number(5)), (0xB04A, 3, number(3))], at + 12)
    assert whole(b"SONY", sony) == {"FocusLocation": "7008 4672 1204 2277", "ReleaseMode": "Exposure Bracketing", "SequenceNumber": "3"}
    single = lambda at: b"SONY DSC \0\0\0" + directory(order, [(0xB049, 3, number(0)), (0xB04A, 3, number(0))], at + 12)
    assert whole(b"SONY", single) == {"ReleaseMode": "Normal", "SequenceNumber": "Single"}
    assert whole(b"Canon", lambda at: directory(order, [(0x95, 2, b"EF 24-70mm\0")], at)) == {"LensModel": "EF 24-70mm"}
    assert whole(b"Other", lambda at: directory(order, [(0x95, 2, b"EF 24-70mm\0")], at)) == {}
    assert whole(b"NIKON", lambda at: b"Nikon\0\2\x10\0\0" + block(">", [(0x04, 2, b"RAW   \0"), (0xA7, 4, struct.pack(">I", 12345))])) == {"Quality": "RAW", "ShutterCount": "12345"}
    assert whole(b"FUJIFILM", lambda at: b"FUJIFILM\x0c\0\0\0" + directory("<", [(0x1000, 2, b"NORMAL \0"), (0x1101, 3, struct.pack("<H", 4))], 12)) == {"Quality": "NORMAL", "SequenceNumber": "4"}
    assert whole(b"Panasonic", lambda at: b"Panasonic\0\0\0" + directory(order, [(0x2B, 4, struct.pack(order + "I", 9))], at + 12)) == {"SequenceNumber": "9"}
    assert whole(b"Apple", lambda at: b"Apple iOS\0\0\1MM" + directory(">", [(0x0B, 2, b"ABCDEF-01\0")], 14)) == {"BurstUUID": "ABCDEF-01"}


def test_large_files_are_read_in_ranges(spark, tmp_path):
    times = struct.pack(">IIII", 2082844800 + 86400, 0, 600, 600 * 3725)
    track = box(b"trak", box(b"tkhd", b"\0" * 76, struct.pack(">II", 1920 << 16, 1080 << 16)), box(b"mdia", b"\0" * 3_000_000))
    with open(tmp_path / "a film é.mov", "wb") as film:  # the picture is a hole of five gigabytes
        film.write(box(b"ftyp", b"qt  ") + struct.pack(">I4sQ", 1, b"mdat", 16 + 5 * 2**30))
        film.seek(5 * 2**30, 1)
        film.write(box(b"moov", box(b"mvhd", b"\0" * 4, times), track))
    (tmp_path / "b.CR3").write_bytes(cr3())
    raw = block("<", [(0x010F, 2, b"Maker\0"), (0x0112, 3, struct.pack("<H", 6))])
    with open(tmp_path / "c.tif", "wb") as big:
        big.write(raw)
        big.truncate(3 * 2**30)
    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + b"\0" * 4 for k, b in ((b"IHDR", struct.pack(">II", 7, 5) + b"\0" * 5), (b"IDAT", b"\0" * 9_000_000), (b"eXIf", raw)))
    (tmp_path / "d.png").write_bytes(png)
    want = {
        "a film é.mov": [("QuickTime", "CreateDate", "1970:01:02 00:00:00"), ("QuickTime", "Duration", "1:02:05"), ("File", "ImageSize", "1920x1080")],
        "b.CR3": CR3_TAGS,
        "c.tif": [("EXIF", "Make", "Maker"), ("EXIF", "Orientation", "6")],
        "d.png": [("File", "ImageSize", "7x5"), ("EXIF", "Make", "Maker"), ("EXIF", "Orientation", "6")],
    }
    for name, tags in want.items():
        system, inside = located(f"file:{tmp_path}/{name}")
        with system.open_input_file(inside) as source:
            data = Ranged(source, source.size())
            assert list(containers.tags_of(data)) == tags and data.n_read < 60_000
    got = {}
    for r in containers.read_tags(spark, str(tmp_path)).orderBy("ord").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["group"], r["name"], r["value"]))
    assert got == want
    lost = spark.createDataFrame([(f"file:{tmp_path}/none.jpg",)], "path string")
    assert [(r["group"], r["name"]) for r in containers.tags_of_files(lost).collect()] == [("File", "Error")]
    whole = containers.read_tags(spark, str(tmp_path), "*.{CR3,png}", ranged=False)
    assert sorted((r["path"].rsplit("/", 1)[1], r["group"], r["name"], r["value"]) for r in whole.collect()) == sorted((n, *t) for n in ("b.CR3", "d.png") for t in want[n])
