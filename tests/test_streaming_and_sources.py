"""Streams, file scans, containers and snapshots."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.operators import metadata as M
from quarry.operators import projection as P
from quarry.operators import storage as G
from quarry.sources import catalog, containers
from quarry.streaming import projections as R


def drain(stream, name, mode):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_stream_folds_as_the_batch_does(spark, tmp_path):
    rows = [("a", "m", 5, 1, "x", "r"), ("a", "m", 4, 2, "late", "r"), ("b", "m", 1, 3, "x", "r")], [("a", "m", 5, 4, "tie", "r"), ("b", "m", 0, 5, "late", "r"), ("c", "m", 9, 6, "new", "r")]
    schema = "path string, projection_kind string, valid_at long, arrival long, status string, source_revision string"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = drain(R.accepted_observations(stream), "accepted", "update")
    last = {}
    for r in got:
        if r["path"] not in last or (r["valid_at"], r["arrival"]) >= last[r["path"]][:2]:
            last[r["path"]] = (r["valid_at"], r["arrival"], r["status"])
    batch = P.latest(spark.read.schema(schema).parquet(f"{tmp_path}/in/*")).collect()
    assert {k: v[2] for k, v in last.items()} == {r["path"]: r["status"] for r in batch} == {"a": "tie", "b": "x", "c": "new"}


def test_windowed_activity_and_audit(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/events").schema).parquet(f"{tmp_path}/events")
    got = {(r["start"], r["event_type"]): r["n"] for r in drain(R.activity(stream), "activity", "complete")}
    batch = spark.read.parquet(f"{tmp_path}/events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().collect()
    assert got == {(r["w"]["start"], r["event_type"]): r["count"] for r in batch}
    audit = stream.select(F.col("ts").alias("at"), (F.col("event_id") % 10).cast("string").alias("request_id"))
    assert len(drain(R.audit_log(audit, "3650 days"), "audit", "append")) == 10


def tiff() -> bytes:
    """A little-endian block: Make, an EXIF directory with FNumber 40/10 and ISO, a GPS directory."""
    entry = lambda tag, kind, n, value: struct.pack("<HHI", tag, kind, n) + value
    main = struct.pack("<H", 3) + entry(0x010F, 2, 6, struct.pack("<I", 200)) + entry(0x8769, 4, 1, struct.pack("<I", 60)) + entry(0x8825, 4, 1, struct.pack("<I", 110)) + b"\0" * 4
    exif = struct.pack("<H", 2) + entry(0x829D, 5, 1, struct.pack("<I", 210)) + entry(0x8827, 3, 1, struct.pack("<HH", 400, 0)) + b"\0" * 4
    gps = struct.pack("<H", 1) + entry(1, 2, 2, b"N\0\0\0") + b"\0" * 4
    out = bytearray(240)
    out[:8] = b"II*\0" + struct.pack("<I", 8)
    out[8 : 8 + len(main)], out[60 : 60 + len(exif)], out[110 : 110 + len(gps)] = main, exif, gps
    out[200:206], out[210:218] = b"Canon\0", struct.pack("<II", 40, 10)
    return bytes(out)


XMP = b"""<x:xmpmeta><rdf:RDF><rdf:Description xmp:Rating="4" xmlns:xmp="u"><dc:subject><rdf:Bag><rdf:li>a &amp; b</rdf:li><rdf:li>c</rdf:li></rdf:Bag></dc:subject><xmp:Label>Red</xmp:Label></rdf:Description></rdf:RDF></x:xmpmeta>"""


def files() -> dict[str, bytes]:
    segment = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    riff = lambda k, body: k + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return {
        "a.jpg": b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tiff()) + segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + XMP) + segment(0xC0, b"\x08" + struct.pack(">HH", 30, 40) + b"\0" * 4) + b"\xff\xda\0\2",
        "b.png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 7, 5) + b"\0" * 5) + chunk(b"eXIf", tiff()) + chunk(b"IEND", b""),
        "c.webp": b"RIFF\0\0\0\0WEBP" + riff(b"EXIF", tiff()) + riff(b"XMP ", XMP),
        "d.tif": tiff(),
        "sub/e.gif": b"GIF89a" + struct.pack("<HH", 3, 2) + b"\0",
        "sub/f.xmp": XMP,
        "g.jpg": b"\xff\xd8\xff",
        "empty.png": b"",
        "sub/deep/h.ARW": b"junk",
        "sub/deep/h.xmp": XMP,
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    for name, data in files().items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root


def test_containers(spark, folder):
    tags = containers.read_tags(spark, str(folder))
    got = {}
    for r in tags.collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], {})[f"{r['group']}:{r['name']}"] = r["value"]
    exif = {"EXIF:Make": "Canon", "EXIF:FNumber": "4", "EXIF:ISO": "400", "GPS:GPSLatitudeRef": "N"}
    xmp = {"XMP:Rating": "4", "XMP:Label": "Red", "XMP:Subject": "a & b, c"}
    assert got["a.jpg"] == exif | xmp | {"File:ImageSize": "40x30"}
    assert got["b.png"] == exif | {"File:ImageSize": "7x5"}
    assert got["c.webp"] == exif | xmp and got["d.tif"] == exif and got["e.gif"] == {"File:ImageSize": "3x2"}
    assert got["f.xmp"] == xmp and "g.jpg" not in got and "empty.png" not in got
    wide = {r["path"].rsplit("/", 1)[1]: r for r in M.capture(tags).collect()}
    assert (wide["a.jpg"]["aperture"], wide["a.jpg"]["iso"], wide["a.jpg"]["vendor"]) == ("f/4", "400", "canon")
    whole = tiff()
    for cut in range(len(whole)):
        list(containers.tags_of(whole[:cut]))


def test_exiftool_output(spark):
    lines = spark.createDataFrame([('{"SourceFile": "/a", "EXIF:Make": "X", "XMP:Rating": 3}',), ("broken",)], "value string")
    assert sorted((r["path"], r["group"], r["name"], r["value"]) for r in containers.exiftool_tags(lines).collect()) == [("/a", "EXIF", "Make", "X"), ("/a", "XMP", "Rating", "3")]


def test_scan(spark, folder):
    root = f"file:{folder}"
    listing = catalog.files(spark, str(folder))
    got = {r["name"]: (r["kind"], r["extension"], r["has_sidecar"]) for r in catalog.assets(listing).collect()}
    assert got["h.ARW"] == ("raw", "ARW", True) and got["a.jpg"] == ("jpeg", "JPG", False)
    assert set(got) == {"a.jpg", "b.png", "c.webp", "d.tif", "g.jpg", "h.ARW"}  # Spark passes over files of no bytes
    tree = {r["name"]: (r["has_children"], r["depth"]) for r in catalog.directories(listing, root).orderBy(*catalog.directory_order()).collect()}
    assert tree == {"sub": (True, 1), "deep": (False, 2)}


def test_walk(spark, folder):
    (folder / "bare" / "er").mkdir(parents=True)
    root = f"file://{folder}"
    found = catalog.walk(spark, root)
    listing = found.where("NOT is_directory")
    assert {r["path"].rsplit("/", 1)[1]: r["size_bytes"] for r in listing.collect()} == {n.rsplit("/", 1)[-1]: len(d) for n, d in files().items()}
    assert "empty.png" in {r["name"] for r in catalog.assets(listing).collect()}
    tree = {r["name"]: (r["has_children"], r["depth"]) for r in catalog.listed_directories(found).collect()}
    assert tree == {"sub": (True, 1), "deep": (False, 2), "bare": (True, 1), "er": (False, 2)}
    assert catalog.walk(spark, root, recursive=False).where("is_directory").count() == 2
    assert catalog.walk(spark, f"{root}/bare/er").count() == 0
    with pytest.raises(OSError, match="cannot be listed"):
        catalog.walk(spark, f"{root}/none")


def test_walk_visits_each_directory_once(spark, tmp_path):
    for name in ("top/b/deep", "top/A/one", "top/a", "out"):
        (tmp_path / name).mkdir(parents=True)
    for name in ("top/b/deep/x.jpg", "top/a/y.jpg", "out/z.jpg"):
        (tmp_path / name).write_bytes(b"1")
    (tmp_path / "top/b/deep/up").symlink_to(tmp_path / "top")  # a loop
    (tmp_path / "top/A/again").symlink_to(tmp_path / "top/b")  # reached before under its own name
    (tmp_path / "top/a/away").symlink_to(tmp_path / "out")
    (tmp_path / "top/c").symlink_to(tmp_path / "top/A/one")  # reached first by the link
    (tmp_path / "top/none").symlink_to(tmp_path / "missing")
    (tmp_path / "linked").symlink_to(tmp_path / "top")

    def lister(uri):
        if uri.endswith("/deep"):
            raise PermissionError(13, "denied")
        return catalog.listed(uri)

    base = f"file://{tmp_path}/top"
    directories = lambda found: [(r["path"][len(base) + 1 :], r["name"], r["depth"], r["sequence"], r["error"]) for r in found.where("is_directory").orderBy("sequence").collect()]
    whole = [("A", "A", 1, 1, None), ("a", "a", 1, 2, None), ("b", "b", 1, 3, None), ("A/one", "c", 1, 4, None), ("b/deep", "deep", 2, 5, None)]
    found = catalog.walk(spark, f"file://{tmp_path}/linked")
    assert directories(found) == whole
    assert sorted(r["path"][len(base) + 1 :] for r in found.where("NOT is_directory").collect()) == ["a/y.jpg", "b/deep/x.jpg"]
    denied = catalog.walk(spark, base, lister=lister)
    assert directories(denied) == [*whole[:-1], ("b/deep", "deep", 2, 5, "PermissionError: denied")]
    old = found.where("NOT is_directory").select(F.lit(base).alias("root_path"), "path", F.lit(1).cast("long").alias("scan_id")).union(spark.createDataFrame([(base, f"{base}/a/gone.jpg", 1), ("other", f"{base}/b/deep/x.jpg", 1)], "root_path string, path string, scan_id long"))
    seen, unread = denied.where("NOT is_directory").select("path"), denied.where("error IS NOT NULL").select("path")
    after = G.next_generation(old, seen, ["path"], base, 2, unread).collect()
    assert sorted((r["root_path"] == base, r["path"][len(base) + 1 :], r["scan_id"]) for r in after) == [(False, "b/deep/x.jpg", 1), (True, "a/y.jpg", 2), (True, "b/deep/x.jpg", 1)]


def test_snapshots(spark, tmp_path):
    versions = catalog.Snapshots(spark, f"file://{tmp_path}/snap")
    with pytest.raises(LookupError):
        versions.read()
    for n in (1, 2, 3):
        assert versions.publish(spark.range(n), expected=n - 1) == n
    assert versions.read().count() == 3 and versions.read(2).count() == 2
    with pytest.raises(LookupError):
        versions.read(1)
    with pytest.raises(ValueError, match="current"):
        versions.publish(spark.range(1), expected=1)
    late = catalog.Snapshots(spark, f"file://{tmp_path}/snap")
    late._numbers = lambda: [(2, "x")]  # another writer's view of before
    with pytest.raises(ValueError, match="another writer"):
        late.publish(spark.range(9), expected=2)
    assert versions.read().count() == 3 and len(list((tmp_path / "snap" / "data").iterdir())) == 2
