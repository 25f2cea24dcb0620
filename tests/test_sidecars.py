"""Sidecars are patched by path, and written all or none."""

import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quarry.operators import metadata as M
from quarry.sources import sidecars as S

OLD = """<?xml version="1.0"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
<rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmp:Rating="2">
  <xmp:Label>Red</xmp:Label><dc:subject>
   <rdf:Bag><rdf:li>old</rdf:li></rdf:Bag></dc:subject><dc:title>stays</dc:title></rdf:Description></rdf:RDF></x:xmpmeta>"""
BARE = S.EMPTY


@pytest.fixture
def library(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.xmp", OLD), ("sub/b.XMP", BARE), ("c.xmp", OLD), ("broken.xmp", "nothing here"), ("a.jpg", "jpg")):
        (tmp_path / name).write_text(text)
    os.chmod(tmp_path / "a.xmp", 0o640)
    return tmp_path


def changes(spark, root):
    at = lambda name: f"file://{root}/{name}"
    rows = [
        (at("a.xmp"), "xmp:Rating", False, ["5"]), (at("a.xmp"), "xmp:Label", False, ['<$1 & \\ "x">']), (at("a.xmp"), "dc:subject", True, ["sea & sky", "$0\\"]), (at("a.xmp"), "lr:hierarchicalSubject", True, ["a|b"]),
        (at("sub/b.XMP"), "digiKam:PickLabel", False, ["3"]), (at("sub/b.XMP"), "dc:subject", True, ["é"]), (at("sub/b.XMP"), "xmp:Rating", False, None),
        (at("new/d.xmp"), "xmp:Rating", False, ["1"]), (at("broken.xmp"), "xmp:Rating", False, ["1"]),
        (at("c.xmp"), "xmp:Label", False, []), (at("c.xmp"), "dc:subject", True, None), (at("c.xmp"), "xmp:Rating", False, None),
    ]
    return spark.createDataFrame(rows, S.CHANGE).repartition(3)


def fields(spark, root):
    rows = M.xmp_fields(S.read_sidecars(spark, f"file://{root}")).collect()
    return {r["path"].split(str(root))[1]: (r["rating"], r["color_label"], r["pick_label"], r["keywords"], r["hierarchical_keywords"]) for r in rows}


WANT = {
    "/a.xmp": (5, '<$1 & \\ "x">', None, ["sea & sky", "$0\\"], ["a|b"]),
    "/sub/b.XMP": (None, None, "accepted", ["é"], []),
    "/new/d.xmp": (1, None, None, [], []),
    "/c.xmp": (None, None, None, [], []),
    "/broken.xmp": (None, None, None, [], []),
}


def test_round_trip(spark, library):
    merged = S.merged(S.read_sidecars(spark, f"file://{library}").withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")), changes(spark, library))
    assert [r["path"].rsplit("/", 1)[1] for r in merged.where("problem IS NOT NULL").collect()] == ["broken.xmp"]
    assert S.write_sidecars(merged.where("problem IS NULL"), f"file://{library}") == 4
    got = fields(spark, library)
    assert {k: v[:2] + v[3:] for k, v in got.items()} == {k: v[:2] + v[3:] for k, v in WANT.items()}
    assert got["/sub/b.XMP"][2] is not None and got["/a.xmp"][2] is None
    for name in ("a.xmp", "sub/b.XMP", "new/d.xmp", "c.xmp"):
        ET.parse(library / name)  # well-formed
    assert "<dc:title>stays</dc:title>" in (library / "a.xmp").read_text() and os.stat(library / "a.xmp").st_mode & 0o777 == 0o640
    again = S.merged(S.read_sidecars(spark, f"file://{library}").withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")), changes(spark, library))
    S.write_sidecars(again.where("problem IS NULL"), f"file://{library}")
    assert fields(spark, library) == got
    assert not [p for p in library.iterdir() if p.name.startswith(".")]


def test_a_failed_task_changes_nothing(spark, library):
    before = {p: p.read_bytes() for p in library.rglob("*") if p.is_file()}
    rows = spark.range(40).select(F.concat(F.lit(f"file://{library}/n"), F.col("id").cast("string"), F.lit(".xmp")).alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("half-way"))).otherwise("text").alias("xml"))
    rows = rows.union(spark.createDataFrame([(f"file://{library}/a.xmp", "replaced")], "path string, xml string"))
    with pytest.raises(Exception, match="half-way"):
        S.write_sidecars(rows, f"file://{library}")
    assert {p: p.read_bytes() for p in library.rglob("*") if p.is_file()} == before
    with pytest.raises(ValueError, match="more than one row"):
        S.write_sidecars(spark.createDataFrame([("file:/x", "1"), ("file:/x", "2")], "path string, xml string"), f"file://{library}")


def test_a_lost_driver(spark, library):
    root = f"file://{library}"
    rows = spark.createDataFrame([(f"{root}/a.xmp", "one"), (f"{root}/c.xmp", "two")], "path string, xml string")
    ready = S.stage(rows, root)
    moves = {r["path"]: r["staged"] for r in spark.read.parquet(f"{ready}/moves").collect()}
    os.replace(moves[f"{root}/a.xmp"].removeprefix("file://"), library / "a.xmp")  # lost after one move
    unready = S.stage(rows.where("false"), root)
    os.remove(f"{unready.removeprefix('file://')}/ready")
    assert (library / "c.xmp").read_text() == OLD
    assert S.recover(spark, root) == 2
    assert ((library / "a.xmp").read_text(), (library / "c.xmp").read_text()) == ("one", "two")
    assert not [p for p in library.iterdir() if p.name.startswith(".")] and S.recover(spark, root) == 0
