"""XMP sidecars: read, patched by path, and written so that a job changes all of its files or none.

Writing goes in two jobs. The first puts every new text into a staging folder beside the library, under names of its own, and ends with a
table of what goes where; where it fails, the folder goes and no sidecar has changed. A mark then makes the table the truth, and the second
job moves each text to its place in one step of the file system. It can be done again from the table as often as it is cut off: what has been
moved is passed over. (Object stores without a rename move by copying; there a reader may see a file for a moment as it was or not at all.)
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import escape_xml
from quarry.sources.log import deleted, located as hadoop
from quarry.sources.ranged import located

#: The namespaces of the properties that the catalog writes.
NAMESPACES = {"xmp": "http://ns.adobe.com/xap/1.0/", "dc": "http://purl.org/dc/elements/1.1/", "lr": "http://ns.adobe.com/lightroom/1.0/", "digiKam": "http://www.digikam.org/ns/1.0/"}
EMPTY = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about=""/></rdf:RDF></x:xmpmeta>'
CHANGE = "path string, name string, bag boolean, values array<string>"
OPENING = r"(?s)<rdf:Description(?=[\s/>])([^>]*?)(/?)>"
_STAGED, _READY = ".sidecars-", "ready"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml) of the sidecars below a path."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[xX][mM][pP]").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def _put_in(xml: Column, attributes: Column, inside: Column) -> Column:
    """The text with attributes added to the first description, and elements put at the front of what it holds."""
    before = F.regexp_extract(xml, r"(?s)^(.*?<rdf:Description)(?=[\s/>])", 1)
    own, closed = F.regexp_extract(xml, OPENING, 1), F.regexp_extract(xml, OPENING, 2)
    after = F.substring(xml, F.length(before) + F.length(own) + F.length(closed) + 2, F.length(xml))
    body = F.when((closed == "/") & (inside != ""), F.concat(F.lit(">"), inside, F.lit("</rdf:Description>"))).when(closed == "/", F.lit("/>")).otherwise(F.concat(F.lit(">"), inside))
    return F.concat(before, F.regexp_replace(own, r"\s+$", ""), attributes, body, after)


def _changed(xml: Column, c: Column) -> Column:
    """The text with one property set: its attribute and its element go, and what the change says comes, if anything."""
    name, values = F.concat(F.lit(r"\Q"), c["name"], F.lit(r"\E")), F.coalesce(c["values"], F.array().cast("array<string>"))
    bare = F.regexp_replace(xml, F.concat(F.lit(r"\s"), name, F.lit(r"""\s*=\s*(?:"[^"]*"|'[^']*')""")), F.lit(""))
    bare = F.regexp_replace(bare, F.concat(F.lit("(?s)<"), name, F.lit(r"(?:\s[^>]*)?(?:/>|(?<!/)>.*?</"), name, F.lit(r"\s*>)")), F.lit(""))
    prefix = F.substring_index(c["name"], ":", 1)
    known = F.create_map(*(F.lit(x) for pair in NAMESPACES.items() for x in pair))
    declared = F.contains(bare, F.concat(F.lit("xmlns:"), prefix, F.lit("=")))
    space = F.when(declared | F.element_at(known, prefix).isNull(), "").otherwise(F.concat(F.lit(" xmlns:"), prefix, F.lit('="'), F.element_at(known, prefix), F.lit('"')))
    items = F.array_join(F.transform(values, lambda v: F.concat(F.lit("<rdf:li>"), escape_xml(v), F.lit("</rdf:li>"))), "")
    bag = F.concat(F.lit("<"), c["name"], F.lit("><rdf:Bag>"), items, F.lit("</rdf:Bag></"), c["name"], F.lit(">"))
    attribute = F.concat(F.lit(" "), c["name"], F.lit('="'), escape_xml(F.get(values, 0)), F.lit('"'))
    made = F.when(c["bag"], _put_in(bare, space, bag)).otherwise(_put_in(bare, F.concat(space, attribute), F.lit("")))
    return F.when(F.size(values) == 0, bare).otherwise(made)


def merged(sidecars: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, xml, problem): the sidecars (path, xml) that changes (path, name, bag, values) touch, as they are to be.

    A change sets a property, such as xmp:Label, to its one value, or a bag, such as dc:subject, to its values; without values, or with null, it takes it away. Changes of one path are
    merged; of several to one property the greatest values count. A path without a sidecar gets a new one. Where a sidecar has no description its text is null and the problem is told.
    """
    one = changes.groupBy("path", "name").agg(F.max(F.struct("bag", "values")).alias("c"))
    listed = one.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "c.bag", "c.values"))).alias("changes"))
    both = listed.join(sidecars.select("path", "xml"), "path", "left").select("path", "changes", F.coalesce("xml", F.lit(EMPTY)).alias("xml"))
    sound = F.col("xml").rlike(OPENING)
    return both.select("path", F.when(sound, F.aggregate("changes", F.col("xml"), _changed)).alias("xml"), F.when(~sound, "no description").alias("problem"))


def _each(act: Callable[[str, str | None], str | None], names: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (batch.column(k).to_pylist() for k in range(2))
            done = [act(a, b) for a, b in zip(first, second, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(done, pa.string())], names=list(names))

    return task


def stage(rows: DataFrame, root: str) -> str:
    """Puts the texts of rows (path, xml) into a staging folder below the root and marks it ready; returns the folder. Where a task fails the folder goes and the error stays."""
    spark = rows.sparkSession
    folder = f"{root.rstrip('/')}/{_STAGED}{uuid.uuid4().hex}"
    if not rows.groupBy("path").count().where("count > 1").isEmpty():
        raise ValueError("a path stands in more than one row")

    def put(path: str, xml: str | None) -> str:
        system, inside = located(f"{folder}/{uuid.uuid4().hex}")  # an attempt's own; of one that fails nothing is used
        with system.open_output_stream(inside) as out:
            out.write((xml or "").encode())
        return f"{folder}/{os.path.basename(inside)}"

    try:
        system, inside = located(folder)
        system.create_dir(inside)
        rows.select("path", "xml").mapInArrow(_each(put, ("path", "staged")), "path string, staged string").write.parquet(f"{folder}/moves")
        path, store = hadoop(spark, f"{folder}/{_READY}")
        store.create(path, False).close()
    except Exception:
        deleted(spark, folder)
        raise
    return folder


def finish(spark: SparkSession, folder: str) -> int:
    """Moves what a ready folder holds to its places, and takes the folder away; the number of sidecars. It may be done again after any failure."""

    def move(path: str, staged: str | None) -> None:
        (system, source), (_, target) = located(staged), located(path)
        if system.get_file_info(source).type != fs.FileType.File:
            return  # moved by an earlier attempt
        if isinstance(system, fs.LocalFileSystem) and os.path.exists(target):
            os.chmod(source, os.stat(target).st_mode)
        system.create_dir(os.path.dirname(target))
        system.move(source, target)

    moves = spark.read.schema("path string, staged string").parquet(f"{folder}/moves")
    number = moves.mapInArrow(_each(move, ("path", "done")), "path string, done string").count()
    deleted(spark, folder)
    return number


def write_sidecars(rows: DataFrame, root: str) -> int:
    """Writes rows (path, xml) below a root: all of them, or none where a task fails for good. Folders on the way to a path are made; a file that is there keeps its mode."""
    return finish(rows.sparkSession, stage(rows, root))


def recover(spark: SparkSession, root: str) -> int:
    """After a driver was lost, with no other writer at work: finishes what was ready, takes away what was not; the number of sidecars moved."""
    path, store = hadoop(spark, root)
    left = [f.getPath().toString() for f in store.listStatus(path) if f.getPath().getName().startswith(_STAGED)]
    number = 0
    for folder in left:
        mark, store = hadoop(spark, f"{folder}/{_READY}")
        if store.exists(mark):
            number += finish(spark, folder)
        else:
            deleted(spark, folder)
    return number
