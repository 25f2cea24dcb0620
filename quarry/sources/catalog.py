"""The asset relation from a file tree, and its versioned snapshots."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import ascii_lower, ascii_upper, asset_kind, base_name, extension, parent_path, stable_id, stem_path
from quarry.operators.query import dense_order
from quarry.sources.log import Log, deleted
from quarry.sources.ranged import located
from quarry.tables import kept, partitions


def files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, size_bytes, modified_at_ms) of the files below a root, without opening them. Files of no bytes are passed over."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("modified_at_ms"))


ENTRY = "parent_sequence long, name string, path string, is_directory boolean, size_bytes long, modified_at_ms long, error string"
Listed = tuple[str, str, bool, int, int]


def listed(uri: str) -> list[Listed]:
    """(name, path, is_directory, size_bytes, modified_at_ms) of what a directory holds. A local directory's path is its real one, links followed."""
    system, inside = located(uri)
    found = system.get_file_info(fs.FileSelector(inside))
    rows = []
    for i in found:
        if i.type in (fs.FileType.File, fs.FileType.Directory):
            is_directory = i.type == fs.FileType.Directory
            real = is_directory and isinstance(system, fs.LocalFileSystem)
            path = "file://" + os.path.realpath(i.path) if real else f"{uri.rstrip('/')}/{i.base_name}"
            rows.append((i.base_name, path, is_directory, i.size or 0, (i.mtime_ns or 0) // 1_000_000))
    return rows


def _entries(lister: Callable[[str], list[Listed]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the directories (sequence, path) of a batch hold; one that cannot be listed is a row of its own with the error."""
    names = [f.split(" ")[0] for f in ENTRY.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sequence, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = [(sequence, *entry, None) for entry in lister(path)]
                except OSError as e:
                    rows = [(sequence, None, path, True, None, None, f"{type(e).__name__}: {e.strerror or e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return task


def real_root(root: str) -> str:
    """A local root's real path; others as they are, without a slash at the end."""
    system, inside = located(root)
    return "file://" + os.path.realpath(inside) if isinstance(system, fs.LocalFileSystem) else root.rstrip("/")


def walk(spark: SparkSession, root: str, recursive: bool = True, lister: Callable[[str], list[Listed]] = listed) -> DataFrame:
    """(path, name, is_directory, size_bytes, modified_at_ms, depth, sequence, error) of all that is below a root URI, empty files and directories too.

    Breadth first: a level's directories are listed by tasks and are the next level's input; nothing but their number comes to the driver. Links are followed, and a directory
    is visited once, by its real path, where it is first reached; links that lead out of the root are left. sequence numbers the directories by depth, their parent's number and
    their name; files have none. A directory that cannot be listed has an error, and what is below it is unknown: an index keeps its rows. A root that cannot be listed is an error.
    """
    root = real_root(root)
    level = spark.createDataFrame([(0, root)], "sequence long, path string")
    visited = level.select("path")
    files, directories, errors, before = [], [], [], 1
    depth = 0
    while True:
        depth += 1
        entries = kept(level.select("sequence", "path").repartition(partitions(spark)).mapInArrow(_entries(lister), ENTRY), "entries")
        failed = entries.where("error IS NOT NULL").select("path", "error")
        if depth == 1 and (wrong := failed.first()) is not None:
            raise OSError(f"{root} cannot be listed: {wrong['error']}")
        errors.append(failed)
        files.append(entries.where("NOT is_directory").withColumn("depth", F.lit(depth)))
        inside = entries.where(F.col("is_directory") & F.col("error").isNull() & F.startswith("path", F.lit(root + "/")))
        place = F.struct("parent_sequence", ascii_lower(F.col("name")).alias("folded"), "name")
        fresh = inside.groupBy("path").agg(F.min(place).alias("first"), F.max("modified_at_ms").alias("modified_at_ms")).join(visited, "path", "left_anti")
        level = kept(dense_order(fresh, F.col("first"), F.col("path")).select((F.col("place") + before).alias("sequence"), "path", F.col("first.name").alias("name"), "modified_at_ms", F.lit(depth).alias("depth")), "directories")
        number = level.count()
        if number:
            directories.append(level)
            visited = visited.union(level.select("path"))
            before += number
        if not number or not recursive:
            break
    columns = ["path", "name", "is_directory", "size_bytes", "modified_at_ms", "depth", "sequence", "error"]
    out = reduce(DataFrame.unionByName, files).withColumn("sequence", F.lit(None).cast("long")).select(*columns)
    if directories:
        every = reduce(DataFrame.unionByName, directories).withColumns({"is_directory": F.lit(True), "size_bytes": F.lit(0).cast("long")})
        out = out.unionByName(every.join(reduce(DataFrame.unionByName, errors), "path", "left").select(*columns))
    return out


def listed_directories(found: DataFrame) -> DataFrame:
    """(path, parent_path, name, has_children, depth, sequence, error) of the directories of a walk."""
    each = found.where("is_directory").select("path", "name", "depth", "sequence", "error")
    parents = each.select(parent_path(F.col("path")).alias("path")).distinct().withColumn("has_children", F.lit(True))
    return each.join(parents, "path", "left").select("path", parent_path(F.col("path")).alias("parent_path"), "name", F.coalesce("has_children", F.lit(False)).alias("has_children"), "depth", "sequence", "error")


def assets(listing: DataFrame) -> DataFrame:
    """Supported files as asset rows; a sidecar beside one, the same path with the extension xmp, is noted and is no row of its own."""
    split = listing.withColumns({"name": base_name(F.col("path")), "ext": extension(F.col("path")), "stem": stem_path(F.col("path"))})
    sidecars = split.where(ascii_lower(F.col("ext")) == "xmp").select("stem").distinct().withColumn("has_sidecar", F.lit(True))
    rows = split.withColumn("kind", asset_kind(F.col("ext"))).where("kind IS NOT NULL").join(sidecars, "stem", "left")
    return rows.select(
        stable_id(F.col("path")).alias("id"), "path", "name", ascii_upper(F.col("ext")).alias("extension"), "kind", "size_bytes", F.coalesce("modified_at_ms", F.lit(0)).alias("modified_at_ms"),
        F.coalesce("has_sidecar", F.lit(False)).alias("has_sidecar"), parent_path(F.col("path")).alias("parent_path"))


def directories(listing: DataFrame, root: str) -> DataFrame:
    """(path, parent_path, name, has_children, depth) of every directory below the root that holds a file at some depth."""
    root = root.rstrip("/")
    below = F.split(F.substring(parent_path(F.col("path")), len(root) + 2, F.length("path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(below)), lambda k: F.struct(F.array_join(F.slice(below, 1, k), "/").alias("sub"), k.alias("depth")))
    each = listing.where(parent_path(F.col("path")) != root).select(F.explode(up).alias("d")).select(F.concat(F.lit(root + "/"), F.col("d.sub")).alias("path"), F.col("d.depth").alias("depth")).distinct()
    parents = each.select(parent_path(F.col("path")).alias("path")).distinct().withColumn("has_children", F.lit(True))
    return each.join(parents, "path", "left").select("path", parent_path(F.col("path")).alias("parent_path"), base_name(F.col("path")).alias("name"), F.coalesce("has_children", F.lit(False)).alias("has_children"), "depth")


def directory_order() -> list:
    return [ascii_lower(F.col("name")), F.col("name"), F.col("path")]


class Snapshots:
    """Immutable versions of a relation under one folder. Version n is current where entry n is the newest of the log; the two newest versions are kept, older ones removed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, f"{self.folder}/log")

    def _numbers(self) -> list[tuple[int, str]]:
        """The numbers and versions of the entries, the newest first."""
        return self.log.newest(3)

    def publish(self, df: DataFrame, expected: int | None = None) -> int:
        """Writes a version and makes it current; refused where another number than expected is current, or where another writer takes the number first."""
        now = self._numbers()
        current = now[0][0] if now else 0
        if expected is not None and expected != current:
            raise ValueError(f"version {current} is current, not {expected}")
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/data/{version}")
        try:
            self.log.append(current + 1, version)
        except ValueError:
            deleted(self.spark, f"{self.folder}/data/{version}")
            raise
        for number, old in self._numbers()[2:]:
            deleted(self.spark, f"{self.folder}/data/{old}")
            self.log.delete(number)
        return current + 1

    def read(self, number: int | None = None) -> DataFrame:
        """The current version, or the one asked for if it is one of the two newest."""
        for n, version in self._numbers()[:2]:
            if number is None or n == number:
                return self.spark.read.parquet(f"{self.folder}/data/{version}")
        raise LookupError("stale" if number is not None else "nothing is published")
