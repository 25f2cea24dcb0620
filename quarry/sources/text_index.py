"""A stored positional index over a catalog's rows, in segments that follow the changes.

A segment is three tables: the row versions it brings, their postings (a row per word, sorted by word and dealt out by ranges of
words, so that a file holds a range), and for each file of postings its first and last word. A prefix is a range of words: a
search reads the files whose ranges it meets, and no others.

A scan of a root compares its rows with the stored ones. Rows that are as they were take part with nothing but the scan's number, which
stands once for the root; new and changed rows, and marks for those that are gone, make a segment. Readers take the newest version of each
row: postings count unless a later segment has the row too. Segments are folded into one when there are too many, or too much is void.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.search import Term, fits, index, match_all, query_terms
from quarry.operators.storage import snapshot_blocked
from quarry.sources.log import Log, deleted
from quarry.tables import partitions

ROOT, GENERATION, GONE = "root_path", "generation", "gone"
#: Rows of a file of postings.
MOST_POSTINGS = 50_000_000
RESERVED = (ROOT, GENERATION, GONE, "field", "at", "word", "print1", "print2", "scan_id")


def meets(low: Column, high: Column, t: Term) -> Column:
    """Whether a range of words can hold one that a query's word fits."""
    up_to = (low <= t.word) | low.startswith(t.word) if t.last else low <= t.word
    return (high >= t.word) & up_to


class TextIndex:
    """The index of rows (root_path, key, columns) under one folder; `fields` are the columns that are searched. Versions are fenced by a log, as those of Snapshots."""

    def __init__(self, spark: SparkSession, folder: str, key: str, fields: tuple[str, ...], files: int | None = None, most_segments: int = 8):
        self.spark, self.folder, self.key, self.fields = spark, folder.rstrip("/"), key, fields
        self.files, self.most_segments = files or partitions(spark), most_segments
        self.log = Log(spark, f"{self.folder}/log")

    def state(self) -> tuple[int, dict]:
        """The current version's number and what it holds: the segments, oldest first, and the number of each root's last scan."""
        newest = self.log.newest(1)
        return (newest[0][0], json.loads(newest[0][1])) if newest else (0, {"segments": [], "scans": {}})

    def _table(self, segment: dict, name: str) -> str:
        return f"{self.folder}/segments/{segment['name']}/{name}"

    def _read(self, state: dict, segment: dict, name: str, *files: str) -> DataFrame:
        columns = StructType.fromJson(state["schema"])
        key = columns[self.key].dataType.simpleString()
        schema = {"rows": columns, "postings": f"{ROOT} string, `{self.key}` {key}, field string, at int, word string", "files": "file string, low string, high string, n_postings long"}[name]
        return self.spark.read.schema(schema).parquet(*(files or (self._table(segment, name),))).withColumn(GENERATION, F.lit(segment["generation"]))

    def _all(self, state: dict, name: str, segments: list[dict]) -> DataFrame:
        return reduce(DataFrame.unionByName, (self._read(state, s, name) for s in segments))

    def _replaced(self, state: dict) -> DataFrame:
        """(root, key, newer): the rows that segments after the first bring or end, and in which generation last. It grows with the changes since the last folding."""
        return self._all(state, "rows", state["segments"][1:]).groupBy(ROOT, self.key).agg(F.max(GENERATION).alias("newer"))

    def _newest(self, versions: DataFrame, state: dict) -> DataFrame:
        """The rows of a table of versions or postings that no later segment replaces."""
        if len(state["segments"]) < 2:
            return versions
        replaced = self._replaced(state).withColumnsRenamed({ROOT: "_root", self.key: "_key"})
        same = F.col(ROOT).eqNullSafe(F.col("_root")) & F.col(self.key).eqNullSafe(F.col("_key")) & (F.col(GENERATION) < F.col("newer"))
        return versions.join(replaced, same, "left_anti")

    def rows(self) -> DataFrame:
        """The rows as they are now, each with its root's last scan as scan_id."""
        _, state = self.state()
        if not state["segments"]:
            raise LookupError("nothing is indexed")
        scans = self.spark.createDataFrame(list(state["scans"].items()), f"{ROOT} string, scan_id long")  # one row per root
        live = self._newest(self._all(state, "rows", state["segments"]), state).where(~F.col(GONE))
        return live.join(scans, ROOT).drop(GENERATION, GONE, "print1", "print2")

    def _put(self, name: str, rows: DataFrame) -> dict | None:
        """Writes a segment's tables; none where there are no rows."""
        path = f"{self.folder}/segments/{name}"
        rows.write.parquet(f"{path}/rows")
        written = self.spark.read.schema(rows.schema).parquet(f"{path}/rows")
        size = written.agg(F.count("*").alias("n"), F.count_if(GONE).alias("gone")).first()
        if not size["n"]:
            return None
        self._put_postings(path, index(written.where(~F.col(GONE)), (ROOT, self.key), *self.fields), size["n"])
        return {"name": name, "rows": size["n"], "gone": size["gone"]}

    def _put_postings(self, path: str, postings: DataFrame, n_rows: int) -> None:
        order = ["word", ROOT, self.key, "field", "at"]
        files = max(1, min(self.files, n_rows // 1000 + 1))  # a small change makes few files
        ranged = postings.repartitionByRange(files, *order).sortWithinPartitions(*order)  # a word of any frequency is dealt out by its rows
        ranged.write.option("maxRecordsPerFile", MOST_POSTINGS).parquet(f"{path}/postings")
        written = self.spark.read.schema(ranged.schema).parquet(f"{path}/postings").select("word", F.col("_metadata.file_name").alias("file"))
        bounds = written.groupBy("file").agg(F.min("word").alias("low"), F.max("word").alias("high"), F.count("*").alias("n_postings"))
        bounds.coalesce(1).write.parquet(f"{path}/files")

    def apply(self, root: str, scanned: DataFrame, scan_id: int | None = None, expected: int | None = None, unread: DataFrame | None = None) -> int:
        """Makes the index hold, of this root, just the scanned rows (key and columns); other roots stay. Returns the new version's number.

        A key is one row's; scanned rows with the same key are an error. Refused where another version than expected is current, or another writer is first.
        unread (path) are directories that a walk could not list: where keys are paths, rows at or below one stay though the scan did not see them.
        """
        clash = [c for c in scanned.columns if c in RESERVED]
        if clash:
            raise ValueError(f"reserved columns: {clash}")
        if not scanned.groupBy(self.key).count().where("count > 1").isEmpty():
            raise ValueError("a key stands in more than one row")
        number, state = self.state()
        if expected is not None and expected != number:
            raise ValueError(f"version {number} is current, not {expected}")
        generation = max((s["generation"] for s in state["segments"]), default=0) + 1
        columns = [c for c in scanned.columns if c != self.key]
        prints = [F.xxhash64(F.lit(k), *(F.struct(F.col(c).isNull(), c) for c in columns)).alias(f"print{k + 1}") for k in range(2)]
        new = scanned.select(F.lit(root).alias(ROOT), F.col(self.key), *columns, *prints, F.lit(False).alias(GONE))
        known = StructType.fromJson(state["schema"]) if "schema" in state else new.schema
        if [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in new.schema]:
            raise ValueError("other columns than those of the index")
        state["schema"] = new.schema.jsonValue()
        changes = new
        if state["segments"]:
            stored = self._newest(self._all(state, "rows", state["segments"]).where(F.col(ROOT) == root), state).where(~F.col(GONE))
            old = stored.select(F.col(self.key).alias("_key"), F.col("print1").alias("_p1"), F.col("print2").alias("_p2"))
            same = new[self.key].eqNullSafe(F.col("_key"))
            unchanged = same & (F.col("print1") == F.col("_p1")) & (F.col("print2") == F.col("_p2"))
            ended = old.join(new.select(self.key), same, "left_anti").select(F.lit(root).alias(ROOT), F.col("_key").alias(self.key), F.lit(True).alias(GONE))
            if unread is not None:
                blind = snapshot_blocked(ended.select(F.col(self.key).alias("path")), unread).select(F.col("path").alias(self.key))
                ended = ended.join(blind, self.key, "left_anti")
            changes = new.join(old, unchanged, "left_anti").unionByName(ended, allowMissingColumns=True)
        name = uuid.uuid4().hex
        segment = self._put(name, changes)
        if segment is not None:
            state["segments"].append(segment | {"generation": generation})
        last = state["scans"].get(root, 0)
        state["scans"][root] = last + 1 if scan_id is None else scan_id
        try:
            self.log.append(number + 1, json.dumps(state))
        except ValueError:
            deleted(self.spark, f"{self.folder}/segments/{name}")
            raise
        if segment is None:
            deleted(self.spark, f"{self.folder}/segments/{name}")
        if self._is_worn(state["segments"]):
            return self.fold(number + 1)
        self._let_go()
        return number + 1

    def _is_worn(self, segments: list[dict]) -> bool:
        """Too many segments, or later ones with more rows than the first."""
        return len(segments) > self.most_segments or sum(s["rows"] for s in segments[1:]) > segments[0]["rows"] if segments else False

    def fold(self, expected: int | None = None) -> int:
        """Makes one segment of all, without what is void. Postings are taken over as they are; no text is split again."""
        number, state = self.state()
        if expected is not None and expected != number:
            raise ValueError(f"version {number} is current, not {expected}")
        segments = state["segments"]
        if len(segments) < 2:
            return number
        name = uuid.uuid4().hex
        path = f"{self.folder}/segments/{name}"
        live = self._newest(self._all(state, "rows", segments), state).where(~F.col(GONE)).drop(GENERATION)
        live.write.parquet(f"{path}/rows")
        n = self.spark.read.schema(live.schema).parquet(f"{path}/rows").count()
        self._put_postings(path, self._newest(self._all(state, "postings", segments), state).drop(GENERATION), n)
        state["segments"] = [{"name": name, "rows": n, "gone": 0, "generation": segments[-1]["generation"]}]
        try:
            self.log.append(number + 1, json.dumps(state))
        except ValueError:
            deleted(self.spark, path)
            raise
        self._let_go()
        return number + 1

    def _let_go(self) -> None:
        """Removes what only versions before the two newest hold; a reader of the last version goes on."""
        entries = [(n, json.loads(content)["segments"]) for n, content in self.log.newest(4)]
        held = {s["name"] for _, segments in entries[:2] for s in segments}
        for number, segments in entries[2:]:
            for s in segments:
                if s["name"] not in held:
                    deleted(self.spark, f"{self.folder}/segments/{s['name']}")
            self.log.delete(number)

    def files_for(self, query: str) -> list[str]:
        """The files of postings that a query must read: those whose ranges of words a word of the query meets."""
        _, state = self.state()
        return sorted(path for paths in self._files_for(state, query_terms(query)).values() for path in paths)

    def _files_for(self, state: dict, terms: list[Term]) -> dict[str, list[str]]:
        """By segment. The list grows with the files that are read, never with all there are."""
        if not state["segments"] or not terms:
            return {}
        hit = reduce(Column.__or__, (meets(F.col("low"), F.col("high"), t) for t in terms))
        tables = (self._read(state, s, "files").where(hit).select(F.lit(s["name"]).alias("segment"), F.concat(F.lit(self._table(s, "postings") + "/"), "file").alias("path")) for s in state["segments"])
        out: dict[str, list[str]] = {}
        for r in reduce(DataFrame.union, tables).collect():
            out.setdefault(r["segment"], []).append(r["path"])
        return out

    def search(self, query: str, root: str | None = None) -> DataFrame:
        """(root_path, key) of the rows that match every term in some field, of one root or of all. A query without a word matches nothing."""
        _, state = self.state()
        if not state["segments"]:
            raise LookupError("nothing is indexed")
        terms = query_terms(query)
        paths = self._files_for(state, terms)
        read = [self._read(state, s, "postings", *paths[s["name"]]) for s in state["segments"] if s["name"] in paths]
        if not read:
            return self._read(state, state["segments"][0], "postings").select(ROOT, self.key).limit(0)
        postings = reduce(DataFrame.unionByName, read).where(reduce(Column.__or__, (fits(F.col("word"), t) for t in terms)))
        if root is not None:
            postings = postings.where(F.col(ROOT) == root)
        return match_all(self._newest(postings, state), query, ROOT, self.key)
