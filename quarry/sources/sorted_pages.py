"""Pages of a relation by place: a snapshot of it in each order, whose files say which places they hold.

A page is a range of places, so it reads the files that hold them and no others, the thousandth page as few as the first. A filtered page counts
each file's matches first, by the filter's columns alone, and then reads the files where its matches stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.query import MOST_PAGE, SORTS, AssetQuery, Page, dense_order, ordering, predicate
from quarry.tables import partitions

FILES = "file string, low long, high long, n long"


class SortedPages:
    """An immutable snapshot under one folder. build() writes it once; readers need nothing but the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, rows: DataFrame, *unique: str, sorts: tuple[str, ...] = tuple(SORTS), files: int | None = None, most_rows: int = 1_000_000) -> None:
        """unique are the columns that settle ties last. A file has at most most_rows rows."""
        if "place" in rows.columns:
            raise ValueError("a column is named place")
        for sort in sorts:
            placed = dense_order(rows, *ordering(AssetQuery(sort=sort), *unique))
            ranged = placed.repartitionByRange(files or partitions(self.spark), "place").sortWithinPartitions("place")
            ranged.write.option("maxRecordsPerFile", most_rows).parquet(f"{self.folder}/{sort}/rows")
            held = self.spark.read.schema(ranged.schema).parquet(f"{self.folder}/{sort}/rows").groupBy(F.col("_metadata.file_name").alias("file"))
            held.agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{self.folder}/{sort}/files")
            self.spark.createDataFrame([(ranged.schema.json(),)], "schema string").coalesce(1).write.text(f"{self.folder}/{sort}/schema")

    def _schema(self, sort: str) -> StructType:
        import json

        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.folder}/{sort}/schema").first()["value"]))

    def _files(self, sort: str) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/{sort}/files")

    def _rows(self, sort: str, files: list[str] | None = None) -> DataFrame:
        schema, folder = self._schema(sort), f"{self.folder}/{sort}/rows"
        if files is not None and not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*([folder] if files is None else [f"{folder}/{f}" for f in files]))

    def _counted(self, query: AssetQuery) -> DataFrame:
        """(file, matches, before): how many rows of each file match, and how many that stand before it in the query's direction. One row a file."""
        files = self._files(query.sort)
        if query == AssetQuery(sort=query.sort, descending=query.descending, offset=query.offset, page_size=query.page_size):
            counted = files.select("file", "low", F.col("n").alias("matches"))
        else:
            hits = self._rows(query.sort).where(predicate(query)).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("matches"))
            counted = files.select("file", "low").join(hits, "file")
        low = F.col("low").desc() if query.descending else F.col("low").asc()
        until = F.sum("matches").over(Window.orderBy(low).rowsBetween(Window.unboundedPreceding, Window.currentRow))  # over the files
        return counted.select("file", "matches", (until - F.col("matches")).alias("before"))

    def _chosen(self, query: AssetQuery) -> tuple[list[str], int, int]:
        """The files that a page needs, how many matches stand before them, and how many there are in all."""
        end = query.offset + min(max(query.page_size, 1), MOST_PAGE)
        counted = self._counted(query)
        needed = (F.col("before") < end) & (F.col("before") + F.col("matches") > query.offset)
        found = counted.agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("total"), F.collect_list(F.when(needed, F.struct("before", "file"))).alias("files")).first()  # a page's files
        files = sorted(found["files"])
        return [f["file"] for f in files], files[0]["before"] if files else 0, found["total"]

    def files_for(self, query: AssetQuery) -> list[str]:
        return self._chosen(query)[0]

    def page(self, query: AssetQuery) -> Page:
        """The same page as from the relation itself: rows in order, the number of matches, the next page's start."""
        files, before, total = self._chosen(query)
        end = query.offset + min(max(query.page_size, 1), MOST_PAGE)
        place = F.col("place").desc() if query.descending else F.col("place").asc()
        items = self._rows(query.sort, files).where(predicate(query)).orderBy(place).offset(max(0, query.offset - before)).limit(end - query.offset).drop("place")
        return Page(items, total, end if end < total else None)
