"""Vectors in blocks that a threshold search can pass over.

The angle between vectors is a distance. A few vectors are pivots; a block, one file, knows the least and the greatest angle of its vectors to each pivot. By the triangle
inequality a vector is no nearer to the query than those angles differ from the query's own, so a block whose bounds are further off than the threshold's angle holds no match.
Vectors are put together by their nearest pivot and their angle to it. What is read is compared exactly, so the rows are those of the exhaustive search.
"""

from __future__ import annotations

from math import acos, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.vectors import search
from quarry.tables import partitions

#: What angles may be off by rounding; the arc cosine of numbers near 1 loses half of a double's digits.
SLACK = 1e-6
#: Vectors that are looked at for each pivot.
SAMPLE = 32


def _angles(pivots: np.ndarray) -> Column:
    """A vector's angles to the pivots; null for one without a length or of another dimension."""

    @F.pandas_udf("array<double>")
    def angles(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            a = None if v is None else np.asarray(v, np.float64)
            size = 0.0 if a is None or a.shape != pivots.shape[1:] else float(np.sqrt(a @ a))
            out.append(np.arccos(np.clip(pivots @ a / size, -1, 1)) if np.isfinite(size) and size > 0 else None)
        return pd.Series(out, dtype=object)

    return angles("vector")


def far_apart(vectors: np.ndarray, most: int) -> np.ndarray:
    """Of unit vectors the first, and then again and again the one that is furthest from those chosen."""
    chosen, nearest = [], np.full(len(vectors), -np.inf)
    for _ in range(min(most, len(vectors))):
        k = int(np.argmin(nearest)) if chosen else 0
        chosen.append(k)
        nearest = np.maximum(nearest, vectors @ vectors[k])
    return vectors[chosen]


class VectorBlocks:
    """Blocks of features under one folder, of one dimension; built once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, features: DataFrame, pivots: int = 16, files: int | None = None, most_rows: int = 100_000) -> None:
        """features has vector and any other columns. Vectors without a length, or of another dimension than the pivots', match nothing and are left out.

        The pivots are taken from SAMPLE vectors a pivot, those of the least hash, each the furthest from those before; they decide what can be passed over, not what is found."""
        usable = features.where("vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)")
        first = usable.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE * pivots).collect()
        dimension = len(first[0]["vector"]) if first else 0
        alike = [r["vector"] for r in first if len(r["vector"]) == dimension]
        own = np.array(alike, np.float64).reshape(len(alike), dimension)
        own = own[np.isfinite(own).all(1)]
        size = np.sqrt((own * own).sum(1))
        own = far_apart(own[size > 0] / size[size > 0, None], pivots)
        placed = usable.withColumn("_angles", _angles(own)).where("_angles IS NOT NULL").withColumn("_near", F.coalesce(F.array_min("_angles"), F.lit(0.0)))
        placed = placed.withColumn("_cell", F.coalesce(F.array_position("_angles", F.col("_near")), F.lit(0)))
        ranged = placed.repartitionByRange(files or partitions(self.spark), "_cell", "_near").sortWithinPartitions("_cell", "_near")
        ranged.drop("_near", "_cell").write.option("maxRecordsPerFile", most_rows).parquet(f"{self.folder}/rows")
        schema = ranged.drop("_near", "_cell").schema
        told = self.spark.read.schema(schema).parquet(f"{self.folder}/rows").groupBy(F.col("_metadata.file_name").alias("file"))
        side = lambda f: F.array(*(f(F.col("_angles")[k]) for k in range(len(own)))).cast("array<double>")
        told.agg(side(F.min).alias("low"), side(F.max).alias("high"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{self.folder}/blocks")
        about = self.spark.createDataFrame([(schema.json(), own.tolist())], "schema string, pivots array<array<double>>")
        about.coalesce(1).write.parquet(f"{self.folder}/about")

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("file string, low array<double>, high array<double>, n long").parquet(f"{self.folder}/blocks")

    def blocks_for(self, query: list[float], threshold: float) -> list[str]:
        """The files that may hold a match."""
        pivots = self.spark.read.schema("pivots array<array<double>>").parquet(f"{self.folder}/about").first()["pivots"]
        length = sqrt(sum(float(x) * float(x) for x in query))
        if not length > 0 or any(len(p) != len(query) for p in pivots):
            return []
        own = [acos(max(-1.0, min(1.0, sum(a * float(b) for a, b in zip(p, query, strict=True)) / length))) for p in pivots]
        reach = acos(max(-1.0, min(1.0, threshold))) + SLACK
        apart = F.lit(False)
        for k, angle in enumerate(own):
            apart = apart | (F.col("low")[k] - angle > reach) | (angle - F.col("high")[k] > reach)
        return sorted(r["file"] for r in self.blocks().where(~apart).select("file").collect())  # the files to be read

    def search(self, query: list[float], threshold: float, current: DataFrame | None = None, valid_only: bool = True) -> DataFrame:
        """The rows of operators.vectors.search over all features, from the blocks that may hold some."""
        import json

        files = self.blocks_for(query, threshold)
        schema = StructType.fromJson(json.loads(self.spark.read.schema("schema string").parquet(f"{self.folder}/about").first()["schema"]))
        rows = self.spark.read.schema(schema).parquet(*(f"{self.folder}/rows/{f}" for f in files)) if files else self.spark.createDataFrame([], schema)
        return search(rows.drop("_angles"), query, threshold, current, valid_only)
