"""What a stream leaves: a table with the newest row of each key, the same after a batch has come twice."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources.log import Log, deleted, located

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class MergedTable:
    """The rows of batches under one folder, of each key the greatest by `order`. A batch has a place of its own, by its number, and is written over when it comes again.

    Batches are folded into one part once there are most_batches of them; a folded batch that comes again is passed over. One writer at a time, as a stream's checkpoint has it.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: tuple[str, ...], order: tuple[str, ...], most_batches: int = 64):
        self.spark, self.folder, self.schema, self.key, self.order, self.most_batches = spark, folder.rstrip("/"), schema, key, order, most_batches
        self.log = Log(spark, f"{self.folder}/log")

    def _folded(self) -> tuple[int, dict]:
        newest = self.log.newest(1)
        return (newest[0][0], json.loads(newest[0][1])) if newest else (0, {"part": None, "upto": -1})

    def batches(self) -> list[int]:
        """The numbers of the batches that are not folded."""
        path, store = located(self.spark, f"{self.folder}/batches")
        if not store.exists(path):
            return []
        upto = self._folded()[1]["upto"]
        return sorted(n for f in store.listStatus(path) if (n := int(f.getPath().getName())) > upto)

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        if number <= self._folded()[1]["upto"]:
            return
        batch.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/batches/{number}")
        if len(self.batches()) > self.most_batches:
            self.fold()

    def read(self) -> DataFrame:
        part = self._folded()[1]["part"]
        paths = [f"{self.folder}/batches/{n}" for n in self.batches()] + ([f"{self.folder}/parts/{part}"] if part else [])
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        best = F.max_by(F.struct(*self.schema.names), F.struct(*self.order)).alias("best")
        return self.spark.read.schema(self.schema).parquet(*paths).groupBy(*self.key).agg(best).select("best.*")

    def fold(self) -> None:
        number, before = self._folded()
        batches = self.batches()
        if not batches:
            return
        part = uuid.uuid4().hex
        self.read().write.parquet(f"{self.folder}/parts/{part}")
        self.log.append(number + 1, json.dumps({"part": part, "upto": batches[-1]}))
        for n in batches:
            deleted(self.spark, f"{self.folder}/batches/{n}")
        if before["part"]:
            deleted(self.spark, f"{self.folder}/parts/{before['part']}")


def drain(stream: DataFrame, table: MergedTable, mode: str, checkpoint: str) -> DataFrame:
    """Takes in what a stream has now; the table as it is then."""
    started = stream.writeStream.foreachBatch(table.write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return table.read()
