"""The same folds on streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.streaming.sink import ROCKS

OUT = "path string, projection_kind string, valid_at long, arrival long, status string, source_revision string"
COLUMNS = [f.split(" ")[0] for f in OUT.split(", ")]
STATE = "valid_at long, arrival long, status string, source_revision string"


class Accept(StatefulProcessor):
    """The best of a key's observations; a row leaves when it changes. What is not observed for `keep_ms` is let go by a timer: a later observation is accepted as a first one."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", STATE)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = tuple(self.best.get()) if self.best.exists() else None
        best, last = old, 0
        for batch in rows:
            last = max(last, int(batch["at_ms"].max()))
            for row in batch.sort_values(["valid_at", "arrival"]).tail(1).itertuples(index=False):
                new = (int(row.valid_at), int(row.arrival), row.status, row.source_revision)
                if best is None or (new[0], new[1]) >= (best[0], best[1]) or (new[0] == best[0] and best is old):
                    best = new
        if self.keep_ms is not None:
            for timer in self.handle.listTimers():
                last = max(last, int(timer) - self.keep_ms)
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.keep_ms)
        if best is not None and best != old:
            self.best.update(best)
            yield pd.DataFrame([(*key, *best)], columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


def accepted_observations(observations: DataFrame, keep_ms: int | None = None, at: str = "at", delay: str = "1 hour") -> DataFrame:
    """A stream of state changes from a stream of observations, tombstones among them.

    With keep_ms a key's state is let go when the watermark of `at`, the time an observation came in, is so far past its last one. Changes are to be merged by key with the greatest (valid_at, arrival),
    as MergedTable does; what comes after that time and is valid for an earlier one then still loses.
    """
    observations.sparkSession.conf.set(*ROCKS)
    timed = observations.withWatermark(at, delay) if keep_ms is not None else observations
    at_ms = F.unix_millis(at) if keep_ms is not None else F.lit(0).cast("long")
    rows = timed.select(*COLUMNS, *([at] if keep_ms is not None else []), at_ms.alias("at_ms"))
    return rows.groupBy("path", "projection_kind").transformWithStateInPandas(Accept(keep_ms), OUT, "Update", "EventTime" if keep_ms is not None else "None")


def audit_log(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Review events, each request once as long as its repeats come within the delay."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["request_id"])


def activity(events: DataFrame, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts and sums per tumbling window and event type, late rows up to the delay included."""
    windowed = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
