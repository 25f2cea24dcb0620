"""Intents of independent scopes as a stream: what each scope wants and where, fenced by epochs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.streaming.sink import ROCKS

OUT = "scope string, key string, tier long, rank long, epoch long, version long"
COLUMNS = [f.split(" ")[0] for f in OUT.split(", ")]


class Demote(NamedTuple):
    """What a new epoch leaves out goes to this tier, before or behind the tier's own, instead of being released."""

    tier: int
    front: bool = False


class Intents(StatefulProcessor):
    """A scope's epoch and its keys' positions. Rows of an older epoch are ignored, rows of the same one add to it, a newer one replaces it.

    Changes leave with a version that rises within the scope; a null position is a release. A scope that is silent for `quiet_ms` is released, or demoted, by a timer.
    """

    def __init__(self, omitted: Demote | None, quiet_ms: int | None):
        self.omitted, self.quiet_ms = omitted, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fence = handle.getValueState("fence", "epoch long, version long")
        self.held = handle.getMapState("held", "key string", "tier long, rank long")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        epoch, version = self.fence.get() if self.fence.exists() else (None, 0)
        last = 0
        for pdf in rows:
            newest = int(pdf["epoch"].max())
            if epoch is not None and newest < epoch:
                continue  # and so does not keep the scope
            last = max(last, int(pdf["at_ms"].max()))
            mine = pdf[pdf["epoch"] == newest].sort_values(["tier", "rank"]).drop_duplicates("key")
            wanted = {k: (int(t), int(r)) for k, t, r in zip(mine["key"], mine["tier"], mine["rank"], strict=True)}
            changes = self._replace(wanted) if epoch is None or newest > epoch else self._add(wanted)
            epoch = newest
            out = [(key[0], k, *(p or (None, None)), epoch, version + n + 1) for n, (k, p) in enumerate(changes)]
            version += len(out)
            if out:
                yield _frame(out)
        self.fence.update((epoch, version))
        if self.quiet_ms is not None:
            for timer in self.handle.listTimers():
                last = max(last, int(timer) - self.quiet_ms)
                self.handle.deleteTimer(timer)
            if last:
                self.handle.registerTimer(last + self.quiet_ms)

    def _add(self, wanted: dict[str, tuple[int, int]]) -> list[tuple[str, tuple[int, int] | None]]:
        """More rows of the epoch: the better of two positions of a key stays."""
        changes = []
        for k, place in wanted.items():
            old = self.held.getValue((k,)) if self.held.containsKey((k,)) else None
            if old is None or place < tuple(old):
                self.held.updateValue((k,), place)
                changes.append((k, place))
        return changes

    def _replace(self, wanted: dict[str, tuple[int, int]]) -> list[tuple[str, tuple[int, int] | None]]:
        before = {k[0]: tuple(p) for k, p in self.held.iterator()}
        left_out = sorted((p, k) for k, p in before.items() if k not in wanted)
        after = dict(wanted)
        if self.omitted is not None:
            own = [k for k, (tier, _) in after.items() if tier == self.omitted.tier]
            behind = max((after[k][1] + 1 for k in own), default=0)
            if self.omitted.front:
                behind = 0
                for k in own:
                    after[k] = (self.omitted.tier, after[k][1] + len(left_out))
            after |= {k: (self.omitted.tier, behind + n) for n, (_, k) in enumerate(left_out)}
        for k in before.keys() - after.keys():
            self.held.removeKey((k,))
        changes: list[tuple[str, tuple[int, int] | None]] = [(k, None) for k in before if k not in after]
        for k, place in after.items():
            if before.get(k) != place:
                self.held.updateValue((k,), place)
                changes.append((k, place))
        return changes

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        epoch, version = self.fence.get()
        changes = self._replace({})
        self.fence.update((epoch, version + len(changes)))  # the fence stays: a late row of an older epoch is still refused
        if changes:
            yield _frame([(key[0], k, *(p or (None, None)), epoch, version + n + 1) for n, (k, p) in enumerate(changes)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({"tier": "Int64", "rank": "Int64", "epoch": "int64", "version": "int64"})


def intent_changes(intents: DataFrame, omitted: Demote | None = None, quiet_ms: int | None = None, delay: str = "1 minute") -> DataFrame:
    """A stream of changes (scope, key, tier, rank, epoch, version) from a stream of intents (scope, epoch, key, tier, rank, at); at is when an intent came in.

    Merged by (scope, key) with the greatest version, the changes are what each scope wants. Without demotion that is the newest epoch's rows, in whatever order rows came.
    A scope's rows meet in one task, which its fence asks for.
    """
    intents.sparkSession.conf.set(*ROCKS)
    timed = intents.withWatermark("at", delay).select("scope", F.col("epoch").cast("long").alias("epoch"), "key", F.col("tier").cast("long").alias("tier"), F.col("rank").cast("long").alias("rank"), "at", F.unix_millis("at").alias("at_ms"))
    return timed.groupBy("scope").transformWithStateInPandas(Intents(omitted, quiet_ms), OUT, "Update", "EventTime" if quiet_ms is not None else "None")


def effective(wanted: DataFrame) -> DataFrame:
    """(key, tier, rank): the best position of each key over the scopes, from their merged changes."""
    best = wanted.where("tier IS NOT NULL").groupBy("key").agg(F.min(F.struct("tier", "rank")).alias("p"))
    return best.select("key", "p.tier", "p.rank")
