"""The work ledger: runs, stage-ordered tasks, claims, and the stage graph."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TASK = ("run_id", "asset_path", "stage_id")


def begin_runs(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Runs after requests (request_id, folder_path, at): a known request changes nothing; a new one gets its folder's next generation and cancels the runs before it."""
    new = requests.dropDuplicates(["request_id"]).join(runs.select("request_id"), "request_id", "left_anti")
    top = runs.groupBy("folder_path").agg(F.max("generation").alias("top"))
    turn = F.row_number().over(Window.partitionBy("folder_path").orderBy("at", "request_id"))
    last = F.lead("request_id").over(Window.partitionBy("folder_path").orderBy("at", "request_id")).isNull()
    started = new.withColumn("turn", turn).withColumn("last", last).join(top, "folder_path", "left")
    added = started.select(F.concat(F.lit("run:"), F.col("request_id")).alias("run_id"), "folder_path", "request_id", (F.coalesce("top", F.lit(0)) + F.col("turn")).cast("long").alias("generation"), F.when(F.col("last"), "running").otherwise("cancelled").alias("state"), F.lit(False).alias("sealed"), F.lit(0).alias("total"))
    old = runs.join(new.select("folder_path").distinct().withColumn("_new", F.lit(True)), "folder_path", "left")
    state = F.when(F.col("_new") & F.col("state").isin("running", "queued"), "cancelled").otherwise(F.col("state"))
    return old.withColumn("state", state).select(*added.columns).unionByName(added)


def enqueue(tasks: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tasks after a batch, and its conflicts: a task that is there with the same source and fingerprint is ignored, with others it is a conflict."""
    identity = ("source_revision", "stage_fingerprint", "stage_order")
    known = batch.alias("b").join(tasks.select(*TASK, *identity).alias("t"), list(TASK))
    same = F.lit(True)
    for c in identity:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}"))
    conflicts = known.where(~same).select(*TASK)
    return tasks.unionByName(batch.join(tasks, list(TASK), "left_anti")), conflicts


def claimable(tasks: DataFrame) -> DataFrame:
    """Queued tasks of which no earlier stage of the same asset and run is open, by one window instead of an anti join on an inequality."""
    first_open = F.min(F.when(F.col("state") != "completed", F.col("stage_order"))).over(Window.partitionBy("run_id", "asset_path"))
    return tasks.withColumn("_first", first_open).where("state = 'queued' AND _first = stage_order").drop("_first")


def next_task(tasks: DataFrame) -> DataFrame:
    """The first claimable task of each run."""
    best = F.min_by(F.struct(*(c for c in tasks.columns if c != "run_id")), F.struct("asset_path", "stage_order", "stage_id"))
    return claimable(tasks).groupBy("run_id").agg(best.alias("t")).select("run_id", "t.*")


def apply_claims(tasks: DataFrame, claims: DataFrame) -> DataFrame:
    """Tasks after claims (run_id, asset_path, stage_id, claim_token): of several claims of a queued, claimable task the least token wins."""
    ready = claimable(tasks).select(*TASK)
    won = claims.join(ready, list(TASK), "left_semi").groupBy(*TASK).agg(F.min("claim_token").alias("_token"))
    joined = tasks.join(won, list(TASK), "left")
    return joined.withColumns({"state": F.when(F.col("_token").isNotNull(), "running").otherwise(F.col("state")), "claim_token": F.coalesce("_token", "claim_token")}).drop("_token")


def apply_outcomes(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Tasks after outcomes (all identity columns, claim_token, outcome, error): one that does not match a running task in every column, the token too, is ignored. Failures cascade."""
    on = [*TASK, "source_revision", "stage_fingerprint", "claim_token"]
    told = outcomes.select(*on, "outcome", F.col("error").alias("_error")).dropDuplicates(on)
    hit = (F.col("state") == "running") & F.col("outcome").isNotNull()
    joined = tasks.join(told, on, "left")
    done = joined.withColumns({"state": F.when(hit, F.col("outcome")).otherwise(F.col("state")), "error": F.when(hit, F.col("_error")).otherwise(F.col("error")), "claim_token": F.when(hit, None).otherwise(F.col("claim_token"))})
    return cascade(done.select(*tasks.columns))


def cascade(tasks: DataFrame) -> DataFrame:
    """Queued tasks behind a failed stage of their asset fail too."""
    w = Window.partitionBy("run_id", "asset_path").orderBy("stage_order").rangeBetween(Window.unboundedPreceding, -1)
    broken = F.coalesce(F.max((F.col("state") == "failed").cast("int")).over(w), F.lit(0)) == 1
    hit = (F.col("state") == "queued") & broken
    return tasks.withColumn("_hit", hit).withColumns({"state": F.when(F.col("_hit"), "failed").otherwise(F.col("state")), "error": F.when(F.col("_hit"), "an earlier stage failed").otherwise(F.col("error"))}).drop("_hit")


def roll_up(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs with done, failed and their state: a sealed run whose tasks have all ended is completed, or failed where any did."""
    ended = tasks.groupBy("run_id").agg(F.count_if(F.col("state") == "completed").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"))
    joined = runs.join(ended, "run_id", "left").withColumns({"done": F.coalesce("done", F.lit(0)), "failed": F.coalesce("failed", F.lit(0))})
    over = F.col("sealed") & (F.col("done") + F.col("failed") >= F.col("total"))
    state = F.when(F.col("state") == "cancelled", "cancelled").when(over & (F.col("failed") == 0), "completed").when(over, "failed").otherwise(F.col("state"))
    return joined.withColumn("state", state)


def recover(tasks: DataFrame) -> DataFrame:
    """Tasks after a restart: running ones are queued again, without their tokens."""
    running = F.col("state") == "running"
    return tasks.withColumns({"claim_token": F.when(running, None).otherwise(F.col("claim_token")), "state": F.when(running, "queued").otherwise(F.col("state"))})


def coalesce_requests(requests: DataFrame) -> DataFrame:
    """(key, priority, seq, payload): pending requests, one per key with the highest priority, the first place in line and the newest payload."""
    return requests.groupBy("key").agg(F.max("priority").alias("priority"), F.min("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))


def effective_positions(intents: DataFrame) -> DataFrame:
    """(key, tier, rank): the best position of each key over all scopes, from each scope's latest epoch alone."""
    newest = intents.groupBy("scope").agg(F.max("epoch").alias("epoch"))
    best = intents.join(newest, ["scope", "epoch"], "left_semi").groupBy("key").agg(F.min(F.struct("tier", "rank")).alias("p"))
    return best.select("key", "p.tier", "p.rank")


def released(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys that no scope names any more."""
    return before.select("key").distinct().join(after.select("key"), "key", "left_anti")


def stage_order(stages: Mapping[str, tuple[str, ...]]) -> list[str]:
    """Stage ids, each behind its dependencies, otherwise by id. Unknown dependencies and cycles are errors. A manifest is a handful of entries."""
    unknown = {d for needs in stages.values() for d in needs} - set(stages)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    sorter = TopologicalSorter(stages)
    try:
        sorter.prepare()
    except CycleError as e:
        raise ValueError("the stages depend on each other") from e
    out: list[str] = []
    ready = list(sorter.get_ready())
    while ready:
        ready.sort()
        out.append(ready.pop(0))
        sorter.done(out[-1])
        ready += sorter.get_ready()
    return out


def fingerprints(stages: Mapping[str, tuple[str, ...]], semantics: Mapping[str, str]) -> dict[str, str]:
    """A stage's fingerprint covers its own semantics and, through theirs, everything it depends on."""
    out: dict[str, str] = {}
    for k in stage_order(stages):
        out[k] = hashlib.sha256(json.dumps([k, semantics[k], sorted(out[d] for d in stages[k])]).encode()).hexdigest()
    return out


def to_recompute(stages: Mapping[str, tuple[str, ...]], old: Mapping[str, str], new: Mapping[str, str]) -> list[str]:
    """Stages whose fingerprint changed, in stage order; whatever depends on them is among them."""
    return [k for k in stage_order(stages) if old.get(k) != new[k]]
