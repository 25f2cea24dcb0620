"""Versioned projections: the state of a resource is its last accepted observation.

An observation is refused only if the state it meets is valid for a later time; of equal times, the later
arrival wins. Folding a batch of observations is therefore one max by (valid_at, arrival) per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("path", "projection_kind")


def latest(observations: DataFrame, key: tuple[str, ...] = KEY, valid_at: str = "valid_at", arrival: str = "arrival") -> DataFrame:
    """One row per key: the accepted state."""
    best = F.max_by(F.struct(*(c for c in observations.columns if c not in key)), F.struct(valid_at, arrival))
    return observations.groupBy(*key).agg(best.alias("s")).select(*key, "s.*")


def fold(state: DataFrame, observations: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The next state. Both have the same columns; state rows arrived before all observations."""
    both = state.withColumn("_turn", F.lit(0)).unionByName(observations.withColumn("_turn", F.lit(1)))
    best = F.max_by(F.struct(*(c for c in state.columns if c not in key)), F.struct("valid_at", "_turn", "arrival"))
    return both.groupBy(*key).agg(best.alias("s")).select(*key, "s.*")


def fold_images(observations: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """As latest, but an observation with a state revision of its own, not 0, also loses to a state whose revision is higher.

    Whether a row is accepted depends on which rows before it were, so each key's observations of the batch are gone through in order of arrival.
    """
    rest = [c for c in observations.columns if c not in (*key, "arrival")]
    rows = F.sort_array(F.collect_list(F.struct("arrival", *rest)))

    def step(state, row):
        stands = state.isNull() | ((row["valid_at"] >= state["valid_at"]) & ((row["state_revision"] == 0) | (row["state_revision"] >= state["state_revision"])))
        return F.when(stands, row).otherwise(state)

    grouped = observations.groupBy(*key).agg(rows.alias("rows"))
    return grouped.select(*key, F.aggregate("rows", F.when(F.lit(False), F.col("rows")[0]), step).alias("s")).select(*key, "s.*")


def numbered(accepted: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """State revisions: per key 1, 2, ... in order of (valid_at, arrival). There is no global counter, and none is needed: revisions are only compared within a key."""
    return accepted.withColumn("state_revision", F.row_number().over(Window.partitionBy(*key).orderBy("valid_at", "arrival")))


def exact(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """State rows whose source revision is the wanted one (path, source_revision)."""
    return state.join(wanted, ["path", "source_revision"], "left_semi")


def while_revalidating(state: DataFrame, assets: DataFrame) -> DataFrame:
    """Ready rows whose source revision begins with the asset's 'mtime:size:', from (path, modified_at_ms, size_bytes)."""
    prefix = F.concat(F.col("modified_at_ms").cast("string"), F.lit(":"), F.col("size_bytes").cast("string"), F.lit(":"))
    return state.alias("s").join(assets.alias("a"), "path").where((F.col("s.status") == "ready") & F.col("s.source_revision").startswith(prefix)).select("path", *(f"s.{c}" for c in state.columns if c != "path"))


def invalidated(state: DataFrame, folder: str, revision: int) -> DataFrame:
    """State after a directory's invalidation: its rows become errors valid at the new revision, so that results under way lose."""
    hit = F.col("parent_path") == folder
    return state.withColumns({
        "status": F.when(hit, "error").otherwise(F.col("status")),
        "result_json": F.when(hit, None).otherwise(F.col("result_json")),
        "valid_at": F.when(hit, F.greatest("valid_at", F.lit(revision))).otherwise(F.col("valid_at")),
    })


def images_invalidated(state: DataFrame, revision: int) -> DataFrame:
    """State after invalidating every image projection; ratings and labels stay."""
    hit = F.col("projection_kind").startswith("image:")
    return state.withColumns({"status": F.when(hit, "error").otherwise(F.col("status")), "valid_at": F.when(hit, F.lit(revision)).otherwise(F.col("valid_at"))})


def enriched(assets: DataFrame, state: DataFrame) -> DataFrame:
    """Assets (path, fingerprint, ...) with rating and labels where the state knows the same fingerprint; missing tells what must be read."""
    known = state.select("path", F.col("source_revision").alias("fingerprint"), "rating", "color_label", "pick_label", F.lit(True).alias("_known"))
    joined = assets.drop("rating", "color_label", "pick_label").join(known, ["path", "fingerprint"], "left")
    return joined.withColumn("missing", F.col("_known").isNull()).drop("_known")


def newest_events(events: DataFrame, key: str = "path") -> DataFrame:
    """Of each resource's events, the one with the highest state revision; of equal ones, the first to arrive."""
    best = F.max_by(F.struct(*(c for c in events.columns if c != key)), F.struct("state_revision", -F.col("arrival")))
    return events.groupBy(key).agg(best.alias("s")).select(key, "s.*")
