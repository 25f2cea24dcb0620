"""Index differences, relocation, artifact choice and cache pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import within_path


def index_diff(old: DataFrame, new: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """(key, change): new, deleted, changed or unchanged."""
    a = old.select(*key, F.struct(*compared).alias("_old"))
    b = new.select(*key, F.struct(*compared).alias("_new"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(*key, change.alias("change"))


def next_generation(old: DataFrame, scanned: DataFrame, columns: list[str], root: str, scan_id: int, unread: DataFrame | None = None, path: str = "path") -> DataFrame:
    """The index (root_path, columns, scan_id) after a scan of one root: of it, what was not seen is gone and what was seen carries the scan's number; other roots stay.

    unread (path) are directories that could not be listed: rows of the root at or below one are not gone, but stay as they were where the scan did not see them.
    """
    own = scanned.select(F.lit(root).alias("root_path"), *columns, F.lit(scan_id).cast("long").alias("scan_id"))
    out = old.where(~F.col("root_path").eqNullSafe(root)).select("root_path", *columns, "scan_id").unionByName(own)
    if unread is None:
        return out
    before = old.where(F.col("root_path").eqNullSafe(root))
    blind = snapshot_blocked(before.select(F.col(path).alias("path")), unread).select(F.col("path").alias(path))
    unseen = before.join(blind, path, "left_semi").join(scanned.select(path), path, "left_anti")
    return out.unionByName(unseen.select("root_path", *columns, "scan_id"))


def snapshot_blocked(directories: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Directories that are a tombstone or below one, by whole path components: each path's ancestors meet the tombstones in an equality join."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return directories.select("path", F.explode(up).alias("up")).join(tombstones.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()


def relocation_plan(known: list[DataFrame], present: DataFrame, old_root: str, new_root: str) -> DataFrame:
    """(path, target, status) for every known path below the old root: missing, verified or unverified at the new one.

    known: any tables with path, and identity or null; present: path, identity.
    """
    every = known[0].select("path", "identity")
    for k in known[1:]:
        every = every.unionByName(k.select("path", "identity"))
    one = every.where(within_path(F.col("path"), old_root)).groupBy("path").agg(F.max("identity").alias("identity"))
    target = F.concat(F.lit(new_root.rstrip("/")), F.substring("path", len(old_root.rstrip("/")) + 1, F.length("path")))
    moved = one.withColumn("target", target)
    found = present.select(F.col("path").alias("target"), F.col("identity").alias("_there"), F.lit(True).alias("_is"))
    status = F.when(F.col("_is").isNull(), "missing").when(F.col("identity").isNotNull() & (F.col("identity") == F.col("_there")), "verified").otherwise("unverified")
    return moved.join(found, "target", "left").select("path", "target", status.alias("status"))


def rebased(rows: DataFrame, column: str, old_root: str, new_root: str) -> DataFrame:
    """Rows with paths below the old root moved to the new one."""
    moved = F.concat(F.lit(new_root.rstrip("/")), F.substring(column, len(old_root.rstrip("/")) + 1, F.length(column)))
    return rows.withColumn(column, F.when(within_path(F.col(column), old_root), moved).otherwise(F.col(column)))


def detail_accepts(width: Column, height: Column, native: Column, need: str, edge: int = 0, edge2: int = 0) -> Column:
    """Whether an artifact has the detail: 'native', 'display' (native, or a long edge of edge or more) or 'bounds' (both edges)."""
    if need == "native":
        return native
    if need == "display":
        return native | (F.greatest(width, height) >= edge)
    return (width >= edge) & (height >= edge2)


def artifact_choice(artifacts: DataFrame, request: list[str], matches: Column, satisfied: Column, interim_allowed: bool = True) -> DataFrame:
    """The best artifact of each request: satisfied ones first, then fewest pixels, then managed ones, then the least id.

    matches: what an artifact must fulfil at all; satisfied: whether it has the full detail.
    """
    usable = artifacts.where(matches).withColumn("satisfied", F.coalesce(satisfied, F.lit(False)))
    if not interim_allowed:
        usable = usable.where("satisfied")
    w = Window.partitionBy(*request).orderBy(F.col("satisfied").desc(), F.col("width").cast("long") * F.col("height"), F.col("managed").desc(), "artifact_id")
    return usable.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def pruned(artifacts: DataFrame, budget: int, order: tuple[str, ...] = ("modified", "path")) -> DataFrame:
    """Artifacts with evicted: stale staging always goes; others, oldest first, until the total is within the budget. Pinned ones count but stay.

    The running total over all artifacts is made in two steps: within ranges of the order, and over the ranges' sums; no task sees more than a range.
    artifacts: size_bytes, stale and pinned beside the order's columns.
    """
    from quarry.operators.query import dense_order

    evictable = F.when(~F.col("pinned"), F.col("size_bytes")).otherwise(0)
    placed = dense_order(artifacts, *map(F.col, order))
    block = F.floor(F.col("place") / 100_000).cast("long")
    blocked = placed.withColumn("_block", block)
    sums = blocked.groupBy("_block").agg(F.sum(evictable).alias("_sum"), F.sum("size_bytes").alias("_all"))
    before = sums.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))
    total = artifacts.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("_total"))
    inside = F.coalesce(F.sum(evictable).over(Window.partitionBy("_block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = blocked.withColumn("_inside", inside).join(F.broadcast(before), "_block").join(F.broadcast(total))
    over = F.col("_total") - F.col("_before") - F.col("_inside") > budget
    return joined.withColumn("evicted", ~F.col("pinned") & (F.col("stale") | over)).drop("place", "_block", "_inside", "_before", "_total")


def usage(artifacts: DataFrame) -> DataFrame:
    return artifacts.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"), F.count("*").alias("artifacts"))


def detection_id(revision: Column, producer: Column, face: Column, body: Column) -> Column:
    """A stable id of a detection: the source, the producer and the boxes to five decimals."""
    rounded = lambda box: F.coalesce(F.array_join(F.transform(box, lambda x: F.format_string("%.5f", x)), ","), F.lit("-"))
    return F.sha2(F.concat_ws("|", revision, producer, rounded(face), rounded(body)), 256)
