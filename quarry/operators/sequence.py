"""Bursts: runs of frames with consecutive numbers, as gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import exif_seconds

#: Seconds that two frames of a burst may lie apart.
MOST_GAP = 10


def bursts(frames: DataFrame, group: list[str], order: list[str], sequence: str, ends_run: Column, seconds: Column, most_gap: int = MOST_GAP) -> DataFrame:
    """The frames that are in a burst of two or more: all columns, and run (per group), place in the run and its size.

    In a group's order, a frame without a number, or one that ends runs, ends one and is in none. A frame with the number of the run's last kept
    frame is skipped. A run goes on with the next number within the gap; a time that is missing on either side is no gap.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    apart = ends_run | F.col(sequence).isNull()
    marked = frames.withColumn("_seconds", seconds).withColumn("_apart", F.coalesce(apart, F.lit(True)))
    marked = marked.withColumn("_segment", F.sum(F.col("_apart").cast("int")).over(w)).where(~F.col("_apart"))
    inside = Window.partitionBy(*group, "_segment").orderBy(*order)
    # repeats of one number stand side by side, so the row before tells as much as the last kept frame would
    first = marked.withColumn("_before", F.lag(sequence).over(inside)).where(F.col("_before").isNull() | (F.col("_before") != F.col(sequence)))
    gap = F.abs(F.col("_seconds") - F.lag("_seconds").over(inside))
    goes_on = (F.col(sequence) == F.lag(sequence).over(inside) + 1) & F.coalesce(gap <= most_gap, F.lit(True))
    numbered = first.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    numbered = numbered.withColumn("run", F.sum("_new").over(Window.partitionBy(*group).orderBy(*order)))
    one = Window.partitionBy(*group, "run")
    sized = numbered.withColumn("size", F.count("*").over(one)).withColumn("place", F.row_number().over(one.orderBy(*order)) - 1)
    return sized.where("size >= 2").drop("_seconds", "_apart", "_segment", "_before", "_new")


def group_bursts(frames: DataFrame, folder: str = "folder") -> DataFrame:
    """(folder, run, representative, release_mode, members) from burst frames; the representative is the first."""
    bracketing = F.coalesce(F.lower("release_mode").contains("bracket"), F.lit(False))
    found = bursts(frames, [folder], ["position"], "sequence_number", bracketing, exif_seconds(F.col("captured_at")))
    members = F.sort_array(F.collect_list(F.struct("place", "path", "release_mode")))
    return found.groupBy(folder, "run").agg(members.alias("m")).select(folder, "run", F.col("m")[0]["path"].alias("representative"), F.col("m")[0]["release_mode"].alias("release_mode"), F.transform("m", lambda x: x["path"]).alias("members"))


FRAME = ("folder", "position", "number", "apart", "seconds")


def frames_of(rows: DataFrame, folder: str, position: str, number: str, apart: Column, seconds: Column) -> DataFrame:
    """Rows as frames (folder, position, number, apart, seconds) for stretches() and regroup(); a position is one frame's."""
    alone = apart | F.col(number).isNull()
    return rows.select(F.col(folder).alias("folder"), F.col(position).alias("position"), F.col(number).alias("number"), F.coalesce(alone, F.lit(True)).alias("apart"), seconds.alias("seconds"))


def stretches(frames: DataFrame, most_gap: int = MOST_GAP, group: tuple[str, ...] = ("folder",)) -> DataFrame:
    """Frames with stretch and skipped: every frame is in one stretch, a run with its skipped repeats or a frame apart, named by its first position."""
    order = Window.partitionBy(*group).orderBy("position")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    near, last = F.lag(F.struct("apart", "number")).over(order), F.last(F.when(~F.col("apart") & ~F.col("skipped"), F.struct("number", "seconds")), ignorenulls=True).over(before)
    marked = frames.withColumn("_near", near).withColumn("skipped", F.coalesce(~F.col("apart") & ~F.col("_near.apart") & (F.col("_near.number") == F.col("number")), F.lit(False)))
    gap = F.coalesce(F.abs(F.col("seconds") - F.col("_last.seconds")) <= most_gap, F.lit(True))
    goes_on = F.col("skipped") | (~F.col("apart") & ~F.col("_near.apart") & (F.col("number") == F.col("_last.number") + 1) & gap)
    begun = F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.struct("position"))
    return marked.withColumn("_last", last).withColumn("stretch", F.last(begun, ignorenulls=True).over(order)["position"]).drop("_near", "_last")


def regroup(state: DataFrame, changes: DataFrame, most_gap: int = MOST_GAP) -> DataFrame:
    """The state after changes, frames with gone: a frame that is gone is taken out, another put in place of what its position held. state is what stretches() or regroup() gave.

    A change can join or split only the stretch it falls in, or behind, the one before and the two after: where the next one is repeats of one number, a new frame of that number takes
    the place of its kept one, and with it what the stretch after that follows on. No other frame is looked at again.
    """
    touched = changes.select("folder").distinct()
    known = state.join(touched, "folder", "left_semi").groupBy("folder", "stretch").agg(F.lit(True).alias("known"))
    marks = known.select("folder", F.col("stretch").alias("at"), "known", F.lit(False).alias("change"))
    marks = marks.unionByName(changes.select("folder", F.col("position").alias("at"), F.lit(False).alias("known"), F.lit(True).alias("change")))
    line = Window.partitionBy("folder").orderBy("at", F.col("known").desc())
    # a change lies in the stretch number `place` of its folder, or behind it; those from place - 1 to place + 2 are worked on
    placed = marks.withColumn("place", F.sum(F.col("known").cast("int")).over(line))
    near = placed.where("change").select("folder", F.explode(F.sequence(F.col("place") - 1, F.col("place") + 2)).alias("place")).distinct()
    # neighbours that are worked on are one region; the stretches between regions stay as borders
    region = near.withColumn("region", F.col("place") - F.row_number().over(Window.partitionBy("folder").orderBy("place")))
    worked = placed.where("known").select("folder", F.col("at").alias("stretch"), "place").join(region, ["folder", "place"]).select("folder", "stretch", "region")
    own = placed.where("change").select("folder", F.col("at").alias("position"), "place").join(region, ["folder", "place"]).select("folder", "position", "region")
    old = state.join(worked, ["folder", "stretch"]).join(changes.select("folder", "position"), ["folder", "position"], "left_anti").select(*FRAME, "region")
    new = changes.where("NOT gone").join(own, ["folder", "position"]).select(*FRAME, "region")
    again = stretches(old.unionByName(new), most_gap, ("folder", "region")).drop("region")
    return state.join(worked, ["folder", "stretch"], "left_anti").select(*FRAME, "skipped", "stretch").unionByName(again.select(*FRAME, "skipped", "stretch"))


def bursts_of(state: DataFrame) -> DataFrame:
    """(folder, stretch, positions): the stretches that are bursts, of two frames or more, skipped ones left out."""
    return state.where("NOT apart AND NOT skipped").groupBy("folder", "stretch").agg(F.array_sort(F.collect_list("position")).alias("positions")).where("size(positions) >= 2")


def unparsed(listing: DataFrame, parsed: DataFrame) -> DataFrame:
    """What of a listing must still be parsed: paths that the cache does not have at that revision."""
    return listing.join(parsed.select("path", "source_revision"), ["path", "source_revision"], "left_anti")


def collapsed(rows: DataFrame, groups: DataFrame, expanded: DataFrame) -> DataFrame:
    """Rows (path, ...) without the members of bursts that are not expanded, but with their representatives."""
    hidden = groups.join(expanded.select("representative"), "representative", "left_anti").select("representative", F.explode("members").alias("path")).where("path != representative").select("path")
    return rows.join(hidden, "path", "left_anti")


def adjusted_total(total: Column, loaded: Column, visible: Column) -> Column:
    """The total less what collapsing hides of the loaded rows, but no less than what is visible."""
    return F.greatest(visible, total - (loaded - visible))
