"""Trees as intervals: a walk around the tree numbers where each node is entered and left, so that a subtree is a range.

The walk is a linked list of two events a node: entering goes on to the first child, leaving to the next sibling or to leaving the parent. Events are ranked by pointer
doubling: in each round every event learns of the event twice as far ahead, so a list of n events takes log2(n) joins of n rows, whatever the shape of the tree. Against a closure,
whose rows are as many as all nodes' depths together, there are two rows a node while it is made and one after.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.query import dense_order
from quarry.tables import kept, removed


def _events(tags: DataFrame) -> DataFrame:
    """(event, next, step, weight): node * 2 is entering, node * 2 + 1 leaving, nodes being places in the order of siblings; the last event has no next. And the nodes' ids."""
    known = tags.select(F.col("id").alias("_parent")).distinct()
    own = tags.select("id", "parent_id", F.coalesce("sort_order", F.lit(0)).alias("sort_order")).join(known, F.col("parent_id") == F.col("_parent"), "left")
    # siblings by places over the whole table, so that a parent of very many children is no group of one task
    placed = kept(dense_order(own.select("id", F.col("_parent").alias("parent_id"), "sort_order"), F.col("parent_id"), F.col("sort_order"), F.col("id")), "tag-siblings")
    after = placed.select((F.col("place") - 1).alias("place"), F.col("place").alias("next_place"), F.col("parent_id").alias("next_parent"))
    up = placed.select(F.col("id").alias("parent_id"), F.col("place").alias("parent_place"))
    first = placed.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.min("place").alias("first_place"))
    joined = placed.join(after, "place", "left").join(up, "parent_id", "left").join(first, "id", "left")
    sibling = F.when(F.col("next_place").isNotNull() & F.col("next_parent").eqNullSafe(F.col("parent_id")), F.col("next_place") * 2)
    enter = F.struct((F.col("place") * 2).alias("event"), F.coalesce(F.col("first_place") * 2, F.col("place") * 2 + 1).alias("next"), F.lit(1).alias("weight"))
    leave = F.struct((F.col("place") * 2 + 1).alias("event"), F.coalesce(sibling, F.col("parent_place") * 2 + 1).alias("next"), F.lit(-1).alias("weight"))
    return joined.select("id", "place", F.explode(F.array(enter, leave)).alias("e")).select("id", "e.*", F.lit(1).cast("long").alias("step"))


def intervals(tags: DataFrame) -> DataFrame:
    """(id, low, high, depth): the numbers of entering and leaving, 0 to 2n - 1 over all trees, and the depth. Siblings stand by sort_order, then id.

    A tag whose parent is not there is a root. Ids are distinct; a cycle is an error.
    """
    made = kept(_events(tags), "tag-events")
    ids = made.select("id", "event")
    events = made.select("event", "next", "step", F.col("weight").cast("long").alias("weight"))
    n = made.count()
    kept_before = None
    for _ in range(n.bit_length() + 1):
        if events.where("next IS NOT NULL").isEmpty():
            break
        ahead = events.select(F.col("event").alias("next"), F.col("next").alias("_next"), F.col("step").alias("_step"), F.col("weight").alias("_weight"))
        both = events.join(ahead, "next", "left")
        more = lambda c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))
        events = kept(both.select("event", F.col("_next").alias("next"), more("step").alias("step"), more("weight").alias("weight")), "tag-ranks")
        if kept_before is not None:
            removed(kept_before)
        kept_before = events
    else:
        raise ValueError("the tags hold a cycle")
    # step counts the events from one to the end, itself included; weights before an event are what those from it on lack
    number = ids.join(events, "event").select("id", (F.lit(n) - F.col("step")).alias("number"), (F.col("event") % 2 == 0).alias("enters"), (-F.col("weight")).alias("depth"))
    return number.groupBy("id").agg(F.min("number").alias("low"), F.max("number").alias("high"), F.max(F.when(F.col("enters"), F.col("depth"))).cast("int").alias("depth"))


def subtree_tests(numbered: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (root, tag) with contained. Ids that are not there contain nothing."""
    outer = numbered.select(F.col("id").alias("root"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    inner = numbered.select(F.col("id").alias("tag"), F.col("low").alias("_at"))
    inside = F.col("_at").between(F.col("_low"), F.col("_high"))
    return asked.join(outer, "root", "left").join(inner, "tag", "left").withColumn("contained", F.coalesce(inside, F.lit(False))).select(*asked.columns, "contained")


def subtree_sizes(numbered: DataFrame) -> DataFrame:
    """(id, tags): how many tags a subtree has, itself included; no join."""
    return numbered.select("id", ((F.col("high") - F.col("low") + 1) / 2).cast("long").alias("tags"))


def match_assets(numbered: DataFrame, assigned: DataFrame, selected: list[int], match_all: bool) -> DataFrame:
    """Assets with a tag in the subtree of every selected tag, or of any: a range test for each selected one. A selected id that is not there is a subtree of itself."""
    wanted = sorted(set(selected))
    if not wanted:
        return assigned.select("asset_path").distinct().limit(0)
    ranges = {r["id"]: (r["low"], r["high"]) for r in numbered.where(F.col("id").isin(wanted)).collect()}  # the user's choice
    tests: list[Column] = [F.coalesce(F.col("low").between(*ranges[x]), F.lit(False)) if x in ranges else F.col("tag_id") == x for x in wanted]
    placed = assigned.select("asset_path", "tag_id").join(numbered.select(F.col("id").alias("tag_id"), "low"), "tag_id", "left").where(reduce(Column.__or__, tests))
    if not match_all:
        return placed.select("asset_path").distinct()
    found = placed.groupBy("asset_path").agg(*(F.bool_or(t).alias(f"t{k}") for k, t in enumerate(tests)))
    return found.where(reduce(Column.__and__, (F.col(f"t{k}") for k in range(len(tests))))).select("asset_path")
