"""Catalog queries: filter, sort and page an asset relation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import ascii_lower, contains_folded
from quarry.tables import kept, partitions

DEFAULT_PAGE, MOST_PAGE = 250, 1000
SORTS = {"name": "name", "modified": "modified_at_ms", "size": "size_bytes", "kind": "kind"}


@dataclass(frozen=True)
class AssetQuery:
    """A conjunction of filters, an order and a page. None, and empty lists, filter nothing."""

    kind: str | None = None
    name_contains: str | None = None
    minimum_rating: int | None = None
    color_labels: tuple[str, ...] = field(default=())
    pick_labels: tuple[str, ...] = field(default=())
    sort: str = "name"
    descending: bool = False
    offset: int = 0
    page_size: int = DEFAULT_PAGE

    @property
    def needs_metadata(self) -> bool:
        """Whether ratings and labels must be known before filtering."""
        return self.minimum_rating is not None or bool(self.color_labels) or bool(self.pick_labels)


@dataclass(frozen=True)
class Page:
    items: DataFrame
    total: int
    next_cursor: int | None


def predicate(query: AssetQuery) -> Column:
    out = F.lit(True)
    if query.kind is not None:
        out = out & (F.col("kind") == query.kind)
    if query.name_contains is not None:
        out = out & contains_folded(F.col("name"), query.name_contains)
    if query.minimum_rating is not None:
        out = out & (F.coalesce("rating", F.lit(0)) >= query.minimum_rating)
    for column, wanted in (("color_label", query.color_labels), ("pick_label", query.pick_labels)):
        if wanted:
            low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            out = out & ascii_lower(F.col(column)).isin(*(w.translate(low) for w in wanted))
    return out


def ordering(query: AssetQuery, *unique: str) -> list[Column]:
    """The sort key, then the name, then the unique columns; descending turns all of them."""
    keys = [ascii_lower(F.col("name"))] if query.sort == "name" else [F.col(SORTS[query.sort])]
    return [k.desc() if query.descending else k.asc() for k in [*keys, F.col("name"), *map(F.col, unique)]]


def filtered(assets: DataFrame, query: AssetQuery) -> DataFrame:
    return assets.where(predicate(query))


def page_items(assets: DataFrame, query: AssetQuery, *unique: str) -> DataFrame:
    """One page. The limit keeps its sort a top-k in each task, merged at the end."""
    size = min(max(query.page_size, 1), MOST_PAGE)
    return filtered(assets, query).orderBy(*ordering(query, *unique)).offset(query.offset).limit(size)


def page(assets: DataFrame, query: AssetQuery, *unique: str) -> Page:
    """One page, the number of matching assets and where the next page starts (None after the last)."""
    total = filtered(assets, query).count()
    end = query.offset + min(max(query.page_size, 1), MOST_PAGE)
    return Page(page_items(assets, query, *unique), total, end if end < total else None)


def next_sort_order(rows: DataFrame, parent: str, order: str) -> DataFrame:
    """For each parent (null is one), the place behind its last child."""
    return rows.groupBy(parent).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_sort_order"))


def dense_order(rows: DataFrame, *keys: Column) -> DataFrame:
    """Adds place, 0 to n - 1 over all rows, without sending them through one task.

    Rows are dealt by ranges of the keys, which sorts them across partitions; places within a partition are shifted by the counts of the earlier ones.
    The ranges are kept as a table: they come from a sample, and dealt out anew after a loss they could differ.
    """
    ranged = kept(rows.repartitionByRange(partitions(rows.sparkSession), *keys).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return ranged.withColumn("_k", within).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_k") - 1).drop("_part", "_k", "_before")


def around_selection(rows: DataFrame, place: str, selected: int, reach: int) -> DataFrame:
    """The rows within reach of the selected place, first itself, then right, left, the rest to the right, the rest to the left; with priority 0, 1, 2 ..."""
    step = F.col(place) - selected
    near = rows.where(F.abs(step) <= reach)
    group = F.when(step == 0, 0).when(step == 1, 1).when(step == -1, 2).when(step > 0, 3).otherwise(4)
    return near.withColumn("priority", F.row_number().over(Window.orderBy(group, F.abs(step))) - 1)


def folder_order_key(name: Column) -> Column:
    """A key under which names sort without case or marks and digit runs by their value: before a run's digits, less leading zeros, stands how many they are."""
    from quarry.operators.search import fold

    parts = F.regexp_extract_all(fold(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    value = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(value(p)).cast("string"), 10, "0"), value(p))).otherwise(p)), "")
