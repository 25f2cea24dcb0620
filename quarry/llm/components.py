"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is a map-side combined minimum per node, kept as a table of its own, and a join with it: the join deals both
sides anew, or broadcasts the minima where they are few, so neither a node with very many neighbours nor a large component
meets in one task. Rounds are kept tables: no lineage grows, and a round that has been replaced is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._tables import kept, removed


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Links every node's (smaller, or larger) neighbours to the least node around it."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = kept(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = near.join(least, "u")
    if small:
        linked = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.where(F.col("u") != F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        linked = joined.where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = kept(linked.distinct() if small else linked, "stars")
    removed(least)
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """For an edge table (a long, b long): one row (node, component) per node with an edge, component the least node reachable.

    Self-links, repeated and reversed edges are allowed; rows with a null end are ignored; no edges give no rows.
    """
    edges = kept(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL AND a != b"), "edges")
    seen = None
    for _ in range(most_rounds):
        large = _star(edges, small=False)
        removed(edges)
        edges = _star(large, small=True)
        removed(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
