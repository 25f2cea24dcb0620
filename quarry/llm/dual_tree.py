"""Centroid clustering: exact Lloyd rounds over cover trees.

Vectors are put into blocks where they are read; each block gets a cover tree, made once and kept as a table. A
round makes a tree over its centroids and walks both trees at once: pairs of a vector node and a centroid node go
as soon as the distance bounds show that another centroid is nearer to all of the node's vectors. A node with one
centroid left is assigned whole; what is left at the leaves is compared exactly, in integers. A task adds up its
vectors by centroid, so a round shuffles at most one row a centroid and task, and no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._tables import kept, removed

#: Components are less than this, so that squared distances of up to 128 components fit 64 bits.
MOST_COMPONENT = 1 << 27
#: What bounds may be off by rounding, as a share of the distances they are made from.
SLACK = 1e-9
#: What distances made from products may be off by, as a share of the longest vector.
BLUR = 1e-7


@dataclass
class Tree:
    """A cover tree in arrays. A node covers order[low:high], all within radius of its centre; its children are the nodes child_low to child_high, none for a leaf."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child_low: np.ndarray
    child_high: np.ndarray

    FIELDS = ("order", "centre", "low", "high", "child_low", "child_high")


def lengths(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", a, a))


def cover_tree(points: np.ndarray, leaf: int, base: float = 1.3) -> Tree:
    """A node's children cover balls of the node's level divided by base: first its own centre's, then that of any point not covered yet, so siblings' centres
    stand further apart than their level. A node of at most `leaf` points, or of equal points, is a leaf."""
    order = np.arange(len(points))
    nodes = [[0, 0, len(points), 0, 0]]  # centre, low, high, child_low, child_high
    radius = [float(lengths(points - points[0]).max())]
    at = 0
    while at < len(nodes):
        centre, low, high, _, _ = nodes[at]
        reach = radius[at]
        if high - low > leaf and reach > 0:
            level = reach / base
            rest, chosen, put = order[low:high], centre, low
            nodes[at][3] = len(nodes)
            while len(rest):
                away = lengths(points[rest] - points[chosen])
                inside = away <= level
                members = rest[inside]
                order_next = put + len(members)
                nodes.append([chosen, put, order_next, 0, 0])
                radius.append(float(away[inside].max()))
                order[put:order_next], rest, put = members, rest[~inside].copy(), order_next
                if len(rest):
                    chosen = rest[0]
            nodes[at][4] = len(nodes)
        at += 1
    centre, low, high, child_low, child_high = np.array(nodes, np.int64).T.copy()
    return Tree(order, centre, np.array(radius), low, high, child_low, child_high)


def _spread(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value repeated for the numbers from low to high, and those numbers."""
    sizes = high - low
    ends = np.cumsum(sizes)
    return np.repeat(values, sizes), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(low, sizes)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances of all rows of a from all rows of b, off by at most BLUR of the longest row."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[np.ndarray, int]:
    """For each point the number of its nearest centroid, the smaller of equally near ones, and how many point and centroid pairs were compared at the leaves.

    over is a tree of the centroids whose leaves hold one centroid or equal ones. Both trees are gone down together, siblings of one side with the candidates of their parent at once:
    of a vector node and an open centroid node the wider is opened.
    """
    best = np.full(len(points), -1, np.int64)
    centres, heads = points[tree.centre].astype(np.float64), centroids[over.centre].astype(np.float64)
    blur = BLUR * float(np.sqrt(max((centres * centres).sum(1).max(), (heads * heads).sum(1).max()))) + SLACK
    leaf, closed = tree.child_low == tree.child_high, over.child_low == over.child_high
    waiting = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, np.inf))]  # vector nodes, their candidates, within what distance each of a node's points has a centroid
    nodes, numbers = [], []
    while waiting:
        v, c, bound = waiting.pop()
        away = _apart(centres[v], heads[c])
        reach = tree.radius[v][:, None] + over.radius[c]
        bound = np.minimum(bound, (away + reach).min(1))
        near = away - reach <= (bound + SLACK * bound + 2 * blur)[:, None]
        widest = np.where(near & ~closed[c], over.radius[c], -1.0).max(1)
        done = (widest < 0) & ((near.sum(1) == 1) | leaf[v])
        if done.any():
            row, column = np.nonzero(near[done])
            node, first = _spread(v[done][row], over.low[c[column]], over.high[c[column]])
            nodes.append(node)
            numbers.append(over.order[first])
        wide = ~done & (widest >= 0) & (leaf[v] | (tree.radius[v] <= widest))
        if wide.any():
            some = c[near[wide].any(0)]
            _, inner = _spread(some[~closed[some]], over.child_low[some[~closed[some]]], over.child_high[some[~closed[some]]])
            waiting.append((v[wide], np.concatenate([some[closed[some]], inner]), bound[wide]))
        for k in np.flatnonzero(~done & ~wide):
            children = np.arange(tree.child_low[v[k]], tree.child_high[v[k]])
            waiting.append((children, c[near[k]], np.full(len(children), bound[k])))

    node, number = np.concatenate(nodes), np.concatenate(numbers)
    alone = np.bincount(node, minlength=len(tree.centre))[node] == 1
    one, at = _spread(number[alone], tree.low[node[alone]], tree.high[node[alone]])
    best[tree.order[at]] = one
    number, at = _spread(number[~alone], tree.low[node[~alone]], tree.high[node[~alone]])
    if len(at):
        row = tree.order[at]
        gap = points[row].astype(np.int64) - centroids[number]
        square = np.einsum("ij,ij->i", gap, gap)
        ranked = np.lexsort((number, square, row))
        lead = np.ones(len(ranked), bool)
        lead[1:] = row[ranked][1:] != row[ranked][:-1]
        best[row[ranked][lead]] = number[ranked][lead]
    return best, len(at)


def usable(embedding: Column, dimensions: int) -> Column:
    """Whether a vector has that many components, none null or not finite."""
    x = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.coalesce((F.size(embedding) == dimensions) & F.forall(embedding, x), F.lit(False))


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(scale * values.astype(np.float64))
    if len(out) and np.abs(out).max() >= MOST_COMPONENT:
        raise ValueError(f"a component times {scale} is not below {MOST_COMPONENT}: squared distances would not fit 64 bits")
    return out.astype(np.int64)


def _ints(field: str) -> str:
    return f"{field} array<int>"


def block_trees(vectors: DataFrame, dimensions: int, scale: int, block: int, leaf: int) -> DataFrame:
    """One row per block of (id, embedding): the ids and whole-number vectors in the order of the block's cover tree, and the tree."""
    kind = vectors.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                points = whole_numbers(part.column(1).flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, dimensions)
                tree = cover_tree(points, leaf)
                ids = part.column(0).take(pa.array(tree.order))
                tree.centre = np.argsort(tree.order)[tree.centre]
                data = points[tree.order].astype("<i4").tobytes()
                fields = [pa.array([getattr(tree, f).astype(np.int32)], pa.list_(pa.int32())) for f in Tree.FIELDS[1:]]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([data], pa.binary()), pa.array([tree.radius], pa.list_(pa.float64())), *fields], names=["ids", "points", "radius", *Tree.FIELDS[1:]])

    return vectors.mapInArrow(task, f"ids array<{kind}>, points binary, radius array<double>, " + ", ".join(map(_ints, Tree.FIELDS[1:])))


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            points = np.frombuffer(batch.column("points")[k].as_buffer(), "<i4").reshape(-1, dimensions).astype(np.int64)
            values = lambda f: batch.column(f)[k].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            own = {f: values(f).astype(np.int64) for f in Tree.FIELDS[1:]}
            yield batch.column("ids")[k].values, points, Tree(order=np.arange(len(points)), radius=values("radius"), **own)


def sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """(number of vectors, their componentwise sum) of each centroid with vectors. Tasks add up; one row a centroid comes to the driver."""
    size, dimensions = centroids.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over, n, total = cover_tree(centroids, 1), np.zeros(size, np.int64), np.zeros((size, dimensions), np.int64)
        for _, points, tree in _blocks(batches, dimensions):
            cluster, _ = nearest(points, tree, centroids, over)
            n += np.bincount(cluster, minlength=size)
            ranked = np.argsort(cluster, kind="stable")
            have, first = np.unique(cluster[ranked], return_index=True)
            total[have] += np.add.reduceat(points[ranked], first)
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(n[have]), pa.array(list(total[have]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = blocks.mapInArrow(task, "cluster int, n long, total array<long>").groupBy("cluster")
    rows = parts.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[k]) for k in range(dimensions))).alias("total")).collect()
    return {r["cluster"]: (r["n"], r["total"]) for r in rows}


def assigned(blocks: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dimensions = centroids.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = cover_tree(centroids, 1)
        for ids, points, tree in _blocks(batches, dimensions):
            cluster, _ = nearest(points, tree, centroids, over)
            gap = points - centroids[cluster]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(np.einsum("ij,ij->i", gap, gap))], names=["id", "cluster", "distance"])

    return blocks.mapInArrow(task, f"id {kind}, cluster int, distance long")


def cluster(embeddings: DataFrame, clusters: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: str = "2", block: int = 1024, leaf: int = 8, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per usable vector: the id, cluster, distance (squared), cluster_inertia, inertia, centroid (its final centroid).

    A vector is usable with `dimensions` components, none null or not finite; others, and null vectors, have no row. Component x becomes floor(scale * x). The centroids
    0, 1, ... start as the vectors of the smallest sha256 of "seed:id", and are replaced after each round by their vectors' componentwise floor of the mean; one without
    vectors stays. Of equally near centroids the smaller number counts. Fewer usable vectors than clusters make so many clusters; none give no rows. Repeated rows each
    count and may start several centroids; equal ids are ordered by their vectors, and a null id counts as an empty one. Other columns are ignored. Components of
    2**27 or more after scaling are an error. The centroids (clusters x dimensions numbers) are all that the driver holds.
    """
    if not 0 < dimensions <= 128 or clusters < 1:
        raise ValueError("dimensions must be from 1 to 128, clusters at least 1")
    spark = embeddings.sparkSession
    narrow = embeddings.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("embedding")).where(usable(F.col("embedding"), dimensions))
    kind = narrow.schema["id"].dataType.simpleString()
    first = narrow.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "embedding").limit(clusters).collect()
    schema = f"`{id_column}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.stack([whole_numbers(np.array(r["embedding"], np.float64), scale) for r in first])
    blocks = kept(block_trees(narrow, dimensions, scale, block, leaf), "cover-trees")
    for _ in range(rounds):
        for number, (n, total) in sums(blocks, centroids).items():
            centroids[number] = [x // n for x in total]
    found = kept(assigned(blocks, centroids, kind), "clusters")
    removed(blocks)
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per cluster
    total = sum(inertia.values())
    about = spark.createDataFrame([(k, s, total, centroids[k].tolist()) for k, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
