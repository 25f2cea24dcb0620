"""Lloyd rounds over trees against plain Python."""

import hashlib

import numpy as np
import pytest

from quarry.llm.dual_tree import cluster, cover_tree, nearest


@pytest.mark.parametrize("leaf", [1, 4])
def test_cover_tree(leaf):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-9, 9, (120, 3)), np.repeat(rng.integers(-9, 9, (1, 3)), 40, 0)])
    t = cover_tree(points, leaf)
    assert sorted(t.order) == list(range(160))
    for k in range(len(t.centre)):
        away = np.linalg.norm(points[t.order[t.low[k] : t.high[k]]] - points[t.centre[k]], axis=1)
        assert away.max() <= t.radius[k] + 1e-9
        children = range(t.child_low[k], t.child_high[k])
        if len(children):
            assert t.centre[children[0]] == t.centre[k]
            assert [t.low[c] for c in children] + [t.high[k]] == [t.low[k]] + [t.high[c] for c in children]
            level = t.radius[k] / 1.3
            assert all(np.linalg.norm(points[t.centre[a]] - points[t.centre[b]]) > level for a in children for b in children if a < b)
        else:
            assert t.high[k] - t.low[k] <= leaf or t.radius[k] == 0


def test_nearest_against_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(150):
        wide = int(rng.choice([2, 6, 1000, 1 << 26]))
        points = rng.integers(-wide, wide, (rng.integers(1, 150), rng.integers(1, 6)))
        centroids = rng.integers(-wide, wide, (rng.integers(1, 12), points.shape[1]))
        centroids[-1] = centroids[0]
        found, _ = nearest(points, cover_tree(points, int(rng.integers(1, 9))), centroids, cover_tree(centroids, 1))
        assert (found == ((points[:, None] - centroids[None]) ** 2).sum(2).argmin(1)).all()


def test_bounds_spare_comparisons():
    rng = np.random.default_rng(7)
    centres = rng.integers(-10_000, 10_000, (20, 64))
    points = (centres[rng.integers(0, 20, 1000)] + rng.integers(-50, 50, (1000, 64))).astype(np.int64)
    found, compared = nearest(points, cover_tree(points, 8), centres, cover_tree(centres, 1))
    assert (found == ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)).all()
    assert compared == 0


def lloyd(rows, clusters, rounds, dimensions, scale):
    usable = [(i, v) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    usable.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    whole = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in usable]
    centroids = [v for _, v in whole[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in whole]
        for k in set(own):
            mine = [v for (_, v), o in zip(whole, own, strict=True) if o == k]
            centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in whole]
    return sorted(((i, k, d, sum(e for _, e, j in last if j == k), sum(e for _, e, _ in last), centroids[k]) for i, d, k in last), key=repr)


def test_clusters(spark):
    rng = np.random.default_rng(11)
    rows = [(int(k), [float(x) for x in np.float32(rng.normal(size=4) + 5 * (k % 3))]) for k in range(120)]
    rows += [(7, [0.5] * 4), (7, [0.5] * 4), (None, [0.25] * 4)] + [(500 + k, [1.0, 2.0, -3.0, 0.0]) for k in range(60)]
    bad = [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0] * 5), (5, [1.0, None, 1.0, 1.0]), (6, [1.0, float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 as cluster", "'x' as id").repartition(5)
    for clusters, block in ((9, 16), (1, 1024), (500, 50)):
        got = cluster(df, clusters=clusters, rounds=3, dimensions=4, block=block)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(rows, clusters, 3, 4, 256)
    assert cluster(df.limit(0), dimensions=4).count() == 0
    assert cluster(df.where("embedding IS NULL"), dimensions=4).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    with pytest.raises(Exception, match="64 bits"):
        cluster(spark.createDataFrame([(1, [3e38] * 4)], "vec_id long, embedding array<float>"), dimensions=4).count()
