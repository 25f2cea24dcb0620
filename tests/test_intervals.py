"""Trees as intervals against plain Python."""

import random

import pytest

from quarry.operators import intervals as N
from quarry.operators import tags as T

SCHEMA = "id long, parent_id long, name string, sort_order long"


def walk(rows):
    """(low, high, depth) of each node."""
    ids = {r[0] for r in rows}
    children = {}
    for i, parent, _, order in rows:
        children.setdefault(parent if parent in ids else None, []).append((order or 0, i))
    out, number = {}, 0
    waiting = [(i, 0, False) for _, i in sorted(children.get(None, []), reverse=True)]
    while waiting:
        i, depth, leaving = waiting.pop()
        if leaving:
            out[i] = (out[i][0], number, depth)
        else:
            out[i] = (number, None, depth)
            waiting.append((i, depth, True))
            waiting += [(c, depth + 1, False) for _, c in sorted(children.get(i, []), reverse=True)]
        number += 1
    return out


def trees():
    rng = random.Random(3)
    bushy = [(k, rng.choice([None, 999, *range(k)]) if k else None, f"t{k}", rng.choice([None, -5, 0, 3])) for k in range(60)]
    deep = [(k, k - 1 if k else None, "d", 0) for k in range(70)]
    wide = [(0, None, "root", 0)] + [(k, 0, "w", -k) for k in range(1, 150)]
    return {"bushy": bushy, "deep": deep, "wide": wide, "one": [(7, None, "x", None)], "two": [(7, None, "x", 1), (8, None, "y", 0)]}


@pytest.mark.parametrize("name", sorted(trees()))
def test_intervals(spark, name):
    rows = trees()[name]
    tags = spark.createDataFrame(rows, SCHEMA).repartition(3)
    numbered = N.intervals(tags)
    got = {r["id"]: (r["low"], r["high"], r["depth"]) for r in numbered.collect()}
    want = walk(rows)
    assert got == want
    if name == "bushy":
        inside = lambda a, b: a in want and b in want and want[a][0] <= want[b][0] <= want[a][1]
        asked = spark.createDataFrame([(a, b) for a in range(0, 63, 3) for b in range(0, 63, 2)], "root long, tag long")
        assert all(r["contained"] == inside(r["root"], r["tag"]) for r in N.subtree_tests(numbered, asked).collect())
        assert {r["id"]: r["tags"] for r in N.subtree_sizes(numbered).collect()} == {a: sum(inside(a, b) for b in want) for a in want}
        rng = random.Random(4)
        assigned = spark.createDataFrame([(f"/a{rng.randint(0, 40)}", rng.choice([*range(60), 500])) for _ in range(200)], "asset_path string, tag_id long")
        closed = T.closure(spark.createDataFrame([(i, p if p != 999 else None, n, s) for i, p, n, s in rows], SCHEMA))
        for selected in ([0], [0, 500], [3, 7, 7], [12345], []):
            for every in (True, False):
                own = sorted(map(tuple, N.match_assets(numbered, assigned, selected, every).collect()))
                assert own == (sorted(map(tuple, T.match_assets(closed, assigned, selected, every).collect())) if selected else [])


def test_cycles_and_emptiness(spark):
    with pytest.raises(ValueError, match="cycle"):
        N.intervals(spark.createDataFrame([(0, None, "r", 0), (1, 2, "a", 0), (2, 3, "b", 0), (3, 1, "c", 0)], SCHEMA))
    assert N.intervals(spark.createDataFrame([], SCHEMA)).count() == 0
