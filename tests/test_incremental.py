"""Bursts regrouped batch by batch, and searches that pass over blocks, against the whole work."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import sequence as B
from quarry.operators import vectors as V
from quarry.sources.vector_blocks import VectorBlocks

FRAME = "folder string, position long, number int, apart boolean, seconds long"


def whole(frames):
    found = B.bursts(frames, ["folder"], ["position"], "number", F.col("apart"), F.col("seconds"))
    return sorted((r["folder"], r["p"]) for r in found.groupBy("folder", "run").agg(F.array_sort(F.collect_list("position")).alias("p")).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_regrouping(spark, seed):
    rng = random.Random(seed)
    held = {}

    def some(n):
        out = {}
        for _ in range(n):
            at = (f"f{rng.randint(0, 3)}", rng.randint(0, 60))
            out[at] = (*at, None if rng.random() < 0.05 else at[1] // (2 * seed) + rng.choice([0, 0, 0, 1]), rng.random() < 0.1, rng.choice([None, at[1], at[1] + 9, 3 * at[1]]))
        return out

    held.update(some(60))
    state = B.stretches(spark.createDataFrame(list(held.values()), FRAME))
    assert sorted((r["folder"], r["positions"]) for r in B.bursts_of(state).collect()) == whole(spark.createDataFrame(list(held.values()), FRAME))
    for _ in range(5):
        new, gone = some(12), set(rng.sample(sorted(held), min(5, len(held))))
        changes = [(*new[k], False) for k in new if k not in gone] + [(*k, None, None, None, True) for k in gone]
        held = {k: v for k, v in (held | new).items() if k not in gone}
        state = spark.createDataFrame(B.regroup(state, spark.createDataFrame(changes, FRAME + ", gone boolean")).collect(), state.select(*B.FRAME, "skipped", "stretch").schema)
        frames = spark.createDataFrame(list(held.values()), FRAME)
        assert sorted((r["folder"], r["positions"]) for r in B.bursts_of(state).collect()) == whole(frames)
        assert state.count() == len(held)
        fresh = B.stretches(frames)
        assert sorted(tuple(r) for r in fresh.select("folder", "position", "stretch", "skipped").collect()) == sorted(tuple(r) for r in state.select("folder", "position", "stretch", "skipped").collect())


def test_blocks_are_passed_over(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    vectors = [(int(k), [float(x) for x in np.float32((centres[k % 12] + 0.15 * rng.normal(size=24)) * rng.uniform(0.5, 2))]) for k in range(1500)]
    odd = [(9001, [0.0] * 24), (9002, [1.0] * 5), (9003, None), (9004, [float("nan")] * 24), (9005, vectors[0][1]), (9006, vectors[0][1])]
    features = spark.createDataFrame(vectors + odd, "feature_row_id long, vector array<float>").repartition(4)
    stored = VectorBlocks(spark, f"file://{tmp_path}/v")
    stored.build(features, pivots=16, files=40)
    total = stored.blocks().count()
    for threshold in (-1.0, 0.0, 0.5, 0.9, 0.999999):
        for query in (vectors[0][1], vectors[5][1], [1.0] * 24):
            want = {r["feature_row_id"]: r["similarity"] for r in V.search(features, query, threshold, valid_only=False).collect()}
            got = {r["feature_row_id"]: r["similarity"] for r in stored.search(query, threshold, valid_only=False).collect()}
            assert got == want
    assert len(stored.blocks_for(vectors[0][1], 0.9)) < total / 2 and len(stored.blocks_for(vectors[0][1], -1.0)) == total
    assert stored.search([0.0] * 24, 0.0).count() == 0 and stored.search([1.0] * 5, 0.5, valid_only=False).count() == 0
    empty = VectorBlocks(spark, f"file://{tmp_path}/e")
    empty.build(features.limit(0))
    assert empty.search([1.0] * 24, 0.0).count() == 0
