"""State that is let go, batches that come twice, and intents in any order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.operators import ledger as L
from quarry.operators import projection as P
from quarry.streaming import intents as I
from quarry.streaming import projections as R
from quarry.streaming.sink import MergedTable, drain

OBSERVED = "path string, projection_kind string, valid_at long, arrival long, status string, source_revision string, at timestamp"
WANTED = "scope string, epoch long, key string, tier long, rank long, at timestamp"


def feed(spark, folder, schema, batches):
    """A stream of one file a batch, with what it is given so far."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def time(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def test_merged_table_takes_a_batch_twice(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v long, n long").schema
    table = MergedTable(spark, f"file://{tmp_path}/t", schema, ("k",), ("v",), most_batches=3)
    assert table.read().count() == 0
    rng, rows = random.Random(1), []
    for number in range(9):
        batch = [(rng.choice("abcde"), rng.randint(0, 99), number) for _ in range(4)]
        rows += batch
        for _ in range(1 + number % 2):
            table.write(spark.createDataFrame(batch, schema), number)
        if number in (2, 5):  # the stream starts again from an earlier batch
            table.write(spark.createDataFrame(batch, schema), number)
            table.write(spark.createDataFrame([("z", 1000, 0)], schema), 0) if 0 not in table.batches() else None
        best = {k: max(v for x, v, _ in rows if x == k) for k, _, _ in rows}
        assert {r["k"]: r["v"] for r in table.read().collect()} == best and table.read().count() == len(best)
    assert len(table.batches()) <= 3
    assert len(list((tmp_path / "t" / "parts").iterdir())) == 1


def test_observations_are_let_go_and_results_stay(spark, tmp_path):
    rng = random.Random(2)
    batches = []
    for k in range(6):
        rows = [(f"p{rng.randint(0, 5)}/{k}", "m", rng.randint(0, 50), 100 * k + n, "x", "r", time(60 * k + n)) for n in range(8)]
        batches.append(rows + [("late", "m", 40 - 10 * k, 100 * k + 50, "x", "r", time(60 * k))])
    batches[5].append(("p0/0", "m", -5, 1, "late and older", "r", time(300)))
    stream = feed(spark, f"{tmp_path}/in", OBSERVED, batches)
    schema = spark.createDataFrame([], R.OUT).schema
    changes = R.accepted_observations(stream, keep_ms=30 * 60_000, delay="1 minute")
    table = MergedTable(spark, f"file://{tmp_path}/t", schema, P.KEY, ("valid_at", "arrival"))
    started = changes.writeStream.foreachBatch(table.write).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    started.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in started.recentProgress if p["stateOperators"]]
    keys = len({r[0] for b in batches for r in b})
    assert max(held) < keys  # the state never holds all of them
    want = P.latest(spark.createDataFrame([r for b in batches for r in b], OBSERVED).drop("at")).collect()
    assert sorted((r["path"], r["valid_at"], r["arrival"]) for r in table.read().collect()) == sorted((r["path"], r["valid_at"], r["arrival"]) for r in want)


@pytest.mark.parametrize("seed", [1, 2])
def test_intents_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"s{rng.randint(0, 3)}", rng.randint(0, 4), f"k{rng.randint(0, 9)}", rng.randint(0, 2), rng.randint(0, 9), time(n)) for n in range(150)]
    shuffled = rng.sample(rows, len(rows))
    stream = feed(spark, f"{tmp_path}/in", WANTED, [shuffled[k : k + 38] for k in range(0, 150, 38)])
    changes = I.intent_changes(stream)
    table = MergedTable(spark, f"file://{tmp_path}/t", changes.schema, ("scope", "key"), ("version",))
    got = I.effective(drain(changes, table, "update", f"{tmp_path}/c")).collect()
    want = L.effective_positions(spark.createDataFrame(rows, WANTED).drop("at")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def reconciled(epochs, omitted):
    """One scope after its epochs in order."""
    held = {}
    for wanted in epochs:
        left_out = sorted((p, k) for k, p in held.items() if k not in wanted)
        held = dict(wanted)
        if omitted is not None:
            own = [k for k in held if held[k][0] == omitted.tier]
            start = 0 if omitted.front else max([held[k][1] + 1 for k in own], default=0)
            for k in own if omitted.front else []:
                held[k] = (omitted.tier, held[k][1] + len(left_out))
            held.update({k: (omitted.tier, start + n) for n, (_, k) in enumerate(left_out)})
    return held


@pytest.mark.parametrize("omitted", [None, I.Demote(1), I.Demote(1, front=True)])
def test_what_an_epoch_leaves_out(spark, tmp_path, omitted):
    rng = random.Random(5)
    epochs = {s: [{f"k{k}": (rng.randint(0, 2), rng.randint(0, 5)) for k in rng.sample(range(8), 4)} for _ in range(4)] for s in ("a", "b")}
    batches = [[(s, e, k, *p, time(e)) for s in epochs for k, p in epochs[s][e].items()] for e in range(4)]
    changes = I.intent_changes(feed(spark, f"{tmp_path}/in", WANTED, batches), omitted)
    table = MergedTable(spark, f"file://{tmp_path}/t", changes.schema, ("scope", "key"), ("version",))
    rows = drain(changes, table, "update", f"{tmp_path}/c").where("tier IS NOT NULL").collect()
    for s in epochs:
        assert {r["key"]: (r["tier"], r["rank"]) for r in rows if r["scope"] == s} == reconciled(epochs[s], omitted)


def test_a_silent_scope_is_released(spark, tmp_path):
    batches = [[("old", 3, "x", 0, 0, time(0)), ("busy", 1, "y", 0, 0, time(0))], [("busy", 2, "y", 0, 1, time(20))], [("busy", 3, "y", 0, 2, time(40))], [("old", 2, "z", 0, 0, time(41)), ("busy", 4, "y", 0, 3, time(60))]]
    changes = I.intent_changes(feed(spark, f"{tmp_path}/in", WANTED, batches), quiet_ms=30 * 60_000)
    table = MergedTable(spark, f"file://{tmp_path}/t", changes.schema, ("scope", "key"), ("version",))
    rows = {(r["scope"], r["key"]): r["tier"] for r in drain(changes, table, "update", f"{tmp_path}/c").collect()}
    assert rows == {("old", "x"): None, ("busy", "y"): 0}  # and the older epoch of the silent one is refused
    assert [tuple(r) for r in I.effective(table.read()).collect()] == [("y", 0, 3)]
    assert table.read().where(F.col("scope") == "old").first()["epoch"] == 3
