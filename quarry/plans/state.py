"""Queries of projections, bursts, the ledger and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import ledger as L
from quarry.operators import metadata as M
from quarry.operators import projection as P
from quarry.operators import sequence as B
from quarry.plans.registry import Register
from quarry.plans.views import TASKS, table, tasks
from quarry.sources import sidecars as C
from quarry.tables import kept, new_path

register = Register()
QUERIES, ORACLE = register.queries, register.oracle

OBSERVATIONS = """obs AS (SELECT 'u' || user_id AS path, event_type AS projection_kind, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS valid_at, event_id AS arrival, CAST(event_id % 4 AS BIGINT) AS state_revision, CAST(value AS VARCHAR) AS status FROM events)"""


def _observations(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """events, or a stream of them, as observations, their time in whole hours, so that there are ties."""
    hours = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    return (events or table(spark, sf_dir, "events")).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("projection_kind"), hours.alias("valid_at"), F.col("event_id").alias("arrival"),
        (F.col("event_id") % 4).cast("long").alias("state_revision"), F.col("value").cast("string").alias("status"))


@register(f"WITH {OBSERVATIONS} SELECT path, projection_kind, valid_at, arrival FROM (SELECT *, row_number() OVER (PARTITION BY path, projection_kind ORDER BY valid_at DESC, arrival DESC) AS k FROM obs) x WHERE k = 1")
def projection_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest(_observations(spark, sf_dir)).select("path", "projection_kind", "valid_at", "arrival")


@register(f"""WITH {OBSERVATIONS}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, projection_kind ORDER BY valid_at DESC, arrival DESC) AS k FROM obs WHERE arrival % 2 = 0) x WHERE k = 1),
b AS (SELECT *, 1 AS turn FROM obs WHERE arrival % 2 = 1 UNION ALL SELECT path, projection_kind, valid_at, arrival, state_revision, status, 0 FROM a)
SELECT path, projection_kind, valid_at, arrival FROM (SELECT *, row_number() OVER (PARTITION BY path, projection_kind ORDER BY valid_at DESC, turn DESC, arrival DESC) AS k FROM b) x WHERE k = 1""")
def projection_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _observations(spark, sf_dir)
    return P.fold(P.latest(obs.where("arrival % 2 = 0")).select(*obs.columns), obs.where("arrival % 2 = 1")).select("path", "projection_kind", "valid_at", "arrival")


@register(f"""WITH RECURSIVE {OBSERVATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY path, projection_kind ORDER BY arrival) AS k FROM obs),
s AS (SELECT path, projection_kind, k, valid_at, state_revision, arrival FROM r WHERE k = 1
  UNION ALL SELECT s.path, s.projection_kind, r.k,
    CASE WHEN r.valid_at >= s.valid_at AND (r.state_revision = 0 OR r.state_revision >= s.state_revision) THEN r.valid_at ELSE s.valid_at END,
    CASE WHEN r.valid_at >= s.valid_at AND (r.state_revision = 0 OR r.state_revision >= s.state_revision) THEN r.state_revision ELSE s.state_revision END,
    CASE WHEN r.valid_at >= s.valid_at AND (r.state_revision = 0 OR r.state_revision >= s.state_revision) THEN r.arrival ELSE s.arrival END
  FROM s JOIN r ON r.path = s.path AND r.projection_kind = s.projection_kind AND r.k = s.k + 1)
SELECT path, projection_kind, arrival FROM (SELECT *, row_number() OVER (PARTITION BY path, projection_kind ORDER BY k DESC) AS last FROM s) x WHERE last = 1""")
def projection_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fold_images(_observations(spark, sf_dir)).select("path", "projection_kind", "arrival")


@register(f"WITH {OBSERVATIONS} SELECT arrival, row_number() OVER (PARTITION BY path, projection_kind ORDER BY valid_at, arrival) AS state_revision FROM obs")
def projection_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.numbered(_observations(spark, sf_dir)).select("arrival", F.col("state_revision").cast("long").alias("state_revision"))


@register(f"""WITH {OBSERVATIONS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, projection_kind ORDER BY valid_at DESC, arrival DESC) AS k FROM obs) x WHERE k = 1)
SELECT path, projection_kind, CASE WHEN path LIKE '%3' THEN 'error' ELSE 'ready' END AS status, CASE WHEN path LIKE '%3' THEN NULL ELSE '{{}}' END AS result_json, CASE WHEN path LIKE '%3' THEN greatest(valid_at, 500000) ELSE valid_at END AS valid_at FROM l""")
def projection_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = P.latest(_observations(spark, sf_dir)).withColumns({"parent_path": F.when(F.col("path").endswith("3"), "/three").otherwise("/rest"), "status": F.lit("ready"), "result_json": F.lit("{}")})
    return P.invalidated(state, "/three", 500000).select("path", "projection_kind", "status", "result_json", "valid_at")


@register(f"""WITH {OBSERVATIONS} SELECT path, projection_kind, CASE WHEN projection_kind LIKE 'c%' THEN 'error' ELSE 'ready' END AS status, CASE WHEN projection_kind LIKE 'c%' THEN 9 ELSE max(valid_at) END AS valid_at FROM obs GROUP BY path, projection_kind""")
def projection_image_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("projection_kind").startswith("c"), F.concat(F.lit("image:"), "projection_kind")).otherwise(F.col("projection_kind"))
    state = P.latest(_observations(spark, sf_dir)).withColumns({"projection_kind": named, "status": F.lit("ready")})
    return P.images_invalidated(state, 9).select("path", F.regexp_replace("projection_kind", "^image:", "").alias("projection_kind"), "status", F.col("valid_at").cast("long").alias("valid_at"))


@register("""
SELECT p_partkey, o_orderkey FROM part JOIN (SELECT o_orderkey, o_custkey, (o_orderkey % 3) || ':' || (o_orderkey % 2) || ':x' AS rev, o_orderstatus FROM orders) o
  ON o_custkey = p_partkey WHERE o_orderstatus = 'F' AND starts_with(rev, (p_size % 3) || ':' || (p_partkey % 2) || ':')""")
def projection_stale_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    state = orders.select(F.col("o_custkey").alias("path"), "o_orderkey", F.concat_ws(":", (F.col("o_orderkey") % 3).cast("string"), (F.col("o_orderkey") % 2).cast("string"), F.lit("x")).alias("source_revision"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("error").alias("status"))
    found = P.while_revalidating(state, part.select(F.col("p_partkey").alias("path"), (F.col("p_size") % 3).alias("modified_at_ms"), (F.col("p_partkey") % 2).alias("size_bytes")))
    return found.select(F.col("path").alias("p_partkey"), "o_orderkey")


@register("""
SELECT p_partkey, o_orderstatus AS color_label, o_orderkey IS NULL AS missing FROM part LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) o ON o.o_orderkey = p_partkey AND o.o_custkey % 5 = p_size % 5""")
def projection_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 5).cast("int").alias("source_revision"), F.lit(1).alias("rating"), F.col("o_orderstatus").alias("color_label"), F.lit(None).cast("string").alias("pick_label"))
    assets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), (F.col("p_size") % 5).alias("fingerprint"))
    return P.enriched(assets, state).select(F.col("path").alias("p_partkey"), "color_label", "missing")


@register(f"WITH {OBSERVATIONS} SELECT path, state_revision, arrival FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY state_revision DESC, arrival) AS k FROM obs) x WHERE k = 1")
def projection_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.newest_events(_observations(spark, sf_dir)).select("path", "state_revision", "arrival")


BURSTS = """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn, l_returnflag = 'R' AS apart FROM lineitem),
s AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY rn) AS segment FROM f),
d AS (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey, segment ORDER BY rn) AS before FROM s WHERE NOT apart),
k AS (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey, segment ORDER BY rn) AS last, lag(l_shipdate) OVER (PARTITION BY l_orderkey, segment ORDER BY rn) AS shipped FROM d WHERE before IS NULL OR before <> l_linenumber),
b AS (SELECT *, sum(CASE WHEN l_linenumber = last + 1 AND abs(date_diff('second', shipped, l_shipdate)) <= 400 * 86400 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY rn) AS run FROM k),
n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, run) AS size FROM b)
SELECT l_orderkey, CAST(rn AS BIGINT) AS rn, CAST(size AS BIGINT) AS size, CAST(row_number() OVER (PARTITION BY l_orderkey, run ORDER BY rn) - 1 AS BIGINT) AS place FROM n WHERE size >= 2"""


@register(BURSTS)
def burst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long"))
    found = B.bursts(rows, ["l_orderkey"], ["rn"], "l_linenumber", F.col("l_returnflag") == "R", F.unix_seconds(F.col("l_shipdate").cast("timestamp")), 400 * 86400)
    return found.select("l_orderkey", "rn", "size", F.col("place").cast("long").alias("place"))


@register(BURSTS)
def burst_regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bursts when frames come in three batches and every eleventh is wrong at first."""
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long"))
    frames = kept(B.frames_of(rows, "l_orderkey", "rn", "l_linenumber", F.col("l_returnflag") == "R", F.unix_seconds(F.col("l_shipdate").cast("timestamp"))), "frames")
    turn = (F.xxhash64("folder", "position") % 11 + 11) % 11
    wrong = frames.withColumn("number", F.when(turn == 10, F.col("number") + 1).otherwise(F.col("number")))
    state = kept(B.stretches(wrong.where(turn % 3 != 1), 400 * 86400), "stretches")
    for batch in (wrong.where(turn % 3 == 1).withColumn("gone", F.lit(False)), frames.where(turn == 10).withColumn("gone", F.lit(False))):
        state = kept(B.regroup(state, batch, 400 * 86400), "stretches")
    return B.bursts_of(state).select(F.col("folder").alias("l_orderkey"), F.size("positions").cast("long").alias("size"), F.posexplode("positions").alias("place", "rn")).select("l_orderkey", "rn", "size", F.col("place").cast("long").alias("place"))


@register("SELECT o_custkey, CAST(greatest(count(*) FILTER (WHERE o_orderstatus = 'F'), 10 - (count(*) - count(*) FILTER (WHERE o_orderstatus = 'F'))) AS BIGINT) AS total FROM orders GROUP BY o_custkey")
def burst_adjusted_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("loaded"), F.count_if(F.col("o_orderstatus") == "F").alias("visible"))
    return shown.select("o_custkey", B.adjusted_total(F.lit(10), F.col("loaded"), F.col("visible")).alias("total"))


@register("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders")
def exif_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"), F.lit("+09:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.exif_seconds(text).alias("seconds"))


@register(f"""WITH {TASKS} SELECT run_id, asset_path, stage_id FROM tasks t WHERE state = 'queued' AND NOT EXISTS (SELECT 1 FROM tasks e WHERE e.run_id = t.run_id AND e.asset_path = t.asset_path AND e.stage_order < t.stage_order AND e.state <> 'completed')""")
def claimable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.claimable(tasks(spark, sf_dir)).select("run_id", "asset_path", "stage_id")


@register(f"""WITH {TASKS}, c AS (SELECT * FROM tasks t WHERE state = 'queued' AND NOT EXISTS (SELECT 1 FROM tasks e WHERE e.run_id = t.run_id AND e.asset_path = t.asset_path AND e.stage_order < t.stage_order AND e.state <> 'completed'))
SELECT run_id, asset_path, stage_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY asset_path, stage_order) AS k FROM c) x WHERE k = 1""")
def next_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.next_task(tasks(spark, sf_dir)).select("run_id", "asset_path", "stage_id")


@register(f"""WITH {TASKS} SELECT run_id, asset_path, stage_id, CASE WHEN state = 'queued' AND EXISTS (SELECT 1 FROM tasks e WHERE e.run_id = t.run_id AND e.asset_path = t.asset_path AND e.stage_order < t.stage_order AND e.state = 'failed') THEN 'failed' ELSE state END AS state FROM tasks t""")
def failure_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cascade(tasks(spark, sf_dir)).select("run_id", "asset_path", "stage_id", "state")


@register(f"""WITH {TASKS}, e AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE state = 'completed') AS done, count(*) FILTER (WHERE state = 'failed') AS failed FROM tasks WHERE run_id <> 'run:7' AND (state <> 'queued' OR run_id LIKE '%3') GROUP BY run_id)
SELECT run_id, done, failed, CASE WHEN run_id = 'run:9' THEN 'running' WHEN done + failed >= total THEN CASE WHEN failed = 0 THEN 'completed' ELSE 'failed' END ELSE 'running' END AS state FROM e UNION ALL SELECT 'run:7', 0, 0, 'completed'""")
def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tasks(spark, sf_dir).where("run_id != 'run:7' AND (state != 'queued' OR run_id LIKE '%3')")
    totals = own.groupBy("run_id").agg(F.count("*").alias("total")).unionByName(spark.range(1).select(F.lit("run:7").alias("run_id"), F.lit(0).cast("long").alias("total")))
    runs = totals.select("run_id", (F.col("run_id") != "run:9").alias("sealed"), "total", F.lit("running").alias("state"))
    return L.roll_up(runs, own).select("run_id", F.col("done").cast("long").alias("done"), F.col("failed").cast("long").alias("failed"), "state")


@register(f"WITH {TASKS} SELECT run_id, asset_path, stage_id, CASE WHEN stage_order % 2 = 0 AND state = 'queued' THEN 'queued' ELSE state END AS state FROM tasks")
def ledger_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = tasks(spark, sf_dir).withColumns({"claim_token": F.when(F.col("stage_order") % 2 == 0, "t"), "state": F.when((F.col("stage_order") % 2 == 0) & (F.col("state") == "queued"), "running").otherwise(F.col("state"))})
    return L.recover(half).select("run_id", "asset_path", "stage_id", "state")


@register("""
WITH runs AS (SELECT 'run:' || o_orderkey AS run_id, 'f' || o_custkey AS folder_path, 'q' || o_orderkey AS request_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS generation FROM orders WHERE o_orderkey % 3 = 0),
new AS (SELECT 'q' || o_orderkey AS request_id, 'f' || o_custkey AS folder_path, o_orderkey AS seq FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0)
SELECT run_id, generation, CASE WHEN folder_path IN (SELECT folder_path FROM new) THEN 'cancelled' ELSE 'running' END AS state FROM runs
UNION ALL SELECT 'run:' || request_id, coalesce((SELECT max(generation) FROM runs r WHERE r.folder_path = n.folder_path), 0) + row_number() OVER (PARTITION BY folder_path ORDER BY seq),
  CASE WHEN row_number() OVER (PARTITION BY folder_path ORDER BY seq DESC) = 1 THEN 'running' ELSE 'cancelled' END FROM new n""")
def ledger_begin(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("at"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("folder_path"), F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("request_id"))
    runs = o.where("at % 3 = 0").select(F.concat(F.lit("run:"), F.col("at").cast("string")).alias("run_id"), "folder_path", "request_id", F.row_number().over(Window.partitionBy("folder_path").orderBy("at")).cast("long").alias("generation"), F.lit("running").alias("state"), F.lit(False).alias("sealed"), F.lit(0).alias("total"))
    return L.begin_runs(runs, o.where("at % 2 = 0")).select("run_id", "generation", "state")


@register(f"""WITH {TASKS} SELECT run_id, asset_path, stage_id, 'kept' AS what FROM tasks WHERE stage_order < 5 UNION ALL SELECT run_id, asset_path, stage_id, 'added' FROM tasks WHERE stage_order >= 5
UNION ALL SELECT run_id, asset_path, stage_id, 'conflict' FROM tasks WHERE stage_order = 4""")
def ledger_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tasks(spark, sf_dir)
    batch = own.where("stage_order >= 3").withColumn("stage_fingerprint", F.when(F.col("stage_order") == 4, "other").otherwise(F.col("stage_fingerprint")))
    after, conflicts = L.enqueue(own.where("stage_order < 5"), batch)
    what = F.when(F.col("stage_order") < 5, "kept").otherwise("added").alias("what")
    return after.select("run_id", "asset_path", "stage_id", what).unionByName(conflicts.select("run_id", "asset_path", "stage_id", F.lit("conflict").alias("what")))


@register(f"""WITH {TASKS}, c AS (SELECT * FROM tasks t WHERE state = 'queued' AND NOT EXISTS (SELECT 1 FROM tasks e WHERE e.run_id = t.run_id AND e.asset_path = t.asset_path AND e.stage_order < t.stage_order AND e.state <> 'completed'))
, a AS (SELECT t.*, CASE WHEN c.stage_id IS NULL THEN t.state WHEN t.asset_path % 4 = 0 THEN 'failed' WHEN t.asset_path % 4 = 1 THEN 'running' ELSE 'completed' END AS now
  FROM tasks t LEFT JOIN c ON c.run_id = t.run_id AND c.asset_path = t.asset_path AND c.stage_id = t.stage_id)
SELECT run_id, asset_path, stage_id, CASE WHEN now = 'queued' AND EXISTS (SELECT 1 FROM a e WHERE e.run_id = a.run_id AND e.asset_path = a.asset_path AND e.stage_order < a.stage_order AND e.now = 'failed') THEN 'failed' ELSE now END AS state FROM a""")
def ledger_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tasks(spark, sf_dir)
    claims = own.select(*L.TASK, F.explode(F.array(F.lit("t2"), F.lit("t1"))).alias("claim_token"))
    running = L.apply_claims(own, claims)
    token = F.when(F.col("asset_path") % 4 == 1, "t2").otherwise("t1")
    outcomes = own.select(*L.TASK, "source_revision", "stage_fingerprint", token.alias("claim_token"), F.when(F.col("asset_path") % 4 == 0, "failed").otherwise("completed").alias("outcome"), F.lit("e").alias("error"))
    return L.apply_outcomes(running, outcomes).select("run_id", "asset_path", "stage_id", "state")


@register("SELECT user_id AS key, max(CAST(value AS INTEGER) % 5) AS priority, min(event_id) AS seq, arg_max(event_type, event_id) AS payload FROM events GROUP BY user_id".replace("CAST(value AS INTEGER)", "CAST(floor(value) AS INTEGER)"))
def request_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.floor("value").cast("int") % 5).alias("priority"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return L.coalesce_requests(e)


@register("""
WITH i AS (SELECT 's' || (event_id % 7) AS scope, event_id // 500 AS epoch, user_id AS key, CAST(floor(value) AS BIGINT) % 3 AS tier, event_id % 11 AS rank FROM events),
n AS (SELECT scope, max(epoch) AS epoch FROM i GROUP BY scope), c AS (SELECT i.* FROM i JOIN n ON n.scope = i.scope AND n.epoch = i.epoch)
SELECT key, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, rank) AS k FROM c) x WHERE k = 1""")
def scoped_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string")).alias("scope"), F.floor(F.col("event_id") / 500).alias("epoch"), F.col("user_id").alias("key"), (F.floor("value").cast("long") % 3).alias("tier"), (F.col("event_id") % 11).alias("rank"))
    return L.effective_positions(e)


TAG_ROWS = """t AS (
  SELECT 'o' || o_orderkey AS path, 0 AS ord, 'EXIF' AS "group", 'Make' AS name, o_orderpriority AS value FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 'o' || o_orderkey, 1, 'EXIF', 'Make', 'second' FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 2, 'XMP', 'Make', CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE ' xmp ' END FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 'o' || o_orderkey, 3, 'EXIF', 'FNumber', (o_orderkey % 50) || '/10' FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 4, 'EXIF', 'ExposureCompensation', CASE WHEN o_orderkey % 2 = 0 THEN '-1/4' ELSE '0/3' END FROM orders)"""


@register(f"""WITH {TAG_ROWS}, w AS (SELECT path, arg_min(value, ord) FILTER (WHERE "group" = 'EXIF' AND name = 'Make') AS exif, nullif(trim(arg_min(value, ord) FILTER (WHERE "group" = 'XMP' AND name = 'Make')), '') AS xmp,
  CAST(string_split(max(value) FILTER (WHERE name = 'FNumber'), '/')[1] AS INTEGER) AS f, max(value) FILTER (WHERE name = 'ExposureCompensation') AS ev FROM t GROUP BY path)
SELECT path, coalesce(xmp, exif) AS camera_make, 'f/' || CASE WHEN f % 10 = 0 THEN CAST(f // 10 AS VARCHAR) ELSE (f // 10) || '.' || (f % 10) END AS aperture, CASE WHEN ev = '-1/4' THEN '-0.25 EV' ELSE '0 EV' END AS exposure_compensation FROM w""")
def eav_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    row = lambda d, k, g, n, v: d.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.lit(k).alias("ord"), F.lit(g).alias("group"), F.lit(n).alias("name"), v.alias("value"))
    rows = row(o.where("o_orderkey % 2 = 0"), 0, "EXIF", "Make", F.col("o_orderpriority")).unionByName(row(o, 1, "EXIF", "Make", F.lit("second")))
    rows = rows.unionByName(row(o.where("o_orderkey % 3 = 0"), 2, "XMP", "Make", F.when(F.col("o_orderkey") % 4 == 0, "  ").otherwise(" xmp ")))
    rows = rows.unionByName(row(o, 3, "EXIF", "FNumber", F.concat((F.col("o_orderkey") % 50).cast("string"), F.lit("/10"))))
    rows = rows.unionByName(row(o, 4, "EXIF", "ExposureCompensation", F.when(F.col("o_orderkey") % 2 == 0, "-1/4").otherwise("0/3")))
    return M.capture(rows).select("path", "camera_make", "aperture", "exposure_compensation")


@register("""
SELECT c_custkey AS k, coalesce(nullif(trim(s.name), ''), c_name) AS name, coalesce(CAST(s.bal AS VARCHAR), CAST(c_nationkey AS VARCHAR)) AS bal FROM customer
LEFT JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '  ' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey END AS bal FROM supplier) s ON s_suppkey = c_custkey""")
def metadata_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    below = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("bal"))
    above = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, "  ").otherwise(F.col("s_name")).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey")).alias("bal"))
    return M.overlay(below, above, "k", ["name", "bal"])


LABEL = "CASE o_orderkey % 6 WHEN 0 THEN ' red ' WHEN 1 THEN 'NONE' WHEN 2 THEN '' WHEN 3 THEN 'PURPLE' WHEN 4 THEN 'Teal' END"


@register(f"SELECT o_orderkey, CASE WHEN lower(trim({LABEL})) IN ('', 'none') THEN NULL WHEN lower(trim({LABEL})) = 'red' THEN 'Red' WHEN lower(trim({LABEL})) = 'purple' THEN 'Purple' ELSE trim({LABEL}) END AS color FROM orders")
def color_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.color_label(F.expr(LABEL)).alias("color"))


@register("""SELECT o_orderkey, CASE r WHEN ' 1' THEN 'rejected' WHEN 'Pending' THEN 'pending' WHEN 'PICKED ' THEN 'accepted' WHEN '3' THEN 'accepted' END AS pick,
  CASE WHEN r IN (' 1') THEN 1 WHEN r = '3' THEN 3 WHEN r = '+4' THEN 4 END AS rating
FROM (SELECT o_orderkey, ([' 1', 'Pending', 'PICKED ', '3', '6', '3.0', '', '+4', '-1', '300'])[CAST(o_orderkey % 11 + 1 AS INTEGER)] AS r FROM orders) x""")
def pick_and_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(*map(F.lit, (" 1", "Pending", "PICKED ", "3", "6", "3.0", "", "+4", "-1", "300")))
    r = F.get(values, (F.col("o_orderkey") % 11).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.pick_label(r).alias("pick"), X.rating(r).alias("rating"))


@register("""SELECT o_orderkey, CASE v WHEN 'YCbCr4:2:0' THEN '4:2:0' WHEN '2x1' THEN '4:2:2' WHEN ' 2, 2 ' THEN '4:2:0' WHEN '4:4:4' THEN '4:4:4' END AS chroma,
  CASE WHEN m = 'NIKON CORPORATION' THEN 'nikon' WHEN m = 'OM Digital Solutions' THEN 'olympus' WHEN m = 'FUJIFILM' THEN 'fujifilm' ELSE 'other' END AS vendor
FROM (SELECT o_orderkey, (['YCbCr4:2:0', '2x1', ' 2, 2 ', '4:4:4', '9 9'])[CAST(o_orderkey % 6 + 1 AS INTEGER)] AS v, (['NIKON CORPORATION', 'OM Digital Solutions', 'FUJIFILM', 'Leica'])[CAST(o_orderkey % 5 + 1 AS INTEGER)] AS m FROM orders) x""")
def chroma_and_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("o_orderkey") % n).cast("int"))
    chroma, make = pick(("YCbCr4:2:0", "2x1", " 2, 2 ", "4:4:4", "9 9"), 6), pick(("NIKON CORPORATION", "OM Digital Solutions", "FUJIFILM", "Leica"), 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.chroma_subsampling(chroma).alias("chroma"), X.camera_vendor(make).alias("vendor"))


@register("""SELECT p_partkey, CASE WHEN o BETWEEN 5 AND 8 THEN h ELSE w END AS width, CASE WHEN o BETWEEN 5 AND 8 THEN w ELSE h END AS height,
  CASE o WHEN 2 THEN w - x WHEN 3 THEN w - x WHEN 5 THEN y WHEN 6 THEN h - y WHEN 7 THEN h - y WHEN 8 THEN y ELSE x END AS px,
  CASE o WHEN 3 THEN h - y WHEN 4 THEN h - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN w - x WHEN 8 THEN w - x ELSE y END AS py
FROM (SELECT p_partkey, CAST(p_partkey % 10 AS INTEGER) AS o, 600 AS w, 400 AS h, p_size * 5 AS x, p_size * 3 AS y FROM part) t""")
def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = X.oriented_point(F.lit(600), F.lit(400), F.col("p_size") * 5, F.col("p_size") * 3, (F.col("p_partkey") % 10).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", point.alias("p")).select("p_partkey", "p.width", "p.height", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@register("""SELECT p_partkey, round((CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END) * (p_size + (p_partkey % 60) / 60.0 + (p_partkey % 7) / 3600.0), 6) AS degrees,
  CASE WHEN p_size % 3 = 0 AND p_size > 0 THEN CASE WHEN p_partkey % p_size = 0 THEN CAST(p_partkey // p_size AS VARCHAR) ELSE p_partkey || '/' || p_size END WHEN p_partkey = 0 THEN 'undef' ELSE p_partkey || '/0' END AS ratio,
  CASE WHEN p_partkey >= 3600 THEN printf('%d:%02d:%02d', p_partkey // 3600, p_partkey % 3600 // 60, p_partkey % 60) ELSE printf('%d:%02d', p_partkey // 60, p_partkey % 60) END AS duration FROM part""")
def metadata_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(",", F.col("p_size").cast("string"), (F.col("p_partkey") % 60).cast("string"), F.concat((F.col("p_partkey") % 7).cast("string"), F.when(F.col("p_size") % 2 == 0, "S").otherwise("N")))
    ratio = X.rational_text(F.col("p_partkey"), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("long")).otherwise(F.lit(0).cast("long")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.xmp_gps_degrees(text), 6).alias("degrees"), ratio.alias("ratio"), X.duration_text(F.col("p_partkey").cast("double")).alias("duration"))


@register("""SELECT s_suppkey, CAST(s_suppkey % 6 AS INTEGER) AS rating, CASE WHEN s_suppkey % 2 = 0 THEN 'Red' END AS color_label, CASE WHEN s_suppkey % 3 = 0 THEN [] ELSE [s_name, '<' || s_nationkey || ' & co>'] END AS keywords,
  ['n|' || s_nationkey] AS hierarchical_keywords FROM supplier""")
def sidecar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other supplier has a sidecar; all get new ratings and keywords, and the files are read back."""
    root = new_path(spark, "sidecars")
    path = F.concat(F.lit(f"{root}/"), F.col("s_suppkey").cast("string"), F.lit(".xmp"))
    s = table(spark, sf_dir, "supplier").withColumn("path", path)
    first = '<rdf:RDF xmlns:rdf="r"><rdf:Description xmlns:xmp="x" xmp:Rating="1" xmp:Label="red"><dc:subject xmlns:dc="d"><rdf:Bag><rdf:li>old</rdf:li></rdf:Bag></dc:subject></rdf:Description></rdf:RDF>'
    before = s.where("s_suppkey % 2 = 0").select("path", F.lit(first).alias("xml"))
    C.write_sidecars(before, root)
    change = lambda name, bag, *values: F.struct(F.lit(name).alias("name"), F.lit(bag).alias("bag"), F.array(*values).cast("array<string>").alias("values"))
    words = change("dc:subject", True, F.col("s_name"), F.concat(F.lit("<"), F.col("s_nationkey").cast("string"), F.lit(" & co>")))
    listed = F.array(change("xmp:Rating", False, F.col("s_suppkey") % 6), F.when(F.col("s_suppkey") % 3 != 0, words).otherwise(change("dc:subject", True)), change("lr:hierarchicalSubject", True, F.concat(F.lit("n|"), F.col("s_nationkey").cast("string"))))
    changes = s.select("path", F.explode(listed).alias("c")).select("path", "c.*")
    C.write_sidecars(C.merged(before, changes), root)
    read = M.xmp_fields(C.read_sidecars(spark, root)).withColumn("s_suppkey", F.regexp_extract("path", r"([0-9]+)\.xmp$", 1).cast("long"))
    return read.select("s_suppkey", "rating", "color_label", "keywords", "hierarchical_keywords")


@register("""SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_custkey % 7 <= 5 THEN CAST(c_custkey % 7 AS INTEGER) END AS rating, CASE c_custkey % 4 WHEN 0 THEN 'Red' WHEN 1 THEN c_mktsegment || ' & co' END AS color_label,
  list_filter([c_name, '<' || c_mktsegment || '>', ''], lambda x: x <> '') AS keywords FROM customer""")
def xmp_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    label = F.when(F.col("c_custkey") % 4 == 0, "red").when(F.col("c_custkey") % 4 == 1, X.escape_xml(F.concat("c_mktsegment", F.lit(" & co")))).otherwise("None")
    head = F.concat(F.lit('<rdf:Description xmp:Rating="'), (F.col("c_custkey") % 7).cast("string"), F.lit('"><xmp:Label>'), label, F.lit("</xmp:Label>"))
    bag = F.concat(F.lit("<dc:subject><rdf:Bag><rdf:li> "), "c_name", F.lit(" </rdf:li>\n<rdf:li>"), X.escape_xml(F.concat(F.lit("<"), "c_mktsegment", F.lit(">"))), F.lit("</rdf:li><rdf:li> </rdf:li></rdf:Bag></dc:subject></rdf:Description>"))
    return M.xmp_fields(c.select(F.col("c_custkey").cast("string").alias("path"), F.concat(head, bag).alias("xml"))).select("path", "rating", "color_label", "keywords")
