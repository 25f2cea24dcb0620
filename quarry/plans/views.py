"""The test tables seen as catalog relations. Each view has a twin in SQL, so that both sides of a comparison start alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as assets."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").cast("long").alias("size_bytes"),
        (F.col("p_partkey") % 97).cast("long").alias("modified_at_ms"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 6).alias("rating"), F.col("p_brand").alias("color_label"),
        F.when(F.col("p_size") % 4 == 0, "rejected").when(F.col("p_size") % 4 == 1, "Accepted").alias("pick_label"))


ASSETS = """assets AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS kind, CAST(p_size AS BIGINT) AS size_bytes, CAST(p_partkey % 97 AS BIGINT) AS modified_at_ms,
         CASE WHEN p_size % 7 <> 0 THEN p_size % 6 END AS rating, p_brand AS color_label,
         CASE WHEN p_size % 4 = 0 THEN 'rejected' WHEN p_size % 4 = 1 THEN 'Accepted' END AS pick_label
  FROM part)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their nations, and market segments, as a tag tree of up to three levels."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    root = spark.range(1).select(F.lit(1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("World").alias("name"), F.lit(0).cast("long").alias("sort_order"))
    regions = region.select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.lit(1).cast("long").alias("parent_id"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("sort_order"))
    nations = nation.select((F.col("n_nationkey") + 1000).cast("long").alias("id"), (F.col("n_regionkey") + 100).cast("long").alias("parent_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("sort_order"))
    segments = customer.select("c_mktsegment").distinct().select((F.length("c_mktsegment") + 5000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("c_mktsegment").alias("name")).groupBy("id", "parent_id").agg(F.min("name").alias("name")).withColumn("sort_order", F.lit(9).cast("long"))
    return root.unionByName(regions).unionByName(nations).unionByName(segments)


TAGS = """tags AS (
  SELECT CAST(1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'World' AS name, CAST(0 AS BIGINT) AS sort_order
  UNION ALL SELECT CAST(r_regionkey + 100 AS BIGINT), 1, r_name, r_regionkey FROM region
  UNION ALL SELECT CAST(n_nationkey + 1000 AS BIGINT), n_regionkey + 100, n_name, n_nationkey FROM nation
  UNION ALL SELECT CAST(length(c_mktsegment) + 5000 AS BIGINT), NULL, min(c_mktsegment), 9 FROM customer GROUP BY length(c_mktsegment)
), closed(ancestor, tag, depth) AS (
  SELECT id, id, 0 FROM tags
  UNION ALL SELECT t.parent_id, c.tag, c.depth + 1 FROM closed c JOIN tags t ON t.id = c.ancestor WHERE t.parent_id IS NOT NULL)"""


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer carries its nation; two in three its segment too."""
    customer = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("asset_path")
    by_nation = customer.select(path, (F.col("c_nationkey") + 1000).cast("long").alias("tag_id"))
    return by_nation.unionByName(customer.where("c_custkey % 3 != 0").select(path, (F.length("c_mktsegment") + 5000).cast("long").alias("tag_id")))


ASSIGNED = """assigned AS (
  SELECT '/c/' || c_custkey AS asset_path, CAST(c_nationkey + 1000 AS BIGINT) AS tag_id FROM customer
  UNION ALL SELECT '/c/' || c_custkey, CAST(length(c_mktsegment) + 5000 AS BIGINT) FROM customer WHERE c_custkey % 3 <> 0)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of half the assignments: manual, sidecar, both or person."""
    rows = assigned(spark, sf_dir)
    n = F.length("asset_path") + F.col("tag_id")
    kinds = F.when(n % 4 == 0, F.array(F.lit("manual"), F.lit("sidecar"))).when(n % 4 == 1, F.array(F.lit("sidecar"))).when(n % 4 == 2, F.array(F.lit("person"))).otherwise(F.array().cast("array<string>"))
    return rows.select("asset_path", "tag_id", F.explode(kinds).alias("source_kind")).withColumn("source_id", F.when(F.col("source_kind") == "person", "p1").otherwise(""))


SOURCES = """sources AS (
  SELECT asset_path, tag_id, source_kind, CASE WHEN source_kind = 'person' THEN 'p1' ELSE '' END AS source_id FROM (
    SELECT asset_path, tag_id, unnest(CASE (length(asset_path) + tag_id) % 4 WHEN 0 THEN ['manual', 'sidecar'] WHEN 1 THEN ['sidecar'] WHEN 2 THEN ['person'] ELSE [] END) AS source_kind FROM assigned))"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as tasks: the order is the asset, the line its stage, one of each."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("status"), F.min("l_returnflag").alias("flag"))
    state = F.when(F.col("flag") == "A", "completed").when(F.col("flag") == "R", F.when(F.col("status") == "F", "failed").otherwise("completed")).otherwise("queued")
    return rows.select(
        F.concat(F.lit("run:"), (F.col("l_orderkey") % 50).cast("string")).alias("run_id"), F.col("l_orderkey").alias("asset_path"), F.lit("r").alias("source_revision"), F.col("l_linenumber").cast("string").alias("stage_id"),
        F.lit("f").alias("stage_fingerprint"), F.col("l_linenumber").alias("stage_order"), state.alias("state"), F.lit(None).cast("string").alias("claim_token"), F.lit(None).cast("string").alias("error"))


TASKS = """tasks AS (
  SELECT 'run:' || (l_orderkey % 50) AS run_id, l_orderkey AS asset_path, CAST(l_linenumber AS VARCHAR) AS stage_id, l_linenumber AS stage_order,
         CASE WHEN flag = 'A' THEN 'completed' WHEN flag = 'R' THEN CASE WHEN status = 'F' THEN 'failed' ELSE 'completed' END ELSE 'queued' END AS state
  FROM (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS status, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber) x)"""
