"""Queries of sources, snapshots, streams, and single functions of metadata."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import metadata as M
from quarry.operators import projection as P
from quarry.operators import query as Q
from quarry.operators import search as S
from quarry.operators import sequence as B
from quarry.operators import storage as G
from quarry.operators import tags as T
from quarry.plans.registry import Register
from quarry.plans.state import OBSERVATIONS, _observations
from quarry.plans.views import TAGS, table, tags
from quarry.sources import catalog, containers
from quarry.sources.ranged import located
from quarry.streaming import intents as I
from quarry.streaming import projections as R
from quarry.streaming.sink import MergedTable, drain
from quarry.tables import kept, new_path, partitions

register = Register()
QUERIES, ORACLE = register.queries, register.oracle


@register("""SELECT 'n_regionkey=' || n_regionkey AS name, true AS has_children, 1 AS depth, 'tree' AS parent FROM nation
UNION SELECT 'n_name=' || replace(n_name, ' ', '%20'), false, 2, 'n_regionkey=' || n_regionkey FROM nation""".replace("%20", " "))
def directory_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of partition folders is written, then walked."""
    root = new_path(spark, "walk") + "/tree"
    table(spark, sf_dir, "nation").write.partitionBy("n_regionkey", "n_name").csv(root)
    found = catalog.listed_directories(catalog.walk(spark, root))
    return found.select("name", "has_children", "depth", F.element_at(F.split("parent_path", "/"), -1).alias("parent"))


@register("""SELECT 'r' || n_regionkey AS root_path, c_custkey, c_name, CAST(1 AS BIGINT) AS scan_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1
UNION ALL SELECT 'r1', c_custkey, upper(c_name), 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 AND c_custkey % 3 <> 0""")
def next_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    old = known.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("root_path"), "c_custkey", "c_name", F.lit(1).cast("long").alias("scan_id"))
    scanned = known.where("n_regionkey = 1 AND c_custkey % 3 != 0").select("c_custkey", F.upper("c_name").alias("c_name"))
    return G.next_generation(old, scanned, ["c_custkey", "c_name"], "r1", 2)


@register("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'deleted' WHEN c_custkey % 5 = 1 THEN 'changed' ELSE 'unchanged' END AS change FROM customer""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions are published; the newest is compared with the one before."""
    versions = catalog.Snapshots(spark, new_path(spark, "snapshots"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    versions.publish(rows.limit(0), expected=0)
    versions.publish(rows, expected=1)
    versions.publish(rows.where("c_custkey % 5 != 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))), expected=2)
    return G.index_diff(versions.read(2), versions.read(3), ["c_custkey"], ["c_acctbal"])


@register("""SELECT 'o' || o_orderkey AS path, 'EXIF' AS "group", 'Make' AS name, o_orderpriority AS value FROM orders
UNION ALL SELECT 'o' || o_orderkey, 'XMP', 'Rating', CAST(o_orderkey % 6 AS VARCHAR) FROM orders UNION ALL SELECT 'o' || o_orderkey, 'Plain', 'Plain', o_orderstatus FROM orders""")
def exiftool_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("SourceFile", F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))), ("EXIF:Make", F.col("o_orderpriority")), ("XMP:Rating", F.col("o_orderkey") % 6), ("Plain", F.col("o_orderstatus")))
    lines = table(spark, sf_dir, "orders").select(F.to_json(F.struct(*(v.alias(k) for k, v in fields))).alias("value"))
    return containers.exiftool_tags(lines).select("path", "group", "name", "value")


def _picture(make: str, iso: int, rating: int) -> bytes:
    """A JPEG of an EXIF block (maker and ISO), an XMP packet (rating) and no picture."""
    maker = make.encode() + b"\0"
    exif = b"Exif\0\0II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 0x010F, 2, len(maker), 38) + struct.pack("<HHIHH", 0x8827, 3, 1, iso, 0) + b"\0" * 4 + maker
    xmp = b"http://ns.adobe.com/xap/1.0/\0" + f'<x:xmpmeta><rdf:RDF><rdf:Description xmp:Rating="{rating}"/></rdf:RDF></x:xmpmeta>'.encode()
    return b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", len(x) + 2) + x for x in (exif, xmp)) + b"\xff\xda\0\2"


@register("""SELECT s_suppkey, 'EXIF' AS "group", 'Make' AS name, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'EXIF', 'ISO', CAST(s_suppkey % 60000 AS VARCHAR) FROM supplier
UNION ALL SELECT s_suppkey, 'XMP', 'Rating', CAST(s_suppkey % 6 AS VARCHAR) FROM supplier""")
def picture_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks write a picture a supplier; tasks read the pictures' tags in ranges."""
    root = new_path(spark, "pictures")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = located(root)
        system.create_dir(inside)
        for batch in batches:
            keys, makers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, make in zip(keys, makers, strict=True):
                with system.open_output_stream(f"{inside}/{key}.jpg") as out:
                    out.write(_picture(make, key % 60000, key % 6))
            yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{key}.jpg" for key in keys], pa.string())], names=["path"])

    written = kept(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long"), "s_name").mapInArrow(write, "path string"), "picture-paths")
    tags = containers.tags_of_files(written.repartition(partitions(spark)))
    return tags.select(F.regexp_extract("path", r"([0-9]+)\.jpg$", 1).cast("long").alias("s_suppkey"), "group", "name", "value")


@register("""SELECT p_partkey, '<rdf:Description' || CASE p_partkey % 3 WHEN 0 THEN ' xmp:Label="old"' WHEN 1 THEN ' xmp:Label="$&lt;' || p_size || '\\"' ELSE '' END || ' a="b"/>' AS xml FROM part""".replace("\\\\", "\\"))
def xmp_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("p_partkey") % 3
    value = F.when(turn == 1, F.concat(F.lit("$<"), F.col("p_size").cast("string"), F.lit("\\")))
    return table(spark, sf_dir, "part").select("p_partkey", M.patched(F.lit('<rdf:Description xmp:Label="old" a="b"/>'), "xmp:Label", turn != 0, value).alias("xml"))


@register("SELECT p_partkey FROM part")
def search_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.match_or_list(table(spark, sf_dir, "part"), " \t ", "p_partkey", "p_name")


@register("""SELECT p_partkey, CAST(row_number() OVER (ORDER BY CASE p_partkey % 3 WHEN 2 THEN 0 ELSE 1 END, p_size, p_partkey % 2, p_partkey) - 1 AS BIGINT) AS place FROM part""")
def folder_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names such as 'Été 7-0012', 'ETE 31-9...98' and 'ätna 5-03': the first two begin alike, and numbers go by their value, those of forty digits too."""
    turn = F.col("p_partkey") % 3
    word = F.when(turn == 0, "Été").when(turn == 1, "ETE").otherwise("ätna")
    name = F.concat(word, F.lit(" "), F.col("p_size").cast("string"), F.lit("-"), F.repeat(F.lit("0"), (F.col("p_partkey") % 4).cast("int")), F.when(F.col("p_partkey") % 2 == 1, "9" * 30).otherwise(""), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    return Q.dense_order(table(spark, sf_dir, "part").select("p_partkey", Q.folder_order_key(name).alias("key")), F.col("key")).select("p_partkey", F.col("place").cast("long").alias("place"))


@register(f"WITH RECURSIVE {TAGS} SELECT a.id AS root, b.id AS tag, EXISTS (SELECT 1 FROM closed c WHERE c.ancestor = a.id AND c.tag = b.id) AS contained FROM tags a, tags b WHERE a.id < 1000")
def tag_subtree_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tags(spark, sf_dir)
    asked = own.where("id < 1000").select(F.col("id").alias("root")).join(own.select(F.col("id").alias("tag")))  # a handful of regions with the vocabulary
    return T.subtree_tests(T.closure(own), asked)


@register("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0 OR o_orderstatus = 'P'")
def burst_unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), "o_orderkey", F.col("o_orderstatus").alias("source_revision"))
    parsed = listing.where("path % 4 != 0").withColumn("source_revision", F.when(F.col("source_revision") == "P", "old").otherwise(F.col("source_revision")))
    return B.unparsed(listing, parsed).select("o_orderkey")


@register("""WITH g AS (SELECT o_custkey, min(o_orderkey) AS representative FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
SELECT o_orderkey FROM orders LEFT JOIN g ON g.o_custkey = orders.o_custkey WHERE o_orderstatus = 'P' OR o_orderkey = representative OR representative % 3 = 0""")
def burst_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    members = rows.where("o_orderstatus != 'P'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("representative"), F.collect_list("o_orderkey").alias("members"))
    expanded = members.where("representative % 3 = 0").select("representative")
    return B.collapsed(rows.select(F.col("o_orderkey").alias("path")), members.select("representative", "members"), expanded).select(F.col("path").alias("o_orderkey"))


@register("""SELECT p_partkey, CASE WHEN p_size % 9 BETWEEN 5 AND 8 THEN 400 ELSE 600 END AS width, CASE WHEN p_size % 9 BETWEEN 5 AND 8 THEN 600 ELSE 400 END AS height,
  round((CASE WHEN p_partkey % 4 IN (1, 3) THEN -1 ELSE 1 END) * (p_size + (p_partkey % 60) / 60.0 + (p_partkey % 50) / 3600.0), 8) AS degrees,
  CASE WHEN p_partkey % 5 = 0 THEN '0000:00:00 00:00:00' WHEN p_partkey % 5 = 1 THEN CAST(p_partkey AS VARCHAR) ELSE strftime(TIMESTAMP '1970-01-01' + to_seconds(p_partkey * 86461), '%Y:%m:%d %H:%M:%S') END AS taken FROM part""")
def display_and_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = X.swapped_for_display(F.lit(600), F.lit(400), F.col("p_size") % 9)
    side = F.element_at(F.array(F.lit("N"), F.lit(" s"), F.lit("E"), F.lit("W")), (F.col("p_partkey") % 4 + 1).cast("int"))
    degrees = X.gps_degrees(F.col("p_size"), F.col("p_partkey") % 60, F.col("p_partkey") % 50, side)
    turn = F.col("p_partkey") % 5
    seconds = F.when(turn == 0, 0).when(turn == 1, F.col("p_partkey")).otherwise(F.col("p_partkey") * 86461 + X.QUICKTIME_EPOCH)
    return table(spark, sf_dir, "part").select("p_partkey", width.alias("width"), height.alias("height"), F.round(degrees, 8).alias("degrees"), X.quicktime_date(seconds).alias("taken"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, for a plain name must be a folder here


def _drained(stream: DataFrame, mode: str, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """What a stream gives for the files there are, merged by key."""
    spark = stream.sparkSession
    return drain(stream, MergedTable(spark, new_path(spark, "stream"), stream.schema, key, order), mode, new_path(spark, "stream-state"))


@register(f"WITH {OBSERVATIONS} SELECT path, projection_kind, valid_at, arrival FROM (SELECT *, row_number() OVER (PARTITION BY path, projection_kind ORDER BY valid_at DESC, arrival DESC) AS k FROM obs) x WHERE k = 1")
def stream_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = _observations(spark, sf_dir, _events(spark, sf_dir)).withColumns({"source_revision": F.lit("r"), "at": F.timestamp_millis(F.col("arrival"))})
    accepted = R.accepted_observations(observations, keep_ms=86_400_000)
    return _drained(accepted, "update", P.KEY, ("valid_at", "arrival")).select("path", "projection_kind", "valid_at", "arrival")


@register("SELECT DISTINCT event_type || ':' || (user_id % 7) AS request_id FROM events")
def stream_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeat that comes after the delay, when the request is forgotten, is merged in the table."""
    request = F.concat_ws(":", "event_type", (F.col("user_id") % 7).cast("string"))
    events = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("at"), request.alias("request_id"))
    return _drained(R.audit_log(events, "1 hour"), "append", ("request_id",), ("at",)).select("request_id")


@register("""
WITH i AS (SELECT 's' || (event_id % 7) AS scope, event_id // 500 AS epoch, user_id AS key, CAST(floor(value) AS BIGINT) % 3 AS tier, event_id % 11 AS rank FROM events),
n AS (SELECT scope, max(epoch) AS epoch FROM i GROUP BY scope), c AS (SELECT i.* FROM i JOIN n ON n.scope = i.scope AND n.epoch = i.epoch)
SELECT CAST(key AS VARCHAR) AS key, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, rank) AS k FROM c) x WHERE k = 1""")
def stream_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    scope, epoch = F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string")), F.floor(F.col("event_id") / 500)
    intents = e.select(scope.alias("scope"), epoch.alias("epoch"), F.col("user_id").cast("string").alias("key"), (F.floor("value").cast("long") % 3).alias("tier"), (F.col("event_id") % 11).alias("rank"), F.col("ts").cast("timestamp").alias("at"))
    return I.effective(_drained(I.intent_changes(intents), "update", ("scope", "key"), ("version",)))


@register("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(R.activity(events), "complete", ("start", "event_type"), ("n",)).select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))
