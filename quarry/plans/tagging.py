"""Queries of the tag side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import intervals as N
from quarry.operators import tags as T
from quarry.plans.registry import Register
from quarry.plans.views import ASSIGNED, SOURCES, TAGS, assigned, sources, table, tags
from quarry.tables import kept

register = Register()
QUERIES, ORACLE = register.queries, register.oracle
WITH = f"WITH RECURSIVE {TAGS}, {ASSIGNED}"
WITH_SOURCES = f"WITH {ASSIGNED}, {SOURCES}"
SELECTED = [100, 102, 5008, 5009, 5010, 102]


@register(f"WITH RECURSIVE {TAGS} SELECT ancestor, tag, CAST(depth AS INTEGER) AS depth FROM closed")
def tag_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.closure(tags(spark, sf_dir))


ROOTS = f"roots AS (SELECT DISTINCT unnest({SELECTED}) AS root), hit AS (SELECT a.asset_path, r.root FROM assigned a JOIN closed c ON c.tag = a.tag_id JOIN roots r ON r.root = c.ancestor)"


@register(f"{WITH}, {ROOTS} SELECT DISTINCT asset_path FROM hit")
def tag_match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.match_assets(T.closure(tags(spark, sf_dir)), assigned(spark, sf_dir), SELECTED, match_all=False)


@register(f"{WITH}, hit AS (SELECT a.asset_path, c.ancestor AS root FROM assigned a JOIN closed c ON c.tag = a.tag_id WHERE c.ancestor IN (1, 101, 5009)) SELECT asset_path FROM hit GROUP BY asset_path HAVING count(DISTINCT root) = 3")
def tag_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.match_assets(T.closure(tags(spark, sf_dir)), assigned(spark, sf_dir), [1, 101, 5009, 101], match_all=True)


@register(f"{WITH} SELECT DISTINCT asset_path FROM assigned WHERE 1 = 0")
def tag_match_all_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.match_assets(T.closure(tags(spark, sf_dir)), assigned(spark, sf_dir), [1, 424242], match_all=True)


@register(f"{WITH} SELECT DISTINCT asset_path FROM assigned WHERE tag_id IN (SELECT tag FROM closed WHERE ancestor = 103)")
def tag_subtree_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.subtree_assets(T.closure(tags(spark, sf_dir)), assigned(spark, sf_dir), 103)


@register(f"{WITH} SELECT c.ancestor AS id, count(DISTINCT c.tag) AS tags, count(DISTINCT a.asset_path) AS assets FROM closed c LEFT JOIN assigned a ON a.tag_id = c.tag GROUP BY c.ancestor")
def tag_delete_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.delete_impact(T.closure(tags(spark, sf_dir)), assigned(spark, sf_dir))


@register(f"WITH RECURSIVE {TAGS} SELECT c.tag AS id, string_agg(t.name, '|' ORDER BY c.depth DESC) AS path FROM closed c JOIN tags t ON t.id = c.ancestor GROUP BY c.tag")
def tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tags(spark, sf_dir)
    return T.paths(own, T.closure(own))


@register(f"""WITH RECURSIVE {TAGS}, keyed AS (SELECT c.tag AS id, string_agg(printf('%012d.%012d', t.sort_order, t.id), '/' ORDER BY c.depth DESC) AS sort_path, CAST(max(c.depth) AS INTEGER) AS depth FROM closed c JOIN tags t ON t.id = c.ancestor GROUP BY c.tag)
SELECT id, depth, CAST(row_number() OVER (ORDER BY sort_path) AS INTEGER) AS place FROM keyed""")
def tag_tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = tags(spark, sf_dir)
    return T.tree_order(own, T.closure(own)).select("id", "depth", F.row_number().over(Window.orderBy("sort_path")).alias("place"))


@register(f"""WITH RECURSIVE {TAGS}, keyed AS (SELECT c.tag AS id, string_agg(printf('%012d.%012d', t.sort_order, t.id), '/' ORDER BY c.depth DESC) AS sort_path, CAST(max(c.depth) AS INTEGER) AS depth FROM closed c JOIN tags t ON t.id = c.ancestor GROUP BY c.tag),
sizes AS (SELECT ancestor AS id, count(*) AS tags FROM closed GROUP BY ancestor)
SELECT keyed.id, depth, CAST(tags AS BIGINT) AS tags, CAST(row_number() OVER (ORDER BY sort_path) - 1 AS BIGINT) AS place FROM keyed JOIN sizes ON sizes.id = keyed.id""")
def tag_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the tree and the subtrees' sizes from the intervals alone: what is entered before a tag stands before it."""
    numbered = kept(N.intervals(tags(spark, sf_dir)), "intervals")
    place = (F.col("low") + F.col("depth")) / 2  # of the numbers below low, those left are low - depth over two, those open depth
    return numbered.join(N.subtree_sizes(numbered), "id").select("id", "depth", "tags", place.cast("long").alias("place"))


@register(f"WITH RECURSIVE {TAGS} SELECT a.id AS root, b.id AS tag, EXISTS (SELECT 1 FROM closed c WHERE c.ancestor = a.id AND c.tag = b.id) AS contained FROM tags a, tags b WHERE a.id < 1000")
def tag_interval_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tags(spark, sf_dir)
    asked = own.where("id < 1000").select(F.col("id").alias("root")).join(own.select(F.col("id").alias("tag")))  # a handful of regions with the vocabulary
    return N.subtree_tests(N.intervals(own), asked)


@register(f"""WITH RECURSIVE {TAGS}, {ASSIGNED} SELECT asset_path FROM assigned JOIN closed ON closed.tag = tag_id WHERE ancestor IN (1, 101, 5009) GROUP BY asset_path HAVING count(DISTINCT ancestor) = 3""")
def tag_interval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.match_assets(kept(N.intervals(tags(spark, sf_dir)), "intervals"), assigned(spark, sf_dir), [1, 101, 5009, 101], match_all=True)


@register(f"WITH RECURSIVE {TAGS} SELECT DISTINCT c.ancestor AS id FROM closed c JOIN tags t ON t.id = c.tag WHERE contains(lower(t.name), 'ion_1')")
def tag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tags(spark, sf_dir)
    return T.visible_in_search(own, T.closure(own), "ION_1")


@register(f"{WITH} SELECT t.id, count(DISTINCT a.asset_path) AS n FROM tags t LEFT JOIN (SELECT * FROM assigned WHERE asset_path IN (SELECT '/c/' || c_custkey FROM customer WHERE c_custkey % 9 = 1)) a ON a.tag_id = t.id GROUP BY t.id")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "customer").where("c_custkey % 9 = 1").select(F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("asset_path"))
    return T.counts(tags(spark, sf_dir), assigned(spark, sf_dir), chosen)


@register(f"WITH {ASSIGNED} SELECT p.asset_path, coalesce(list(DISTINCT a.tag_id ORDER BY a.tag_id) FILTER (WHERE a.tag_id IS NOT NULL), []) AS tag_ids FROM (SELECT '/c/' || (c_custkey + 5) AS asset_path FROM customer) p LEFT JOIN assigned a ON a.asset_path = p.asset_path GROUP BY p.asset_path")
def tag_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "customer").select(F.concat(F.lit("/c/"), (F.col("c_custkey") + 5).cast("string")).alias("asset_path"))
    return T.by_asset(chosen, assigned(spark, sf_dir))


@register(f"{WITH_SOURCES} SELECT DISTINCT asset_path, tag_id FROM sources")
def tag_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.effective(sources(spark, sf_dir))


@register(f"""{WITH_SOURCES} SELECT asset_path, tag_id, source_kind, source_id FROM sources
UNION ALL SELECT asset_path, tag_id, 'legacy', '' FROM assigned a WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.asset_path = a.asset_path AND s.tag_id = a.tag_id)""")
def tag_legacy_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.backfill_legacy(assigned(spark, sf_dir), sources(spark, sf_dir))


CHANGES = "changes AS (SELECT '/c/' || c_custkey AS asset_path, CAST(c_nationkey + 1000 AS BIGINT) AS tag_id, c_custkey % 2 = 0 AS assign FROM customer WHERE c_custkey % 5 < 2)"


@register(f"""{WITH_SOURCES}, {CHANGES} SELECT asset_path, tag_id, source_kind, source_id FROM sources s
WHERE source_kind NOT IN ('legacy', 'manual') OR NOT EXISTS (SELECT 1 FROM changes c WHERE c.asset_path = s.asset_path AND c.tag_id = s.tag_id)
UNION SELECT asset_path, tag_id, 'manual', '' FROM changes WHERE assign""")
def tag_manual_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "customer").where("c_custkey % 5 < 2").select(F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("asset_path"), (F.col("c_nationkey") + 1000).cast("long").alias("tag_id"), (F.col("c_custkey") % 2 == 0).alias("assign"))
    return T.override(sources(spark, sf_dir), changes)


@register(f"""{WITH_SOURCES}, imported AS (SELECT '/c/' || c_custkey AS asset_path FROM customer WHERE c_custkey % 4 < 2 AND c_custkey % 6 <> 0),
desired AS (SELECT '/c/' || c_custkey AS asset_path, CAST(c_nationkey + 1000 AS BIGINT) AS tag_id FROM customer WHERE c_custkey % 8 = 0)
SELECT * FROM sources WHERE source_kind <> 'sidecar' OR asset_path NOT IN (SELECT asset_path FROM imported)
UNION ALL SELECT asset_path, tag_id, 'sidecar', '' FROM desired WHERE asset_path IN (SELECT asset_path FROM imported)""")
def tag_sidecar_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumn("asset_path", F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")))
    desired = customer.where("c_custkey % 8 = 0").select("asset_path", (F.col("c_nationkey") + 1000).cast("long").alias("tag_id"))
    return T.import_sidecars(sources(spark, sf_dir), desired, customer.where("c_custkey % 4 < 2"), customer.where("c_custkey % 6 = 0"))


@register(r"""
WITH s AS (SELECT c_custkey, ['Place|' || n_name, 'Segment'] AS hierarchical, [upper(n_name), 'segment', ' ' || c_mktsegment || ' ', CASE WHEN c_custkey % 10 = 0 THEN 'bad' || chr(10) END] AS subjects FROM customer JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT c_custkey, unnest(list_concat(hierarchical, list_filter(subjects, lambda x: x IS NOT NULL AND NOT list_contains([lower(string_split(hierarchical[1], '|')[-1]), lower(hierarchical[2])], lower(x))))) AS raw FROM s)
SELECT DISTINCT c_custkey, CASE WHEN raw LIKE 'bad%' THEN 'bad' ELSE trim(raw) END AS path FROM w""")
def tag_sidecar_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    bad = F.when(F.col("c_custkey") % 10 == 0, F.array(F.lit("bad "))).otherwise(F.array().cast("array<string>"))
    sidecars = joined.select(
        F.col("c_custkey").alias("asset_path"), F.array(F.concat(F.lit("Place|"), "n_name"), F.lit("Segment")).alias("hierarchical"),
        F.concat(F.array(F.upper("n_name"), F.lit("segment"), F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))), bad).alias("subjects"))
    return T.sidecar_paths(sidecars).select(F.col("asset_path").alias("c_custkey"), "path")


@register(f"""WITH RECURSIVE {TAGS}, paths AS (SELECT c.tag, string_agg(t.name, '|' ORDER BY c.depth DESC) AS path FROM closed c JOIN tags t ON t.id = c.ancestor GROUP BY c.tag),
wanted AS (SELECT DISTINCT 'WORLD|' || r_name || '|New ' || r_regionkey AS path, 'World|' || r_name AS p1 FROM region UNION ALL SELECT 'Fresh|' || r_name, 'Fresh' FROM region),
every AS (SELECT path FROM wanted UNION SELECT p1 FROM wanted UNION SELECT 'WORLD')
SELECT min(path) AS path, lower(coalesce(nullif(regexp_replace(min(path), '\\|?[^|]*$', ''), ''), '')) AS parent FROM every WHERE lower(path) NOT IN (SELECT lower(path) FROM paths) GROUP BY lower(path)""".replace("\\\\", "\\"))
def tag_create_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, region = tags(spark, sf_dir), table(spark, sf_dir, "region")
    wanted = region.select(F.concat(F.lit("WORLD|"), "r_name", F.lit("|New "), F.col("r_regionkey").cast("string")).alias("path")).union(region.select(F.concat(F.lit("Fresh|"), "r_name")))
    return T.missing_tags(T.paths(own, T.closure(own)), wanted).select("path", F.lower(F.coalesce("parent", F.lit(""))).alias("parent"))


@register(f"""WITH RECURSIVE {TAGS}, {ASSIGNED}, paths AS (SELECT c.tag, string_agg(t.name, '|' ORDER BY c.depth DESC) AS path FROM closed c JOIN tags t ON t.id = c.ancestor GROUP BY c.tag)
SELECT asset_path, list(DISTINCT string_split(path, '|')[-1] ORDER BY string_split(path, '|')[-1]) AS subjects, list(DISTINCT path ORDER BY path) AS hierarchical FROM assigned JOIN paths ON tag = tag_id GROUP BY asset_path""")
def tag_xmp_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tags(spark, sf_dir)
    return T.xmp_payload(T.paths(own, T.closure(own)), assigned(spark, sf_dir))


QUEUE = """queue AS (SELECT '/o/' || o_orderkey AS asset_path, o_custkey AS requested_at, CAST(o_orderkey % 3 AS INTEGER) AS attempt_count, CASE WHEN o_orderkey % 3 > 0 THEN 'e' || o_orderpriority END AS last_error FROM orders WHERE o_orderkey % 10 < 6)"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 < 6")
    return o.select(F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("asset_path"), F.col("o_custkey").alias("requested_at"), (F.col("o_orderkey") % 3).cast("int").alias("attempt_count"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("e"), "o_orderpriority")).alias("last_error"))


@register(f"""WITH {QUEUE}, new AS (SELECT '/o/' || o_orderkey AS asset_path, o_custkey + 7 AS requested_at FROM orders WHERE o_orderkey % 10 IN (5, 7))
SELECT * FROM queue WHERE asset_path NOT IN (SELECT asset_path FROM new) UNION ALL SELECT asset_path, requested_at, 0, NULL FROM new""")
def sync_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 IN (5, 7)")
    return T.enqueue(_queue(spark, sf_dir), o.select(F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("asset_path"), (F.col("o_custkey") + 7).alias("requested_at")))


@register(f"""WITH {QUEUE} SELECT asset_path, requested_at, CAST(attempt_count + CASE WHEN requested_at % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS attempt_count, CASE WHEN requested_at % 2 = 0 THEN 'again' ELSE last_error END AS last_error FROM queue""")
def sync_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir)
    return T.record_failures(queue, queue.where("requested_at % 2 = 0").select("asset_path", F.lit("again").alias("error")))


@register(f"WITH {QUEUE} SELECT count(*) AS pending, count(last_error) AS failed, (SELECT last_error FROM queue WHERE last_error IS NOT NULL ORDER BY requested_at DESC, asset_path DESC LIMIT 1) AS newest_error FROM queue")
def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sync_status(_queue(spark, sf_dir))


@register(f"""{WITH_SOURCES} SELECT * FROM sources UNION SELECT '/copy' || asset_path, tag_id, source_kind, source_id FROM sources WHERE source_kind <> 'person' AND asset_path LIKE '%1'""")
def asset_copy_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sources(spark, sf_dir)
    copies = own.where("asset_path LIKE '%1'").select(F.col("asset_path").alias("source_path"), F.concat(F.lit("/copy"), "asset_path").alias("target_path")).distinct()
    return T.copy_state(own, copies)


@register(f"""{WITH_SOURCES} SELECT CASE WHEN asset_path LIKE '%1' THEN '/moved' || asset_path WHEN asset_path LIKE '%2' THEN asset_path || 'b' ELSE asset_path END AS asset_path, tag_id, source_kind, source_id, asset_path LIKE '%1' AS moved_folder FROM sources""")
def asset_move_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sources(spark, sf_dir)
    moves = own.where("asset_path LIKE '%1' OR asset_path LIKE '%2'").select(F.col("asset_path").alias("source_path"), F.when(F.col("asset_path").endswith("1"), F.concat(F.lit("/moved"), "asset_path")).otherwise(F.concat("asset_path", F.lit("b"))).alias("target_path")).distinct()
    return T.move_state(own, moves, X.parent_path(F.col("asset_path")))


@register(f"{WITH_SOURCES} SELECT * FROM sources WHERE asset_path NOT IN (SELECT '/c/' || c_custkey FROM customer WHERE c_acctbal < 0)")
def asset_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("asset_path"))
    return T.forget(sources(spark, sf_dir), gone)


PEOPLE = """instances AS (SELECT '/c/' || o_custkey AS asset_path, 'p' || (o_orderkey % 40) AS person_id, CASE o_orderstatus WHEN 'F' THEN 'belongs' WHEN 'O' THEN 'pending' ELSE 'deferred' END AS decision, o_orderkey % 5 = 0 AS stale FROM orders),
identities AS (SELECT 'p' || n_nationkey AS person_id, CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_nationkey + 1000 AS BIGINT) END AS tag_id FROM nation),
suppressed AS (SELECT '/c/' || c_custkey AS asset_path, 'p' || (c_custkey % 25) AS person_id FROM customer WHERE c_custkey % 2 = 0),
person_sources AS (SELECT DISTINCT i.asset_path, d.tag_id, 'person' AS source_kind, i.person_id AS source_id FROM instances i JOIN identities d ON d.person_id = i.person_id
  WHERE i.decision = 'belongs' AND NOT i.stale AND d.tag_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM suppressed s WHERE s.asset_path = i.asset_path AND s.person_id = i.person_id))"""


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders, nation, customer = (table(spark, sf_dir, t) for t in ("orders", "nation", "customer"))
    decision = F.when(F.col("o_orderstatus") == "F", "belongs").when(F.col("o_orderstatus") == "O", "pending").otherwise("deferred")
    at = lambda c: F.concat(F.lit("/c/"), F.col(c).cast("string")).alias("asset_path")
    who = lambda c: F.concat(F.lit("p"), F.expr(c).cast("string")).alias("person_id")
    return (
        orders.select(at("o_custkey"), who("o_orderkey % 40"), decision.alias("decision"), (F.col("o_orderkey") % 5 == 0).alias("stale")),
        nation.select(who("n_nationkey"), F.when(F.col("n_nationkey") % 3 > 0, (F.col("n_nationkey") + 1000).cast("long")).alias("tag_id")),
        customer.where("c_custkey % 2 = 0").select(at("c_custkey"), who("c_custkey % 25")))


@register(f"WITH {PEOPLE} SELECT * FROM person_sources")
def person_tag_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.person_sources(*_people(spark, sf_dir))


@register(f"""WITH {ASSIGNED}, {SOURCES}, {PEOPLE}, with_legacy AS (SELECT * FROM sources UNION SELECT asset_path, tag_id, 'legacy', '' FROM assigned WHERE asset_path LIKE '%3')
SELECT * FROM with_legacy s WHERE source_kind <> 'person' AND NOT (source_kind = 'legacy' AND EXISTS (SELECT 1 FROM assigned m WHERE m.asset_path LIKE '%13' AND m.asset_path = s.asset_path AND m.tag_id = s.tag_id)) UNION ALL SELECT * FROM person_sources""")
def person_tag_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = assigned(spark, sf_dir)
    legacy = own.where("asset_path LIKE '%3'").select("asset_path", "tag_id", F.lit("legacy").alias("source_kind"), F.lit("").alias("source_id"))
    return T.reconcile_people(sources(spark, sf_dir).unionByName(legacy).distinct(), *_people(spark, sf_dir), own.where("asset_path LIKE '%13'"))


@register("""
WITH k AS (SELECT p_partkey, string_split(p_name || ' ' || upper(p_name) || ' ' || p_brand, ' ') AS words FROM part),
e AS (SELECT p_partkey, unnest(words) AS keyword, unnest(range(len(words))) AS pos FROM k),
f AS (SELECT p_partkey, lower(keyword) AS key, min(pos) AS pos, min_by(keyword, pos) AS keyword FROM e WHERE lower(keyword) NOT IN (SELECT lower(string_split(min(p_name), ' ')[1]) FROM part) GROUP BY ALL)
SELECT p_partkey AS asset_path, list(keyword ORDER BY pos) AS keywords FROM f GROUP BY p_partkey""".replace("GROUP BY ALL", "GROUP BY p_partkey, lower(keyword)"))
def tag_embedded_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    word = part.agg(F.split_part(F.min("p_name"), F.lit(" "), F.lit(1)).alias("name"))
    keywords = part.select(F.col("p_partkey").alias("asset_path"), F.split(F.concat_ws(" ", "p_name", F.upper("p_name"), "p_brand"), " ").alias("keywords"))
    return T.embedded_only(keywords, part.select(F.col("p_partkey").alias("asset_path")).join(word))


@register(r"""
SELECT p_partkey, list_filter(list_transform(string_split_regex(p_type || '\/' || p_brand || '| ' || p_name, '[\\/|]+'), lambda x: trim(x)), lambda x: x <> '') AS parts,
  lower(trim(p_name)) AS name_key, regexp_extract('find #' || p_name, '(?:^|\s)#([^#]*)$', 1) AS typed FROM part""")
def tag_path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = X.hash_tag_query(F.concat(F.lit("find #"), "p_name"))
    path = F.concat("p_type", F.lit("\\/"), "p_brand", F.lit("| "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", X.split_tag_path(path).alias("parts"), F.lower(X.normalized_tag_name(F.col("p_name"))).alias("name_key"), typed.alias("typed"))
