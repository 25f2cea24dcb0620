"""Queries of vectors, boxes and people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import geometry as G
from quarry.operators import people as P
from quarry.operators import vectors as V
from quarry.plans.registry import Register
from quarry.plans.views import table
from quarry.sources.vector_blocks import VectorBlocks
from quarry.tables import new_path

register = Register()
QUERIES, ORACLE = register.queries, register.oracle

D = "embedding::DOUBLE[]"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("feature_row_id"), F.concat(F.lit("/p/"), (F.col("vec_id") % 50).cast("string")).alias("asset_path"), F.col("vec_id").cast("string").alias("instance_id"), (F.col("vec_id") % 3).cast("string").alias("source_revision"),
        (F.col("label") % 4).cast("string").alias("feature_space_id"), (F.col("vec_id") % 20 == 19).cast("string").alias("pipeline_fingerprint"), F.col("embedding").alias("vector"), F.col("label"))


def _first(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()["embedding"]


FEATURES = f"f AS (SELECT vec_id AS feature_row_id, '/p/' || (vec_id % 50) AS asset_path, CAST(vec_id AS VARCHAR) AS instance_id, CAST(vec_id % 3 AS VARCHAR) AS source_revision, {D} AS v, label FROM embeddings), q AS (SELECT v AS qv FROM f ORDER BY feature_row_id LIMIT 1), s AS (SELECT f.*, list_cosine_similarity(v, qv) AS similarity FROM f, q)"


@register(f"WITH {FEATURES} SELECT feature_row_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.1")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.search(_features(spark, sf_dir), _first(spark, sf_dir), 0.1, valid_only=False)
    return found.select("feature_row_id", F.round("similarity", 6).alias("similarity"))


@register(f"WITH {FEATURES} SELECT feature_row_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.3")
def vector_search_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored blocks, which are built first; those that cannot hold a match are not read."""
    stored = VectorBlocks(spark, new_path(spark, "vector-blocks"))
    stored.build(_features(spark, sf_dir))
    return stored.search(_first(spark, sf_dir), 0.3, valid_only=False).select("feature_row_id", F.round("similarity", 6).alias("similarity"))


@register(f"WITH {FEATURES} SELECT feature_row_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.0 AND source_revision <> '1' ORDER BY s.similarity DESC, asset_path, instance_id, feature_row_id LIMIT 20 OFFSET 5")
def vector_search_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir)
    current = rows.where("source_revision != '1'").select("asset_path", "source_revision").distinct()
    page = V.search_page(V.search(rows, _first(spark, sf_dir), 0.0, current, valid_only=False), 5, 20)
    return page.select("feature_row_id", F.round("similarity", 6).alias("similarity"))


@register(f"SELECT vec_id, round(sqrt(list_dot_product({D}, {D})), 6) AS norm, abs(sqrt(list_dot_product({D}, {D})) - 1) <= 0.001 AS valid FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(G.norm(e), 6).alias("norm"), G.vector_is_valid(e).alias("valid"))


@register(f"SELECT vec_id, round(({D})[1] / sqrt(list_dot_product({D}, {D})), 5) AS first FROM embeddings")
def vector_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(G.unit(F.col("embedding"))[0].cast("double"), 5).alias("first"))


@register(f"""WITH x AS (SELECT CAST(label % 4 AS VARCHAR) AS feature_space_id, CASE WHEN vec_id % 20 = 19 THEN 'true' ELSE 'false' END AS p, vec_id, len(embedding) AS n FROM embeddings),
c AS (SELECT feature_space_id, arg_min(p, vec_id) AS producer, CAST(arg_min(n, vec_id) AS INTEGER) AS dimension FROM x GROUP BY feature_space_id)
SELECT c.feature_space_id, producer, dimension, count(*) FILTER (WHERE p <> producer OR n <> dimension) AS conflicts FROM c JOIN x ON x.feature_space_id = c.feature_space_id GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY c.feature_space_id, producer, dimension"))
def vector_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.space_contracts(_features(spark, sf_dir))


def _gallery(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _features(spark, sf_dir)
    return rows.where("feature_row_id % 10 != 0").select(F.col("feature_row_id").alias("face_id"), "vector"), rows.where("feature_row_id % 10 = 0").select(F.col("label").alias("person_id"), "vector")


SCORES = f"""scores AS (SELECT f.vec_id AS face_id, r.label AS person_id, max(list_dot_product(f.v, r.v)) AS score FROM (SELECT vec_id, {D} AS v FROM embeddings WHERE vec_id % 10 <> 0) f, (SELECT label, {D} AS v FROM embeddings WHERE vec_id % 10 = 0) r
  GROUP BY f.vec_id, r.label HAVING max(list_dot_product(f.v, r.v)) >= 0.2)"""


@register(f"WITH {SCORES} SELECT face_id, person_id, round(score, 6) AS score FROM scores")
def gallery_rank_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces, references = _gallery(spark, sf_dir)
    return V.gallery_scores(faces, references, 0.2).select("face_id", "person_id", F.round("score", 6).alias("score"))


@register(f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM scores WINDOW w AS (PARTITION BY face_id ORDER BY score DESC, person_id))
SELECT e.vec_id AS face_id, r.person_id, round(r.score, 6) AS score FROM embeddings e LEFT JOIN r ON r.face_id = e.vec_id AND k = 1 AND (next IS NULL OR r.score - next >= 0.05) WHERE e.vec_id % 10 <> 0""")
def gallery_rank_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces, references = _gallery(spark, sf_dir)
    return V.rank_open(faces, V.gallery_scores(faces, references, 0.2)).select("face_id", "person_id", F.round("score", 6).alias("score"))


@register(f"""WITH p AS (SELECT a.vec_id // 20 AS picture, a.vec_id AS m, b.vec_id AS d, list_cosine_similarity(a.{D}, b.{D}) AS score FROM embeddings a JOIN embeddings b ON a.vec_id // 20 = b.vec_id // 20 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER wm AS mk, lead(score) OVER wm AS mn, row_number() OVER wd AS dk, lead(score) OVER wd AS dn FROM p WHERE score >= 0.05
  WINDOW wm AS (PARTITION BY picture, m ORDER BY score DESC, d), wd AS (PARTITION BY picture, d ORDER BY score DESC, m))
SELECT picture, m AS manual_id, d AS detected_id, round(score, 6) AS score, dk = 1 AND (mn IS NULL OR score - mn >= 0.02) AND (dn IS NULL OR score - dn >= 0.02) AS matched FROM r WHERE mk = 1""")
def align_mutual_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir).select(F.floor(F.col("feature_row_id") / 20).alias("picture"), "feature_row_id", "vector")
    manual, detected = rows.where("feature_row_id % 2 = 0").alias("m"), rows.where("feature_row_id % 2 = 1").alias("d")
    pairs = manual.join(detected, F.col("m.picture") == F.col("d.picture")).select("m.picture", F.col("m.feature_row_id").alias("manual_id"), F.col("d.feature_row_id").alias("detected_id"), G.cosine(F.col("m.vector"), F.col("d.vector")).alias("score"))
    return V.mutual_best(pairs.where("score >= 0.05"), 0.02, ("picture",)).select("picture", "manual_id", "detected_id", F.round("score", 6).alias("score"), "matched")


def _iou(a: str, b: str) -> str:
    common = f"(greatest(least({a}[1] + {a}[3], {b}[1] + {b}[3]) - greatest({a}[1], {b}[1]), 0) * greatest(least({a}[2] + {a}[4], {b}[2] + {b}[4]) - greatest({a}[2], {b}[2]), 0))"
    return f"({common} / ({a}[3] * {a}[4] + {b}[3] * {b}[4] - {common}))"


@register(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem),
b AS (SELECT l_orderkey, rn AS id, CASE WHEN l_suppkey % 9 = 1 THEN 'old' WHEN l_suppkey % 9 <> 0 THEN 'r' || l_orderkey END AS rev, l_partkey % 11 = 0 AS needs, CAST((rn - 1) // 2 % 2 AS DOUBLE) * 0.3 AS x,
  CASE WHEN l_partkey % 3 <> 0 THEN [x, 0.1::DOUBLE, 0.2 + CAST(l_partkey % 5 AS DOUBLE) * 0.01, 0.2::DOUBLE] END AS face, CASE WHEN l_suppkey % 2 = 0 THEN [x, 0.05::DOUBLE, 0.4::DOUBLE, 0.3 + CAST(l_suppkey % 4 AS DOUBLE) * 0.05] END AS body FROM l),
m AS (SELECT * FROM b WHERE id % 2 = 1), d AS (SELECT * FROM b WHERE id % 2 = 0 AND rev = 'r' || l_orderkey),
p AS (SELECT m.l_orderkey, m.id AS mid, d.id AS did, CASE WHEN m.face IS NOT NULL AND d.face IS NOT NULL AND {_iou('m.face', 'd.face')} >= 0.75 AND (m.body IS NULL OR d.body IS NULL OR {_iou('m.body', 'd.body')} >= 0.5) THEN {_iou('m.face', 'd.face')}
  WHEN m.face IS NULL AND d.face IS NULL AND {_iou('m.body', 'd.body')} >= 0.8 THEN {_iou('m.body', 'd.body')} END AS score FROM m JOIN d ON d.l_orderkey = m.l_orderkey WHERE NOT m.needs AND m.rev = 'r' || m.l_orderkey),
r AS (SELECT *, row_number() OVER wm AS mk, lead(score) OVER wm AS mn, row_number() OVER wd AS dk, lead(score) OVER wd AS dn FROM p WHERE score IS NOT NULL
  WINDOW wm AS (PARTITION BY l_orderkey, mid ORDER BY score DESC, did), wd AS (PARTITION BY l_orderkey, did ORDER BY score DESC, mid)),
best AS (SELECT *, dk = 1 AND (mn IS NULL OR score - mn >= 0.15) AND (dn IS NULL OR score - dn >= 0.15) AS ok FROM r WHERE mk = 1)
SELECT m.l_orderkey, m.id AS manual_id, CASE WHEN ok THEN did END AS detected_id, CASE WHEN ok THEN round(score, 6) END AS score,
  CASE WHEN needs THEN 'needs_review' WHEN rev IS NULL THEN 'source_unverified' WHEN rev = 'old' THEN 'source_changed' WHEN did IS NULL THEN 'no_matching_detection' WHEN NOT ok THEN 'ambiguous_geometry' END AS reason
FROM m LEFT JOIN best ON best.l_orderkey = m.l_orderkey AND best.mid = m.id""")
def align_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order a picture, its line items instances: odd places manual, even ones detected."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.row_number().over(order).cast("long"))
    x = F.floor((F.col("id") - 1) / 2) % 2 * F.lit(0.3)
    current = F.concat(F.lit("r"), F.col("l_orderkey").cast("string"))
    rev = F.when(F.col("l_suppkey") % 9 == 1, "old").when(F.col("l_suppkey") % 9 != 0, current)
    face = F.when(F.col("l_partkey") % 3 != 0, F.array(x, F.lit(0.1), 0.2 + (F.col("l_partkey") % 5).cast("double") * 0.01, F.lit(0.2)))
    body = F.when(F.col("l_suppkey") % 2 == 0, F.array(x, F.lit(0.05), F.lit(0.4), 0.3 + (F.col("l_suppkey") % 4).cast("double") * 0.05))
    boxes = rows.select("l_orderkey", "id", rev.alias("source_identity_revision"), current.alias("revision"), face.alias("face_box"), body.alias("body_box"), (F.col("l_partkey") % 11 == 0).alias("needs_review"))
    overlaps = G.pair_overlaps(F.col("m.face_box"), F.col("m.body_box"), F.col("d.face_box"), F.col("d.body_box"))
    found = V.align(boxes.where("id % 2 = 1"), boxes.where("id % 2 = 0"), F.col("revision"), G.overlap_score(), picture=("l_orderkey",), measures=overlaps)
    return found.withColumn("score", F.round("score", 6))


@register(f"""WITH RECURSIVE u AS (SELECT CAST(label AS VARCHAR) AS folder_path, '/p/' || (vec_id % 50) AS asset_path, CAST(vec_id AS VARCHAR) AS instance_id, vec_id % 17 AS quality, {D} AS e, sqrt(list_dot_product({D}, {D})) AS norm FROM embeddings),
f AS (SELECT *, row_number() OVER (PARTITION BY folder_path ORDER BY quality DESC, asset_path, instance_id) AS k, list_transform(e, lambda x: CAST(CAST(x / norm AS FLOAT) AS DOUBLE)) AS v FROM u),
p AS (SELECT a.folder_path, a.k AS i, b.k AS j, CASE WHEN a.asset_path = b.asset_path THEN -1 ELSE list_dot_product(a.v, b.v) END AS l FROM f a JOIN f b ON a.folder_path = b.folder_path AND a.k > b.k),
e AS (SELECT *, row_number() OVER (PARTITION BY folder_path ORDER BY l DESC, i, j) AS step FROM p WHERE l >= 0.12),
bad AS (SELECT folder_path, list({{'i': i, 'j': j}}) AS pairs FROM p WHERE l < 0.12 GROUP BY folder_path),
s AS (SELECT folder_path, CAST(0 AS BIGINT) AS step, list(k ORDER BY k) AS owner FROM f GROUP BY folder_path
  UNION ALL SELECT folder_path, step, CASE WHEN a <> b AND len(list_filter(pairs, lambda x: (owner[x.i] = a AND owner[x.j] = b) OR (owner[x.i] = b AND owner[x.j] = a))) = 0
    THEN list_transform(owner, lambda o: CASE WHEN o = b THEN a ELSE o END) ELSE owner END
  FROM (SELECT s.folder_path, e.step, s.owner, coalesce(bad.pairs, []) AS pairs, s.owner[e.i] AS a, s.owner[e.j] AS b FROM s JOIN e ON e.folder_path = s.folder_path AND e.step = s.step + 1 LEFT JOIN bad ON bad.folder_path = s.folder_path) t),
last AS (SELECT folder_path, arg_max(owner, step) AS owner FROM s GROUP BY folder_path),
o AS (SELECT f.folder_path, asset_path, instance_id, owner[k] AS owner FROM f JOIN last ON last.folder_path = f.folder_path),
n AS (SELECT folder_path, owner, sha256('[' || string_agg('["' || asset_path || '", "' || instance_id || '"]', ', ' ORDER BY asset_path, instance_id) || ']') AS cluster_id FROM o GROUP BY folder_path, owner HAVING count(*) > 1)
SELECT o.folder_path, asset_path, instance_id, cluster_id FROM o LEFT JOIN n ON n.folder_path = o.folder_path AND n.owner = o.owner""")
def complete_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _features(spark, sf_dir).select(F.col("label").cast("string").alias("folder_path"), "asset_path", "instance_id", (F.col("feature_row_id") % 17).cast("double").alias("quality"), G.unit(F.col("vector")).alias("vector"))
    return V.complete_link(faces, threshold=0.12)


BOX = "[(p_partkey % 10) / 20.0, (p_size % 10) / 20.0, 0.2 + (p_size % 7) / 20.0, 0.2 + (p_partkey % 5) / 20.0]"
OTHER = "[(p_partkey % 9) / 20.0, (p_size % 11) / 20.0, 0.25 + (p_size % 3) / 20.0, 0.25 + (p_partkey % 4) / 20.0]"


def _box(text: str) -> str:
    return f"CAST(array{text.replace('[', '(').replace(']', ')')} AS ARRAY<DOUBLE>)"


@register(f"""WITH b AS (SELECT p_partkey, {BOX}::DOUBLE[] AS a, {OTHER}::DOUBLE[] AS b FROM part),
o AS (SELECT *, greatest(least(a[1] + a[3], b[1] + b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[2] + a[4], b[2] + b[4]) - greatest(a[2], b[2]), 0) AS c FROM b)
SELECT p_partkey, round(c / (a[3] * a[4] + b[3] * b[4] - c), 6) AS iou, a[1] + a[3] <= 1 + 8 * 2.220446049250313e-16 AND a[2] + a[4] <= 1 + 8 * 2.220446049250313e-16 AS valid,
  CASE WHEN p_partkey % 3 <> 0 AND c / (a[3] * a[4] + b[3] * b[4] - c) >= CASE WHEN p_partkey % 3 = 1 THEN 0.61 ELSE 0.51 END THEN round(c / (a[3] * a[4] + b[3] * b[4] - c), 6) END AS score FROM o""")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_box(BOX)).alias("a"), F.expr(_box(OTHER)).alias("b"))
    a, b = F.col("a"), F.col("b")
    # a third has faces on both sides, a third bodies alone, a third a face on one side
    turn = F.col("p_partkey") % 3
    score = G.pair_score(F.when(turn == 1, a), F.when(turn == 2, a), F.when(turn != 2, b), F.when(turn == 2, b), min_face=0.61, min_body=0.51)
    return rows.select("p_partkey", F.round(G.iou(a, b), 6).alias("iou"), G.box_is_valid(a).alias("valid"), F.when(turn != 0, F.round(score, 6)).alias("score"))


@register("""SELECT p_partkey, round(p_retailprice * sqrt(0.2 * (0.1 + p_size / 100.0)), 6) AS quality, CASE WHEN least(p_size * 10 - 20, 300) > greatest(p_size * 8 - 100, 0) THEN round((least(p_size * 10 - 20, 300) - greatest(p_size * 8 - 100, 0)) / 300.0, 6) END AS width FROM part""")
def detection_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    box = G.clamp_box(size * 8 - 100, F.lit(10.0), size * 10 - 20, F.lit(90.0), F.lit(300.0), F.lit(100.0))
    unit = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.2), 0.1 + size / 100)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(G.face_quality(F.col("p_retailprice"), unit), 6).alias("quality"), F.round(box[2], 6).alias("width"))


@register("""WITH RECURSIVE b AS (SELECT p_partkey // 50 AS picture, p_partkey AS id, CAST(p_partkey * 7 % 90 AS DOUBLE) AS x1, CAST(p_size * 3 AS DOUBLE) AS y1, CAST(p_partkey * 7 % 90 AS DOUBLE) + 40 AS x2, CAST(p_size * 3 AS DOUBLE) + 30 AS y2, p_retailprice AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY picture ORDER BY score DESC, id) AS k FROM b),
s AS (SELECT picture, k, [{'x': x1, 'y': y1}] AS kept, true AS stays FROM r WHERE k = 1
  UNION ALL SELECT picture, k, CASE WHEN free THEN list_append(kept, {'x': x1, 'y': y1}) ELSE kept END, free FROM (
    SELECT r.picture, r.k, r.x1, r.y1, s.kept, len(list_filter(s.kept, lambda o: greatest(least(o.x + 40, r.x2) - greatest(o.x, r.x1) + 1, 0) * greatest(least(o.y + 30, r.y2) - greatest(o.y, r.y1) + 1, 0)
      / (2 * 41 * 31 - greatest(least(o.x + 40, r.x2) - greatest(o.x, r.x1) + 1, 0) * greatest(least(o.y + 30, r.y2) - greatest(o.y, r.y1) + 1, 0)) > 0.4)) = 0 AS free
    FROM s JOIN r ON r.picture = s.picture AND r.k = s.k + 1) t)
SELECT r.picture, id, x1, y1, x2, y2, score FROM s JOIN r ON r.picture = s.picture AND r.k = s.k WHERE stays""")
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    x, y = (F.col("p_partkey") * 7 % 90).cast("double"), (F.col("p_size") * 3).cast("double")
    boxes = p.select(F.floor(F.col("p_partkey") / 50).alias("picture"), F.col("p_partkey").alias("id"), x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 30).alias("y2"), F.col("p_retailprice").alias("score"))
    return V.suppress(boxes, "picture", 0.4)


@register("""SELECT vec_id, vec_id % 5 <> 0 AND vec_id % 3 <> 2 AS usable FROM embeddings""")
def cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 512 numbers and of 64, of squared lengths within 0.002 of 1 and beyond."""
    stretch = (1 + (F.col("vec_id") % 3) * 0.0008) / G.norm(F.col("embedding"))
    wide = F.transform(F.flatten(F.array_repeat("embedding", 8)), lambda x: x.cast("double") * stretch / 8**0.5)
    vector = F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: x.cast("double") * stretch)).otherwise(wide)
    return table(spark, sf_dir, "embeddings").select("vec_id", G.cluster_vector(vector).isNotNull().alias("usable"))


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 60 OFFSET 7")
def gallery_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gallery_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 7, 100, "o_totalprice", "o_orderkey")


INSTANCES = """instances AS (SELECT o_custkey AS k, CAST(o_orderkey AS VARCHAR) AS instance_id, CASE WHEN o_orderkey % 4 = 0 THEN 'old' ELSE c_nationkey || ':' || o_custkey END AS rev, o_orderstatus = 'P' AS needs FROM orders JOIN customer ON c_custkey = o_custkey),
reviews AS (SELECT CAST(l_orderkey AS VARCHAR) AS instance_id, max(l_returnflag) AS flag FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey),
known AS (SELECT i.*, CASE r.flag WHEN 'A' THEN 'belongs' WHEN 'N' THEN 'pending' WHEN 'R' THEN 'doesNotBelong' END AS decision, rev <> c_nationkey || ':' || c_custkey OR needs AS stale FROM instances i JOIN customer ON c_custkey = k LEFT JOIN reviews r ON r.instance_id = i.instance_id)"""


def _person(spark: SparkSession, sf_dir: str, state: str, person: str | None = "me") -> DataFrame:
    orders, customer, lineitem = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    rev = F.concat_ws(":", F.col("c_nationkey").cast("string"), F.col("o_custkey").cast("string"))
    instances = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_custkey").alias("asset_path"), F.col("o_orderkey").cast("string").alias("instance_id"), F.when(F.col("o_orderkey") % 4 == 0, "old").otherwise(rev).alias("source_revision"), (F.col("o_orderstatus") == "P").alias("needs_review"))
    flag = F.col("flag")
    decision = F.when(flag == "A", "belongs").when(flag == "N", "pending").when(flag == "R", "doesNotBelong")
    reviews = lineitem.where("l_orderkey % 3 != 0").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag")).select(F.col("l_orderkey").cast("string").alias("instance_id"), F.lit("me").alias("person_id"), decision.alias("decision"))
    assets = customer.select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("size_bytes"), F.col("c_custkey").alias("modified_at_ms"))
    return P.person_filter(assets, instances, reviews, state, person).select("path")


for _state, _test in {"all": "NOT stale AND decision <> 'doesNotBelong'", "pending": "NOT stale AND decision = 'pending'", "belongs": "NOT stale AND decision = 'belongs'", "doesNotBelong": "NOT stale AND decision = 'doesNotBelong'", "deferred": "NOT stale AND decision = 'deferred'", "needsReview": "stale"}.items():
    register(f"WITH {INSTANCES} SELECT c_custkey AS path FROM customer WHERE EXISTS (SELECT 1 FROM known WHERE k = c_custkey AND {_test})", f"person_filter_{_state}")(lambda s, d, state=_state: _person(s, d, state))


@register(f"WITH {INSTANCES} SELECT c_custkey AS path FROM customer WHERE NOT EXISTS (SELECT 1 FROM known WHERE k = c_custkey AND NOT stale AND decision IS NOT NULL)")
def person_filter_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _person(spark, sf_dir, "unassigned")


@register("SELECT c_custkey AS path FROM customer")
def person_filter_no_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _person(spark, sf_dir, "unassigned", None)


@register("SELECT CAST(c_nationkey AS VARCHAR) AS folder_path, min(o_orderkey) AS cover, count(DISTINCT o_custkey) AS people, count(*) AS instances FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY c_nationkey")
def person_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return P.folders(joined.select(F.col("c_nationkey").cast("string").alias("folder_path"), F.col("o_orderkey").alias("asset_path"), F.col("o_custkey").alias("person_id")))


@register("""SELECT c_custkey AS path FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderkey % 3 = 1)""")
def cluster_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    assets = customer.select(F.col("c_custkey").alias("path"), F.lit(1).alias("size_bytes"), F.col("c_custkey").alias("modified_at_ms"))
    members = orders.select(F.col("o_custkey").alias("asset_path"), F.col("o_orderstatus").alias("cluster_id"), F.concat(F.when(F.col("o_orderkey") % 3 == 1, "1:").otherwise("2:"), F.col("o_custkey").cast("string")).alias("source_revision"))
    return P.cluster_filter(assets, members, "O").select("path")


@register("""SELECT c_custkey AS path FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""")
def tuple_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    assets = customer.select(F.col("c_custkey").alias("path"), F.lit(1).alias("size_bytes"), F.col("c_custkey").alias("modified_at_ms"))
    tuples = orders.select(F.col("o_custkey").alias("asset_path"), F.col("o_orderpriority").alias("group_id"), F.col("o_orderstatus").alias("decision"), F.concat(F.lit("1:"), F.col("o_custkey").cast("string")).alias("source_revision"))
    return P.tuple_filter(assets, tuples, "1-URGENT", "F").select("path")


@register("""SELECT o_orderkey, e.vec_id FROM orders LEFT JOIN embeddings e ON e.vec_id = o_orderkey AND e.label % 2 = 0 AND o_orderkey % 3 = vec_id % 2""")
def evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    detections = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("/a").alias("asset_path"), F.col("o_orderkey").alias("instance_id"), (F.col("o_orderkey") % 3).alias("source_revision"))
    e = table(spark, sf_dir, "embeddings")
    features = e.select(F.lit("/a").alias("asset_path"), F.col("vec_id").alias("instance_id"), (F.col("vec_id") % 2).alias("source_revision"), (F.col("label") % 2).alias("feature_space_id"), F.col("vec_id").alias("vector"))
    return P.evidence(detections, features, features.select("feature_space_id").distinct(), 0).select("o_orderkey", F.col("vector").alias("vec_id"))


@register("""SELECT (SELECT count(*) FROM customer c WHERE c_custkey % 3 > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'P')) AS without_face,
  (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS not_analysed, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 = 0) AS without_vector""")
def analysis_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    found = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("asset_path"), F.when(F.col("o_orderkey") % 5 != 0, F.lit(1)).alias("vector"))
    return P.coverage(assets, assets.where("path % 3 > 0"), found)


@register("""WITH d AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS k FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey)
SELECT CAST(o_custkey AS VARCHAR) AS person_id, o_orderkey AS instance_id, k AS vector FROM orders JOIN d ON l_orderkey = o_orderkey AND n = 1 WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'""")
def reference_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    reviews = o.select(F.col("o_orderkey").alias("instance_id"), F.col("o_custkey").cast("string").alias("person_id"), F.when(F.col("o_orderstatus") == "F", "belongs").otherwise("pending").alias("decision"))
    unit = F.array(F.lit(0.1), F.lit(0.1), F.lit(0.5), F.lit(0.5))
    manual = o.select(F.col("o_orderkey").alias("instance_id"), F.col("o_orderkey").alias("asset_path"), F.lit("r").alias("source_revision"), unit.alias("face_box"), (F.col("o_orderpriority") == "5-LOW").alias("needs_review"))
    near = F.array(F.when(F.col("l_quantity") > 25, 0.1 + 1e-10).otherwise(0.2), F.lit(0.1), F.lit(0.5), F.lit(0.5))
    detections = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset_path"), F.lit("r").alias("source_revision"), F.col("l_linenumber").alias("instance_id"), near.alias("face_box"))
    features = detections.select("asset_path", "instance_id", "source_revision", F.col("instance_id").alias("vector")).distinct()
    return P.references(reviews, manual, detections, features)


@register("""SELECT l_orderkey AS instance_id, l_linenumber AS person_id, CASE WHEN o_orderstatus = 'F' AND f <> 'R' THEN 'pending' ELSE CASE f WHEN 'R' THEN 'doesNotBelong' ELSE f END END AS decision, CAST(1 + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS revision
FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber) x JOIN orders ON o_orderkey = l_orderkey""")
def require_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    reviews = one.select(F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("person_id"), F.when(F.col("f") == "R", "doesNotBelong").otherwise(F.col("f")).alias("decision"), F.lit(1).cast("long").alias("revision"))
    return P.require_review(reviews, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("instance_id")))


@register("""WITH r AS (SELECT DISTINCT l_orderkey AS instance_id, l_suppkey % 5 AS global_id, CASE l_returnflag WHEN 'R' THEN 'doesNotBelong' WHEN 'A' THEN 'belongs' ELSE 'pending' END AS decision FROM lineitem WHERE l_suppkey % 10 < 8)
SELECT instance_id, global_id AS person_id, CASE WHEN count(*) = 1 THEN min(decision) WHEN bool_or(decision = 'doesNotBelong') THEN 'doesNotBelong' ELSE 'deferred' END AS decision FROM r GROUP BY instance_id, global_id""")
def identity_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    reviews = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.col("l_suppkey").alias("person_id"), F.when(flag == "R", "doesNotBelong").when(flag == "A", "belongs").otherwise("pending").alias("decision"))
    links = table(spark, sf_dir, "supplier").where("s_suppkey % 10 < 8").select(F.col("s_suppkey").alias("person_id"), (F.col("s_suppkey") % 5).alias("global_id"))
    return P.migrate(reviews, links)


@register("""WITH t AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'm' || o_custkey ELSE CAST(o_orderkey AS VARCHAR) END AS instance_id FROM orders WHERE o_orderstatus = 'P'),
r AS (SELECT 'm' || c_custkey AS instance_id, CASE WHEN c_custkey % 2 = 0 THEN 'belongs' ELSE 'doesNotBelong' END AS decision FROM customer WHERE c_custkey % 5 = 0)
SELECT count(*) FILTER (WHERE decision IS NULL) AS added, count(*) FILTER (WHERE decision = 'belongs') AS preserved, count(*) FILTER (WHERE decision = 'doesNotBelong') AS conflicted FROM t LEFT JOIN r ON r.instance_id = t.instance_id""")
def cluster_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), table(spark, sf_dir, "customer")
    members = orders.select(F.col("o_orderkey").cast("string").alias("instance_id"))
    aligned = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("detected_id"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("manual_id"))
    reviews = customer.where("c_custkey % 5 = 0").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("instance_id"), F.lit("me").alias("person_id"), F.when(F.col("c_custkey") % 2 == 0, "belongs").otherwise("doesNotBelong").alias("decision"))
    return P.adopt_cluster(members, aligned, reviews, "me")[1]


@register("""WITH base AS (SELECT CAST(o_orderkey AS VARCHAR) AS i, CASE WHEN o_orderkey % 2 = 0 THEN 'person:' || (o_custkey % 7) ELSE 'unknown:g' || (o_custkey % 11) END AS g, o_orderkey % 2 = 0 AS known FROM orders UNION ALL SELECT 'm' || s_suppkey, 'unknown:m' || s_suppkey, false FROM supplier),
rev AS (SELECT CAST(c_custkey AS VARCHAR) AS i, 'person:' || (c_nationkey % 7) AS g, CASE WHEN c_custkey % 3 = 0 THEN 'doesNotBelong' WHEN c_custkey % 3 = 1 THEN 'belongs' ELSE 'pending' END AS decision FROM customer
  UNION ALL SELECT 'm' || s_suppkey, 'person:' || (s_nationkey % 7), 'doesNotBelong' FROM supplier WHERE s_acctbal < 0),
m AS (SELECT b.i, r.g, true AS known, r.decision FROM rev r JOIN base b ON b.i = r.i
  UNION ALL SELECT b.i, 'unknown:' || b.i, false, NULL FROM rev r JOIN base b ON b.i = r.i WHERE r.decision = 'doesNotBelong'
  UNION ALL SELECT b.i, b.g, b.known, NULL FROM base b WHERE NOT EXISTS (SELECT 1 FROM rev r WHERE r.i = b.i AND r.decision <> 'doesNotBelong')),
o AS (SELECT g, i, bool_or(known) AS known, max(decision) AS decision FROM m GROUP BY g, i)
SELECT g AS group_id, known, i AS instance_id, decision, count(*) OVER (PARTITION BY g) AS size FROM o""")
def person_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    even = F.col("o_orderkey") % 2 == 0
    person = F.when(even, (F.col("o_custkey") % 7).cast("string"))
    suggestions = o.select(F.col("o_orderkey").cast("string").alias("instance_id"), F.lit("/a").alias("asset_path"), F.when(even, F.concat(F.lit("person:"), person)).otherwise(F.concat(F.lit("unknown:g"), (F.col("o_custkey") % 11).cast("string"))).alias("group_id"), person.alias("person_id"))
    k = F.col("c_custkey") % 3
    reviews = c.select(F.col("c_custkey").cast("string").alias("instance_id"), (F.col("c_nationkey") % 7).cast("string").alias("person_id"), F.when(k == 0, "doesNotBelong").when(k == 1, "belongs").otherwise("pending").alias("decision"))
    manual_id = F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("instance_id")
    excluded = s.where("s_acctbal < 0").select(manual_id, (F.col("s_nationkey") % 7).cast("string").alias("person_id"), F.lit("doesNotBelong").alias("decision"))
    return P.workspace(suggestions, s.select(manual_id, F.lit("/m").alias("asset_path")), reviews.unionByName(excluded)).drop("asset_path")
