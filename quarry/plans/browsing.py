"""Queries of the browsing side: pages, search, sources, storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import query as Q
from quarry.operators import search as S
from quarry.operators import storage as G
from quarry.plans.registry import Register
from quarry.plans.views import ASSETS, assets, table
from quarry.sources import catalog
from quarry.sources.sorted_pages import SortedPages
from quarry.sources.text_index import TextIndex
from quarry.tables import new_path

register = Register()
QUERIES, ORACLE = register.queries, register.oracle
LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NAME_KEY = LOW.format("name")


@register(f"WITH {ASSETS} SELECT * FROM assets ORDER BY {NAME_KEY}, name, id LIMIT 250 OFFSET 10")
def asset_page_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.page_items(assets(spark, sf_dir), Q.AssetQuery(offset=10), "id")


@register(f"WITH {ASSETS} SELECT * FROM assets ORDER BY size_bytes DESC, name DESC, id DESC LIMIT 1000")
def asset_page_size_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.page_items(assets(spark, sf_dir), Q.AssetQuery(sort="size", descending=True, page_size=5000), "id")


@register(f"WITH {ASSETS} SELECT * FROM assets ORDER BY modified_at_ms, name, id LIMIT 300 OFFSET 100")
def asset_page_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.page_items(assets(spark, sf_dir), Q.AssetQuery(sort="modified", offset=100, page_size=300), "id")


FILTER = f"contains(lower(name), lower('E')) AND coalesce(rating, 0) >= 1 AND {LOW.format('color_label')} IN ('brand#11', 'brand#12', 'brand#13', 'brand#21', 'brand#32') AND {LOW.format('pick_label')} IN ('accepted', 'rejected')"
FILTERED = Q.AssetQuery(name_contains="E", minimum_rating=1, color_labels=("BRAND#11", "Brand#12", "brand#13", "Brand#21", "Brand#32"), pick_labels=("accepted", "REJECTED"), sort="kind")


@register(f"WITH {ASSETS} SELECT * FROM assets WHERE {FILTER} ORDER BY kind, name, id LIMIT 250")
def asset_page_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.page_items(assets(spark, sf_dir), FILTERED, "id")


@register(f"WITH {ASSETS} SELECT CAST(count(*) AS BIGINT) AS total FROM assets WHERE {FILTER}")
def asset_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.filtered(assets(spark, sf_dir), FILTERED).agg(F.count("*").alias("total"))


@register(f"WITH {ASSETS} SELECT id FROM assets WHERE coalesce(rating, 0) >= 0 AND kind = (SELECT min(p_type) FROM part)")
def asset_kind_with_null_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "part").agg(F.min("p_type").alias("kind"))
    return Q.filtered(assets(spark, sf_dir), Q.AssetQuery(minimum_rating=0)).join(kinds, "kind", "left_semi").select("id")


@register("SELECT c_custkey FROM customer WHERE contains(lower(c_name), lower('R#00000012'))")
def name_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(X.contains_folded(F.col("c_name"), "R#00000012")).select("c_custkey")


@register(f"""WITH {ASSETS}, a AS (SELECT *, row_number() OVER (ORDER BY {NAME_KEY} DESC, name DESC, id DESC) AS k FROM assets WHERE coalesce(rating, 0) >= 2)
SELECT 'filtered' AS page, id, (SELECT count(*) FROM a) AS total FROM a WHERE k BETWEEN 101 AND 400
UNION ALL SELECT 'deep', id, (SELECT count(*) FROM assets) FROM (SELECT *, row_number() OVER (ORDER BY size_bytes, name, id) AS k, count(*) OVER () AS n FROM assets) x WHERE k > n // 2 AND k <= n // 2 + 250""")
def asset_page_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page from the middle, and a filtered one from the end, of a snapshot in the orders of names and sizes."""
    rows = assets(spark, sf_dir)
    pages = SortedPages(spark, new_path(spark, "pages"))
    pages.build(rows, "id", sorts=("name", "size"))
    filtered = pages.page(Q.AssetQuery(minimum_rating=2, descending=True, offset=100, page_size=300))
    deep = pages.page(Q.AssetQuery(sort="size", offset=pages.page(Q.AssetQuery(sort="size")).total // 2))
    told = [p.items.select(F.lit(name).alias("page"), "id", F.lit(p.total).cast("long").alias("total")) for name, p in (("filtered", filtered), ("deep", deep))]
    return told[0].unionByName(told[1])


@register(f"SELECT p_partkey FROM part WHERE {LOW.format('p_name')} LIKE '%' || {LOW.format(repr('A_%E'))} || '%'")
def like_nocase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(X.like_nocase(F.col("p_name"), "A_%E")).select("p_partkey")


@register(f"""
WITH d AS (SELECT DISTINCT p_name AS name, '/' || p_type || '/' || p_name AS path FROM part), q AS (SELECT lower(min(split_part(p_name, ' ', 1))) AS t FROM part)
SELECT name, path, CAST(CASE WHEN {LOW.format('name')} = t THEN 0 WHEN {LOW.format('name')} LIKE t || '%' THEN 1 ELSE 2 END AS INTEGER) AS rank
FROM d, q WHERE {LOW.format('name')} LIKE '%' || t || '%'""")
def directory_rank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_name").alias("name"), F.concat(F.lit("/"), "p_type", F.lit("/"), "p_name").alias("path")).distinct()
    word = part.agg(F.lower(F.min(F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("t")).first()["t"]
    return S.rank_directories(rows, word)


@register(r"""
WITH w AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS word FROM documents WHERE text IS NOT NULL
) SELECT doc_id FROM w GROUP BY doc_id HAVING bool_or(starts_with(word, 'cion')) AND bool_or(starts_with(word, 'es')) AND bool_or(starts_with(word, 'ent'))""")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.match_texts(table(spark, sf_dir, "documents"), "Ción  ES ent", "doc_id", "text")


@register(r"""
WITH w AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS word FROM documents WHERE text IS NOT NULL
) SELECT '/docs' AS root_path, doc_id FROM w GROUP BY doc_id HAVING bool_or(starts_with(word, 'cion')) AND bool_or(starts_with(word, 'es')) AND bool_or(starts_with(word, 'ent'))""")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over a stored index, which is built first."""
    stored = TextIndex(spark, new_path(spark, "text-index"), "doc_id", ("text",))
    stored.apply("/docs", table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stored.search("Ción  ES ent")


#: A library in two roots as three scans see it: names change, rows go and come back.
SCANS = (("/odd", "p_partkey % 2 = 1"), ("/even", "p_partkey % 2 = 0"), ("/odd", "p_partkey % 2 = 1 AND p_partkey % 7 <> 0"))


@register(r"""
WITH rows AS (
  SELECT '/even' AS root_path, p_partkey, p_name AS name, p_type AS kind, 2 AS scan_id FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT '/odd', p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_name END, p_type, 3 FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 7 <> 0
), w AS (SELECT *, list_filter(string_split_regex(lower(name), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words, list_filter(string_split_regex(lower(kind), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS kinds FROM rows)
SELECT root_path, p_partkey, CAST(scan_id AS BIGINT) AS scan_id, len(list_filter(words || kinds, lambda x: starts_with(x, 'brand'))) > 0 AS renamed FROM w
WHERE len(list_filter(words || kinds, lambda x: starts_with(x, 'brand') OR starts_with(x, 's'))) > 0""")
def index_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans follow one another; the index's searches and rows are those of what was seen last."""
    stored = TextIndex(spark, new_path(spark, "text-index"), "p_partkey", ("name", "kind"))
    part = table(spark, sf_dir, "part").dropDuplicates(["p_partkey"])
    for k, (root, seen) in enumerate(SCANS):
        name = F.when(F.lit(k == 2) & (F.col("p_partkey") % 5 == 0), F.col("p_brand")).otherwise(F.col("p_name"))
        stored.apply(root, part.where(seen).select("p_partkey", name.alias("name"), F.col("p_type").alias("kind")), scan_id=k + 1)
    brands = stored.search("brand").withColumn("renamed", F.lit(True))
    hits = brands.select("root_path", "p_partkey").union(stored.search("s")).distinct()
    rows = stored.rows().select("root_path", "p_partkey", "scan_id")
    return rows.join(hits, ["root_path", "p_partkey"]).join(brands, ["root_path", "p_partkey"], "left").select("root_path", "p_partkey", "scan_id", F.coalesce("renamed", F.lit(False)).alias("renamed"))


@register(r"""
WITH w AS (
  SELECT p_partkey, ' ' || array_to_string(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') AS words,
         ' ' || array_to_string(list_filter(string_split_regex(lower(p_type), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') AS kinds FROM part
), q AS (SELECT split_part(lower(min(p_name)), ' ', 1) || ' ' || left(split_part(lower(min(p_name)), ' ', 2), 2) AS t FROM part)
SELECT p_partkey FROM w, q WHERE contains(words, ' ' || t) OR contains(kinds, ' ' || t)""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    first, second = part.agg(F.lower(F.min("p_name")).alias("n")).first()["n"].split(" ")[:2]
    return S.match_texts(part, f"{first}-{second[:2]}", "p_partkey", "p_name", "p_type")


@register("""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, CAST(len(parts) AS INTEGER) AS depth,
       CASE WHEN len(parts) > 1 THEN list_transform(range(1, len(parts)), lambda k: '/root/' || array_to_string(parts[1:k], '/')) ELSE [] END AS ancestors
FROM p""")
def path_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    rows = table(spark, sf_dir, "pages").select("page_id", parts.alias("parts"))
    path = F.concat(F.lit("/root/"), F.array_join("parts", "/"))
    return rows.select("page_id", F.size("parts").alias("depth"), S.ancestors(path, F.lit("/root")).alias("ancestors"))


@register("""
WITH p AS (SELECT DISTINCT list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
n AS (SELECT unnest(range(1, len(parts) + 1)) AS k, parts FROM p WHERE len(parts) > 0)
SELECT '/root/' || array_to_string(parts[1:k], '/') AS path, bool_or(k = len(parts)) AS is_match FROM n GROUP BY 1""")
def search_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    rows = table(spark, sf_dir, "pages").select(parts.alias("parts")).where("size(parts) > 0")
    return S.search_tree(rows.select(F.concat(F.lit("/root/"), F.array_join("parts", "/")).alias("path"), F.lit("/root").alias("root_path")).distinct())


@register("SELECT coalesce(n_regionkey, -1) AS parent, CAST(coalesce(max(n_nationkey), -1) + 1 AS INTEGER) AS next_sort_order FROM nation GROUP BY n_regionkey")
def next_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.next_sort_order(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey").select(F.coalesce("n_regionkey", F.lit(-1)).alias("parent"), "next_sort_order")


@register("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END ASC NULLS LAST, o_orderdate, o_orderkey) - 1 AS BIGINT) AS place FROM orders")
def dense_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("sort_order", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")))
    placed = Q.dense_order(orders, F.col("sort_order").asc_nulls_last(), F.col("o_orderdate").asc(), F.col("o_orderkey").asc())
    return placed.select("o_orderkey", F.col("place").cast("long").alias("place"))


@register("""
SELECT n_nationkey, CAST(row_number() OVER (ORDER BY CASE WHEN s = 0 THEN 0 WHEN s = 1 THEN 1 WHEN s = -1 THEN 2 WHEN s > 0 THEN 3 ELSE 4 END, abs(s)) - 1 AS INTEGER) AS priority
FROM (SELECT n_nationkey, n_nationkey - 12 AS s FROM nation) x WHERE abs(s) <= 8""")
def selection_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.around_selection(table(spark, sf_dir, "nation"), "n_nationkey", 12, 8).select("n_nationkey", "priority")


@register("""
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'deleted' WHEN a.p = b.p AND a.o_orderstatus = b.o_orderstatus THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT o_orderkey, o_orderstatus, o_totalprice AS p FROM orders WHERE o_orderkey % 11 <> 3) a
FULL JOIN (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 13 <> 5) b ON a.o_orderkey = b.o_orderkey""")
def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("p"))
    new = orders.where("o_orderkey % 13 != 5").withColumn("p", F.when(F.col("o_orderkey") % 7 == 2, F.col("p") + 1).otherwise(F.col("p")))
    return G.index_diff(orders.where("o_orderkey % 11 != 3"), new, ["o_orderkey"], ["o_orderstatus", "p"])


@register("""
WITH known AS (SELECT '/old/' || c_custkey AS path, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS identity FROM customer UNION SELECT '/old/' || o_custkey, NULL FROM orders UNION SELECT '/older/' || s_suppkey, s_name FROM supplier),
one AS (SELECT path, max(identity) AS identity FROM known WHERE path = '/old' OR starts_with(path, '/old/') GROUP BY path),
present AS (SELECT '/new/' || c_custkey AS path, CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE c_name END AS identity FROM customer WHERE c_custkey % 3 <> 0)
SELECT o.path, '/new' || substr(o.path, 5) AS target, CASE WHEN p.path IS NULL THEN 'missing' WHEN o.identity = p.identity THEN 'verified' ELSE 'unverified' END AS status
FROM one o LEFT JOIN present p ON p.path = '/new' || substr(o.path, 5)""")
def relocation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders, supplier = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    path = lambda root, c: F.concat(F.lit(root), F.col(c).cast("string")).alias("path")
    known = [
        customer.select(path("/old/", "c_custkey"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("identity")), orders.select(path("/old/", "o_custkey"), F.lit(None).cast("string").alias("identity")),
        supplier.select(path("/older/", "s_suppkey"), F.col("s_name").alias("identity"))]
    present = customer.where("c_custkey % 3 != 0").select(path("/new/", "c_custkey"), F.when(F.col("c_custkey") % 5 == 0, "other").otherwise(F.col("c_name")).alias("identity"))
    return G.relocation_plan(known, present, "/old", "/new/")


@register("""
WITH a AS (SELECT doc_id, n_chars AS size_bytes, doc_id % 17 = 0 AS pinned, doc_id % 101 = 7 AS stale FROM documents),
r AS (SELECT *, sum(size_bytes) OVER () AS total, coalesce(sum(CASE WHEN NOT pinned THEN size_bytes ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT doc_id, NOT pinned AND (stale OR total - before > 1000000) AS evicted FROM r""")
def prune_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size_bytes"), (F.col("doc_id") % 17 == 0).alias("pinned"), (F.col("doc_id") % 101 == 7).alias("stale"))
    return G.pruned(rows, 1_000_000, ("doc_id",)).select("doc_id", "evicted")


@register("""
WITH a AS (SELECT p_brand, p_partkey AS artifact_id, p_size * 10 AS width, (p_size * 7) % 300 + 10 AS height, p_partkey % 2 = 0 AS managed, p_size % 10 = 0 AS native, p_partkey % 3 <> 0 AS ok FROM part),
r AS (SELECT *, native OR greatest(width, height) >= 320 AS satisfied FROM a WHERE ok)
SELECT p_brand, artifact_id, satisfied FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY satisfied DESC, CAST(width AS BIGINT) * height, managed DESC, artifact_id) AS k FROM r) x WHERE k = 1""")
def artifact_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select(
        "p_brand", F.col("p_partkey").alias("artifact_id"), (F.col("p_size") * 10).alias("width"), ((F.col("p_size") * 7) % 300 + 10).alias("height"), (F.col("p_partkey") % 2 == 0).alias("managed"),
        (F.col("p_size") % 10 == 0).alias("native"), (F.col("p_partkey") % 3 != 0).alias("ok"))
    best = G.artifact_choice(a, ["p_brand"], F.col("ok"), G.detail_accepts(F.col("width"), F.col("height"), F.col("native"), "display", 320))
    return best.select("p_brand", "artifact_id", "satisfied")


@register("SELECT CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS size_bytes, count(*) AS artifacts FROM documents")
def cache_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.usage(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("size_bytes")))


@register("""
WITH f AS (SELECT '/lib/' || lang || '/' || source || '/' || doc_id || CASE doc_id % 7 WHEN 0 THEN '.ARW' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.xmp' WHEN 3 THEN '.Tif' WHEN 4 THEN '.txt' WHEN 5 THEN '' ELSE '.hif' END AS path, n_chars FROM documents
  UNION ALL SELECT '/lib/' || lang || '/' || source || '/' || doc_id || '.XMP', 1 FROM documents WHERE doc_id % 3 = 0),
s AS (SELECT path, n_chars, regexp_extract(path, '[^/]*$', 0) AS name, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext, regexp_replace(path, '\\.[^./]*$', '') AS stem FROM f)
SELECT path, name, upper(ext) AS extension, CASE WHEN ext = 'arw' THEN 'raw' WHEN ext = 'jpeg' THEN 'jpeg' WHEN ext = 'tif' THEN 'tiff' ELSE 'heif' END AS kind, n_chars AS size_bytes,
       stem IN (SELECT stem FROM s WHERE ext = 'xmp') AS has_sidecar, substr(sha256(path), 1, 16) AS id
FROM s WHERE ext IN ('arw', 'jpeg', 'tif', 'hif')""".replace("\\\\", "\\"))
def asset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    stem = F.concat(F.lit("/lib/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    tail = F.element_at(F.array(*map(F.lit, (".ARW", ".jpeg", ".xmp", ".Tif", ".txt", "", ".hif"))), (F.col("doc_id") % 7 + 1).cast("int"))
    listing = d.select(F.concat(stem, tail).alias("path"), F.col("n_chars").alias("size_bytes")).unionByName(d.where("doc_id % 3 = 0").select(F.concat(stem, F.lit(".XMP")).alias("path"), F.lit(1).cast("long").alias("size_bytes")))
    return catalog.assets(listing.withColumn("modified_at_ms", F.lit(None).cast("long"))).select("path", "name", "extension", "kind", "size_bytes", "has_sidecar", "id")


@register("""
WITH d AS (SELECT DISTINCT '/lib/' || lang AS path, 1 AS depth, true AS has_children FROM documents UNION SELECT DISTINCT '/lib/' || lang || '/' || source, 2, false FROM documents)
SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent_path, regexp_extract(path, '[^/]*$', 0) AS name, has_children, depth FROM d""")
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    listing = d.select(F.concat(F.lit("/lib/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    return catalog.directories(listing, "/lib").select("path", "parent_path", "name", "has_children", "depth")


@register("""
WITH t AS (SELECT '/lib/' || lang AS path FROM documents WHERE lang = 'de' UNION SELECT '/lib/' || lang || '/' || source FROM documents WHERE source = 'src1'),
d AS (SELECT DISTINCT '/lib/' || lang || '/' || source AS path FROM documents)
SELECT path FROM d WHERE EXISTS (SELECT 1 FROM t WHERE d.path = t.path OR starts_with(d.path, t.path || '/'))""")
def tombstone_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = lambda *c: F.concat(*[x for k in c for x in (F.lit("/"), k)])
    stones = d.where("lang = 'de'").select(at(F.lit("lib"), "lang").alias("path")).union(d.where("source = 'src1'").select(at(F.lit("lib"), "lang", "source"))).distinct()
    return G.snapshot_blocked(d.select(at(F.lit("lib"), "lang", "source").alias("path")).distinct(), stones)


@register("SELECT n_nationkey AS k FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def union_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    keys = customer.select(F.col("c_nationkey").alias("k")).union(supplier.select("s_nationkey")).distinct()
    return nation.select(F.col("n_nationkey").alias("k")).join(keys, "k", "left_semi")


@register("""
SELECT page_id, coalesce(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), '(none)') AS title, CAST(len(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS INTEGER) AS items,
  substr(sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '''', '&apos;'), '"', '&quot;'), '>', '&gt;'), '<', '&lt;')), 1, 16) AS escaped
FROM pages WHERE html IS NOT NULL""")
def xml_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    items = F.regexp_extract_all(html, F.lit("(?s)<li>(.*?)</li>"), F.lit(1))
    title = F.coalesce(F.nullif(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1), F.lit("")), F.lit("(none)"))
    return table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", title.alias("title"), F.size(items).alias("items"), X.stable_id(X.escape_xml(html)).alias("escaped"))


@register("""
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) x WHERE p = 1""")
def newest_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(newest.alias("o_orderkey"))
