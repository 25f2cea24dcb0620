"""Hierarchical tags: closure, matching, provenance.

The vocabulary is an adjacency table (id, parent_id, name). Its closure is built by doubling: each round
joins paths of length up to n with themselves, so a tree of depth d takes log2(d) joins, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import normalized_tag_name
from quarry.tables import kept

#: Added to numbers in sort keys, so that negative ones stand before others.
SHIFT = 10**15


def closure(tags: DataFrame, most_rounds: int = 12) -> DataFrame:
    """(ancestor, tag, depth) for every pair, a tag itself at depth 0. A cycle, or more than 2 ** most_rounds levels, is an error."""
    paths = tags.select(F.col("id").alias("ancestor"), F.col("id").alias("tag"), F.lit(0).alias("depth")).unionByName(
        tags.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("ancestor"), F.col("id").alias("tag"), F.lit(1).alias("depth")))
    reach = 1
    for _ in range(most_rounds):
        edge = paths.where(F.col("depth") == reach)
        if edge.isEmpty():
            return paths
        far = edge.alias("e").join(paths.where("depth > 0").alias("p"), F.col("e.ancestor") == F.col("p.tag"))
        paths = kept(paths.unionByName(far.select("p.ancestor", "e.tag", (F.col("e.depth") + F.col("p.depth")).alias("depth"))), "tag-paths")
        reach *= 2
    raise ValueError("the tags hold a cycle, or too many levels")


def subtree_contains(closed: DataFrame, root: int, tag: int) -> bool:
    return not closed.where((F.col("ancestor") == root) & (F.col("tag") == tag)).isEmpty()


def subtree_tests(closed: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (root, tag) with contained: the same test for many pairs at once."""
    known = closed.select(F.col("ancestor").alias("root"), "tag", F.lit(True).alias("_in"))
    return asked.join(known, ["root", "tag"], "left").withColumn("contained", F.coalesce("_in", F.lit(False))).drop("_in")


def match_assets(closed: DataFrame, assigned: DataFrame, selected: list[int], match_all: bool) -> DataFrame:
    """Assets with a tag in the subtree of every selected tag (or of any). A selected id outside the vocabulary is a subtree of itself."""
    spark = closed.sparkSession
    roots = spark.createDataFrame([(x,) for x in sorted(set(selected))], "root long")
    inside = closed.join(F.broadcast(roots), F.col("ancestor") == F.col("root")).select("root", F.col("tag").alias("tag_id"))
    inside = inside.unionByName(roots.select("root", F.col("root").alias("tag_id"))).distinct()
    hits = assigned.select("asset_path", "tag_id").join(inside, "tag_id")
    if not match_all:
        return hits.select("asset_path").distinct()
    return hits.groupBy("asset_path").agg(F.countDistinct("root").alias("n")).where(F.col("n") == len(set(selected))).select("asset_path")


def subtree_assets(closed: DataFrame, assigned: DataFrame, root: int) -> DataFrame:
    below = closed.where(F.col("ancestor") == root).select(F.col("tag").alias("tag_id"))
    return assigned.join(below, "tag_id", "left_semi").select("asset_path").distinct()


def delete_impact(closed: DataFrame, assigned: DataFrame) -> DataFrame:
    """For each tag, how many tags and assets go with its subtree."""
    joined = closed.join(assigned.select("asset_path", F.col("tag_id").alias("tag")), "tag", "left")
    return joined.groupBy(F.col("ancestor").alias("id")).agg(F.countDistinct("tag").alias("tags"), F.countDistinct("asset_path").alias("assets"))


def paths(tags: DataFrame, closed: DataFrame) -> DataFrame:
    """(id, path): the names from the topmost ancestor there is, joined by pipes."""
    named = closed.join(tags.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    up = named.groupBy(F.col("tag").alias("id")).agg(F.sort_array(F.collect_list(F.struct("depth", "name")), asc=False).alias("up"))
    return up.select("id", F.array_join(F.transform("up", lambda x: x["name"]), "|").alias("path"))


def tree_order(tags: DataFrame, closed: DataFrame) -> DataFrame:
    """(id, depth, sort_path): ordering by sort_path walks the tree depth first, children by sort_order then id."""
    named = closed.join(tags.select(F.col("id").alias("ancestor"), "sort_order"), "ancestor")
    step = F.struct("depth", F.format_string("%016d.%016d", F.coalesce("sort_order", F.lit(0)) + SHIFT, F.col("ancestor") + SHIFT).alias("key"))
    up = named.groupBy(F.col("tag").alias("id")).agg(F.sort_array(F.collect_list(step), asc=False).alias("up"))
    return up.select("id", (F.size("up") - 1).alias("depth"), F.array_join(F.transform("up", lambda x: x["key"]), "/").alias("sort_path"))


def visible_in_search(tags: DataFrame, closed: DataFrame, query: str) -> DataFrame:
    """Ids of the tags whose name contains the query and of their ancestors."""
    hits = tags.where(F.lower("name").contains(F.lower(F.lit(query)))).select(F.col("id").alias("tag"))
    return closed.join(hits, "tag", "left_semi").select(F.col("ancestor").alias("id")).distinct()


def counts(tags: DataFrame, assigned: DataFrame, assets: DataFrame) -> DataFrame:
    """Every tag with the number of the given assets that carry it."""
    carried = assigned.join(assets.select("asset_path").distinct(), "asset_path", "left_semi").groupBy("tag_id").agg(F.countDistinct("asset_path").alias("n"))
    return tags.select("id").join(carried, F.col("id") == F.col("tag_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def by_asset(assets: DataFrame, assigned: DataFrame) -> DataFrame:
    """(asset_path, tag_ids): every given asset with its tags in order, none as an empty list."""
    lists = assigned.groupBy("asset_path").agg(F.sort_array(F.collect_set("tag_id")).alias("tag_ids"))
    return assets.select("asset_path").join(lists, "asset_path", "left").select("asset_path", F.coalesce("tag_ids", F.array().cast("array<bigint>")).alias("tag_ids"))


def effective(sources: DataFrame) -> DataFrame:
    """The derived assignments: a pair is there if any source says so."""
    return sources.select("asset_path", "tag_id").distinct()


def override(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Sources after manual changes (asset_path, tag_id, assign): legacy and manual sources of those pairs go, assigned pairs get a manual one, other kinds stay."""
    touched = sources.join(changes.select("asset_path", "tag_id"), ["asset_path", "tag_id"], "left_semi").where(F.col("source_kind").isin("legacy", "manual"))
    rest = sources.join(touched, ["asset_path", "tag_id", "source_kind", "source_id"], "left_anti")
    return rest.unionByName(changes.where("assign").select("asset_path", "tag_id", F.lit("manual").alias("source_kind"), F.lit("").alias("source_id"))).distinct()


def backfill_legacy(assigned: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with a legacy one added for every assignment that has none."""
    bare = assigned.select("asset_path", "tag_id").join(sources, ["asset_path", "tag_id"], "left_anti")
    return sources.unionByName(bare.select("asset_path", "tag_id", F.lit("legacy").alias("source_kind"), F.lit("").alias("source_id")))


def sidecar_paths(sidecars: DataFrame) -> DataFrame:
    """(asset_path, path): the tag paths a sidecar asks for, from (asset_path, subjects, hierarchical).

    Flat subjects equal to the leaf of a hierarchical one, without regard to case, are left out. Every segment is normalized; a path with a bad segment is null.
    """
    leaves = F.transform("hierarchical", lambda p: F.lower(F.element_at(F.split(p, r"\|"), -1)))
    flat = F.filter("subjects", lambda s: ~F.array_contains(leaves, F.lower(s)))
    both = sidecars.select("asset_path", F.explode(F.array_union("hierarchical", flat)).alias("raw"))
    segments = F.transform(F.split("raw", r"\|"), normalized_tag_name)
    return both.select("asset_path", F.when(F.forall(segments, lambda s: s.isNotNull()), F.array_join(segments, "|")).alias("path")).distinct()


def missing_tags(tag_paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, parent, name) of the tags that must be created for the wanted paths, parents included, each once; paths compare without case."""
    parts = F.split("path", r"\|")
    prefixes = wanted.where("path IS NOT NULL").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "|"))).alias("path"))
    one = prefixes.groupBy(F.lower("path").alias("key")).agg(F.min("path").alias("path"))
    new = one.join(tag_paths.select(F.lower("path").alias("key")), "key", "left_anti")
    return new.select("path", F.nullif(F.regexp_replace("path", r"\|?[^|]*$", ""), F.lit("")).alias("parent"), F.element_at(F.split("path", r"\|"), -1).alias("name"))


def import_sidecars(sources: DataFrame, desired: DataFrame, imported: DataFrame, pending: DataFrame) -> DataFrame:
    """Sources after reading sidecars: the imported assets' sidecar sources become the desired pairs; assets with a pending sync stay as they are."""
    now = imported.select("asset_path").distinct().join(pending.select("asset_path"), "asset_path", "left_anti")
    old = sources.where("source_kind = 'sidecar'").join(now, "asset_path", "left_semi")
    rest = sources.join(old, ["asset_path", "tag_id", "source_kind", "source_id"], "left_anti")
    new = desired.join(now, "asset_path", "left_semi").select("asset_path", "tag_id", F.lit("sidecar").alias("source_kind"), F.lit("").alias("source_id")).distinct()
    return rest.unionByName(new)


def xmp_payload(tag_paths: DataFrame, assigned: DataFrame) -> DataFrame:
    """(asset_path, subjects, hierarchical): leaf names and full paths to write into each sidecar, in order."""
    joined = assigned.join(tag_paths.select(F.col("id").alias("tag_id"), "path"), "tag_id")
    leaf = F.element_at(F.split("path", r"\|"), -1)
    return joined.groupBy("asset_path").agg(F.sort_array(F.collect_set(leaf)).alias("subjects"), F.sort_array(F.collect_set("path")).alias("hierarchical"))


def enqueue(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """The sync queue after requests (asset_path, requested_at): a request starts its asset anew, without attempts or error."""
    new = requests.groupBy("asset_path").agg(F.max("requested_at").alias("requested_at")).select("asset_path", "requested_at", F.lit(0).alias("attempt_count"), F.lit(None).cast("string").alias("last_error"))
    return queue.join(new, "asset_path", "left_anti").select("asset_path", "requested_at", "attempt_count", "last_error").unionByName(new)


def record_failures(queue: DataFrame, failures: DataFrame) -> DataFrame:
    """The queue after failures (asset_path, error): one attempt more, and the error."""
    joined = queue.join(failures.select("asset_path", "error"), "asset_path", "left")
    failed = F.col("error").isNotNull()
    return joined.select("asset_path", "requested_at", (F.col("attempt_count") + failed.cast("int")).alias("attempt_count"), F.coalesce("error", "last_error").alias("last_error"))


def sync_status(queue: DataFrame) -> DataFrame:
    """One row: pending, failed, and the newest error (of equal times, the greatest path's)."""
    newest = F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.struct("requested_at", "asset_path")))
    return queue.agg(F.count("*").alias("pending"), F.count("last_error").alias("failed"), newest.alias("newest_error"))


def copy_state(sources: DataFrame, copies: DataFrame) -> DataFrame:
    """Sources after copying assets (source_path, target_path): all but the person kind go along."""
    moved = sources.where("source_kind != 'person'").join(copies, F.col("asset_path") == F.col("source_path")).select(F.col("target_path").alias("asset_path"), "tag_id", "source_kind", "source_id")
    return sources.unionByName(moved).distinct()


def move_state(rows: DataFrame, moves: DataFrame, folder: Column) -> DataFrame:
    """Rows (asset_path, ...) after moving assets (source_path, target_path), with moved_folder: whether the folder changed, so that reviews and features must be redone."""
    joined = rows.join(moves, F.col("asset_path") == F.col("source_path"), "left")
    target = F.col("target_path")
    changed = F.coalesce(target.isNotNull() & (folder != F.regexp_replace(target, r"/[^/]*$", "")), F.lit(False))
    return joined.select(*(F.coalesce(target, F.col("asset_path")).alias(c) if c == "asset_path" else F.col(c) for c in rows.columns), changed.alias("moved_folder"))


def forget(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("asset_path"), "asset_path", "left_anti")


def person_sources(instances: DataFrame, identities: DataFrame, suppressed: DataFrame) -> DataFrame:
    """(asset_path, tag_id, source_kind, source_id): an identity with a tag gives it to assets where an instance of it belongs, is not stale and the pair is not suppressed."""
    confirmed = instances.where("decision = 'belongs' AND NOT stale").select("asset_path", "person_id").distinct()
    tagged = confirmed.join(identities.where("tag_id IS NOT NULL").select("person_id", "tag_id"), "person_id")
    kept = tagged.join(suppressed.select("asset_path", "person_id"), ["asset_path", "person_id"], "left_anti")
    return kept.select("asset_path", "tag_id", F.lit("person").alias("source_kind"), F.col("person_id").cast("string").alias("source_id")).distinct()


def reconcile_people(sources: DataFrame, instances: DataFrame, identities: DataFrame, suppressed: DataFrame, migrated: DataFrame) -> DataFrame:
    """Sources with the person kind rebuilt, and legacy sources of migrated pairs (asset_path, tag_id) retired."""
    others = sources.where("source_kind != 'person'")
    retired = others.where("source_kind = 'legacy'").join(migrated.select("asset_path", "tag_id"), ["asset_path", "tag_id"], "left_semi")
    rest = others.join(retired, ["asset_path", "tag_id", "source_kind", "source_id"], "left_anti")
    return rest.unionByName(person_sources(instances, identities, suppressed))


def embedded_only(keywords: DataFrame, managed: DataFrame) -> DataFrame:
    """(asset_path, keywords): embedded keywords that no managed tag of the asset covers, each once without regard to case, in their order."""
    each = keywords.select("asset_path", F.posexplode("keywords").alias("at", "keyword")).withColumn("key", F.lower("keyword"))
    free = each.join(managed.select("asset_path", F.lower("name").alias("key")), ["asset_path", "key"], "left_anti")
    once = free.groupBy("asset_path", "key").agg(F.min(F.struct("at", "keyword")).alias("first"))
    return once.groupBy("asset_path").agg(F.transform(F.sort_array(F.collect_list("first")), lambda x: x["keyword"]).alias("keywords"))
