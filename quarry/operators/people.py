"""Person filters, evidence, references and workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import summary_revision

STATES = ("all", "pending", "belongs", "doesNotBelong", "deferred", "needsReview", "unassigned")


def person_filter(assets: DataFrame, instances: DataFrame, reviews: DataFrame, state: str, person: str | None) -> DataFrame:
    """Assets (path, size_bytes, modified_at_ms, ...) with an instance in the state for the person.

    instances: asset_path, instance_id, source_revision, needs_review. reviews: instance_id, person_id, decision. An instance is stale where its
    revision is not the asset's or it needs review; stale ones count for needsReview alone. Without a person no decision is known.
    """
    own = reviews.where(F.col("person_id") == person) if person is not None else reviews.limit(0)
    known = instances.join(own.select("instance_id", "decision"), "instance_id", "left").alias("i")
    revision = summary_revision(F.col("a.size_bytes"), F.col("a.modified_at_ms"))
    stale = ~F.col("i.source_revision").eqNullSafe(revision) | F.coalesce("i.needs_review", F.lit(False))
    decided = ~stale & F.col("i.decision").isNotNull()
    tests: dict[str, Column] = {
        "needsReview": stale,
        "all": decided & (F.col("i.decision") != "doesNotBelong"),
        "unassigned": decided,
    }
    test = tests.get(state, decided & (F.col("i.decision") == state))
    how = "left_anti" if state == "unassigned" else "left_semi"
    return assets.alias("a").join(known, (F.col("a.path") == F.col("i.asset_path")) & test, how)


def cluster_filter(assets: DataFrame, members: DataFrame, cluster: str) -> DataFrame:
    """Assets with a member of the cluster at the asset's own revision; 'ungrouped' stands for faces in none."""
    wanted = members.where(F.col("cluster_id").isNull() if cluster == "ungrouped" else F.col("cluster_id") == cluster)
    keyed = assets.withColumn("_revision", summary_revision(F.col("size_bytes"), F.col("modified_at_ms")))
    return keyed.join(wanted.select(F.col("asset_path").alias("path"), F.col("source_revision").alias("_revision")), ["path", "_revision"], "left_semi").drop("_revision")


def tuple_filter(assets: DataFrame, tuples: DataFrame, group: str, decision: str | None = None) -> DataFrame:
    """Assets with an instance in the tuple group, at the asset's own revision, with the decision where one is given."""
    wanted = tuples.where(F.col("group_id") == group)
    if decision is not None:
        wanted = wanted.where(F.col("decision") == decision)
    keyed = assets.withColumn("_revision", summary_revision(F.col("size_bytes"), F.col("modified_at_ms")))
    return keyed.join(wanted.select(F.col("asset_path").alias("path"), F.col("source_revision").alias("_revision")), ["path", "_revision"], "left_semi").drop("_revision")


def evidence(detections: DataFrame, features: DataFrame, spaces: DataFrame, space: str) -> DataFrame:
    """Every detection with its vector in the space, where the space is known and the revisions agree."""
    usable = features.where(F.col("feature_space_id") == space).join(spaces.select("feature_space_id"), "feature_space_id", "left_semi")
    return detections.join(usable.select("asset_path", "instance_id", "source_revision", "vector"), ["asset_path", "instance_id", "source_revision"], "left")


def coverage(assets: DataFrame, completed: DataFrame, found: DataFrame) -> DataFrame:
    """One row: assets analysed without a face, assets not analysed, and detections without a vector."""
    done = assets.join(completed.select("path"), "path", "left_semi")
    bare = done.join(found.select(F.col("asset_path").alias("path")), "path", "left_anti").agg(F.count("*").alias("without_face"))
    open_ = assets.join(completed.select("path"), "path", "left_anti").agg(F.count("*").alias("not_analysed"))
    return bare.join(open_).join(found.agg(F.count_if(F.col("vector").isNull()).alias("without_vector")))


def references(reviews: DataFrame, manual: DataFrame, detections: DataFrame, features: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(person_id, instance_id, vector): confirmed, current manual instances that fit exactly one detection, with its vector."""
    confirmed = reviews.where("decision = 'belongs'").join(manual.where("NOT needs_review"), "instance_id")
    same = F.forall(F.zip_with("m.face_box", "d.face_box", lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
    on = (F.col("m.asset_path") == F.col("d.asset_path")) & (F.col("m.source_revision") == F.col("d.source_revision")) & same
    fits = confirmed.alias("m").join(detections.alias("d"), on).select("m.person_id", "m.instance_id", "m.asset_path", "m.source_revision", F.col("d.instance_id").alias("detected"))
    single = fits.groupBy("person_id", "instance_id", "asset_path", "source_revision").agg(F.count("*").alias("n"), F.min("detected").alias("detected")).where("n = 1")
    vectors = features.select("asset_path", F.col("instance_id").alias("detected"), "source_revision", "vector")
    return single.join(vectors, ["asset_path", "detected", "source_revision"]).select("person_id", "instance_id", "vector")


def first_detections(detections: DataFrame, key: tuple[str, ...] = ("asset_path", "instance_id")) -> DataFrame:
    """Detections with a box left, the first of each id."""
    w = Window.partitionBy(*key).orderBy("ord")
    return detections.where("box IS NOT NULL").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def workspace(suggestions: DataFrame, manual: DataFrame, reviews: DataFrame) -> DataFrame:
    """(group_id, known, instance_id, asset_path, decision, size): a folder's groups, known people first, the larger first.

    suggestions: instance_id, asset_path, group_id, person_id (null: unknown). manual: instance_id, asset_path. reviews: instance_id, person_id, decision.
    A review puts the instance into its person's group; one that excludes it also returns it to the unknown. An instance is in a group once.
    """
    unknown = F.concat(F.lit("unknown:"), F.col("instance_id"))
    base = suggestions.select("instance_id", "asset_path", "group_id", "person_id").unionByName(manual.select("instance_id", "asset_path", unknown.alias("group_id"), F.lit(None).cast("string").alias("person_id")))
    places = base.select("instance_id", "asset_path").distinct()
    reviewed = reviews.join(places, "instance_id").select("instance_id", "asset_path", F.concat(F.lit("person:"), F.col("person_id")).alias("group_id"), "person_id", "decision", F.lit(0).alias("turn"))
    back = reviews.where("decision = 'doesNotBelong'").join(places, "instance_id").select("instance_id", "asset_path", unknown.alias("group_id"), F.lit(None).cast("string").alias("person_id"), F.lit(None).cast("string").alias("decision"), F.lit(1).alias("turn"))
    settled = reviews.where("decision != 'doesNotBelong'").select("instance_id").distinct()
    open_ = base.join(settled, "instance_id", "left_anti").select("instance_id", "asset_path", "group_id", "person_id", F.lit(None).cast("string").alias("decision"), F.lit(2).alias("turn"))
    every = reviewed.unionByName(back).unionByName(open_)
    once = every.groupBy("group_id", "instance_id").agg(F.min_by(F.struct("asset_path", "person_id", "decision"), F.struct("turn", "decision")).alias("m"))
    sizes = once.groupBy("group_id").agg(F.count("*").alias("size"))
    return once.join(sizes, "group_id").select("group_id", F.col("m.person_id").isNotNull().alias("known"), "instance_id", "m.asset_path", "m.decision", "size").orderBy(F.col("known").desc(), F.col("size").desc(), "group_id", "instance_id")


def folders(confirmed: DataFrame) -> DataFrame:
    """(folder, cover, people, instances): for each folder the first path, and how many people and instances are confirmed."""
    return confirmed.groupBy("folder_path").agg(F.min("asset_path").alias("cover"), F.countDistinct("person_id").alias("people"), F.count("*").alias("instances"))


def gallery_page(rows: DataFrame, offset: int, limit: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(min(max(limit, 1), 60))


def require_review(reviews: DataFrame, changed: DataFrame) -> DataFrame:
    """Reviews after their instances changed: exclusions stay, others are pending again; both get the next revision."""
    joined = reviews.join(changed.select("instance_id").distinct().withColumn("_hit", F.lit(True)), "instance_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.withColumns({"decision": F.when(hit & (F.col("decision") != "doesNotBelong"), "pending").otherwise(F.col("decision")), "revision": F.col("revision") + hit.cast("long")}).drop("_hit")


def adopt_cluster(members: DataFrame, aligned: DataFrame, reviews: DataFrame, person: str) -> tuple[DataFrame, DataFrame]:
    """Reviews to add for a cluster's members, and one row of counts: added, preserved, conflicted.

    members: instance_id. aligned: (detected_id, manual_id) of members that stand for a manual instance; a member without one is its own.
    """
    targets = members.join(aligned, F.col("instance_id") == F.col("detected_id"), "left").select(F.coalesce("manual_id", "instance_id").alias("instance_id")).distinct()
    own = reviews.where(F.col("person_id") == person).select("instance_id", "decision")
    joined = targets.join(own, "instance_id", "left")
    added = joined.where("decision IS NULL").select("instance_id", F.lit(person).alias("person_id"), F.lit("pending").alias("decision"), F.lit(1).cast("long").alias("revision"))
    tally = joined.agg(F.count_if(F.col("decision").isNull()).alias("added"), F.count_if(F.col("decision") != "doesNotBelong").alias("preserved"), F.count_if(F.col("decision") == "doesNotBelong").alias("conflicted"))
    return added, tally


def migrate(reviews: DataFrame, links: DataFrame) -> DataFrame:
    """Reviews (instance_id, person_id, decision) of linked local people as reviews of the global ones: agreement stays, an exclusion prevails, other conflicts are deferred."""
    moved = reviews.join(links, "person_id").groupBy("instance_id", "global_id").agg(F.collect_set("decision").alias("all"))
    one = F.when(F.size("all") == 1, F.col("all")[0]).when(F.array_contains("all", "doesNotBelong"), "doesNotBelong").otherwise("deferred")
    return moved.select("instance_id", F.col("global_id").alias("person_id"), one.alias("decision"))
