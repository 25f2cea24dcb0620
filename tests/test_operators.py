"""Operators on worked cases, and order-dependent ones against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import geometry as G
from quarry.functions import text as X
from quarry.operators import ledger as L
from quarry.operators import metadata as M
from quarry.operators import projection as P
from quarry.operators import query as Q
from quarry.operators import search as S
from quarry.operators import sequence as B
from quarry.operators import storage as St
from quarry.operators import tags as T
from quarry.operators import vectors as V
from quarry.schemas import RELATIONS, clearable


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "want"), [("40/10", "f/4"), ("28/10", "f/2.80"[:-1]), ("5/0", "f/5/0"), ("x", "f/x")])
def test_aperture(spark, value, want):
    assert one(spark, X.aperture(F.lit(value))) == want


def test_capture_formats(spark):
    assert one(spark, X.focal_length(F.lit("85/1"))) == "85 mm"
    assert one(spark, X.focal_length(F.lit(" 50 mm"))) == "50 mm"
    assert one(spark, X.exposure_compensation(F.lit("-1/3"))) == "-0.33 EV"
    assert one(spark, X.exposure_compensation(F.lit("2/3"))) == "+0.67 EV"
    assert one(spark, X.exposure_compensation(F.lit("0/3"))) == "0 EV"
    assert one(spark, X.exposure_time(F.lit(" 1/250 s"))) == "1/250 s"
    assert one(spark, X.format_number(F.lit(0.5))) == "0.5"


def test_exif_times_are_lenient(spark):
    assert one(spark, X.exif_seconds(F.lit("1970:01:02 00:00:01"))) == 86401
    assert one(spark, X.exif_seconds(F.lit("2000:02:29 12:00:00 and more"))) == 951825600
    assert one(spark, X.exif_seconds(F.lit("2001:13:01 00:00:00"))) is not None
    for bad in ("", "2001:01:01", "    :  :     :  :  ", None):
        assert one(spark, X.exif_seconds(F.lit(bad).cast("string"))) is None


def test_folding(spark):
    assert one(spark, X.ascii_lower(F.lit("ÄBc"))) == "Äbc"
    assert one(spark, X.contains_folded(F.lit("Ärger_%"), "ärger_%"))
    assert not one(spark, X.contains_folded(F.lit("ab"), "a%"))
    assert one(spark, X.like_nocase(F.lit("xABy"), "a%y"))
    assert one(spark, X.like_nocase(F.lit("a\\b"), "\\"))
    assert not one(spark, X.within_path(F.lit("/a/bc"), "/a/b"))
    assert one(spark, X.within_path(F.lit("/a/b/c"), "/a/b/"))
    assert one(spark, X.unescape_xml(F.lit("&amp;lt;"))) == "&lt;"
    assert one(spark, X.unescape_xml(X.escape_xml(F.lit("<a b=\"c\" d='&lt;'>")))) == "<a b=\"c\" d='&lt;'>"


def test_boxes(spark):
    box = lambda *b: F.array(*map(F.lit, b))
    assert one(spark, G.box_is_valid(box(0.7, 0.1, 0.3 + 1e-16, 0.9)))
    assert not one(spark, G.box_is_valid(box(0.7, 0.1, 0.3 + 1e-12, 0.9)))
    assert not one(spark, G.box_is_valid(box(0.1, 0.1, float("nan"), 0.1)))
    assert not one(spark, G.box_is_valid(box(0.1, 0.1, 0.0, 0.1)))
    assert one(spark, G.iou(box(0.0, 0.0, 1.0, 1.0), box(0.0, 0.0, 0.5, 1.0))) == 0.5
    assert one(spark, G.iou(box(0.0, 0.0, 0.0, 0.0), box(0.0, 0.0, 0.0, 0.0))) == 0.0
    assert one(spark, G.cosine(box(0.0, 0.0), box(1.0, 0.0))) is None


def naive_bursts(frames):
    groups, run = [], []

    def flush():
        if len(run) > 1:
            groups.append([f[0] for f in run])
        run.clear()

    for f in frames:
        _, sequence, apart, seconds = f
        if apart or sequence is None:
            flush()
        elif not run:
            run.append(f)
        elif run[-1][1] != sequence:
            gap = seconds is None or run[-1][3] is None or abs(seconds - run[-1][3]) <= 10
            if not (sequence == run[-1][1] + 1 and gap):
                flush()
            run.append(f)
    flush()
    return groups


def test_bursts(spark):
    rng = random.Random(1)
    rows, want = [], []
    for folder in range(300):
        sequence, seconds, frames = 0, 0, []
        for at in range(rng.randint(1, 14)):
            sequence += rng.choice([0, 1, 1, 1, 2])
            seconds += rng.choice([0, 1, 10, 11])
            frames.append((at, None if rng.random() < 0.05 else sequence, rng.random() < 0.08, None if rng.random() < 0.1 else seconds))
        rows += [(folder, *f) for f in frames]
        want += [(folder, tuple(g)) for g in naive_bursts(frames)]
    df = spark.createDataFrame(rows, "folder int, at int, seq int, apart boolean, seconds long").repartition(4)
    found = B.bursts(df, ["folder"], ["at"], "seq", F.col("apart"), F.col("seconds")).groupBy("folder", "run").agg(F.sort_array(F.collect_list("at")).alias("m")).collect()
    assert sorted((r["folder"], tuple(r["m"])) for r in found) == sorted(want) and want
    listing = spark.createDataFrame([("f", 0, "a", 1, None, "2020:01:01 00:00:00"), ("f", 1, "b", 2, None, "2020:01:01 00:00:01"), ("f", 2, "c", 4, None, "2020:01:01 00:00:01")], "folder string, position int, path string, sequence_number int, release_mode string, captured_at string")
    groups = B.group_bursts(listing)
    assert [(r["representative"], r["members"]) for r in groups.collect()] == [("a", ["a", "b"])]
    shown = B.collapsed(listing.select("path"), groups, groups.limit(0).select("representative"))
    assert sorted(r["path"] for r in shown.collect()) == ["a", "c"]


def test_threshold_search(spark):
    rows = [(1, "/a", "1", "r", [1.0, 0.0, 0.0]), (2, "/b", "1", "r", [0.8, 0.6, 0.0]), (3, "/c", "1", "r", [0.0, 1.0, 0.0]), (4, "/d", "1", "r", [0.0, 0.0, 0.0]), (5, "/e", "1", "r", [float("nan"), 1.0, 0.0])]
    features = spark.createDataFrame(rows, "feature_row_id long, asset_path string, instance_id string, source_revision string, vector array<float>")
    found = V.search(features, [1.0, 0.0, 0.0], 0.7)
    assert [r["feature_row_id"] for r in V.search_page(found, 0, 10).collect()] == [1, 2]
    current = spark.createDataFrame([("/a", "new"), ("/b", "r")], "asset_path string, source_revision string")
    fresh = V.search(features, [1.0, 0.0, 0.0], 0.7, current)
    assert [r["feature_row_id"] for r in V.search_page(fresh, 0, 1).collect()] == [2]
    assert V.search_page(fresh, 1, 1).collect() == []


def test_gallery_scores(spark, monkeypatch):
    monkeypatch.setattr(V, "SIDE", 64, raising=False)  # many tiles
    rng = np.random.default_rng(7)
    nan, inf = float("nan"), float("inf")
    vector = lambda: [float(np.float32(x)) for x in rng.normal(size=5) / 2]
    odd = [None, [], [nan] * 5, [inf, 0.0, 1.0, 0.0, 0.0], [1.0, None, 0.0, 0.0, 0.0], [1e200, 1e200, 1.0, 0.0, 0.0], [-0.0, 0.0, 0.0, 0.0, 0.0], [1.0, 0.5], [0.2, 0.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0]]
    twin = vector()
    faces = [(k, v) for k, v in enumerate(odd + [twin] * 30 + [vector() for _ in range(90)])] + [(3, vector()), (None, vector())]
    references = [(k % 4 if k % 5 else None, v) for k, v in enumerate(odd + [twin] * 40 + [vector() for _ in range(50)])]
    for threshold in (0.2, -9.0):
        want: dict = {}
        for f, a in faces:
            for p, b in references:
                if a is None or b is None or len(a) != len(b) or None in a or None in b:
                    continue
                score = 0.0
                for x, y in zip(a, b, strict=True):  # sum() would compensate
                    score += x * y
                if score >= threshold:
                    want[f, p] = max(want.get((f, p), score), score)
        tables = [spark.createDataFrame(rows, f"{name} int, vector array<double>") for rows, name in ((faces, "face_id"), (references, "person_id"))]
        got = V.gallery_scores(*tables, threshold)
        assert {(r["face_id"], r["person_id"]): r["score"] for r in got.collect()} == want and want
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # no row a pair
        for none in (tables[0].where("false"), tables[1]), (tables[0], tables[1].where("false")):
            assert V.gallery_scores(*none, threshold).count() == 0


def test_open_ranking(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.8, 0.6]), (4, [-1.0, 0.0]), (5, None), (6, [0.75, 0.7])]
    faces = spark.createDataFrame(rows, "face_id int, vector array<float>")
    references = spark.createDataFrame([(7, [1.0, 0.0]), (7, [0.9, 0.1]), (8, [0.0, 1.0]), (9, None)], "person_id int, vector array<float>")
    ranked = V.rank_open(faces, V.gallery_scores(faces, references, 0.2))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(face_id") == 2, plan  # the scores and the faces, once each
    assert plan.count("Join") == 1  # no row a pair
    assert {r["face_id"]: (r["person_id"], r["score"] and round(r["score"], 5)) for r in ranked.collect()} == {1: (7, 1.0), 2: (8, 0.8), 3: (7, 0.8), 4: (None, None), 5: (None, None), 6: (7, 0.75)}


def naive_links(vectors, pictures, threshold):
    n = len(vectors)
    like = lambda i, j: -1.0 if pictures[i] == pictures[j] or vectors[i] is None or vectors[j] is None else float(vectors[i] @ vectors[j])
    edges = sorted([(i, j) for i in range(n) for j in range(i) if like(i, j) >= threshold], key=lambda e: (-like(*e), e))
    groups = [{k} for k in range(n)]
    for i, j in edges:
        a, b = (next(g for g in groups if k in g) for k in (i, j))
        if a is not b and all(like(x, y) >= threshold for x in a for y in b):
            a |= b
            groups.remove(b)
    return {frozenset(g) for g in groups}


def test_complete_link(spark):
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for folder in range(8):
        centres = rng.normal(size=(4, 6))
        faces = []
        for k in range(25):
            v = centres[k % 4] + rng.normal(size=6) * 0.7
            v = (v / np.linalg.norm(v)).round(6)
            faces.append((f"f{folder}", f"p{rng.integers(0, 9)}", f"i{k:02}", float(rng.integers(0, 5)), None if k % 9 == 8 else v.tolist()))
        faces.sort(key=lambda f: (-f[3], f[1], f[2]))
        groups = naive_links([None if f[4] is None else np.array(f[4]) for f in faces], [f[1] for f in faces], 0.5)
        want |= {(f"f{folder}", frozenset(faces[k][2] for k in g)) for g in groups if len(g) > 1}
        rows += faces
    df = spark.createDataFrame(rows, "folder_path string, asset_path string, instance_id string, quality double, vector array<double>").repartition(3)
    got: dict = {}
    for r in V.complete_link(df).where("cluster_id IS NOT NULL").collect():
        got.setdefault((r["folder_path"], r["cluster_id"]), set()).add(r["instance_id"])
    assert {(k[0], frozenset(v)) for k, v in got.items()} == want and want
    sizes = [r["size"] for r in V.cluster_sizes(V.complete_link(df)).collect()]
    assert sizes == sorted(sizes, reverse=True)


class Ordered(np.ndarray):
    """A vector whose products are summed front to end."""

    def __new__(cls, values):
        return np.asarray(values).view(cls)

    def __matmul__(self, other):
        return np.cumsum(np.asarray(self) * np.asarray(other))[-1]


def test_links_with_ties():
    rng = np.random.default_rng(5)
    for k in range(60):
        n, dimensions = int(rng.integers(1, 50)), int(rng.integers(1, 6))
        v = rng.normal(size=(n, dimensions))
        if k % 4 == 1:
            v = np.round(v)  # many equal similarities, and such at the threshold
        elif k % 4 == 2:
            v = v[rng.integers(0, n // 6 + 1, n)]  # copies
        if k % 10 == 9:
            v[rng.integers(0, n)] *= 1e200
        vectors = [None if rng.random() < 0.07 else x for x in v]
        pictures, threshold = [f"p{p}" for p in rng.integers(0, rng.integers(1, 12), n)], float(rng.choice([0.12, 0.5, 1.0, -0.3]))
        groups: dict = {}
        for face, owner in enumerate(V.link(vectors, pictures, threshold)):
            groups.setdefault(owner, set()).add(face)
        assert set(map(frozenset, groups.values())) == naive_links([None if x is None else Ordered(x) for x in vectors], pictures, threshold), k
    assert V.link([None, None], ["a", "b"], 0.5) == [0, 1]


def test_large_clusters_cost_what_is_added(monkeypatch):
    rng = np.random.default_rng(8)
    v = np.eye(8)[rng.integers(0, 3, 300)] + rng.normal(size=(300, 8)) * 0.05
    v = list(v / np.linalg.norm(v, axis=1, keepdims=True))
    products, made = V._Faces.products, []
    monkeypatch.setattr(V._Faces, "products", lambda self, c, r, table=None: made.append(len(c) * len(r)) or products(self, c, r, table))
    owners = V.link(v, list(map(str, range(300))), 0.5)
    assert len(set(owners)) == 3 and sum(made) < 8 * 300 * 300  # 34 times that square, were whole clusters compared after each merge


def test_a_folder_of_many_faces(spark):
    rng = np.random.default_rng(6)
    n = 5200
    v = rng.normal(size=(n, 4))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).round(6)
    pictures = [f"p{p:03}" for p in rng.integers(0, 400, n)]
    rows = [("f", pictures[k], str(k), float(k % 17), v[k].tolist()) for k in range(n)]
    df = spark.createDataFrame(rows, "folder_path string, asset_path string, instance_id string, quality double, vector array<double>")
    groups: dict = {}
    for k, r in enumerate(V.complete_link(df, threshold=0.9).collect()):
        groups.setdefault(r["cluster_id"] or k, []).append(int(r["instance_id"]))
    assert sorted(k for g in groups.values() for k in g) == list(range(n))
    like = v @ v.T
    like[np.array(pictures)[:, None] == np.array(pictures)] = -1.0
    np.fill_diagonal(like, 1.0)
    of = list(groups.values())
    least = np.array([np.minimum.reduceat(like[g].min(axis=0)[np.concatenate(of)], np.cumsum([0, *map(len, of[:-1])])) for g in of])
    assert (np.diag(least) >= 0.9 - 1e-9).all() and len(of) < n / 5  # all pairs of a cluster reach it
    np.fill_diagonal(least, -1.0)
    assert (least < 0.9 + 1e-9).all()  # and no two clusters could merge
    with pytest.raises(Exception, match="a folder has 5200 faces; 5000 is the most"):
        V.complete_link(df, most=5000).count()


def test_alignment_reasons(spark):
    schema = "id string, source_identity_revision string, face_box array<double>, body_box array<double>, needs_review boolean"
    far, near = [0.1, 0.1, 0.2, 0.2], [0.5, 0.5, 0.2, 0.2]
    shifted = [0.52, 0.5, 0.2, 0.2]
    manual = spark.createDataFrame([("m1", "r", far, None, False), ("m2", "r", near, None, False), ("m3", "old", far, None, False), ("m4", None, far, None, False), ("m5", "old", far, None, True), ("m6", "r", [0.8, 0.8, 0.1, 0.1], None, False), ("m7", "r", None, [0.0, 0.0, 1.0, 1.0], False)], schema)
    detected = spark.createDataFrame([("d1", "r", far, None, False), ("d2", "r", near, None, False), ("d3", "r", shifted, None, False), ("d4", "r", None, [0.0, 0.0, 1.0, 0.9], False)], schema)
    score = G.pair_score(F.col("m.face_box"), F.col("m.body_box"), F.col("d.face_box"), F.col("d.body_box"))
    got = {r["manual_id"]: (r["detected_id"], r["reason"]) for r in V.align(manual, detected, "r", score, margin=0.2).collect()}
    assert got == {"m1": ("d1", None), "m2": (None, "ambiguous_geometry"), "m3": (None, "source_changed"), "m4": (None, "source_unverified"), "m5": (None, "needs_review"), "m6": (None, "no_matching_detection"), "m7": ("d4", None)}


def test_suppression(spark):
    boxes = spark.createDataFrame([("p", 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("p", 2, 1.0, 1.0, 11.0, 11.0, 0.8), ("p", 3, 30.0, 30.0, 40.0, 40.0, 0.7), ("q", 4, 1.0, 1.0, 11.0, 11.0, 0.1)], "picture string, id long, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r["id"] for r in V.suppress(boxes, "picture", 0.4).collect()) == [1, 3, 4]


def test_prune(spark):
    rng = random.Random(2)
    for _ in range(6):
        rows = [(k, rng.randint(0, 9), rng.randint(1, 50), rng.random() < 0.2, rng.random() < 0.1) for k in range(40)]
        total, gone = sum(r[2] for r in rows), set()
        for k, _, size, pinned, stale in sorted(rows, key=lambda r: (r[1], r[0])):
            if not pinned and (total > 400 or stale):
                gone.add(k)
                total -= size
        df = spark.createDataFrame(rows, "path long, modified int, size_bytes long, pinned boolean, stale boolean").repartition(3)
        assert {r["path"] for r in St.pruned(df, 400).where("evicted").collect()} == gone


def test_page_cursor(spark):
    rows = spark.createDataFrame([(k, f"N{k % 3}", "raw", k, k) for k in range(10)], "id long, name string, kind string, size_bytes long, modified_at_ms long")
    first = Q.page(rows, Q.AssetQuery(page_size=4), "id")
    assert (first.total, first.next_cursor, first.items.count()) == (10, 4, 4)
    last = Q.page(rows, Q.AssetQuery(page_size=4, offset=8), "id")
    assert (last.next_cursor, last.items.count()) == (None, 2)
    assert Q.AssetQuery(minimum_rating=0).needs_metadata and not Q.AssetQuery(kind="raw").needs_metadata
    names = ["b10", "B9", "é1", "a10", "a2", "a1234567890123456789", "a1234567890123456780", "a" + "0" * 40 + "11", "a9" * 20, "x" + "9" * 30, "x1" + "0" * 30]
    keyed = spark.createDataFrame([(n,) for n in names], "n string").orderBy(Q.folder_order_key(F.col("n")))
    assert [r["n"] for r in keyed.collect()] == ["a2", "a9" * 20, "a10", "a" + "0" * 40 + "11", "a1234567890123456780", "a1234567890123456789", "B9", "b10", "é1", "x" + "9" * 30, "x1" + "0" * 30]


def test_candidates_hold_every_match(spark):
    rng = random.Random(3)
    letters = "aàÁbßéÉnñÑσΣς IİıK0٣-_.́̀ǅǆÅ京ſ"
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))) for k in range(1500)] + [(9000, None), (9001, "ΟΔΟΣ οδος"), (9002, "Ción\u0301 x")]
    df = spark.createDataFrame(rows, "id long, name string")
    indexed = S.index(df, "id", "name").cache()
    for query in ("a", "É", "ñ-a", "σ", "οδος", "cion", "k", "i", "ß", "0 a", "åa", "ǆ", "s", "京", "n.e b"):
        assert sorted(r["id"] for r in S.match_texts(df, query, "id", "name").collect()) == sorted(r["id"] for r in S.match_all(indexed, query, "id").collect())


def test_phrases_and_marks(spark):
    rows = spark.createDataFrame([(1, "Café-Noir 12", "/x"), (2, "noir cafe", "/café"), (3, "cafe nothing", "/y")], "id long, name string, directory string")
    indexed = S.index(rows, "id", "name", "directory")
    match = lambda q: sorted(r["id"] for r in S.match_all(indexed, q, "id").collect())
    assert match("CAFE") == [1, 2, 3]
    assert match("cafe-noi") == [1] and match("cafe-no") == [1, 3]
    assert match("noir cafe") == [1, 2]
    assert match("cafe no") == [1, 2, 3]
    assert match("  ") == []


def test_tag_cycles_are_errors(spark):
    with pytest.raises(ValueError, match="cycle"):
        T.closure(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent_id long"), most_rounds=3)
    deep = spark.createDataFrame([(k, k - 1 if k else None) for k in range(20)], "id long, parent_id long")
    assert T.closure(deep).count() == 210
    assert T.subtree_contains(T.closure(deep), 3, 19) and not T.subtree_contains(T.closure(deep), 19, 3)


def test_late_observations_lose(spark):
    obs = spark.createDataFrame([("a", "m", 5, 1, 0, "x"), ("a", "m", 4, 2, 0, "late"), ("a", "m", 5, 3, 0, "tie"), ("b", "m", 1, 1, 5, "x"), ("b", "m", 3, 2, 2, "lower"), ("b", "m", 2, 3, 0, "free")], "path string, projection_kind string, valid_at long, arrival long, state_revision long, status string")
    assert {r["path"]: r["status"] for r in P.latest(obs).collect()}["a"] == "tie"
    assert {r["path"]: r["status"] for r in P.fold_images(obs).collect()} == {"a": "tie", "b": "free"}


def test_stage_graph():
    stages = {"c": ("a", "b"), "b": ("a",), "a": (), "z": ()}
    assert L.stage_order(stages) == ["a", "b", "c", "z"]
    old = L.fingerprints(stages, dict.fromkeys(stages, "1"))
    new = L.fingerprints(stages, {**dict.fromkeys(stages, "1"), "b": "2"})
    assert L.to_recompute(stages, old, new) == ["b", "c"]
    with pytest.raises(ValueError, match="each other"):
        L.stage_order({"a": ("b",), "b": ("a",)})
    with pytest.raises(ValueError, match="unknown"):
        L.stage_order({"a": ("b",)})


def test_xmp_precedence(spark):
    rows = [("p", 0, "EXIF", "Make", "Canon"), ("p", 1, "XMP", "Make", "  "), ("p", 2, "EXIF", "FNumber", "28/10"), ("p", 3, "XMP", "FNumber", "4/1"), ("p", 4, "XMP", "Temperature", "x"), ("q", 0, "EXIF", "Make", "Sony"), ("q", 1, "XMP", "Tint", "-5"), ("q", 2, "XMP", "Rating", "-1"), ("q", 3, "XMP", "Subject", "a, ,b")]
    tags = spark.createDataFrame(rows, "path string, ord int, group string, name string, value string")
    got = {r["path"]: r for r in M.capture(tags).collect()}
    assert (got["p"]["camera_make"], got["p"]["aperture"], got["p"]["color_temperature"], got["p"]["vendor"]) == ("Canon", "f/4", None, "canon")
    assert got["q"]["tint"] == "-5"
    edits = {r["path"]: r for r in M.editable(tags).collect()}
    assert (edits["q"]["pick_label"], edits["q"]["rating"], edits["q"]["keywords"]) == ("rejected", None, ["a", "b"])


def test_patch_is_three_valued(spark):
    xml = '<rdf:Description xmp:Label="Red" x:y="1"/>'
    patch = lambda present, value: one(spark, M.patched(F.lit(xml), "xmp:Label", F.lit(present), F.lit(value).cast("string")))
    assert patch(False, "Blue") == xml
    assert patch(True, None) == '<rdf:Description x:y="1"/>'
    assert X.re.search('xmp:Label="B&amp;\\$"', patch(True, "B&$"))


def test_cache_clear_keeps_what_users_made():
    assert "custom_tag" not in clearable() and "projection" in clearable()
    assert all(set(r.key) <= set(r.schema.names) for r in RELATIONS.values())
