"""The stored index against a search of the rows as they are, after any scans."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import search as S
from quarry.sources.text_index import TextIndex

SCHEMA = "path string, name string, directory string, size long"
WORDS = ["Café", "cafe", "Strand", "straße", "été", "IMG", "img-0042", "0042", "x.y", "北京", "ΟΔΟΣ", "", "a", "ab", "abc"]


def row(rng, path):
    return (path, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4))) if rng.random() < 0.95 else None, "/root/" + rng.choice(WORDS), rng.randint(1, 3))


def size_of(folder: Path) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_scans_give_what_a_rebuild_gives(spark, tmp_path):
    rng = random.Random(1)
    found = TextIndex(spark, f"file://{tmp_path}/index", "path", ("name", "directory"), files=4, most_segments=2)
    with pytest.raises(LookupError):
        found.search("a")
    state = {root: {} for root in ("/r", "/s")}
    queries = ["cafe", "CAF ete", "img-00", "0042 x", "x-y", "ab", "stra", "北", "οδος", "root", "zz", "  ", "-"]
    for step in range(5):
        root = "/r" if step % 3 else "/s"
        own = state[root]
        for k in range(40 if step < 2 else 6):
            path = f"{root}/{rng.randint(0, 60)}"
            own[path] = row(rng, path)
        for path in rng.sample(sorted(own), min(4, len(own))):
            del own[path]
        if step == 4:
            own.clear()
        number = found.apply(root, spark.createDataFrame(list(own.values()), SCHEMA).repartition(3), scan_id=10 + step)
        assert found.state()[0] == number and len(found.state()[1]["segments"]) <= 2
        now = spark.createDataFrame([(r, *v) for r, rows in state.items() for v in rows.values()], f"root_path string, {SCHEMA}")
        assert sorted(map(tuple, found.rows().select(*now.columns).collect()), key=str) == sorted(map(tuple, now.collect()), key=str)
        scans = {r["root_path"]: r["scan_id"] for r in found.rows().select("root_path", "scan_id").distinct().collect()}
        assert root not in scans or scans[root] == 10 + step
        for query in queries if step == 3 else queries[:2]:
            want = sorted(map(tuple, S.match_all(S.index(now, ("root_path", "path"), "name", "directory"), query, "root_path", "path").collect()))
            assert sorted(map(tuple, found.search(query).collect())) == want
            assert sorted(map(tuple, found.search(query, "/r").collect())) == [w for w in want if w[0] == "/r"]
    held = {s["name"] for _, content in found.log.newest(2) for s in json.loads(content)["segments"]}
    assert {p.name for p in (tmp_path / "index" / "segments").iterdir()} == held


def test_writes_follow_the_changes(spark, tmp_path):
    folder = tmp_path / "index"
    found = TextIndex(spark, f"file://{folder}", "path", ("name",), files=8)
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" Common")).alias("name"))
    found.apply("/r", rows)
    full = size_of(folder)
    found.apply("/r", rows)
    assert size_of(folder) == full and found.rows().agg(F.max("scan_id")).first()[0] == 2  # nothing but the scan's number
    found.apply("/r", rows.where("path <> '7'").withColumn("name", F.when(F.col("path") == "9", "another").otherwise(F.col("name"))))
    assert size_of(folder) < full * 1.05
    assert [r["path"] for r in found.search("anoth").collect()] == ["9"]
    assert found.search("word7").where("path = '7'").isEmpty() and found.search("word9").where("path = '9'").isEmpty()
    assert found.search("common").count() == 19_998
    every = list(folder.rglob("postings/*.parquet"))
    assert len(every) == 9
    assert len(found.files_for("word1234")) == 1 and len(found.files_for("comm")) < 6 and len(found.files_for("zzz")) == 0
    assert set(found.search("word1234").inputFiles()) & set(found.files_for("zzz")) == set()
    read = {f for f in found.search("word1234").inputFiles() if "/postings/" in f}
    assert {Path(f).name for f in read} == {Path(f).name for f in found.files_for("word1234")}
    assert found.fold() == 4 and found.search("common").count() == 19_998


def test_refusals(spark, tmp_path):
    found = TextIndex(spark, f"file://{tmp_path}/index", "path", ("name",))
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, name string")
    found.apply("/r", rows)
    with pytest.raises(ValueError, match="current"):
        found.apply("/r", rows, expected=5)
    with pytest.raises(ValueError, match="more than one row"):
        found.apply("/r", rows.union(rows.limit(1).selectExpr("path", "'z'")))
    with pytest.raises(ValueError, match="reserved"):
        found.apply("/r", rows.withColumn("word", F.lit(1)))
    with pytest.raises(ValueError, match="other columns"):
        found.apply("/r", rows.withColumn("more", F.lit(1)))
    late = TextIndex(spark, f"file://{tmp_path}/index", "path", ("name",))
    late.state = lambda: (0, {"segments": [], "scans": {}})  # another writer's view of before
    with pytest.raises(ValueError, match="another writer"):
        late.apply("/r", rows)
    assert found.search("x").count() == 1 and len(list((tmp_path / "index" / "segments").iterdir())) == 1


def test_unread_directories_keep_their_rows(spark, tmp_path):
    found = TextIndex(spark, f"file://{tmp_path}/index", "path", ("name",))
    rows = [(f"/r/{p}", f"pic {p}") for p in ("a/1", "a/2", "ab/3", "c/d/4", "c/5")]
    found.apply("/r", spark.createDataFrame(rows, "path string, name string"))
    unread = spark.createDataFrame([("/r/a",), ("/r/c/d",)], "path string")
    found.apply("/r", spark.createDataFrame([("/r/a/2", "new name")], "path string, name string"), unread=unread)
    assert sorted(r["path"] for r in found.rows().collect()) == ["/r/a/1", "/r/a/2", "/r/c/d/4"]
    assert sorted(r["path"] for r in found.search("pic").collect()) == ["/r/a/1", "/r/c/d/4"] and found.search("new").count() == 1
