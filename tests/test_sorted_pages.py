"""Pages by place against pages of the relation, and what they read."""

import random

import pytest

from quarry.operators import query as Q
from quarry.sources.sorted_pages import SortedPages

SCHEMA = "id long, name string, kind string, size_bytes long, modified_at_ms long, rating int, color_label string, pick_label string"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "B", "b", "é", None]) and f"{rng.choice('aBbé')}{rng.randint(0, 30)}", rng.choice(["raw", "jpeg", None]), rng.randint(0, 9), rng.choice([None, *range(20)]), rng.choice([None, *range(6)]), rng.choice([None, "Red"]), None) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pages = SortedPages(spark, f"file://{tmp_path_factory.mktemp('pages')}/p")
    pages.build(df, "id", files=6, most_rows=100)
    return df, pages


@pytest.mark.parametrize("filters", [{}, {"kind": "raw", "minimum_rating": 3}, {"name_contains": "3", "color_labels": ("red",)}, {"kind": "none"}])
def test_pages_are_those_of_the_relation(made, filters):
    df, pages = made
    for sort, descending, offset, size in (("name", False, 0, 40), ("modified", True, 730, 120), ("size", False, 95, 11), ("kind", True, 2990, 50)):
        query = Q.AssetQuery(sort=sort, descending=descending, offset=offset, page_size=size, **filters)
        want, got = Q.page(df, query, "id"), pages.page(query)
        assert (got.total, got.next_cursor) == (want.total, want.next_cursor)
        assert [r["id"] for r in got.items.collect()] == [r["id"] for r in want.items.collect()]


def test_a_page_reads_its_files(made):
    _, pages = made
    first, late = (pages.files_for(Q.AssetQuery(sort="size", offset=offset, page_size=50)) for offset in (0, 2900))
    assert 1 <= len(first) <= 2 and 1 <= len(late) <= 2 and len(pages.files_for(Q.AssetQuery(offset=5000))) == 0
    read = pages.page(Q.AssetQuery(sort="size", offset=2900, page_size=50)).items.inputFiles()
    assert sorted(f.rsplit("/", 1)[1] for f in read) == sorted(late)
