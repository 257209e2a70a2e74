"""The paginated source: pages from files, filters sent to the server, failing pages."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import tables
from quarry.sources import paged

COLUMNS = "gid string, start string, credits long, code string"


def shaky(options, page, filters):
    """Every third page always fails, every second one the first time."""
    if page % 3 == 0:
        raise OSError(f"status 500 on page {page}")
    state = f"{options['path'].removeprefix('file:')}/.tried-{page}"
    import os

    if page % 2 == 0 and not os.path.exists(state):
        open(state, "w").close()
        raise TimeoutError("slow")
    return paged.landed_page(options, page, filters)


def no_first(options, page, filters):
    raise ConnectionError("no")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "landed")
    items = spark.range(100).selectExpr(
        "id", "concat(IF(id % 2 = 0, 'GS', 'VCS'), id) AS gid", "IF(id % 7 = 0, NULL, concat('20', 15 + id % 10, '-01-01')) AS start", "id % 5 AS credits", "concat('c', id % 9) AS code"
    )
    paged.land(items, "id", 10, path)
    return path


def test_all_pages(spark, folder):
    df = paged.read(spark, COLUMNS, path=folder, pages_a_partition=3)
    assert df.rdd.getNumPartitions() == 4
    got = sorted((r.page, r.place, r.gid) for r in df.collect())
    assert got == sorted((k // 10 + 1, k % 10, f"{'GS' if k % 2 == 0 else 'VCS'}{k}") for k in range(100))


def test_filters_go_to_the_server(spark, folder):
    df = paged.read(spark, COLUMNS, path=folder).where("gid LIKE 'GS%' AND start >= '2020-01-01' AND credits > 0 AND length(code) = 2")
    plan = df._jdf.queryExecution().executedPlan().toString()
    kept = [line for line in plan.split("\n") if "Filter" in line and "Scan" not in line]
    assert "length(code" in kept[0] and not any(x in kept[0] for x in ("gid", "start", "credits")), plan
    want = {k for k in range(100) if k % 2 == 0 and k % 7 and 15 + k % 10 >= 20 and k % 5 > 0}
    assert {int(r.gid[2:]) for r in df.collect()} == want


def test_failing_pages_are_skipped_and_reported(spark, folder):
    df = paged.read(spark, COLUMNS, path=folder, transport="tests.test_paged:shaky", wait=0).persist()
    asked = paged.read(spark, COLUMNS, path=folder, transport="tests.test_paged:shaky", wait=0).where("gid LIKE 'GS%' AND credits > 1")
    assert sorted(r.page for r in paged.fetched(asked)[1].collect()) == [3, 6, 9]
    items, skipped = paged.fetched(df)
    assert sorted((r.page, r.error) for r in skipped.collect()) == [(p, f"OSError: status 500 on page {p}") for p in (3, 6, 9)]
    assert items.count() == 70
    first, _ = paged.fetched(df, 25)
    assert [r.page for r in first.orderBy("page", "place").collect()] == [1] * 10 + [2] * 10 + [4] * 5


def test_a_failing_first_page(spark, folder):
    items, skipped = paged.fetched(paged.read(spark, COLUMNS, path=folder, transport="tests.test_paged:no_first", wait=0))
    assert items.count() == 0 and [r.page for r in skipped.collect()] == [1]


def test_first_seen_code(spark, folder):
    items, _ = paged.fetched(paged.read(spark, COLUMNS, path=folder))
    found = tables.first_seen(items.where(F.col("code") != ""), ["code"], ["page", "place"])
    assert sorted(r.gid for r in found.collect()) == sorted(f"{'GS' if k % 2 == 0 else 'VCS'}{k}" for k in range(9))
