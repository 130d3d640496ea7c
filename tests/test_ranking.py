"""Pages of a stored ranking against one sort."""

import random

import pytest

from parley.operators import ranking

ORDER = [("level", True), ("score", False), ("name", False), ("id", True)]


def rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, 0, 1, 2]), rng.choice([None, 1.5, 2.5, -1.0]), rng.choice([None, "a", "b", "ß"]), i) for i in range(n)]


def place(r):
    first = (r[0] is not None, r[0] or 0)
    down = lambda v, neg: (v is None, neg(v) if v is not None else 0)
    return (*first, *down(r[1], lambda v: -v), *down(r[2], lambda v: -ord(v)), r[3])


@pytest.fixture(scope="module")
def ranked(spark, tmp_path_factory):
    data = rows(1, 1000)
    df = spark.createDataFrame(data, "level int, score double, name string, id long")
    r = ranking.write(df, f"file://{tmp_path_factory.mktemp('rank')}/r", ORDER, rows_per_range=60)
    return r, sorted(data, key=place)


def test_pages_by_offset(ranked):
    r, want = ranked
    assert r.ranges.count() > 5
    for offset, limit in ((0, 50), (37, 200), (555, 1), (980, 50), (1000, 10), (5000, 10)):
        got = r.page_at(offset=offset, limit=limit).collect()
        assert [tuple(x)[:4] for x in got] == want[offset : offset + limit]
        assert [x["pos"] for x in got] == list(range(offset, min(offset + limit, 1000)))[: len(got)]


def test_pages_follow_each_other(ranked):
    r, want = ranked
    page, seen = r.page_at(limit=150), []
    while (cursor := r.cursor(page)) is not None:
        seen += [tuple(x)[:4] for x in page.collect()]
        page = r.page_after(cursor, limit=150)
    assert seen == want
    gone = (1, 2.0, "a", -5)  # between rows, and in no row
    assert [tuple(x)[:4] for x in r.page_after(gone, limit=20).collect()] == [x for x in want if place(x) > place(gone)][:20]
    before = (None, 9.0, "z", -1)
    assert [tuple(x)[:4] for x in r.page_after(before, limit=20).collect()] == want[:20]


def test_a_page_reads_its_ranges_alone(ranked):
    r, _ = ranked
    page = r.page_at(offset=900, limit=10)
    assert len({f.split("range=")[1].split("/")[0] for f in page.inputFiles()}) <= len(r.ranges.collect())
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "range#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_bounds_and_empty_rankings(spark, tmp_path):
    df = spark.createDataFrame([], "level int, score double, name string, id long")
    r = ranking.write(df, f"file://{tmp_path}/e", ORDER)
    assert r.page_at().count() == 0 and r.page_after((1, 1.0, "a", 1)).count() == 0 and r.cursor(r.page_at()) is None
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}):
        with pytest.raises(ValueError):
            r.page_at(**bad)
    with pytest.raises(ValueError):
        ranking.write(spark.range(1).withColumnRenamed("id", "pos"), f"file://{tmp_path}/x", [("pos", True)])
