"""Publication of many tables by one manifest, and upserts by bucket."""

import random

import pytest
from pyspark.sql import functions as F

from parley.sources import manifest as mf
from parley.sources import sinks


def tables(spark, n):
    return {"customers": spark.range(n).withColumnRenamed("id", "c"), "messages": spark.range(3 * n).select((F.col("id") % n).alias("c"), "id")}


def seen(spark, root):
    now = mf.load(spark, root)
    return now.number, now.run_id, {t: mf.read(spark, now, t).count() for t in sorted(now.tables)}


def test_all_tables_or_none(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    assert mf.load(spark, root) is None and mf.read(spark, None, "customers") is None
    first = mf.publish(spark, root, "a", lambda now: tables(spark, 2))
    assert seen(spark, root) == (0, "a", {"customers": 2, "messages": 6}) and first.tables["messages"].rows == {"": 6}
    assert mf.publish(spark, root, "a", lambda now: 1 / 0).number == 0  # the same run again

    def crash(now):
        mf.write_table(spark.range(9), root, "customers")
        raise OSError("lost")

    with pytest.raises(OSError):
        mf.publish(spark, root, "b", crash)
    assert seen(spark, root) == (0, "a", {"customers": 2, "messages": 6})
    enough = lambda new: {"rows": new.tables["customers"].rows[""] >= 2, "all": len(new.tables) == 2}
    with pytest.raises(RuntimeError, match="rows"):
        mf.publish(spark, root, "b", lambda now: tables(spark, 1), gates=enough)
    assert seen(spark, root)[1] == "a"
    mf.publish(spark, root, "b", lambda now: {"customers": spark.range(5)}, gates=enough)
    assert seen(spark, root) == (1, "b", {"customers": 5, "messages": 6})  # what a run doesn't give stays
    assert mf.read(spark, first, "customers").count() == 2  # a reader keeps its manifest
    assert mf.vacuum(spark, root, keep=1) == 4 and seen(spark, root) == (1, "b", {"customers": 5, "messages": 6})


def test_of_two_writers_none_is_lost(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    mf.publish(spark, root, "start", lambda now: {"t": spark.range(1)})
    tries = []

    def late(now):
        tries.append(now.run_id)
        if len(tries) == 1:  # another run comes first
            mf.publish(spark, root, "other", lambda now: {"t": mf.read(spark, now, "t").union(spark.range(10, 12))})
        return {"t": mf.read(spark, now, "t").union(spark.range(20, 23))}

    assert mf.publish(spark, root, "late", late).number == 2 and tries == ["start", "other"]
    assert sorted(r[0] for r in mf.read(spark, mf.load(spark, root), "t").collect()) == [0, 10, 11, 20, 21, 22]

    def never(now):
        mf.publish(spark, root, f"other {now.number}", lambda now: {})
        return {"t": spark.range(1)}

    with pytest.raises(mf.Conflict):
        mf.publish(spark, root, "never", never, tries=2)
    assert mf.read(spark, mf.load(spark, root), "t").count() == 6


def test_upserts_write_what_they_touch(spark, tmp_path):
    root, schema, rng = f"file://{tmp_path}/out", "k long, s string, v int, review string", random.Random(2)
    plain, table = None, None
    for step in range(4):
        keys = {(rng.choice([None, *range(40)]), rng.choice([None, "x"])) for _ in range([60, 3, 0, 5][step])}
        new = spark.createDataFrame([(k, s, step, f"r{step}") for k, s in keys], schema)
        before = table
        table = mf.upsert_table(spark, table, new, root, "t", ["k", "s"], keep=["review"], buckets=16)
        plain = spark.createDataFrame((new if plain is None else sinks.upsert(plain, new, ["k", "s"], ["review"])).collect(), schema)
        got = mf._files(spark, table, list(table.paths))
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and sum(table.rows.values()) == plain.count()
        if before is not None:
            same = [b for b in before.paths if table.paths[b] == before.paths[b]]
            assert len(before.paths) - len(same) <= len(keys)
    none = mf.upsert_table(spark, None, spark.createDataFrame([], schema), root, "u", ["k"])
    assert mf._files(spark, none, []).count() == 0 and mf._files(spark, none, []).columns == ["k", "s", "v", "review"]
    with pytest.raises(ValueError):
        mf.upsert_table(spark, table, new, root, "t", ["k"])
