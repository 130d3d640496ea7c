"""Sinks: atomic publishing, upserts and text exports on plain Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def guard_output(root: str, path: str) -> str:
    """``path``, which must lie under ``root``."""
    from posixpath import normpath

    if not (normpath(path) + "/").startswith(normpath(root) + "/"):
        raise ValueError("outputs must lie in the project's folder")
    return path


def _pointers(spark: SparkSession, root: str, name: str) -> list[str]:
    fs, folder = _fs(spark, f"{root}/{name}/_pointers")
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def publish(df: DataFrame, root: str, name: str) -> str:
    """Write a new version beside the old ones, then add a pointer to it.

    Pointers are never replaced: each is a file of its own with a higher number, renamed into
    place when it is whole, and readers take the highest. So there is a version to read at
    any moment, and after a crash too.
    """
    spark = df.sparkSession
    version = f"{root}/{name}/run_id={uuid.uuid4().hex}"
    df.write.parquet(version)
    last = [p for p in _pointers(spark, root, name) if not p.startswith(".")]
    number = int(last[-1].split("-")[0]) + 1 if last else 0
    pointer = f"{number:012d}-{uuid.uuid4().hex}"
    fs, fresh = _fs(spark, f"{root}/{name}/_pointers/.{pointer}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    if not fs.rename(fresh, _fs(spark, f"{root}/{name}/_pointers/{pointer}")[1]):
        raise OSError(f"{name}: the pointer could not be put in place")
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The published version, or None."""
    last = [p for p in _pointers(spark, root, name) if not p.startswith(".")]
    if not last:
        return None
    return spark.read.parquet(spark.read.text(f"{root}/{name}/_pointers/{last[-1]}").first()[0])


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """New rows over old ones; columns in ``keep`` stay as they were where a row was there. A null key equals a null key."""
    o = old.select(*(F.col(c).alias(f"__o_{c}") for c in old.columns))
    joined = new.join(o, _same(key, "__o_"), "left")
    fresh = joined.select(*(F.coalesce(f"__o_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns))
    gone = new.select(*(F.col(k).alias(f"__n_{k}") for k in key))
    return fresh.unionByName(old.join(gone, _same(key, "__n_"), "left_anti"), allowMissingColumns=True)


def _same(key: list[str], prefix: str):
    on = F.lit(True)
    for k in key:
        on &= F.col(k).eqNullSafe(F.col(prefix + k))
    return on


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def write_lines(rows: DataFrame, path: str, column: str, order: list[str]) -> None:
    """One JSON text per line, globally in order; parts follow each other."""
    rows.orderBy(*order).select(column).write.mode("overwrite").text(path)


def restore(fresh: DataFrame, old: DataFrame, key: list[str], valid: dict[str, DataFrame]) -> DataFrame:
    """``fresh`` and those old rows that it lacks and whose references still exist.

    valid: column -> frame that has the column's admissible values under the same name.
    """
    for column, frame in valid.items():
        old = old.join(frame.select(column).distinct(), column, "left_semi")
    return insert_or_ignore(fresh, old.select(*fresh.columns), key)


def activate(fresh: DataFrame, snapshot_id: str, root: str, name: str) -> bool:
    """Publish a snapshot in place of the one before; False, and nothing done, if it is the current one."""
    now = current(fresh.sparkSession, root, name)
    if now is not None and now.select("snapshot_id").limit(1).collect() == [(snapshot_id,)]:
        return False
    publish(fresh.withColumn("snapshot_id", F.lit(snapshot_id)), root, name)
    return True
