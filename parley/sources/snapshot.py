"""Reads of inputs that may be written meanwhile, and their fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def signature(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, modification time) of the files under a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p) or []
    out = []
    for s in found:
        for f in fs.listStatus(s.getPath()) if s.isDirectory() else [s]:
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def recorded_copy(spark: SparkSession, path: str, to: str) -> DataFrame:
    """:func:`stable_copy`, and the copy's :func:`file_digests`: what a run says it has read."""
    return file_digests(spark, stable_copy(spark, path, to))


def stable_copy(spark: SparkSession, path: str, to: str, tries: int = 2) -> str:
    """Copy ``path`` to ``to`` such that it didn't change meanwhile; else an error."""
    fu = spark._jvm.org.apache.hadoop.fs.FileUtil
    conf = spark._jsc.hadoopConfiguration()
    src, dst = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
    for _ in range(tries):
        before = signature(spark, path)
        fu.copy(src.getFileSystem(conf), src, dst.getFileSystem(conf), dst, False, True, conf)
        if before == signature(spark, path):
            return to
    raise RuntimeError("the input changed while it was read")
