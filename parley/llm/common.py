"""Shared helpers: shared folder, safe columns, word shingles, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship  # noqa: F401  the operators take it from here


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a session whose tasks all run in the driver's process (``local[...]``)
    gets a temporary one; on a cluster that is an error, for executors don't share local folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "parley-checkpoints")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a durable lineage cut.

    Spark is told to delete the shuffle files of this write once it has ended: nothing reads
    them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._parley_path = path  # type: ignore[attr-defined]
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables made by :func:`store` once nothing lazy refers to them."""
    for df in frames:
        path = getattr(df, "_parley_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def packed(docs: DataFrame, **keys: str) -> DataFrame:
    """All columns of ``docs`` in one column ``row``, and its columns named in ``keys`` beside it.

    Whatever a user's columns are called, they can't clash with an operator's own.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(whole, *(F.col(f"`{c}`").alias(k) for k, c in keys.items()))


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without columns of these names, in whatever case."""
    return docs.drop(*(c for c in docs.columns if c.lower() in names))


def crc_mod(doc_id, m: int):
    """crc32 of the id as text, modulo m (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % m


# ----- word shingles ---------------------------------------------------------


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered up to a fixed number of words."""

    LIMIT = 300_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(32), np.uint64(29)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S1)) * _P1
    h = (h ^ (h >> _S2)) * _P2
    return h ^ (h >> _S1)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes.split() splits on just those bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def gram_hashes(words: list[bytes], cache: WordHash, n: int) -> np.ndarray:
    """64-bit hash of each n-word shingle in order; with fewer words, of the whole sequence; uint64."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    m = len(w) - k + 1
    h = np.full(m, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            h = mix(h + w[i : i + m])
    return h


# ----- connected components --------------------------------------------------


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable over the given links.

    Min-label propagation with pointer jumping; each round is written to the shared folder.
    Rounds grow with the logarithm of the longest path.
    """
    sym = store(
        edges.select(F.col(u).alias("src"), F.col(v).alias("dst"))
        .unionByName(edges.select(F.col(v).alias("src"), F.col(u).alias("dst")))
        .filter("src <> dst").distinct(),
        "cc-edges",
    )
    labels = store(sym.groupBy(F.col("src").alias("node")).agg(F.least(F.col("src"), F.min("dst")).alias("label")), "cc-0")
    while True:
        near = sym.join(labels, sym.dst == labels.node).groupBy("src").agg(F.min("label").alias("seen"))
        step = labels.join(near, labels.node == near.src).select("node", F.least("label", "seen").alias("next"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("p"), F.col("label").alias("p_label"))
        jumped = store(
            step.join(up, step.next == up.p, "left").select("node", F.least("next", F.coalesce("p_label", "next")).alias("label"), "old"), "cc"
        )
        changed = jumped.filter("label <> old").limit(1).count()
        drop_stored(labels)
        path = jumped._parley_path
        labels = jumped.select("node", "label")
        labels._parley_path = path
        if not changed:
            drop_stored(sym)
            return labels
