"""Session settings that the operators assume."""

from __future__ import annotations

import os
import pathlib
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # secrets of keyed digests are literals in plans
    "spark.redaction.regex": "(?i)secret|password|token|access[.]?key",
}


def session(name: str = "parley", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: computed once, and not again if an executor is lost.

    Where no folder is set, a session whose tasks all run in the driver's process gets a
    temporary one; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="parley-checkpoints-"))
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder (see :func:`checkpointed` for where that is)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="parley-checkpoints-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder: what :func:`checkpointed` does, computed once and read by columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, through the session's own file server."""
    root = pathlib.Path(__file__).resolve().parent
    app = (spark.sparkContext.applicationId, str(root))
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(), "parley_workers.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
