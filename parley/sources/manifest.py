"""One publication of many tables: numbered manifests, each naming a version of every table.

A run writes its tables beside the old ones and then one manifest, which is put in place
under the next number only if no other has that number. Readers take one manifest and all
tables from it, so they never see two runs mixed; after a crash the last manifest still names
whole tables. Of two writers that start from one manifest, one finds the number taken: it
builds again from the other's result, or fails once its tries are used up.

A table may be split into buckets by a hash of its key. An upsert then reads and writes the
buckets that its batch touches; the new version refers to the old files of all others.

Putting a manifest in place relies on one atomic step of the file system: a hard link
for local files, else a rename that doesn't overwrite. A store without such a rename needs a
single writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .sinks import upsert

BUCKETS = 64
_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another run was published meanwhile."""


@dataclass
class Table:
    """Files of one version: path and rows by bucket ("" for a table without buckets)."""

    paths: dict[str, str]
    rows: dict[str, int]
    key: list[str] = field(default_factory=list)
    buckets: int = 0
    schema: str = ""


@dataclass
class Manifest:
    number: int
    run_id: str
    tables: dict[str, Table]
    gates: dict[str, bool]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _path(spark, f"{root}/_manifests")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:12]) for n in names if n.endswith(".json") and not n.startswith("."))


def load(spark: SparkSession, root: str, number: int | None = None) -> Manifest | None:
    """The manifest of this number, or the latest; None if there is none."""
    if number is None:
        found = _numbers(spark, root)
        if not found:
            return None
        number = found[-1]
    text = spark.read.text(f"{root}/_manifests/{number:012d}.json", wholetext=True).first()[0]
    told = json.loads(text)
    return Manifest(told["number"], told["run_id"], {k: Table(**t) for k, t in told["tables"].items()}, told["gates"])


def read(spark: SparkSession, manifest: Manifest | None, name: str) -> DataFrame | None:
    """A table as the manifest names it; None if it doesn't."""
    table = manifest and manifest.tables.get(name)
    return _files(spark, table, list(table.paths)) if table else None


def _files(spark: SparkSession, table: Table, buckets: list[str]) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(table.schema))
    paths = [table.paths[b] for b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _place(spark: SparkSession, root: str, number: int, text: str) -> bool:
    """Put the manifest in place whole, unless its number is taken."""
    fs, fresh = _path(spark, f"{root}/_manifests/.{number:012d}-{uuid.uuid4().hex}")
    out = fs.create(fresh, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, goal = spark._jvm, _path(spark, f"{root}/_manifests/{number:012d}.json")[1]
    try:
        if fs.getScheme() == "file":
            files = jvm.java.nio.file.Files
            at = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (goal, fresh)]
            files.createLink(*at)
            fs.delete(fresh, False)
        else:
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            never = spark.sparkContext._gateway.new_array(rename, 1)
            never[0] = rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, goal, never)
    except Py4JJavaError as e:
        fs.delete(fresh, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def write_table(df: DataFrame, root: str, name: str) -> Table:
    """A new version of a table without buckets."""
    path = f"{root}/{name}/version={uuid.uuid4().hex}"
    told, seen = _counted(df)
    told.write.parquet(path)
    return Table({"": path}, {"": seen.get["n"]}, schema=df.schema.json())


def _bucketed(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return df.withColumn(_BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def upsert_table(
    spark: SparkSession, old: Table | None, new: DataFrame, root: str, name: str, key: list[str], *, keep: list[str] = (), buckets: int = BUCKETS
) -> Table:
    """A version with ``new`` upserted by ``key`` (null equals null); only touched buckets are read and written.

    ``keep``: columns that stay as they were where a row was there. Keys of ``new`` are unique.
    """
    if old is not None and (old.key != list(key) or not old.buckets):
        raise ValueError(f"{name} has other buckets")
    buckets = old.buckets if old is not None else buckets
    fresh = _bucketed(new, key, buckets)
    touched = [str(r[0]) for r in fresh.select(_BUCKET).distinct().collect()]  # ``buckets`` numbers at most
    if not touched:
        return old or Table({}, {}, list(key), buckets, new.schema.json())
    had = [b for b in touched if old is not None and b in old.paths]
    rows = upsert(_files(spark, old, had), new, list(key), list(keep)) if had else new
    path = f"{root}/{name}/version={uuid.uuid4().hex}"
    out = _bucketed(rows, key, buckets)
    out.repartition(min(len(touched), buckets), _BUCKET).write.partitionBy(_BUCKET).parquet(path)
    written = spark.read.parquet(path).groupBy(_BUCKET).count().collect()  # from the files' footers
    paths, count = dict(old.paths) if old else {}, dict(old.rows) if old else {}
    for b, n in written:
        paths[str(b)], count[str(b)] = f"{path}/{_BUCKET}={b}", n
    return Table(paths, count, list(key), buckets, rows.schema.json())


def publish(
    spark: SparkSession, root: str, run_id: str, build: Callable[[Manifest | None], dict[str, DataFrame | Table]], *,
    gates: Callable[[Manifest], dict[str, bool]] | None = None, tries: int = 3,
) -> Manifest:
    """Publish what ``build`` makes of the current manifest as one new one, and give it.

    ``build`` gives frames, which are written whole, or tables that :func:`upsert_table` made; tables
    it doesn't give stay as they are. ``gates`` looks at the new manifest before it is put
    in place: a gate that isn't open stops the run and leaves the current one. A run that is
    the current one already changes nothing. On a conflict all is built again, from the
    manifest that came first; after ``tries`` of them it is an error.
    """
    for _ in range(tries):
        now = load(spark, root)
        if now is not None and now.run_id == run_id:
            return now
        made = {name: t if isinstance(t, Table) else write_table(t, root, name) for name, t in build(now).items()}
        new = Manifest(now.number + 1 if now else 0, run_id, {**(now.tables if now else {}), **made}, {})
        new.gates = gates(new) if gates else {}
        if shut := sorted(g for g, ok in new.gates.items() if not ok):
            raise RuntimeError(f"gates are not open: {', '.join(shut)}")
        if _place(spark, root, new.number, json.dumps(asdict(new))):
            return new
    raise Conflict(f"{run_id}: other runs were published {tries} times meanwhile")


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete manifests but the last ``keep``, and versions that no kept one names; how many versions went.

    Not beside a running writer: its versions are not named yet.
    """
    numbers = _numbers(spark, root)
    kept = [load(spark, root, n) for n in numbers[-keep:]]
    used = {p.split(f"/{_BUCKET}=")[0] for m in kept for t in m.tables.values() for p in t.paths.values()}
    gone = 0
    for n in numbers[:-keep]:
        fs, p = _path(spark, f"{root}/_manifests/{n:012d}.json")
        fs.delete(p, False)
    for name in {name for m in kept for name in m.tables}:
        fs, folder = _path(spark, f"{root}/{name}")
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            last = f.getPath().getName()
            if last.startswith("version=") and f"{root}/{name}/{last}" not in used:
                gone += fs.delete(f.getPath(), True)
    return gone
