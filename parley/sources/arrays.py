"""Elements of large JSON arrays, one row each, read by many tasks from one file.

A file can't be cut at a record's border without knowing whether the place is in a string
and how deep it is. So a first pass reads the ranges side by side and tells for either case
(in a string or not) what a range does: whether it changes the case, by how much the depth
changes, the least depth and the commas there. Chained from the array's start, that gives
each range its true state and the number of elements before it. Then each task reads the
elements that begin in its range, up to the end of the last one. Tasks hold one block and
one element; the driver gets a row of a few numbers for each range and file.

Only separators are looked at: an element that is no JSON stays a row with its text and
spoils no other. A file that isn't UTF-8, an array that isn't closed and a file without the
array are errors. Files are opened by Arrow: other schemes than it knows (local files, S3,
HDFS, Google storage) fail.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

CHUNK = 64 << 20  # bytes of a range
BLOCK = 4 << 20  # bytes a task looks at at once
NAMES = 4096  # bytes before an array in which its key must lie
SMALL = 10_000  # files up to which their envelopes are broadcast

_KIND = np.zeros(256, np.int8)  # 1 opens, -1 closes, 2 separates
_KIND[[ord("["), ord("{")]], _KIND[[ord("]"), ord("}")]], _KIND[ord(",")] = 1, -1, 2
_MODES = {
    "head": "file string, size long, at long",
    "scan": "file string, start long, flips boolean, delta array<long>, least array<long>, commas array<long>",
    "shell": "file string, shell string",
    "read": "file string, position long, raw string",
    "digest": "file string, sha256 string",
}


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))
    return fs.open_input_file(path)


class _Marks:
    """Separators of a file's bytes outside of strings, block by block."""

    def __init__(self, inside: bool, escaped: bool):
        self.inside, self.escaped = inside, escaped

    def __call__(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, kind, quotes before it) of every separator, in strings or not; moves the state on."""
        quotes = np.flatnonzero(block == 34)
        slashes = np.flatnonzero(block == 92)
        if len(slashes) or self.escaped:
            # backslashes in a row end at ``ends``, having begun at ``begins``; one row may go on from the block before
            cut = np.flatnonzero(np.diff(slashes) != 1)
            begins = slashes[np.r_[0, cut + 1]] if len(slashes) else slashes
            ends = slashes[np.r_[cut, len(slashes) - 1]] if len(slashes) else slashes
            odd = (ends - begins + 1 + ((begins == 0) & self.escaped)) % 2 == 1
            bad = ends[odd] + 1
            if self.escaped and not (len(begins) and begins[0] == 0):
                bad = np.r_[0, bad]
            quotes = quotes[~np.isin(quotes, bad)]
            self.escaped = bool(len(bad)) and int(bad[-1]) == len(block)
        kinds = _KIND[block]
        at = np.flatnonzero(kinds)
        before = np.searchsorted(quotes, at)
        self.turned = len(quotes) % 2 == 1
        return at, kinds[at], before

    def outside(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, kind) of the separators outside of strings."""
        at, kind, before = self(block)
        out = (before + self.inside) % 2 == 0
        self.inside ^= self.turned
        return at[out], kind[out]


def _blocks(f, start: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    f.seek(start)
    while (end is None or start < end) and (got := f.read(BLOCK if end is None else min(BLOCK, end - start))):
        yield start, got
        start += len(got)


def _escaped(f, at: int, least: int) -> bool:
    """Whether an odd number of backslashes ends right before ``at``."""
    n = 0
    while at - n > least:
        size = min(NAMES, at - n - least)
        f.seek(at - n - size)
        got = f.read(size)
        run = len(got) - len(got.rstrip(b"\\"))
        n += run
        if run < size:
            break
    return n % 2 == 1


def _head(file: str, key: str | None) -> Iterator[tuple]:
    """Where the array's elements begin: in the root, or under ``key`` of the root's object (the first so called)."""
    with _open(file) as f:
        size, depth, marks, tail, root = f.size(), 0, _Marks(False, False), b"", None
        name = None if key is None else re.compile(rb"[{,]\s*" + re.escape(json.dumps(key, ensure_ascii=False).encode()) + rb"\s*:\s*\Z")
        for start, block in _blocks(f, 0):
            if root is None and (text := block.removeprefix(b"\xef\xbb\xbf").lstrip()):
                root = text[:1]
                if root != (b"[" if key is None else b"{"):
                    break
            at, kind = marks.outside(np.frombuffer(block, np.uint8))
            deep = depth + np.cumsum(np.where(kind == 2, 0, kind))
            for p in at[(kind == 1) & (deep == (1 if key is None else 2))]:
                before = (tail + block[max(0, p - NAMES) : p])[-NAMES:]
                if block[p : p + 1] == b"[" and (name is None or name.search(before)):
                    yield file, size, start + int(p) + 1
                    return
            depth = int(deep[-1]) if len(deep) else depth
            tail = (tail + block)[-NAMES:]
        yield file, size, -1


def _scan(file: str, least: int, start: int, end: int) -> Iterator[tuple]:
    """What a range does if it begins outside of a string, and if it begins in one."""
    depth, lowest, commas, odd = [0, 0], [0, 0], [0, 0], False
    with _open(file) as f:
        marks = _Marks(False, _escaped(f, start, least))
        for _, block in _blocks(f, start, end):
            at, kind, before = marks(np.frombuffer(block, np.uint8))
            for h in (0, 1):
                own = kind[(before + odd + h) % 2 == 0]
                if not len(own):
                    continue
                deep = depth[h] + np.cumsum(np.where(own == 2, 0, own))
                low = min(lowest[h], int(deep.min()))
                if low < lowest[h]:
                    lowest[h], commas[h] = low, 0
                commas[h] += int(((own == 2) & (deep == low)).sum())
                depth[h] = int(deep[-1])
            odd ^= marks.turned
    yield file, start, odd, depth, lowest, commas


def _borders(f, least: int, start: int, inside: bool, depth: int) -> Iterator[tuple[int, bytes, list[tuple[int, bool]]]]:
    """(offset, block, [(place, whether the array ends there)]) from ``start`` to the end of the array."""
    marks = _Marks(inside, _escaped(f, start, least))
    for offset, block in _blocks(f, start):
        at, kind = marks.outside(np.frombuffer(block, np.uint8))
        deep = depth + np.cumsum(np.where(kind == 2, 0, kind))
        end = np.flatnonzero(deep < 0)[:1]
        if len(end):
            at, kind, deep = at[: end[0] + 1], kind[: end[0] + 1], deep[: end[0] + 1]
        hit = ((kind == 2) & (deep == 0)) | (deep < 0)
        yield offset, block, list(zip(at[hit].tolist(), (deep[hit] < 0).tolist(), strict=True))
        if len(end):
            return
        depth = int(deep[-1]) if len(deep) else depth


def _shell(file: str, least: int, start: int, inside: bool, depth: int) -> Iterator[tuple]:
    """The file's text with an empty array: what stands around the elements."""
    with _open(file) as f:
        f.seek(0)
        head = f.read(least)
        for offset, _, borders in _borders(f, least, start, inside, depth):
            if borders and borders[-1][1]:
                f.seek(offset + borders[-1][0])
                text = (head + f.read()).decode("utf-8-sig")
                json.loads(text)
                yield file, text
                return


def _read(file: str, least: int, start: int, end: int, inside: bool, depth: int, position: int) -> Iterator[pa.RecordBatch]:
    """The elements that begin in the range; one without position and text if the array is empty."""
    def batch():
        raw = pa.array([r for _, r in rows], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([p for p, _ in rows], pa.int64()), raw], ["file", "position", "raw"])

    rows, size = [], 0
    held = bytearray() if start == least else None  # of the element that is being read
    with _open(file) as f:
        for offset, block, borders in _borders(f, least, start, inside, depth):
            at = 0
            for p, last in borders:
                if held is not None:
                    text = bytes(held + block[at:p]).strip()
                    rows.append((None, None) if last and position == 0 and not text else (position, text))
                    size, held = size + len(text), None
                if last or offset + p >= end:
                    break
                held, at, position = bytearray(), p + 1, position + 1
            else:
                if held is not None:
                    held += block[at:]
                if held is not None or offset + len(block) < end:
                    if size > BLOCK:
                        yield batch()
                        rows, size = [], 0
                    continue
            break
    if rows:
        yield batch()


def _digest(file: str) -> Iterator[tuple]:
    told = hashlib.sha256()
    with _open(file) as f:
        for _, block in _blocks(f, 0):
            told.update(block)
    yield file, told.hexdigest()


_READ = {"head": _head, "scan": _scan, "shell": _shell, "read": _read, "digest": _digest}


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.mode, self.work = options["mode"], options["work"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(w) for w in json.loads(self.work)]

    def read(self, partition: InputPartition):
        return _READ[self.mode](*partition.value)


class JsonRanges(DataSource):
    """Byte ranges of JSON files, a task each; see :func:`read_array`."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return _MODES[self.options["mode"]]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def files(spark: SparkSession, *paths: str) -> list[str]:
    """URIs of the files that paths, patterns and folders name, hidden ones left out."""
    found = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        told = fs.globStatus(p) or []
        if not len(told):
            raise FileNotFoundError(path)
        for s in told:
            found += list(fs.listStatus(s.getPath())) if s.isDirectory() else [s]
    kept = [s.getPath() for s in found if not s.isDirectory() and s.getPath().getName()[0] not in "._"]
    return sorted({re.sub(r"^file:/+", "file:///", p.toUri().toString()) for p in kept})


def _of(spark: SparkSession, mode: str, work: list) -> DataFrame:
    ship(spark)
    spark.dataSource.register(JsonRanges)
    return spark.read.format("json_ranges").option("mode", mode).option("work", json.dumps(work)).load()


def digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, sha256) of files of any size, read block by block."""
    return _of(spark, "digest", [[f] for f in files(spark, *paths)])


def read_array(spark: SparkSession, *paths: str, key: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(source_file, shell, position, raw): each element's text with its place, from 0, in the array.

    The array is the file's root or, with ``key``, that member of the root's object; ``shell``
    is the file's text with an empty array. An empty array gives one row without position and raw.
    """
    heads = {r["file"]: r for r in _of(spark, "head", [[f, key] for f in files(spark, *paths)]).collect()}
    if none := sorted(f for f, r in heads.items() if r["at"] < 0):
        raise ValueError(f"no array {key or ''} in {none[:3]}")
    spans = {f: [(s, min(s + chunk, r["size"])) for s in range(r["at"], r["size"], chunk)] for f, r in heads.items()}
    scans = {(r["file"], r["start"]): r for r in _of(spark, "scan", [[f, heads[f]["at"], s, e] for f, own in spans.items() for s, e in own]).collect()}
    read, shells = [], []
    for f, own in spans.items():
        inside, depth, position = False, 0, 0
        for s, e in own:
            read.append([f, heads[f]["at"], s, e, inside, depth, position])
            r = scans[f, s]
            low = depth + r["least"][inside]
            if low < 0:
                shells.append([f, heads[f]["at"], s, inside, depth])
                break
            position += r["commas"][inside] if low == 0 else 0
            depth, inside = depth + r["delta"][inside], inside ^ r["flips"]
        else:
            raise ValueError(f"{f}: the array isn't closed")
    around = _of(spark, "shell", shells)
    rows = _of(spark, "read", read).join(F.broadcast(around) if len(shells) <= SMALL else around, "file")
    return rows.select(F.col("file").alias("source_file"), "shell", "position", "raw")
