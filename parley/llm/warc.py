"""WARC archives, written by record and read as a table of chunks.

Of pages with equal payloads of ``MIN_REVISIT`` bytes or more, that with the smallest id is
a response and the others revisit it. Each task writes its pages to one gzipped archive,
member by member, in the shared folder; it writes under a name of its own attempt and
renames at the end, so that a repeated attempt replaces the file. Archives are read as
streams: a record becomes rows (record id, chunk number) of ``CHUNK`` bytes at most, each
with the SHA-256 of the payload so far. Reading holds no record as a whole; writing has a
page's text once, as the row that Spark hands over, and takes it in steps of ``STEP`` bytes.
Archives stay in the folder, for the chunk table reads them when it is asked for.

Defined results: a null payload counts as empty; rows that repeat the smallest id of a
payload are responses too; pages without an id rank last and name no page in refers_to;
a null url is written as an empty one, line breaks in it as spaces; an empty table gives no
archive; payloads equal in length and SHA-256 are equal; other columns are not written.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, ship, store

MIN_REVISIT = 100
CHUNK = 1 << 20
STEP = 1 << 16
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
_CHUNKS = "record_id string, page_id long, record_type string, refers_to long, chunk_no int, offset long, data binary, digest string, last boolean, payload_bytes long, payload_digest string"


def roles(pages: DataFrame, *, page_id="page_id", payload="html", url="url") -> DataFrame:
    """(page_id, url, payload, bytes, digest, refers_to); refers_to is null for responses."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    same = rows.filter(F.col("bytes") >= MIN_REVISIT).groupBy(F.col("digest").alias("d")).agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    )
    same = store(same.filter("n > 1 and first is not null").drop("n"), "same")
    joined = rows.join(same, F.col("digest") == F.col("d"), "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("d", "first")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; Hadoop's name for S3 is known, too."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def _name(page: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page is None else page}:{digest[:32]}>"


def _record(page, url, payload, digest: str, refers_to) -> Iterator[bytes]:
    """A gzip member in pieces; of the payload (any buffer) one step at a time is copied."""
    payload = memoryview(payload)
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = payload if refers_to is None else memoryview(b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(http) + len(body)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: {_name(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        ]
    yield z.compress(("\r\n".join(head) + "\r\n\r\n").encode() + http)
    for at in range(0, len(body), STEP):
        yield z.compress(body[at : at + STEP])
    yield z.compress(b"\r\n\r\n") + z.flush()


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """(path, records) of the archives written from the rows of :func:`roles`."""
    ship(rows.sparkSession)

    def run(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():06d}.warc.gz"
        own = f"{base}/.{task.partitionId():06d}-{task.taskAttemptId()}.tmp"
        out, n = None, 0
        for b in batches:
            for page, url, payload, _, digest, refers_to in zip(*(c for c in b.columns)):
                out = out or fs.open_output_stream(own, compression=None)
                # the batch's own buffer: neither decoded nor encoded again
                for piece in _record(page.as_py(), url.as_py(), payload.as_buffer(), digest.as_py(), refers_to.as_py()):
                    out.write(piece)
                n += 1
        if out:
            out.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return rows.select("page_id", "url", "payload", "bytes", "digest", "refers_to").mapInArrow(run, "path string, records long")


class _Stream:
    """Uncompressed bytes of a gzip file of many members, taken as asked for."""

    def __init__(self, source):
        self.source, self.z, self.raw, self.held = source, None, b"", b""

    def _feed(self, data: bytes) -> bool:
        self.z = self.z or zlib.decompressobj(31)
        out = self.z.decompress(data, CHUNK)
        self.held += out
        # at the end of a member unconsumed_tail may repeat what unused_data holds
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        if self.z.eof:
            self.z = None
        return bool(out)

    def more(self) -> bool:
        if not self.raw and self.z and self._feed(b""):  # output held back so far
            return True
        if not self.raw:
            self.raw = self.source.read(STEP)
            if not self.raw:
                return False
        self._feed(self.raw)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        return out


def chunks_of(source, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of one archive; see _CHUNKS."""
    s = _Stream(source)
    while (head := s.until(b"\r\n\r\n")) is not None:
        field = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").strip("\r\n").split("\r\n")[1:] if ": " in x)
        length = int(field["Content-Length"])
        http = s.until(b"\r\n\r\n") or b""
        left = length - len(http) - 4
        page, refers = field.get("X-Page-ID"), field.get("X-Refers-To-Page-ID")
        same = (field["WARC-Record-ID"], int(page) if page else None, field["WARC-Type"], int(refers) if refers else None)
        told = field["WARC-Payload-Digest"].removeprefix("sha256:")
        digest, no, at = hashlib.sha256(), 0, 0
        while True:
            data = s.take(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError(f"record {same[0]} is cut off")
            digest.update(data)
            left -= len(data)
            last = left == 0
            size, full = (at + len(data), digest.hexdigest()) if same[2] == "response" else (int(field["X-Payload-Length"]), told)
            if last and same[2] == "response" and full != told:
                raise ValueError(f"record {same[0]}: payload and digest differ")
            yield (*same, no, at, data, digest.hexdigest(), last, size if last else None, full if last else None)
            no, at = no + 1, at + len(data)
            if last:
                break
        s.take(4)
    if s.held or s.z:
        raise ValueError("archive is cut off within a record's head or trailer")


def read_archives(archives: DataFrame, files: int) -> DataFrame:
    """Chunk rows of the archives named in ``path``."""
    ship(archives.sparkSession)

    def run(batches):
        schema = pa.schema(
            [
                ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                ("chunk_no", pa.int32()), ("offset", pa.int64()), ("data", pa.binary()), ("digest", pa.string()), ("last", pa.bool_()),
                ("payload_bytes", pa.int64()), ("payload_digest", pa.string())
            ]
        )
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = _open(path)
                held, size = [], 0
                with fs.open_input_stream(name, compression=None) as source:
                    for row in chunks_of(source):
                        held.append(row)
                        size += len(row[6])
                        if size >= 4 * CHUNK or len(held) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return archives.select("path").repartition(max(1, files)).mapInArrow(run, _CHUNKS)


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Chunk table read back from archives of ``pages`` in the shared folder."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    written = store(write_archives(roles(pages, **names), folder), "archives")
    return read_archives(written, written.count())


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives it was written to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return round_trip(pages).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc": op5_warc}
ORACLE = {
    "op5_warc": f"""
with p as (
  select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages
), q as (
  select *, min(page_id) over (partition by d) as first from p
)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when n >= {MIN_REVISIT} and first <> page_id then 'revisit' else 'response' end as record_type,
       case when n >= {MIN_REVISIT} and first <> page_id then first end as refers_to
from q
"""
}
