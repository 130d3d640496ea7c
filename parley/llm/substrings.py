"""Substring dedup: repeated lines by digest, and repeated passages by exact word windows.

Lines are normalised (A-Z lower-cased, ASCII white space collapsed) and known by a 128-bit
digest. Of all lines with one digest that with the lowest rank (id, text hash, line number)
stays. The others go where they stand in a run of such lines, blank ones aside, that has
``min_words`` words or more in all: a long line alone, short ones together. A short formula
between lines of its own text stays.

Every run of ``WINDOW`` words or more that an earlier place has too goes as well, wherever
lines begin or end; an earlier place in the same document counts if the two don't overlap.
Rows by window would be one per word, so this takes two steps. Of each window the least
hash of its ``SHINGLE``-word shingles is its mark: equal windows have equal marks, and few
shingles are marks. Only windows whose mark two texts share, or one text repeats, get rows
(a 64-bit hash with its rank), of which all but the earliest go. Whole copies of a text are
known by the text's hash and get no rows by window.

Hot lines are no trouble: the first occurrence is an aggregate with partial sums in each
task, and repeated lines find it by a join that Spark splits where a key is hot.

Defined results: null and empty texts have no lines to remove; rows equal in id and text
are one document with one result; equal lines rank by id, then by the text's hash, then by
place; a null id ranks last; texts of any length are taken whole, one at a time; other
columns are kept, and none can clash but ``kept_spans``, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, mix, packed, ship, store, without, words_of

MIN_WORDS = 15  # of a run of repeated lines
WINDOW, SHINGLE = 50, 25  # words
LAST = (1 << 63) - 1  # rank of a null id
_BASE = 0x9E3779B97F4A7C15
_LINES = "doc_id long, th long, unit int, place int, words int, start int, stop int, h1 long, h2 long"


def lines(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, th, unit, place, words, start, stop, h1, h2) of each line that has a word.

    unit numbers all lines, place those with a word; start and stop count characters of the
    original text.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows, digests = [], []
            for i, th, t in zip(*(c.to_pylist() for c in b.columns)):
                at = place = 0
                for k, line in enumerate(t.split("\n")):
                    if words := words_of(line):
                        rows.append((i, th, k, place, len(words), at, at + len(line)))
                        digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                        place += 1
                    at += len(line) + 1
            cols = list(zip(*rows)) if rows else [()] * 7
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            kinds = [pa.int64()] * 2 + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(cols, kinds)), *(pa.array(np.ascontiguousarray(h[:, k])) for k in (0, 1))],
                names=["doc_id", "th", "unit", "place", "words", "start", "stop", "h1", "h2"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.filter("text is not null").mapInArrow(run, _LINES)


def repeated_lines(docs: DataFrame, *, min_words=MIN_WORDS, **names) -> DataFrame:
    """(doc_id, th, unit, start, stop, first_doc_id, first_unit): lines that go, and which stays for them."""
    found = store(lines(docs, **names), "lines")
    rank = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("th"), F.col("unit"))
    first = found.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
    first = store(first.filter("first <> last").drop("last"), "first")
    rest = found.withColumn("rank", rank).join(first, ["h1", "h2"]).filter(F.col("rank") != F.col("first"))
    rest = rest.select(
        "doc_id", "th", "unit", "place", "words", "start", "stop",
        F.when(F.col("first.id") != LAST, F.col("first.id")).alias("first_doc_id"), F.col("first.unit").alias("first_unit"),
    ).distinct()
    # runs of neighbours: places less their number in order are equal
    own = Window.partitionBy("doc_id", "th")
    rest = rest.withColumn("run", F.col("place") - F.row_number().over(own.orderBy("place")))
    rest = rest.withColumn("in_run", F.sum("words").over(Window.partitionBy("doc_id", "th", "run")))
    return rest.filter(F.col("in_run") >= min_words).drop("place", "words", "run", "in_run")


def rolling(w: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n of the word hashes."""
    if len(w) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(w), _BASE, np.uint64))
        down = np.cumprod(np.full(len(w) - n + 1, pow(_BASE, -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up, dtype=np.uint64)])
        return mix((sums[n:] - sums[:-n]) * down)


def marks(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of WINDOW words: the place and the hash of its mark."""
    v = rolling(w, SHINGLE)
    span = WINDOW - SHINGLE + 1
    if len(v) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(v, span)
    at = np.arange(len(view)) + view.argmin(1)
    return at, v[at]


def _hashed(text: str, cache: WordHash) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of each word, and the places of line ends, in characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.ones(len(points) + 2, bool)
    blank[1:-1] = (points == 32) | ((points >= 9) & (points <= 13))
    return np.flatnonzero(blank[1:] != blank[:-1]).astype(np.int32).reshape(-1, 2), np.flatnonzero(points == 10)


def windows(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, th, h, start, stop, unit, head): windows that may be repeated.

    For a whole copy of a text of WINDOW words or more: one row for all of it, where h is null and
    head the rank of the smallest id with that text.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")
    ).filter("text is not null")

    def mark(batches):
        cache = WordHash()
        for b in batches:
            ths, found, many = [], [], []
            for th, t in zip(*(c.to_pylist() for c in b.columns)):
                at, v = marks(_hashed(t, cache))
                _, first = np.unique(at, return_index=True)
                x, n = np.unique(v[first], return_counts=True)
                ths.append(np.full(len(x), th, np.int64)), found.append(x.view(np.int64)), many.append(n > 1)
            if ths:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ths, found, many)], names=["th", "mark", "many"])

    by_text = store(rows.select("th", "text").mapInArrow(mark, "th long, mark long, many boolean"), "marks")
    shared = by_text.groupBy("mark").agg(
        F.min("th").alias("lo"), F.max("th").alias("hi"), F.max("many").alias("many")
    ).filter("lo <> hi or many").select("mark")
    of = by_text.select("th", "mark").join(shared, "mark").groupBy("th").agg(F.collect_set("mark").alias("marks"))
    heads = rows.groupBy("th").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("other"))
    wanted = heads.join(of, "th", "left").filter("head <> other or marks is not null").select("th", "head", "marks")

    def run(batches):
        cache = WordHash()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                out = [[] for _ in range(7)]
                for i, th, t, head, own in zip(*(c.to_pylist() for c in b.slice(at, 200).columns)):
                    if i == head and not own:
                        continue
                    spans, ends = _places(t)
                    if len(spans) < WINDOW:
                        continue
                    if i != head:
                        first, last, h = spans[:1, 0], spans[-1:, 1], [None]
                    else:
                        w = _hashed(t, cache)
                        k = np.flatnonzero(np.isin(marks(w)[1].view(np.int64), np.array(own, np.int64)))
                        first, last, h = spans[k, 0], spans[k + WINDOW - 1, 1], rolling(w, WINDOW)[k].view(np.int64).tolist()
                    n = len(first)
                    for x, y in zip(
                        out,
                        (
                            [i] * n, [th] * n, h, first.tolist(), last.tolist(), np.searchsorted(ends, first).tolist(),
                            [head if i != head else None] * n
                        )
                    ):
                        x.extend(y)
                kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "th", "h", "start", "stop", "unit", "head"]
                )

    return rows.join(wanted, "th").select("doc_id", "th", "text", "head", "marks").mapInArrow(
        run, "doc_id long, th long, h long, start int, stop int, unit int, head long"
    )


def repeated_passages(docs: DataFrame, **kind) -> DataFrame:
    """(doc_id, th, unit, start, stop, first_doc_id, first_unit): runs of WINDOW words or more that an earlier place has.

    unit is the line in which the run begins; first_ says where the first window of the run stays.
    """
    found = store(windows(docs, **kind), "windows")
    rank = F.struct("doc_id", "th", "start", "stop", "unit")
    each = found.filter("h is not null")
    first = each.groupBy("h").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).filter(F.col("first") != F.col("last")).drop("last")
    first = store(first, "first-windows")
    elsewhere = (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.th") != F.col("th"))
    gone = each.join(first, "h").filter(elsewhere | (F.col("first.stop") <= F.col("start")))
    gone = gone.select("doc_id", "th", "start", "stop", "unit", F.col("first.doc_id").alias("first_doc_id"), F.col("first.unit").alias("first_unit"))
    # windows that meet are one run; rows equal in id and text fall into the same
    own = Window.partitionBy("doc_id", "th").orderBy("start", "stop")
    before = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    gone = gone.withColumn("fresh", F.when(F.col("start") <= before, 0).otherwise(1))
    gone = gone.withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = gone.groupBy("doc_id", "th", "run").agg(F.min(F.struct("start", "unit", "first_doc_id", "first_unit")).alias("m"), F.max("stop").alias("stop"))
    runs = runs.select("doc_id", "th", "m.unit", "m.start", "stop", "m.first_doc_id", "m.first_unit")
    copies = found.filter("h is null").distinct().select(
        "doc_id", "th", "unit", "start", "stop", F.col("head").alias("first_doc_id"), F.col("unit").alias("first_unit")
    )
    known = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return runs.unionByName(copies).select(known("doc_id"), "th", "unit", "start", "stop", known("first_doc_id"), "first_unit")


def repeats(docs: DataFrame, *, doc_id="doc_id", text="text", **kind) -> DataFrame:
    """Repeated lines, and repeated passages; where both hold, places overlap."""
    return repeated_lines(docs, doc_id=doc_id, text=text, **kind).unionByName(repeated_passages(docs, doc_id=doc_id, text=text))


def _disjoint(batches):
    """(id, th, gone) with overlapping places joined."""
    for b in batches:
        joined = []
        for spans in b.column(2).to_pylist():
            out = []
            for s in spans:
                if out and s["start"] <= out[-1]["stop"]:
                    out[-1]["stop"] = max(out[-1]["stop"], s["stop"])
                else:
                    out.append(dict(s))
            joined.append(out)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(joined, b.column(2).type)], names=["id", "th", "gone"])


def without_repeats(docs: DataFrame, *, doc_id="doc_id", text="text", **kind) -> DataFrame:
    """``docs`` with repeated lines and passages cut from the text, and ``kept_spans``: (start, stop) of what stays."""
    gone = repeats(docs, doc_id=doc_id, text=text, **kind)
    gone = gone.groupBy(F.col("doc_id").alias("id"), F.col("th").alias("th")).agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("gone")
    )
    gone = gone.mapInArrow(_disjoint, gone.schema).alias("g")
    docs = without(docs, "kept_spans")
    rows = packed(docs, id=doc_id, text=text).withColumn("th", F.xxhash64("text")).alias("r")
    on = F.col("r.id").cast("long").eqNullSafe(F.col("g.id")) & (F.col("r.th") == F.col("g.th"))
    rows = rows.join(gone, on, "left").select("row", "text", F.coalesce("gone", F.array().cast("array<struct<start:int,stop:int>>")).alias("gone"))
    # a place that goes takes the line's end with it
    inner = F.flatten(F.transform("gone", lambda g: F.array(g.start, F.least(g.stop + 1, F.length("text")))))
    edges = F.concat(F.array(F.lit(0)), inner, F.array(F.length("text")))
    at = lambda i: F.get(edges, i.cast("int"))
    spans = F.transform(
        F.sequence(F.lit(0), (F.size(edges) / 2 - 1).cast("int")), lambda i: F.struct(at(i * 2).alias("start"), at(i * 2 + 1).alias("stop"))
    )
    rows = rows.withColumn("kept_spans", F.when(F.col("text").isNotNull(), F.filter(spans, lambda s: s.stop > s.start)))
    cut = F.array_join(F.transform("kept_spans", lambda s: F.substring("text", s.start + 1, s.stop - s.start)), "")
    rows = rows.withColumn("text", F.when(F.size("gone") > 0, cut).otherwise(F.col("text")))
    return rows.select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns), "kept_spans")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated lines, and passages of 50 words or more, that an earlier place has already, with their places."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeats(docs).drop("th")


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
# ids of documents are unique in the tables, so ranks need no hash of the text here
ORACLE = {
    "op1_substring_dedup": rf"""
with t as (
  select doc_id, text, string_split(text, chr(10)) as ls from documents where text is not null
), l as (
  select doc_id, ls, unnest(range(len(ls))) as unit from t
), u as (
  select doc_id, unit, coalesce(list_sum(list_transform(ls[1:unit], lambda x: length(x) + 1)), 0) as start, ls[unit + 1] as line from l
), w as (
  select doc_id, unit, start, start + length(line) as stop,
         list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from u
), f as (
  select *, array_to_string(ws, ' ') as norm, row_number() over (partition by doc_id order by unit) as place from w where len(ws) > 0
), r as (
  select *, first_value(doc_id) over o as first_doc_id, first_value(unit) over o as first_unit, row_number() over o as k
  from f window o as (partition by norm order by doc_id, unit)
), g as (
  select *, place - row_number() over (partition by doc_id order by place) as run from r where k > 1
), repeated_lines as (
  select * from (select *, sum(len(ws)) over (partition by doc_id, run) as in_run from g) where in_run >= {MIN_WORDS}
), x as (
  select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as raw from t
), y as (
  select doc_id, text, raw, list_transform(raw, lambda v: translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as ws,
         regexp_extract_all(text, '[\x20\x09-\x0D]+') as gaps, not regexp_matches(text, '^[\x20\x09-\x0D]') as bare,
         min(doc_id) over (partition by text) as head
  from x where len(raw) >= {WINDOW}
), heads as (
  select * from y where doc_id = head
), words as (
  select doc_id, unnest(range(1, len(raw) + 1)) as i, unnest(raw) as v, unnest(list_concat(case when bare then [''] else [] end, gaps)[1:len(raw)]) as gap from heads
), placed as (
  select doc_id, i, sum(length(gap) + length(v)) over o as stop, sum(length(gap) + length(v)) over o - length(v) as start,
         sum(length(gap) - length(replace(gap, chr(10), ''))) over o as line
  from words window o as (partition by doc_id order by i)
), windows as (
  select h.doc_id, h.k, md5(array_to_string(h.ws[h.k:h.k + {WINDOW - 1}], ' ')) as norm, a.start, z.stop, a.line
  from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as k from heads) h
  join placed a on a.doc_id = h.doc_id and a.i = h.k join placed z on z.doc_id = h.doc_id and z.i = h.k + {WINDOW - 1}
), seen as (
  select *, first_value(doc_id) over o as first_doc_id, first_value(start) over o as first_start, first_value(stop) over o as first_stop, first_value(line) over o as first_line
  from windows window o as (partition by norm order by doc_id, start)
), gone as (
  select *, max(stop) over (partition by doc_id order by start rows between unbounded preceding and 1 preceding) as before
  from seen where first_doc_id <> doc_id or first_stop <= start
), runs as (
  select *, sum(case when start <= before then 0 else 1 end) over (partition by doc_id order by start) as run from gone
), passages as (
  select doc_id, min(line) as unit, min(start) as start, max(stop) as stop, arg_min(first_doc_id, start) as first_doc_id, arg_min(first_line, start) as first_unit
  from runs group by doc_id, run
), copies as (
  select doc_id, text, head, length(regexp_extract(text, '^[\x20\x09-\x0D]*')) as start, length(text) - length(regexp_extract(text, '[\x20\x09-\x0D]*$')) as stop
  from y where doc_id <> head
), whole as (
  select doc_id, length(text[1:start]) - length(replace(text[1:start], chr(10), '')) as unit, start, stop, head as first_doc_id from copies
)
select doc_id, cast(unit as int) as unit, cast(start as int) as start, cast(stop as int) as stop, first_doc_id, cast(first_unit as int) as first_unit
from (
  select doc_id, unit, start, stop, first_doc_id, first_unit from repeated_lines
  union all select doc_id, unit, start, stop, first_doc_id, first_unit from passages
  union all select doc_id, unit, start, stop, first_doc_id, unit from whole
)
"""
}
