"""Periodic runs of words, by partition refinement over equal factors.

Positions of a text fall into classes: two are in one class of level q if the q words from
there are equal. Level q + 1 splits the classes of level q by the class of the next position;
of the parts that a class falls into, all but the largest serve as splitters of the level
after (the smaller-half strategy), so that a position is looked at O(log n) times. Class
members are linked in order of place. Members that are neighbours in a class of level q and
stand q words apart begin a square of period q, and that period is the smallest one (else a
member would stand between them). Squares of one period at consecutive places are merged
into a maximal run.

Neighbours are only recorded when a link is made or breaks: a link of distance d that holds
from level b up to level e is a square if b <= d <= e. A class of fewer members than a run
has periods is no longer split. The texts of a batch are refined together, as one sequence
with a border of its own after each text; words of different texts are different letters.

A text's work is n log n in its words, and a task holds a batch of about BATCH bytes or one
text, whichever is more; no rows are shuffled.

Defined results: null texts and texts without a word have no run and an empty collapsed
text; rows are independent, so repeated rows, ties, null ids and an empty table need no
rule; equal lengths are told apart by start, then period; all columns of the input are kept in
``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, ship

PERIODS = 4  # a run repeats its period so many times at least
SHORTEST = 6  # and has so many words at least
BATCH = 4_000_000  # bytes of text refined together
_NONE = np.int64(-1)


class Refinement:
    """Classes of equal factors over a sequence of letters, and the squares that their links show.

    ``limit`` is the longest period that matters at each place; ``least`` members make a class
    worth splitting.
    """

    def __init__(self, letters: np.ndarray, limit: np.ndarray, least: int):
        n = len(letters)
        self.limit, self.least = limit, least
        self.members = np.argsort(letters, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(letters[self.members]) != 0])) if n else np.empty(0, np.int64)
        count = np.diff(np.append(first, n))
        self.cls, self.place = np.empty(n, np.int64), np.empty(n, np.int64)
        self.cls[self.members] = np.repeat(np.arange(len(first)), count)
        self.place[self.members] = np.arange(n)
        # classes by number; there are never more than places
        self.start, self.size, self.died = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.classes = len(first)
        self.start[: len(first)], self.size[: len(first)] = first, count
        self.next, self.prev, self.birth = np.full(n, _NONE), np.full(n, _NONE), np.ones(n, np.int64)
        inner = np.ones(n, bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        self.next[self.members[at - 1]] = self.members[at]
        self.prev[self.members[at]] = self.members[at - 1]
        self.moved = np.zeros(n, bool)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) of every square whose class kept ``least`` members, in no order."""
        level, top = 1, int(self.limit.max(initial=0))
        small = np.arange(1, len(self.cls))
        while len(small) and level < top:
            level += 1
            small = self._refine(small, level)
        alive = np.flatnonzero(self.next >= 0)
        d = self.next[alive] - alive
        died = self.died[self.cls[alive]]
        ok = (self.birth[alive] <= d) & (d <= self.limit[alive]) & ((died == 0) | (d < died))
        self.found.append((alive[ok], d[ok]))
        return np.concatenate([f[0] for f in self.found]), np.concatenate([f[1] for f in self.found])

    def _refine(self, small: np.ndarray, level: int) -> np.ndarray:
        """Split by the classes of the places in ``small``; gives the places that split the next level."""
        p = small - 1
        c = self.cls[p]
        use = (self.size[c] >= self.least) & (self.limit[p] >= level)
        p, c, by = p[use], c[use], self.cls[small[use]]
        if not len(p):
            return p
        order = np.lexsort((p, by, c))
        p, c, by = p[order], c[order], by[order]
        # groups: places of one class with one splitter
        new_class = np.concatenate([[True], c[1:] != c[:-1]])
        new_group = new_class | np.concatenate([[True], by[1:] != by[:-1]])
        g_at = np.flatnonzero(new_group)
        g_size = np.diff(np.append(g_at, len(p)))
        g_class = c[g_at]
        c_at = np.flatnonzero(np.concatenate([[True], g_class[1:] != g_class[:-1]]))  # in groups
        c_groups = np.diff(np.append(c_at, len(g_at)))
        taken, most = np.add.reduceat(g_size, c_at), np.maximum.reduceat(g_size, c_at)
        # where no other place is left, the first of the largest groups keeps the class
        whole = np.repeat(taken == self.size[g_class[c_at]], c_groups)
        largest = g_size == np.repeat(most, c_groups)
        rank = np.cumsum(largest)
        first_largest = largest & (rank - np.repeat(rank[c_at] - largest[c_at], c_groups) == 1)
        go = ~(whole & first_largest)
        if not go.any():
            return p[:0]
        stays = np.repeat(go, g_size)
        p, g_size, g_class = p[stays], g_size[go], g_class[go]
        c_at = np.flatnonzero(np.concatenate([[True], g_class[1:] != g_class[:-1]]))
        c_groups = np.diff(np.append(c_at, len(g_class)))
        ids = g_class[c_at]
        taken, most = np.add.reduceat(g_size, c_at), np.maximum.reduceat(g_size, c_at)
        left = self.size[ids] - taken

        # links, in order of place within a class
        own = np.repeat(np.arange(len(ids)), taken)  # number of p's class
        by_place = np.argsort(own * len(self.cls) + p)
        m = p[by_place]
        self.moved[m] = True
        head = np.concatenate([[True], (self.next[m[:-1]] != m[1:])])
        tail = np.concatenate([head[1:], [True]])
        before, after = self.prev[m[head]], self.next[m[tail]]
        g_end = np.cumsum(g_size)
        succ = np.append(p[1:], _NONE)
        succ[g_end - 1] = _NONE
        pred = np.concatenate([[_NONE], p[:-1]])
        pred[g_end - g_size] = _NONE
        has = before >= 0
        self._relink(np.concatenate([p, before[has]]), np.concatenate([succ, after[has]]), level)
        self.prev[p] = pred
        has = after >= 0
        self.prev[after[has]] = before[has]

        # members: those that go stand at the end of their class's stretch, group by group
        ends = self.start[ids] + left
        zone = np.repeat(ends - (np.cumsum(taken) - taken), taken) + np.arange(len(p))
        sitting = self.members[zone]
        sitting = sitting[~self.moved[sitting]]
        holes = self.place[p]
        holes = holes[holes < np.repeat(ends, taken)]
        self.members[holes], self.place[sitting] = sitting, holes
        self.members[zone], self.place[p] = p, zone
        self.moved[m] = False
        fresh = np.arange(self.classes, self.classes + len(g_size))
        self.classes += len(g_size)
        self.cls[p] = np.repeat(fresh, g_size)
        self.start[fresh], self.size[fresh] = zone[g_end - g_size], g_size
        self.size[ids] = left
        touched = np.concatenate([fresh, ids])
        self.died[touched[self.size[touched] < self.least]] = level

        # smaller halves: all parts but the largest
        over = left < most
        largest = g_size == np.repeat(most, c_groups)
        rank = np.cumsum(largest)
        first_largest = largest & (rank - np.repeat(rank[c_at] - largest[c_at], c_groups) == 1)
        kept = ~(np.repeat(over, c_groups) & first_largest)
        rest = ids[over]
        return np.concatenate([p[np.repeat(kept, g_size)], self.members[_ranges(self.start[rest], self.size[rest])]])

    def _relink(self, i: np.ndarray, to: np.ndarray, level: int) -> None:
        old = self.next[i]
        changed = old != to
        i, to, old = i[changed], to[changed], old[changed]
        d = old - i
        ok = (old >= 0) & (self.birth[i] <= d) & (d < level) & (d <= self.limit[i])
        if ok.any():
            self.found.append((i[ok], d[ok]))
        self.next[i], self.birth[i] = to, level


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each start and size, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def runs_of(texts: list[np.ndarray], periods: int = PERIODS, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, by text, start and period; a text is an array of letters >= 0."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    if not (n >= shortest).any():
        return (np.empty(0, np.int64),) * 4
    base = np.cumsum(n + 1) - (n + 1)
    width = max(int(t.max(initial=0)) for t in texts) + 2
    letters = np.empty(int((n + 1).sum()), np.int64)
    for k, t in enumerate(texts):
        letters[base[k] : base[k] + n[k]] = t + np.int64(k * width)
    letters[base + n] = np.arange(len(texts)) * width + (width - 1)
    place, d = Refinement(letters, np.repeat(n // periods, n + 1), max(2, periods - 1)).squares()
    order = np.lexsort((place, d))
    place, d = place[order], d[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (place[1:] != place[:-1] + 1)])[: len(d)]
    at = np.flatnonzero(new)
    period = d[at]
    length = np.diff(np.append(at, len(d))) - 1 + 2 * period
    long = length >= np.maximum(shortest, periods * period)
    start, length, period = place[at][long], length[long], period[long]
    text = np.searchsorted(base, start, side="right") - 1
    start = start - base[text]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


class _Letters(dict):
    """word -> number, in order of first sight."""

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        return n


def _chunks(size: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers by size, about BATCH bytes at a time and one row at least: texts of like length share their levels."""
    order = np.argsort(size, kind="stable")
    upto = np.cumsum(size[order] + 64)
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH, side="right")))
        yield order[at:end]
        at = end


def _solve(texts: pa.Array, periods: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """Words of each text, (offsets, runs) and the collapsed texts."""
    rows = len(texts)
    words, collapsed, found = np.zeros(rows, np.int64), [b""] * rows, []
    for some in _chunks(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
        split = [(t or b"").split() for t in texts.take(pa.array(some)).to_pylist()]
        words[some] = list(map(len, split))
        ids = _Letters()
        coded = [np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in split]
        text, start, length, period = runs_of(coded, periods, shortest)
        found.append((some[text], start, length, period))
        upto = np.searchsorted(text, np.arange(len(some) + 1))
        for k, w in enumerate(split):
            a, b = upto[k], upto[k + 1]
            if a < b:
                drop = np.zeros(len(w) + 1, np.int64)
                np.add.at(drop, start[a:b] + period[a:b], 1)
                np.add.at(drop, start[a:b] + length[a:b], -1)
                w = [w[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
            collapsed[some[k]] = b" ".join(w)
    text, start, length, period = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4
    order = np.argsort(text, kind="stable")
    offsets = np.searchsorted(text[order], np.arange(rows + 1))
    return words, offsets, np.stack([start[order], length[order], period[order]]), collapsed


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def find_runs(docs: DataFrame, *, text="text", periods: int = PERIODS, shortest: int = SHORTEST) -> DataFrame:
    """(row, words, runs, collapsed): the runs of each row's words and its text without their repetitions.

    ``row`` has all columns of ``docs``; ``words`` counts the words ``[^\\x20\\x09-\\x0D]+``;
    ``runs`` is an array of (start, length, period) by start, then period; ``collapsed`` has the
    words that no run holds after its first period, joined by one space.
    """
    return _found(packed(docs, text=text), periods, shortest)


def _found(rows: DataFrame, periods: int = PERIODS, shortest: int = SHORTEST) -> DataFrame:
    ship(rows.sparkSession)
    schema = rows.select("row", F.lit(0).cast("long").alias("words"), F.lit(None).cast(f"array<{RUN}>").alias("runs"), F.lit("").alias("collapsed")).schema
    run_type = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False)
            # slices bound what is held beside the batch itself
            cut = np.flatnonzero(np.diff(np.cumsum(size) // (4 * BATCH), prepend=0)).tolist()
            for a, b in zip([0, *cut], [*cut, whole.num_rows]):
                if a == b:
                    continue
                part = whole.slice(a, b - a)
                words, offsets, found, collapsed = _solve(part.column("text").cast(pa.binary()), periods, shortest)
                runs = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in found], fields=list(run_type))
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(words), runs, pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["row", "words", "runs", "collapsed"],
                )

    return rows.select("row", "text").mapInArrow(run, schema)


def _planted(doc_id, text):
    """The text whose words repeat from a place on, for one document in ten (crc32 of the id divisible by 10)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    w = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        turned = F.transform(words, lambda x, i: F.when(i < a, x).otherwise(F.element_at(words, (a + F.pmod(i - a, p) + 1).cast("int"))))
        return F.when(n > 0, F.array_join(turned, " ")).otherwise(F.lit(""))

    # a lambda binds the words, which would else be split once for each of their words
    told = F.element_at(F.transform(F.array(w), repeated), 1)
    return F.when(F.pmod(h, F.lit(10)) == 0, told).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document's words, its longest run and digests of its runs and of its collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.select(F.struct("doc_id").alias("row"), _planted(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("n"), (-r.start).alias("s"), (-r.period).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return _found(rows).select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(F.col("best.n") * 1000 / -F.col("best.p")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def oracle() -> dict[str, str]:
    """Pairs of equal words within a fourth of a text, chained into stretches by period; the least period of a stretch counts."""
    bit = "list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),"
        f" lambda acc, b: list_extract(list_transform([xor(acc, b)], lambda c: {bit}), 1)), 4294967295)"
    )
    sql = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, {crc} AS h,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS o
  FROM documents),
s AS (SELECT *, len(o) AS n, h // 10 AS g FROM d),
t AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a,
    CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p
  FROM s),
w AS (
  SELECT rid, i, o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS word, n
  FROM (SELECT rid, a, p, n, o, unnest(range(n)) AS i FROM t)),
pairs AS (
  SELECT x.rid, x.i, y.i - x.i AS q
  FROM w x JOIN w y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
stretches AS (
  SELECT rid, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs)
  GROUP BY rid, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT rid, start, length, min(q) AS period FROM stretches GROUP BY rid, start, length),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid),
told AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY rid),
best AS (
  SELECT rid, start, length, period
  FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) AS k FROM runs) WHERE k = 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid) LEFT JOIN best USING (rid)
"""
    return {"op13_periodic_runs": sql}


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
