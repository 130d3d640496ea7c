"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

Vectors x are lifted to (x/M, sqrt(1-|x|^2/M^2)) with M the largest norm, queries q to
(q/|q|, 0): the order by Euclidean distance is then that by inner product. Each of ``TABLES``
tables hashes by Gaussian projections, floor((a.v + b)/WIDTH), as many as make buckets of about
``FILL`` vectors. A query visits its own bucket and then perturbed ones in estimated order of
success (the precomputed sequence of perturbation sets over the sorted distances to the cell's
borders). How many it visits is fitted on one half of a bounded sample of ``SAMPLE`` queries,
whose exact neighbours are found by a scan, so that ``RECALL`` of these, and two standard errors
of the sample more, lie in visited buckets; the other half measures what that gives. Every row is
indexed.

Buckets are the keys: rows go to the part that owns their bucket, once for each table, and a
query to the parts that own buckets it visits, with the list of these. A part has about
``ROWS`` rows; a bucket of more is split over as many parts by the rows' hashes. A task holds
one part's rows, each once however many of its tables' buckets the part owns, takes its queries
in batches, scores each batch against the buckets it visits by the exact product in double
precision and returns every query's best; the best of all parts are merged. Recall is then
measured on the merged result of the sample's other half.

Where ``PROBES`` probes don't reach ``RECALL``, or the measured recall is under ``LEAST``, all
rows are scored, in blocks of queries and rows; so they are for each query that found fewer
than k rows, or than all there are. ``scanned`` tells which way a row came.

Defined results: vectors null, empty, zero or with null or non-finite components take no
part, as queries or candidates, nor do those of another length than most (ties: the
longest); a query's own row is left out, rows that repeat its id too; of queries that repeat
an id with other vectors the least vector asks; equal vectors are indexed once and each of
their rows is found; equal scores go by smaller vec_id; rows with a null id are no queries and
rank last; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, store

SEED = 7
TABLES, WIDTH, FILL = 4, 3.0, 25
PROBES = 1024  # in a table, at most; beyond them a scan is cheaper
SAMPLE, RECALL, LEAST = 256, 0.94, 0.9
ROWS, TOGETHER = 16_384, 256  # rows of a part, queries scored at once
BLOCK, QUERY_BLOCK = 4096, 2048  # of the scan
MANY = (1 << 63) - 1  # rank of a null id


def perturbations(bits: int, probes: int) -> np.ndarray:
    """[probe, slot] perturbation sets over the sorted 2*bits distances, best first; -1 pads."""
    n = 2 * bits
    cost = [
        j * (j + 1) / (
            4 * (bits + 1) * (bits + 2)
        ) if j <= bits else 1 - (n + 1 - j) / (bits + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (bits + 1) * (bits + 2)) for j in range(1, n + 1)
    ]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        s, a = heapq.heappop(heap)
        if not any(n - 1 - j in a for j in a):
            out.append(a)
        j = a[-1]
        if j + 1 < n:
            heapq.heappush(heap, (s - cost[j] + cost[j + 1], (*a[:-1], j + 1)))
            heapq.heappush(heap, (s + cost[j + 1], (*a, j + 1)))
    table = np.full((len(out), bits), -1, np.int64)
    for k, a in enumerate(out):
        table[k, : len(a)] = a
    return table


class Hashes:
    """Projections of all tables, and bucket keys."""

    def __init__(self, dim: int, largest: float, rows: int):
        rng = np.random.default_rng(SEED)
        self.bits = max(4, min(24, round(math.log2(max(1, rows) / FILL + 1))))
        self.largest = largest
        self.a = rng.normal(size=(TABLES, dim + 1, self.bits))
        self.b = rng.uniform(0, WIDTH, size=(TABLES, 1, self.bits))

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1))
        if query:
            return np.hstack([x / norm[:, None], np.zeros((len(x), 1))])
        return np.hstack([x / self.largest, np.sqrt(np.maximum(0.0, 1.0 - (norm / self.largest) ** 2))[:, None]])

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.full(cells.shape[:-1], table + 1, np.int64)
            for i in range(self.bits):
                h = (h * 1000003) ^ (cells[..., i] + 1013 * (i + 1))
        return h

    def of(self, x: np.ndarray) -> np.ndarray:
        """[row, table] bucket keys of vectors."""
        v = self.lift(x, False)
        return np.stack([self.keys(np.floor((v @ self.a[t] + self.b[t]) / WIDTH).astype(np.int64), t) for t in range(TABLES)], 1)

    def probes(self, q: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """[row, table, probe] bucket keys that queries visit, in order."""
        v = self.lift(q, True)
        out = np.empty((len(q), TABLES, len(sets)), np.int64)
        for t in range(TABLES):
            f = (v @ self.a[t] + self.b[t]) / WIDTH
            cell = np.floor(f).astype(np.int64)
            order = np.argsort(np.concatenate([f - cell, 1 - (f - cell)], 1), axis=1, kind="stable")
            for k, a in enumerate(sets):
                c = cell.copy()
                for j in a[a >= 0]:
                    at = order[:, j]
                    c[np.arange(len(q)), at % self.bits] += np.where(at < self.bits, -1, 1)
                out[:, t, k] = self.keys(c, t)
        return out


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same for a pair of vectors wherever it stands."""
    return np.add.reduce(x * y, axis=-1)


def clean(rows: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int, float]:
    """(vec_id, v) of the vectors that take part, their length and largest norm."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")
    ).filter("v is not null and size(v) > 0").filter(~bad).filter(F.exists("v", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = ok.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(norm).alias("norm"))
    top = sizes.orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    if not top:
        return ok, 0, 1.0
    return ok.filter(F.size("v") == top[0]["n"]), top[0]["n"], top[0]["norm"]


def _exact(queries: np.ndarray, groups: DataFrame, k: int) -> dict:
    """Exact neighbours of a few queries by a scan: query position -> (g1, g2, v) of vectors."""
    held = groups.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]):
        q = held.value
        for b in batches:
            if b.num_rows:
                s = q @ _matrix(b.column(2)).T
                n = min(k, s.shape[1])
                at = np.argpartition(-s, n - 1, axis=1)[:, :n]
                own = pa.array(np.repeat(np.arange(len(q)), n))
                at = pa.array(at.ravel())
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(np.take_along_axis(s, at.to_numpy().reshape(len(q), n), 1).ravel()), *(c.take(at) for c in b.columns)],
                    names=["q", "s", "g1", "g2", "v"]
                )

    best = groups.select("g1", "g2", "v").mapInArrow(run, "q long, s double, g1 long, g2 long, v array<double>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "g1", "g2"))
    out: dict = {}
    for r in best.withColumn("r", rank).filter(F.col("r") <= k).orderBy("q", "r").collect():
        out.setdefault(r["q"], []).append((r["g1"], r["g2"], r["v"]))
    return out


def fit(hashes: Hashes, groups: DataFrame, queries: DataFrame, k: int) -> tuple[np.ndarray, dict]:
    """Perturbation sets to visit (none: they don't suffice), and {query: its exact neighbours (g1, g2)} held out."""
    sets = perturbations(hashes.bits, PROBES)
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").collect()
    if not sample:
        return sets[:1], {}
    q = np.array([r["v"] for r in sample], np.float64)
    near = _exact(q, groups, k + 1)
    visited = hashes.probes(q, sets)
    first, held = [], {}
    for i, found in near.items():
        other = [x for x in found if (np.array(x[2]) != q[i]).any()][:k]  # its own vector is found always
        if i % 2 or len(near) == 1:
            held[sample[i]["vec_id"]] = {x[:2] for x in other}
        if i % 2 == 0 and other:
            for row in hashes.of(np.array([x[2] for x in other], np.float64)):
                hit = (visited[i] == row[:, None]).any(0)
                first.append(int(hit.argmax()) if hit.any() else len(sets))
    if not first:
        return sets[:1], held
    aim = min(1.0, RECALL + 2 * math.sqrt(RECALL * (1 - RECALL) / len(first)))
    need = int(np.quantile(np.array(first), aim, method="higher")) + 1
    return sets[: need if need <= len(sets) else 0], held


def measured(best: DataFrame, held: dict) -> float:
    """Part of the held-out queries' exact neighbours that the merged vectors (:func:`_top`) have; at most SAMPLE queries are read."""
    wanted = sum(len(v) for v in held.values())
    if not wanted:
        return 1.0
    rows = best.filter(F.col("query_id").isin(list(held))).select("query_id", "g1", "g2").collect()
    return sum((r["g1"], r["g2"]) in held[r["query_id"]] for r in rows) / wanted


def neighbours(rows: DataFrame, queries: DataFrame, *, k=20, vec_id="vec_id", vector="embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, recall, scanned): the k nearest rows of each query that were found, k if there are as many.

    recall is that of the held-out sample's queries, 1 where all rows were scored (scanned).
    """
    spark = rows.sparkSession
    ship(spark)
    ok, dim, largest = clean(rows, vec_id, vector)
    asked = clean(queries, vec_id, vector)[0].filter("vec_id is not null")
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, recall double, scanned boolean")
    asked = asked.filter(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    # equal vectors: k + 1 smallest ids of each are all that a query can return
    same = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    own = ok.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1)
    own = own.select(F.xxhash64("v").alias("g1"), F.xxhash64(F.lit(SEED), "v").alias("g2"), "vec_id", F.when(F.col("r") == 1, F.col("v")).alias("v"))
    members = store(own, "members")
    groups = members.filter("v is not null").select("g1", "g2", F.coalesce("vec_id", F.lit(MANY)).alias("least"), "v")
    asked = store(asked, "queries")
    n = groups.count()
    hashes = Hashes(dim, float(largest), n)
    sets, held = fit(hashes, groups, asked, k)

    def scanned(some: DataFrame) -> DataFrame:
        out = _spread(_top(_scan(groups, some, k), k), members, k)
        return out.withColumn("recall", F.lit(1.0)).withColumn("scanned", F.lit(True))

    if not len(sets):
        return scanned(asked)
    best = store(_top(_visit(groups, n, asked, hashes, sets, k), k), "best")
    recall = measured(best, held)
    if recall < LEAST:
        return scanned(asked)
    out = _spread(best, members, k).withColumn("recall", F.lit(recall)).withColumn("scanned", F.lit(False))
    out = store(out, "found")
    total = ok.count()
    rest = ok.groupBy("vec_id").agg((total - F.count("*")).alias("others"))
    got = out.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("got"))
    few = asked.join(rest, "vec_id", "left").join(got, "vec_id", "left")
    few = few.filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.coalesce("others", F.lit(total)))).select("vec_id", "v")
    few = store(few, "short-queries")
    if not few.limit(1).count():
        return out
    whole = out.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return whole.unionByName(scanned(few))


_BEST = "query_id long, g1 long, g2 long, least long, score double"


def _best(ids: np.ndarray, q: np.ndarray, seen: np.ndarray, d: np.ndarray, names: np.ndarray, k: int) -> pd.DataFrame:
    """Of each query (row of ``seen``) the k + 1 best candidates, with exact scores; -inf: not a candidate."""
    top = min(seen.shape[1], k + 1)
    part = np.partition(seen, seen.shape[1] - top, axis=1)[:, seen.shape[1] - top :]
    at_q, at_d = np.nonzero((seen >= (part.min(1) - 1e-12)[:, None]) & (seen > -np.inf))
    out = pd.DataFrame({"query_id": ids[at_q], "g1": names[at_d, 0], "g2": names[at_d, 1], "least": names[at_d, 2], "score": dot(q[at_q], d[at_d])})
    out = out.sort_values(["query_id", "score", "least", "g1", "g2"], ascending=[True, False, True, True, True])
    return out.groupby("query_id").head(k + 1)


class _Part:
    """Vectors of one part, each once, and by bucket the places of its vectors."""

    def __init__(self, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches)
        order = np.argsort(t.column("key").to_numpy(), kind="stable")
        self.keys = t.column("key").to_numpy()[order]
        names = np.stack([t.column(c).to_numpy() for c in ("g1", "g2", "least")], 1)
        self.names, one, at = np.unique(names, axis=0, return_index=True, return_inverse=True)
        self.d = _matrix(t.column("v").combine_chunks().take(pa.array(one)))
        self.at = at.reshape(-1)[order]
        self.buckets, self.first = np.unique(self.keys, return_index=True)
        self.last = np.append(self.first[1:], len(self.keys))

    def ask(self, b: pa.RecordBatch, k: int) -> pd.DataFrame:
        """Best candidates of the batch's queries in the buckets that they visit."""
        lists = b.column("visits")
        who = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        keys = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.buckets, keys), len(self.buckets) - 1)
        hit = self.buckets[at] == keys
        who, at = who[hit], at[hit]
        q, seen = _matrix(b.column("v")), np.full((len(lists), len(self.d)), -np.inf)
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        edges = np.flatnonzero(np.diff(at)) + 1
        for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
            if x < y:
                own, here = who[x:y], self.at[self.first[at[x]] : self.last[at[x]]]
                seen[np.ix_(own, here)] = q[own] @ self.d[here].T
        return _best(b.column("g1").to_numpy(), q, seen, self.d, self.names, k)


_PART = "part int, kind int, g1 long, g2 long, least long, key long, v array<double>, visits array<long>"


def _visit(groups: DataFrame, n: int, asked: DataFrame, hashes: Hashes, sets: np.ndarray, k: int) -> DataFrame:
    """Best candidates of each query and part (_BEST): rows and queries meet at the parts that own buckets."""
    spark = groups.sparkSession
    held = spark.sparkContext.broadcast((hashes, sets))

    def index(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                keys = held.value[0].of(_matrix(b.column(3)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=["g1", "g2", "least", "v", "keys"])

    indexed = store(groups.mapInArrow(index, "g1 long, g2 long, least long, v array<double>, keys array<long>"), "indexed")
    each = indexed.select("g1", "g2", "least", "v", F.explode("keys").alias("key"))
    # buckets of more than a part's rows; there are fewer of them than there are parts
    hot = {r["key"]: -(-r["n"] // ROWS) for r in each.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > ROWS).collect()}
    parts = max(1, -(-n * TABLES // ROWS))
    split = spark.sparkContext.broadcast(hot)

    def owners(keys: np.ndarray, slot: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (keys.astype(np.uint64) + slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
            return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)

    def deal(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            keys, g1 = b.column(4).to_numpy(), b.column(0).to_numpy()
            ways = np.fromiter((split.value.get(x, 1) for x in keys.tolist()), np.int64, len(keys))
            none = pa.nulls(len(keys), pa.list_(pa.int64()))
            part = owners(keys, (g1 & 0x7FFFFFFF) % ways)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(np.zeros(len(keys), np.int32)), *b.columns[:3], b.column(4), b.column(3), none],
                names=["part", "kind", "g1", "g2", "least", "key", "v", "visits"]
            )

    def send(batches: Iterator[pa.RecordBatch]):
        h, order = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(start, TOGETHER)
                ask = np.sort(h.probes(_matrix(b.column(1)), order).reshape(b.num_rows, -1), axis=1)
                who, keys = np.repeat(np.arange(b.num_rows), ask.shape[1]), ask.ravel()
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])
                who, keys = who[new], keys[new]
                ways = np.fromiter((split.value.get(x, 1) for x in keys.tolist()), np.int64, len(keys))
                at = np.repeat(np.arange(len(keys)), ways)
                slot = np.arange(len(at)) - np.repeat(np.cumsum(ways) - ways, ways)
                part = owners(keys[at], slot)
                order_ = np.lexsort((part, who[at]))
                who_, part_, keys_ = who[at][order_], part[order_], keys[at][order_]
                edge = np.flatnonzero(np.append(True, (who_[1:] != who_[:-1]) | (part_[1:] != part_[:-1])))
                row, m = who_[edge], len(edge)
                zero = pa.array(np.zeros(m, np.int64))
                visits = pa.ListArray.from_arrays(pa.array(np.append(edge, len(keys_)), pa.int32()), pa.array(keys_))
                ids, vs = (b.column(c).take(pa.array(row)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part_[edge]), pa.array(np.ones(m, np.int32)), ids, zero, zero, zero, vs, visits],
                    names=["part", "kind", "g1", "g2", "least", "key", "v", "visits"]
                )

    def search(batches: Iterator[pa.RecordBatch]):
        part, rows, index = None, [], None
        for whole in batches:
            tags = whole.column(0).to_numpy().astype(np.int64) * 2 + whole.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), len(tags)]
            for x, y in zip(edges, edges[1:]):
                if x == y:
                    continue
                here, kind = divmod(int(tags[x]), 2)
                if here != part:
                    part, rows, index = here, [], None
                if kind == 0:
                    rows.append(whole.slice(x, y - x))
                    continue
                if not rows:
                    continue
                index = index or _Part(rows)
                for at in range(x, y, TOGETHER):
                    best = index.ask(whole.slice(at, min(TOGETHER, y - at)), k)
                    yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    data = each.mapInArrow(deal, _PART)
    wanted = asked.mapInArrow(send, _PART)
    met = data.unionByName(wanted).repartition(parts, "part").sortWithinPartitions("part", "kind")
    return met.mapInArrow(search, _BEST)


def _scan(groups: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Best candidates of each query and block of rows (_BEST), all rows scored."""
    n, m = groups.count(), asked.count()
    blocks, q_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    far, near = F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit(q_blocks - 1))
    data = groups.select("g1", "g2", "least", "v", F.pmod("g1", F.lit(blocks)).cast("int").alias("db"), F.explode(near).alias("qb"))
    wanted = asked.select("vec_id", "v", F.explode(far).alias("db"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb"))

    def block(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"query_id": [], "g1": [], "g2": [], "least": [], "score": []})
        qm, dm = _matrix(q["v"]), _matrix(d["v"])
        return _best(q["vec_id"].to_numpy(), qm, qm @ dm.T, dm, d[["g1", "g2", "least"]].to_numpy(), k)

    return wanted.groupBy("qb", "db").cogroup(data.groupBy("qb", "db")).applyInPandas(block, _BEST)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 best vectors of each query, from the best of all parts; one met in several parts counts once."""
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "least", "g1", "g2"))
    return found.distinct().withColumn("r", first).filter(F.col("r") <= k + 1).drop("r")


def _spread(best: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, from its best vectors (:func:`_top`)."""
    spread = best.join(members.drop("v"), ["g1", "g2"]).filter("query_id <> vec_id or vec_id is null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    out = spread.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found of every vector whose id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours(rows, rows.filter("vec_id % 20 = 0"))


QUERIES = {"op8_neighbours": op8_neighbours}
ORACLE: dict[str, str] = {}
