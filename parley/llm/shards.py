"""Sharding by balanced label propagation.

Documents of equal text are linked. Linked documents of one starting shard move together,
as a node; a group so large that a node would weigh more than ``1/GRAIN`` of a shard is cut
into more nodes by a hash of the id, so that no node is hard to place. All rounds work on
the table of nodes, which is as long as the distinct texts at most and holds no text.

A round sums each group's bytes by shard, lets every node ask for the shard where most of
its group is (ties: by hash), and grants moves under quotas: between two shards as many
bytes as ask in the other direction, and beyond that what linked nodes may still fill of
the target. Requests are granted by ``STEPS`` hash steps for each pair of shards, whose
bytes are the only thing the driver reads. Rounds end when less than ``STILL`` of the bytes
ask or nothing is granted, at the latest after ``ROUNDS``. Then nodes without links move from shards above the mean to those
below it until sizes are even, planned in the same way on a histogram. Linked ones move only
from shards still more than ``SLACK`` over the mean, a group's nodes of one shard together; only
groups of more than ``SLACK`` of a shard are parted. :func:`cut_edges` counts what is left apart.

Defined results: a null text has size 1 and is linked with nothing (each such row is alone
by its id); an empty text has size 1; texts of any length are hashed and sized whole; a null id
is hashed as such; rows equal in id and text go to one shard, in adjacent slots; an empty
table gives an empty table; other columns are kept as they are, but for size, text_crc32,
law, shard and slot, which are replaced.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, packed, store, without

GRAIN = 256
STEPS = 256
FINE = 4096
ROUNDS, STILL = 16, 0.0002
SLACK = 0.01  # of a shard: what is left uneven rather than moving linked nodes, and groups that are kept whole
FILL = 0.98  # part of a shard that linked nodes may fill while labels move
SLOT_ROWS = 20_000  # rows numbered by one task at once
MOST_BUCKETS = 10_000  # counts of buckets (40 bytes for each shard) up to which they are broadcast


def _node_columns(docs: DataFrame, doc_id: str, text: str, shards: int) -> DataFrame:
    """(row, id, size, group, hash, start): all columns in ``row``; group tells equal texts, start is the first shard."""
    rows = packed(docs, id=doc_id, text=text)
    own = F.concat(F.lit("null:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = rows.withColumns({
        "size": F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")) + 1, "crc": F.crc32(F.col("text").cast("binary")),
        "group": F.when(F.col("text").isNull(), F.md5(own)).otherwise(F.md5("text")),
    }).drop("text")
    return rows.withColumn(
        "hash", F.xxhash64(F.col("id").cast("string"), F.col("group"))
    ).withColumn("start", F.pmod("hash", F.lit(shards)).cast("int"))


def _piece(total: int, shards: int):
    """Part of its group's rows of one starting shard that a document belongs to."""
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("held") * shards * GRAIN / F.lit(max(1, total))))
    return F.when(parts > 1, F.pmod(F.shiftright("hash", 20), parts)).otherwise(F.lit(0).cast("long"))


def _grant(asked: dict[tuple[int, int], list[tuple[int, int]]], load: list[int], cap: float) -> list[tuple[int, int, int]]:
    """(from, to, hash step) of the requests that are granted."""
    want = {k: sum(b for _, b in v) for k, v in asked.items()}
    quota = {(i, j): float(min(b, want.get((j, i), 0))) for (i, j), b in want.items()}
    for j in range(len(load)):
        room = max(0.0, cap - load[j])
        more = {k: want[k] - quota[k] for k in want if k[1] == j}
        all_more = sum(more.values())
        for k, b in more.items():
            quota[k] += b * min(1.0, room / all_more) if all_more else 0
    granted = []
    for (i, j), steps in sorted(asked.items()):
        left = quota[(i, j)]
        for step, b in sorted(steps):
            if b <= left:
                left -= b
                granted.append((i, j, step))
    return granted


def _level(cells: dict[int, list[tuple[int, int, int]]], load: list[int]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Even out: (shard, step) cells to move, as (linked, step) -> target, by greedy fitting.

    cells: shard -> (linked, step, bytes); those without links are taken first.
    """
    mean = sum(load) / len(load)
    load = list(load)
    moves: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for linked in (0, 1):
        for i in sorted(range(len(load)), key=lambda x: -load[x]):
            for _, step, b in sorted((c for c in cells.get(i, ()) if c[0] == linked), key=lambda c: (-c[2], c[1])):
                j = min(range(len(load)), key=lambda x: load[x])
                if load[i] - b >= mean - b / 2 and load[j] + b <= mean + b / 2 and load[i] - load[j] > b and (not linked or load[i] > mean * (1 + SLACK)):
                    load[i] -= b
                    load[j] += b
                    moves[(i, linked)].append((step, j))
    return moves


def place_keys(docs: DataFrame, **kind) -> DataFrame:
    """:func:`place` without ``row``."""
    return place(docs, keep=False, **kind)


def place(docs: DataFrame, *, shards=8, doc_id="doc_id", text="text", keep=True) -> DataFrame:
    """(row, id, size, crc, group, hash, shard) of each document, stored; shard from 0."""
    rows = _node_columns(docs, doc_id, text, shards)
    if not keep:  # what is left of a document is a few numbers: hashed once
        rows = store(rows.drop("row"), "sizes")
    key = ["group", "start"]
    held = store(rows.groupBy(*key).agg(F.sum("size").alias("held"), F.count("*").alias("rows")), "held")
    total = held.agg(F.sum("held")).collect()[0][0] or 0
    # only cells of large groups are cut; they are few: less than shards * GRAIN * 2
    large = F.broadcast(held.filter(F.col("held") * shards * GRAIN > total).select(*key, "held"))
    cut = rows.join(large, key, "left").withColumn(
        "held", F.coalesce("held", F.lit(0).cast("long"))
    ).withColumn("piece", _piece(total, shards)).drop("held")
    pieces = cut.filter(F.col("piece") >= 0).join(large.select(*key), key, "left_semi").groupBy(*key, "piece").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows")
    )
    whole = held.join(large.select(*key), key, "left_anti").select(*key, F.lit(0).cast("long").alias("piece"), F.col("held").alias("bytes"), "rows")
    nodes = whole.unionByName(pieces)
    sizes = nodes.groupBy("group").agg(F.sum("rows").alias("all"), F.sum("bytes").alias("mass"))
    nodes = nodes.join(sizes, "group").select(
        *key, "piece", "bytes", "rows", (F.col("all") > 1).cast("int").alias("linked"), F.col("start").alias("shard"),
        (F.col("mass") * shards <= SLACK * total).alias("small")
    )
    nodes = store(nodes.withColumn("h", F.xxhash64(*key, "piece")), "nodes")

    def loads(t: DataFrame) -> list[int]:
        got = {r["shard"]: r["b"] for r in t.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
        return [got.get(i, 0) for i in range(shards)]

    def relabelled(t: DataFrame, moves: list, on: list[str]) -> DataFrame:
        """Nodes after the moves (on..., goal); of these there are shards * shards * FINE at most."""
        to = F.broadcast(docs.sparkSession.createDataFrame(moves, ", ".join(f"{c} int" for c in [*on, "goal"])))
        return store(t.join(to, on, "left").withColumn("shard", F.coalesce("goal", "shard")).select(*columns), "nodes")

    columns = nodes.columns
    load = loads(nodes.filter("linked = 1"))
    for _ in range(ROUNDS):
        here = nodes.filter("linked = 1").groupBy("group", "shard").agg(F.sum("bytes").alias("b"))
        best = here.groupBy("group").agg(
            F.max(F.struct("b", F.xxhash64("group", "shard").alias("x"), F.col("shard").alias("to"))).alias("m"), F.count("*").alias("n")
        ).filter("n > 1").select("group", F.col("m.to").alias("to"))
        step = F.pmod("h", F.lit(STEPS)).cast("int")
        asks = store(nodes.join(best, "group", "left").withColumn("to", F.coalesce("to", "shard")).withColumn("step", step), "asks")
        asked: dict = defaultdict(list)
        for r in asks.filter("shard <> to").groupBy("shard", "to", "step").agg(F.sum("bytes").alias("b")).collect():
            asked[(r["shard"], r["to"])].append((r["step"], r["b"]))
        granted = _grant(asked, load, FILL * total / shards)
        if not granted:
            drop_stored(asks)
            break
        moved = relabelled(asks, [(i, j, s, j) for i, j, s in granted], ["shard", "to", "step"])
        drop_stored(asks, nodes)
        nodes = moved
        load = loads(nodes.filter("linked = 1"))
        if sum(b for v in asked.values() for _, b in v) < STILL * total:
            break
    load = loads(nodes)
    # even sizes, in two passes: a second one deals with what the first one's steps left
    for fine in range(2):
        by = F.when(F.col("small"), F.xxhash64("group")).otherwise(F.col("h"))
        step = F.pmod(F.shiftright(by, 12 * (fine + 1)), F.lit(FINE)).cast("int")
        cells: dict = defaultdict(list)
        for r in nodes.groupBy("shard", "linked", step.alias("step")).agg(F.sum("bytes").alias("b")).collect():
            cells[r["shard"]].append((r["linked"], r["step"], r["b"]))
        plan = _level(cells, load)
        if not plan:
            break
        flat = [(i, linked, x, j) for (i, linked), v in plan.items() for x, j in v]
        moved = relabelled(nodes.withColumn("step", step), flat, ["shard", "linked", "step"])
        drop_stored(nodes)
        nodes = moved
        load = loads(nodes)
    at = nodes.select(*key, "piece", "shard")
    return store(cut.join(at, [*key, "piece"]).drop("start", "piece"), "placed")


def cut_edges(placed: DataFrame) -> DataFrame:
    """(edges, cut): pairs of documents with equal texts, and those of them in different shards; placed: see :func:`place`."""
    pairs = lambda n: n * (n - 1) / 2
    here = placed.groupBy("group", "shard").agg(F.count("*").cast("double").alias("n"))
    by = here.groupBy("group").agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("kept"))
    return by.agg(
        F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("edges"), F.coalesce(F.sum(pairs(F.col("n")) - F.col("kept")), F.lit(0.0)).alias("cut")
    )


def number(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` (of :func:`place`) with slot, gapless from 0 in each shard.

    Rows are numbered in buckets of a hash, each of about SLOT_ROWS rows, after the rows of
    the buckets before; only the buckets' counts are summed up, by a window over them.
    """
    buckets = max(16, rows.count() // SLOT_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("hash", 8), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("from", F.coalesce(before, F.lit(0))).drop("n")
    at = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*order)) - 1
    return rows.join(
        F.broadcast(counts) if buckets <= MOST_BUCKETS else counts, ["shard", "bucket"]
    ).withColumn("slot", (F.col("from") + at).cast("long")).drop("from", "bucket")


def shard(docs: DataFrame, *, shards=8, doc_id="doc_id", text="text") -> DataFrame:
    """``docs`` with size, text_crc32, law, shard and slot."""
    docs = without(docs, "size", "text_crc32", "law", "shard", "slot")
    out = number(place(docs, shards=shards, doc_id=doc_id, text=text), ["hash", "id", "size"])
    return out.select("row.*", "size", "shard", "slot", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, by bytes; groups are equal texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = place_keys(docs, shards=8)
    out = number(rows, ["hash", "id", "size"])
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op3_sharding": op3_sharding}
ORACLE: dict[str, str] = {}
