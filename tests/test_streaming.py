"""The stream's sessions equal the batch ones; repeats and restarts change nothing."""

import json
import os
import random

from pyspark.sql import functions as F

from parley.operators.turns import merge_turns, sessions
from parley.sources import manifest
from parley.streaming import live

SCHEMA = "event_id string, user string, ts timestamp"
FILES = [
    [
        ("a", "u", "2024-01-01 10:00:00"), ("b", "u", "2024-01-01 10:15:00"), ("c", "v", "2024-01-01 10:00:00"), (None, "v", "2024-01-01 10:00:01"),
        ("n", "v", None)
    ],
    [("a", "u", "2024-01-01 10:00:00"), ("d", "u", "2024-01-01 10:30:00.000001"), ("e", "v", "2024-01-01 10:20:00")],
    [("z", "w", "2024-01-02 10:00:00")],
]


def written(folder, first=0):
    os.makedirs(folder, exist_ok=True)
    for k, rows in enumerate(FILES, first):
        path = f"{folder}/{k}.jsonl"
        with open(path, "w") as f:
            f.write("not json\n" + "".join(json.dumps({"event_id": i, "user": u, "ts": t}) + "\n" for i, u, t in rows))
        os.utime(path, (1_700_000_000 + k,) * 2)


def test_sessions_of_stream_and_batch_are_equal(spark, tmp_path):
    folder = f"{tmp_path}/in"
    written(folder)
    first = live.first_events(live.event_stream(spark, f"file://{folder}", schema=SCHEMA, files_per_trigger=1))
    query = live.session_spans(first, key="user").writeStream.format("memory").queryName("spans").option(
        "checkpointLocation", f"file://{tmp_path}/cp"
    ).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    got = sorted((r["user"], str(r["started_at"]), str(r["ended_at"]), r["n"]) for r in spark.table("spans").collect())
    rows = spark.createDataFrame(
        [r for f in FILES for r in f if r[0] and r[2]], "event_id string, user string, t string"
    ).dropDuplicates().withColumn("ts", F.to_timestamp("t"))
    turns = sessions(rows, key="user", order=["ts"], at="ts", gap_seconds=900).groupBy("user", "turn_no").agg(
        F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")
    )
    assert got == sorted((r["user"], str(r["a"]), str(r["b"]), r["n"]) for r in turns.filter("user <> 'w'").collect())
    assert len(got) == 4


def test_table_is_kept_current(spark, tmp_path):
    folder, root = f"{tmp_path}/in", f"file://{tmp_path}/out"
    for k in range(2):  # the same events again, in new files
        written(folder, 3 * k)
        rows = live.first_events(live.event_stream(spark, f"file://{folder}", schema=SCHEMA))
        assert live.keep_current(rows, root, "events", ["event_id"], f"file://{tmp_path}/cp").awaitTermination(90)
        assert sorted(r["event_id"] for r in manifest.read(spark, manifest.load(spark, root), "events").collect()) == ["a", "b", "c", "d", "e", "z"]


MESSAGE = "customer_key string, role string, ts timestamp, source_ordinal long, text string, message_key string"


def test_turns_of_stream_and_batch_are_equal(spark, tmp_path):
    rng, rows, at = random.Random(5), [], 1_704_100_000
    for i in range(400):
        at += rng.choice((0, 20, 300, 900, 901, 4000))
        said = rng.choice(("a", "b", None, ""))
        rows.append((rng.choice("uvw"), rng.choice(("customer", "studio")), at, i, said, f"m{i}"))
    last = [("z", "studio", at + 10**6, 400, "end", "m400"), ("z", "studio", at + 2 * 10**6, 401, "end", "m401")]
    # each file holds its messages out of order, and neighbouring files overlap by less than the delay
    near = sorted(rows, key=lambda r: r[2] + rng.randint(0, 3000))
    stray = [("u", "studio", 1_704_100_000, 500, "too late", "late"), (None, "studio", at, 501, "x", "nobody"), ("u", "studio", None, 502, "x", "never")]
    folder = f"{tmp_path}/in"
    os.makedirs(folder)

    def put(k, some):
        keys = ("customer_key", "role", "ts", "source_ordinal", "text", "message_key")
        with open(f"{folder}/{k}.jsonl", "w") as f:
            f.write("".join(json.dumps(dict(zip(keys, r))) + "\n" for r in some))
        os.utime(f"{folder}/{k}.jsonl", (1_700_000_000 + k,) * 2)

    def run():
        raw = live.event_stream(spark, f"file://{folder}", schema=MESSAGE.replace("ts timestamp", "ts long"), files_per_trigger=1)
        turns = live.turn_stream(raw.withColumn("ts", F.timestamp_seconds("ts")), delay="2 hours")
        query = turns.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option(
            "checkpointLocation", f"file://{tmp_path}/cp"
        ).trigger(availableNow=True).start()
        assert query.awaitTermination(300)

    for k in range(4):
        put(k, rng.sample(near[k * 50 : k * 50 + 50], 50))
    run()
    for k in range(4, 8):  # goes on from the checkpoint
        put(k, rng.sample(near[k * 50 : k * 50 + 50], 50))
    run()
    put(8, last[:1])
    put(9, last[1:] + stray)
    run()
    out = spark.read.parquet(f"file://{tmp_path}/out").toPandas()
    turns = out[out.reason.isna() & (out.customer_key != "z")]
    batch = spark.createDataFrame(rows, MESSAGE.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
    want = merge_turns(batch.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).toPandas()
    form = lambda d: sorted((r.customer_key, int(r.turn_no), r.role, str(r.start_ts), str(r.end_ts), r.text, tuple(r.message_keys)) for r in d.itertuples())
    assert form(turns) == form(want) and len(want) > 100
    lost = out[out.reason.notna()]
    assert sorted((r.reason, r.message_keys[0]) for r in lost.itertuples()) == [("late", "late"), ("untimed", "never"), ("untimed", "nobody")]
