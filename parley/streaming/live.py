"""Live events as a stream: one row per event id, sessions, turns, and a table kept up to date."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import manifest
from ..sources.readers import EVENT


def event_stream(spark: SparkSession, folder: str, *, schema: str = EVENT, files_per_trigger: int = 1000) -> DataFrame:
    """Rows of the JSON-lines files that arrive in ``folder``; unreadable lines have all columns null."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")


def first_events(events: DataFrame, *, event_id="event_id", at="ts", delay="1 hour") -> DataFrame:
    """One row per id among events at most ``delay`` late; state is let go behind the watermark.

    Rows without an id or a time can't be told apart or ordered: they are left out here and
    belong to the batch reader's quarantine.
    """
    ok = events.filter(F.col(event_id).isNotNull() & F.col(at).isNotNull())
    return ok.withWatermark(at, delay).dropDuplicatesWithinWatermark([event_id])


def session_spans(events: DataFrame, *, key: str, at="ts", gap_seconds: int = 900) -> DataFrame:
    """(key, started_at, ended_at, n) of each run of events with gaps of ``gap_seconds`` at most.

    In append mode a session is sent once, when the watermark has passed its end.
    """
    groups = events.groupBy(F.col(key), F.session_window(at, f"{gap_seconds} seconds").alias("w"))
    out = groups.agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count("*").alias("n"))
    return out.drop("w")


_TURN = "key string, turn_no long, role string, start_us long, end_us long, text string, message_keys array<string>, reason string"


def turn_stream(
    messages: DataFrame, *, key="customer_key", role="role", at="ts", ordinal="source_ordinal", text="text", message_key="message_key",
    minutes: int = 15, delay="1 hour"
) -> DataFrame:
    """(key, turn_no, role, start_ts, end_ts, text, message_keys, reason): turns as the batch's merge_turns makes them, each sent once.

    Messages wait until the watermark, ``delay`` behind the newest, has passed them; so their
    order of arrival doesn't matter. A turn is sent when a message of another role or after
    ``minutes`` has followed, or when the watermark is so far that none can join it. Rows that
    can't take their place any more come out by themselves with a reason and no turn_no: ``late``
    (behind the watermark when they came) and ``untimed`` (without key or time). A key's state is
    its open turn, its waiting messages and the number of its turns.
    """
    gap = minutes * 60_000_000
    fields = [
        F.col(key).cast("string").alias("key"), F.col(role).alias("role"), F.unix_micros(at).alias("us"), F.col(ordinal).cast("long").alias("o"),
        F.col(text).alias("text"), F.col(message_key).alias("k"),
    ]

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        waiting, turn, n = json.loads(state.get[0]) if state.exists else ([], None, 0)
        out = []

        def send(no, t, reason=None):
            said = "\n".join(m[3] for m in t["m"] if m[3] is not None)
            out.append((who[0], no, t["role"], t["m"][0][0], t["m"][-1][0], said, [m[4] for m in t["m"]], reason))

        for b in batches:
            b = b.astype(object).where(b.notna(), None)
            for us, o, r, said, k in zip(b["us"], b["o"], b["role"], b["text"], b["k"]):
                m = [int(us), None if o is None else int(o), r, said, k]
                if m[0] < passed:
                    send(None, {"role": r, "m": [m]}, "late")
                else:
                    waiting.append(m)
        waiting.sort(key=lambda m: (m[0], m[1] is not None, m[1] or 0))
        ready = sum(m[0] < passed for m in waiting)
        for m in waiting[:ready]:
            if turn and (turn["role"] != m[2] or m[0] - turn["m"][-1][0] > gap):
                send(n, turn)
                turn, n = None, n + 1
            turn = turn or {"role": m[2], "m": []}
            turn["m"].append(m)
        waiting = waiting[ready:]
        if turn and turn["m"][-1][0] + gap < passed:
            send(n, turn)
            turn, n = None, n + 1
        state.update((json.dumps([waiting, turn, n]),))
        due = [m[0] for m in waiting[:1]] + ([turn["m"][-1][0] + gap] if turn else [])
        if due:
            state.setTimeoutTimestamp(max(min(due) // 1000, passed // 1000))
        if out:
            yield pd.DataFrame(out, columns=["key", "turn_no", "role", "start_us", "end_us", "text", "message_keys", "reason"]).astype({"turn_no": "Int64"})

    timed = messages.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay)
    # the step needs a column that is known as event time; with the times in it Spark would leave out late rows before the step sees them
    mark = F.lit(None).cast("timestamp").alias("mark", metadata=timed.schema[at].metadata)
    timed = timed.select(*fields, mark)
    turns = timed.groupBy("key").applyInPandasWithState(step, _TURN, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    rest = messages.filter(F.col(key).isNull() | F.col(at).isNull()).select(*fields)
    rest = rest.select(
        "key", F.lit(None).cast("long").alias("turn_no"), "role", F.col("us").alias("start_us"), F.col("us").alias("end_us"), "text",
        F.array("k").alias("message_keys"), F.lit("untimed").alias("reason")
    )
    out = turns.unionByName(rest)
    return out.select(
        F.col("key").alias(key), "turn_no", "role", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"), "text",
        "message_keys", "reason"
    )


def keep_current(rows: DataFrame, root: str, name: str, key: list[str], checkpoint: str, *, buckets: int = 64, **trigger) -> StreamingQuery:
    """Start a query that upserts each batch into the published table ``name`` (see :mod:`~..sources.manifest`).

    A batch reads and writes the buckets it touches. One that is run again after a failure
    finds its own rows by key, so the table is the same. Of a batch's rows with one key any
    one is kept; make keys unique before.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession

        def build(now):
            old = now.tables.get(name) if now else None
            return {name: manifest.upsert_table(spark, old, batch.dropDuplicates(key), root, name, key, buckets=buckets)}

        manifest.publish(spark, root, f"{name}-{uuid.uuid4().hex}", build)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
