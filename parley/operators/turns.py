"""Turns, reply pairs and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..functions.keys import content_digest


def sessions(rows: DataFrame, *, key: str, order: list[str], at: str | None, gap_seconds: int | None, same: str | None = None) -> DataFrame:
    """``rows`` with turn_no, from 0 in each key.

    A row continues the turn of the row before it if both have one ``same`` value and lie 0
    to ``gap_seconds`` apart. ``order`` may be a text column: order and gap are separate, so a
    step back in time starts a new turn.
    """
    w = Window.partitionBy(key).orderBy(*order)
    new = F.lag(F.lit(1)).over(w).isNull()
    if same is not None:
        new |= ~F.col(same).eqNullSafe(F.lag(same).over(w))
    if gap_seconds is not None:
        gap = F.unix_micros(F.col(at)) - F.unix_micros(F.lag(at).over(w))
        new |= F.coalesce((gap < 0) | (gap > gap_seconds * 1_000_000), F.lit(True))
    marked = rows.withColumn("__new", new.cast("int"))
    return marked.withColumn("turn_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long") - 1).drop("__new")


def merge_turns(
    messages: DataFrame, *, key="customer_key", role="role", stamp="timestamp", at="ts", ordinal="source_ordinal", text="text",
    message_key="message_key", minutes: int | None = 15
) -> DataFrame:
    """(key, turn_no, role, started_at, ended_at, start_ts, end_ts, text, message_keys)."""
    order = [stamp, ordinal]
    marked = sessions(messages, key=key, order=order, at=at, gap_seconds=None if minutes is None else minutes * 60, same=role)
    row = F.struct(F.col(stamp).alias("s"), F.col(ordinal).alias("o"), F.col(at).alias("at"), F.col(text).alias("t"), F.col(message_key).alias("k"))
    turns = marked.groupBy(key, "turn_no").agg(F.first(role).alias("role"), F.array_sort(F.collect_list(row)).alias("m"))
    last = F.element_at("m", -1)
    return turns.select(
        key, "turn_no", "role", F.col("m")[0]["s"].alias("started_at"), last["s"].alias("ended_at"), F.col("m")[0]["at"].alias("start_ts"),
        last["at"].alias("end_ts"),
        F.array_join(F.transform("m", lambda m: m.t), "\n").alias("text"), F.transform("m", lambda m: m.k).alias("message_keys"),
    )


def pair_quality(trigger, reply, lexicon: lx.Lexicon = lx.Lexicon()):
    """0 to 12."""
    bare = lambda c: F.regexp_replace(c, tx.java(r"\s+"), "")
    t, r = bare(trigger), bare(reply)
    n, m = F.length(t), F.length(r)
    point = lambda cond, k: F.when(cond, k).otherwise(0)
    return (
        point(n.between(4, 500), 3) + point(m.between(5, 500), 4) + point(~r.isin(*lexicon.low_value), 3)
        + point(tx.contains_any(trigger, lexicon.question), 1) + point(F.size(F.array_distinct(F.split(r, ""))) >= 4, 1)
    )


def pair_turns(
    turns: DataFrame, *, key="customer_key", asker="customer", answerer="studio", minutes: int | None = 30, least=8, context=2, redacted=True,
    lexicon: lx.Lexicon = lx.Lexicon()
) -> DataFrame:
    """An asker's turn and the answerer's turn right after it, with the turns before as context.

    Pairs below the quality bar go; of pairs that read alike in one key the first stays.
    """
    if redacted:
        turns = tx.with_redaction(turns, "text", "red")
    else:
        turns = turns.withColumn("red", F.struct(F.col("text").alias("text"), F.array().cast("array<string>").alias("flags")))
    w = Window.partitionBy(key).orderBy("turn_no")
    before = [
        F.lag(
            F.struct(F.col("role"), F.col("red.text").alias("text"), F.col("ended_at").alias("timestamp")), k
        ).over(w) for k in range(context, 0, -1)
    ]
    cols = ["role", "text", "red", "message_keys", "start_ts", "ended_at"]
    nxt = F.lead(F.struct(*cols)).over(w)
    rows = turns.withColumn("reply", nxt).withColumn("context", F.array_compact(F.array(*before)))
    rows = rows.filter((F.col("role") == asker) & (F.col("reply.role") == answerer))
    if minutes is not None:
        gap = F.unix_micros("reply.start_ts") - F.unix_micros("end_ts")
        rows = rows.filter(gap.between(0, minutes * 60_000_000))
    rows = rows.withColumn("quality_score", pair_quality(F.col("text"), F.col("reply.text"), lexicon)).filter(F.col("quality_score") >= least)
    alike = F.lower(F.regexp_replace(F.concat(F.col("red.text"), F.lit("\x1f"), F.col("reply.red.text")), tx.java(r"[\s\x1f]+"), ""))
    rows = rows.withColumn("dup_key", content_digest(alike))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(key, "dup_key").orderBy("turn_no"))).filter("n = 1")
    both = F.concat_ws("\n", "text", "reply.text")
    flags = tx.risk_flags(both, F.array_union("red.flags", "reply.red.flags"), lexicon.risk)
    marked = F.when(
        F.size(F.array_union("red.flags", "reply.red.flags")) > 0, F.array_sort(F.array_union(flags, F.array(F.lit("redacted_value"))))
    ).otherwise(flags)
    return rows.select(
        key, "turn_no", F.col("red.text").alias("trigger_text"), F.col("reply.red.text").alias("reply_text"), "context",
        F.col("message_keys").alias("trigger_keys"),
        F.col("reply.message_keys").alias("reply_keys"), F.col("reply.ended_at").alias("timestamp"), tx.intent("text", lexicon).alias("intent_stage"),
        marked.alias("risk_flags"), tx.risk_level(flags).alias("risk_level"), "quality_score",
    )


def episodes(rows: DataFrame, *, key: str, order: list[str], at: str, hours=24) -> DataFrame:
    """``rows`` with episode_no: more than ``hours`` of silence start a new one."""
    return sessions(rows, key=key, order=order, at=at, gap_seconds=hours * 3600).withColumnRenamed("turn_no", "episode_no")
