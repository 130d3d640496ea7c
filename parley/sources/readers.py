"""Readers: exports, live events, binding lists, order envelopes, knowledge caches.

Schemas are explicit and all text: missing, null and empty values are equal. Bad rows are
told apart by a reason instead of failing the job, unless the format is fail-fast by
definition. Line numbers are part of keys: they are counted by split and added up.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as tx
from ..functions.keys import content_digest, hmac_id
from ..session import ship
from . import arrays

MESSAGE = "conversation_id string, conversation_type string, message_id string, timestamp string, message_type string, text string, raw_payload struct<status:int>"
INDEX = "conversation_id string, conversation_type string, display_name string, remark string, nick_name string"
EVENT = "event_id string, account_profile string, message_timestamp string, message_time string, conversation_id string, conversation_name string, chat_type string, sender string, message_type string, text string"
ORDER = "record_id string, phone string, tracking_no string, platform string, customer_name string, address string, customer_info string, pay_date string, revenue string, refund_type string, refund_reason string, refund_amount string, refund_date string, return_status string"
SPLITS = 100_000  # counts of file splits up to which they are broadcast
BINDING = ("账号", "客户手机号", "微信原始ID", "绑定置信度")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, ordinal from 1, line) of one or more text files, read in splits.

    Rows of a split are counted by the reading task; the lines of the splits before it in
    its file are added. Only the counts of splits are shuffled, and they are broadcast up to
    ``SPLITS`` of them (about 100 bytes each).
    """
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__m"), F.regexp_replace("value", "\r$", "").alias("line")
    )
    splits = raw.groupBy("__file", "__start").agg(F.min("__m").alias("__least"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("__file", "__start", "__least", F.coalesce(before, F.lit(0)).alias("__before"))
    if raw.rdd.getNumPartitions() + len(raw.inputFiles()) <= SPLITS:
        splits = F.broadcast(splits)
    rows = raw.join(splits, ["__file", "__start"])
    return rows.select(
        F.element_at(F.split("__file", "/"), -1).alias("source_file"),
        (F.col("__m") - F.col("__least") + F.col("__before") + 1).cast("long").alias("ordinal"), "line"
    )


def friend_index(index: DataFrame) -> DataFrame:
    """Friend conversations with an id; of an id's entries the last (column ``position``) counts."""
    ok = index.filter((F.col("conversation_type") == "friend") & (F.coalesce("conversation_id", F.lit("")) != ""))
    best = ok.groupBy("conversation_id").agg(F.max_by(F.struct(*ok.columns), "position").alias("r"))
    return best.select("r.*")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Friend conversations of a JSON array, read in several tasks; of an id's entries the last counts."""
    rows = arrays.read_array(spark, path).select("position", F.from_json("raw", INDEX).alias("r")).select("r.*", "position")
    return friend_index(rows)


def read_window(spark: SparkSession, folder: str, first: Column, last: Column) -> tuple[Column, Column]:
    """(first, last) instant of an export: those of its summary if both can be read, else the given ones."""
    try:
        got = spark.read.schema("first_timestamp string, last_timestamp string").json(f"{folder}/summary.json", multiLine=True).first()
    except AnalysisException:
        got = None
    told = [parse.instant(F.lit(x)) for x in (got or (None, None))]
    both = told[0].isNotNull() & told[1].isNotNull()
    return F.when(both, told[0]).otherwise(first), F.when(both, told[1]).otherwise(last)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(calibration_id, reviewer_role) of a review list; fails on a missing column or another role."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    rows = rows.toDF(*(c.lstrip("\ufeff").strip() for c in rows.columns))
    if missing := {"calibration_id", "reviewer_role"} - set(rows.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    role = F.trim(F.coalesce("reviewer_role", F.lit("")))
    return rows.select(
        "calibration_id",
        parse.refuse_unless(role.isin("studio", "customer"), role, "reviewer_role must be studio or customer").alias("reviewer_role")
    )


_ACCOUNT = "struct<canonical_account_id:string,self_sender:string,binding_account_alias:string,state:string>"
_STATE = "struct<initialized:boolean,last_poll_at:string,last_error:string>"


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """(account_profile, account_id, self_sender, binding_account_alias, state) of an account file."""
    rows = spark.read.schema(f"version int, accounts map<string, {_ACCOUNT}>").json(path, multiLine=True)
    each = rows.select(F.explode("accounts").alias("account_profile", "a"))
    flat = lambda c: F.coalesce(F.trim(f"a.{c}"), F.lit(""))
    return each.select(
        "account_profile", flat("canonical_account_id").alias("account_id"),
        *(flat(c).alias(c) for c in ("self_sender", "binding_account_alias", "state"))
    )


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """(account_profile, initialized, last_poll_at, last_error, last_success_at) of a state file."""
    rows = spark.read.schema(f"status string, last_success_at string, accounts map<string, {_STATE}>").json(path, multiLine=True)
    return rows.select("last_success_at", F.explode("accounts").alias("account_profile", "s")).select("account_profile", "s.*", "last_success_at")


def eligible(rows: DataFrame, conv: DataFrame | None = None) -> DataFrame:
    """Text messages of friends with a status of 2 (studio) or 3 (customer) and some text."""
    body = tx.strip("text")
    ok = rows.withColumn("text", body).filter(
        (F.col("conversation_type") == "friend") & (F.col("message_type") == "text") & F.col("raw_payload.status").isin(2, 3) & (F.col("text") != "")
    )
    if conv is not None:
        ok = ok.join(
            F.broadcast(conv.select("conversation_id")) if conv.limit(100_001).count() <= 100_000 else conv.select("conversation_id"),
            "conversation_id", "left_semi"
        )
    return ok.withColumn("role", F.when(F.col("raw_payload.status") == 2, "studio").otherwise("customer"))


def read_export(spark: SparkSession, folder: str, secret: str, account: str) -> DataFrame:
    """Messages of an export: fails on a bad line or timestamp; a repeated key's first row counts."""
    lines = numbered_lines(spark, f"{folder}/messages.jsonl").filter("trim(line) <> ''")
    rows = lines.select(
        "source_file", "ordinal", F.from_json("line", MESSAGE, {"mode": "FAILFAST"}).alias("m")
    ).select("source_file", "ordinal", "m.*")
    rows = eligible(rows, read_index(spark, f"{folder}/conversation_index.json"))
    at = parse.instant("timestamp")
    rows = rows.withColumn("ts", parse.refuse_unless(at.isNotNull(), at, "a message's timestamp can't be read"))
    rows = rows.withColumns({
        "customer_key": hmac_id(secret, "customer", F.lit(account), "conversation_id"),
        "message_key": hmac_id(secret, "message", F.lit(account), "conversation_id", "source_file", "ordinal"),
    })
    first = Window.partitionBy("message_key").orderBy("ordinal")
    rows = rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    return rows.select("message_key", "customer_key", "role", "timestamp", "ts", "text", "source_file", F.col("ordinal").alias("source_ordinal"))


def canonical_json(text: str) -> Column:
    """Keys sorted, numbers as written: what tells an exact repeat from a conflict."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import json

        def one(t):
            try:
                return json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            except (TypeError, ValueError):
                return None

        return s.map(one)

    return run(F.col(text))


def ladder(*steps: tuple[str, Column]) -> Column:
    """The first reason whose condition holds; null: accepted. A null condition doesn't hold."""
    out = F.when(F.coalesce(steps[0][1], F.lit(False)), steps[0][0])
    for reason, cond in steps[1:]:
        out = out.when(F.coalesce(cond, F.lit(False)), reason)
    return out


def live_events(lines: DataFrame, accounts: DataFrame, secret: str, *, skew_seconds=60, text_type="文本") -> DataFrame:
    """Every line with reject_reason (null: accepted) and, where accepted, its message columns.

    lines: (source_file, ordinal, line). accounts: (account_profile, account_id, self_sender).
    Repeats are found among all lines with an event id, so that one first met on a rejected
    line is a repeat later on. Texts are redacted, identifiers of the conversation and of all
    accounts before anything else.
    """
    ship(lines.sparkSession)
    flat = lambda c: F.coalesce(F.trim(c), F.lit(""))
    rows = lines.withColumn("sig", canonical_json("line")).withColumn("e", F.from_json("line", EVENT))
    obj = F.col("sig").startswith("{")
    rows = rows.withColumns(
        {
            c: flat(F.col(f"e.{c}")) for c in (
                "event_id", "account_profile", "message_timestamp", "message_time", "conversation_id", "conversation_name", "chat_type", "sender",
                "message_type"
            )
        }
    ).withColumn("text", tx.strip("e.text"))
    named = F.when(obj & (F.col("event_id") != ""), F.col("event_id"))
    w = Window.partitionBy(
        F.coalesce(named, F.concat(F.lit("\x00"), "source_file", F.lit(":"), F.col("ordinal").cast("string")))
    ).orderBy("source_file", "ordinal")
    rows = rows.withColumns({"nth": F.row_number().over(w), "first_sig": F.first("sig").over(w)})
    rows = rows.join(
        F.broadcast(accounts.select(F.col("account_profile").alias("p"), "account_id", "self_sender")), F.col("account_profile") == F.col("p"), "left"
    )
    epoch = F.col("message_timestamp").try_cast("bigint")
    shown = parse.instant(F.col("message_time"), parse.ZONE)
    raw_id = tx.raw_identifier("conversation_id")
    reason = ladder(
        ("blank_line", F.trim("line") == ""), ("invalid_json", F.col("sig").isNull()), ("invalid_record", ~obj),
        ("missing_event_id", F.col("event_id") == ""),
        ("duplicate_exact", (F.col("nth") > 1) & F.col("sig").eqNullSafe(F.col("first_sig"))), ("duplicate_conflict", F.col("nth") > 1),
        ("unknown_profile", F.col("p").isNull()),
        ("non_private", F.col("chat_type") != "private"), ("non_text", F.col("message_type") != text_type), ("empty_text", F.col("text") == ""),
        ("unknown_sender", ~F.col("sender").isin("") & (F.col("sender") != F.col("self_sender"))),
        ("invalid_timestamp", epoch.isNull() | shown.isNull()),
        ("timestamp_mismatch", F.abs(F.unix_seconds(shown) - epoch) > skew_seconds), ("invalid_conversation_id", raw_id.isNull()),
    )
    rows = rows.withColumn("reject_reason", reason)
    senders = F.broadcast(accounts.agg(F.collect_set(F.coalesce("self_sender", F.lit(""))).alias("senders")))
    out = rows.crossJoin(senders).withColumns({
        "role": F.when(F.col("sender") == "", "customer").otherwise("studio"), "raw_id": raw_id, "ts": F.timestamp_seconds(epoch),
        "timestamp": parse.epoch_local(epoch),
        "customer_key": hmac_id(secret, "customer", "account_id", raw_id), "raw_hash": hmac_id(secret, "raw-wechat-id", "account_id", raw_id),
        "message_key": hmac_id(secret, "message", "event_id", parse.epoch_local(epoch), content_digest("text")),
        "evidence": F.when(F.col("sender") == "", "empty_sender").otherwise("configured_self_sender"),
    })
    out = out.withColumn("text", F.when(F.col("reject_reason").isNull(), tx.redact(tx.scrub_identifiers("text", "raw_id", F.col("senders")))["text"]))
    return out.select(
        "source_file", "ordinal", "reject_reason", "account_profile", "account_id", "conversation_name", "sender", "raw_id", "raw_hash", "event_id",
        "role", "evidence", "timestamp", "ts", "customer_key", "message_key", "text"
    )


def accounting(rows: DataFrame, reason="reject_reason") -> DataFrame:
    """(reason, rows); accepted rows are ``accepted``."""
    return rows.groupBy(F.coalesce(F.col(reason), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("rows"))


def observations(accounts: DataFrame, state: DataFrame, last: DataFrame, global_at: Column) -> DataFrame:
    """Up to when each profile was observed, and why not where it wasn't.

    state: (account_profile, initialized, last_poll_at, last_error); last: (account_profile,
    last_ts). The last message never stands in for an observation.
    """
    rows = accounts.select("account_profile").join(state, "account_profile", "left").join(last, "account_profile", "left")
    at = parse.synced_at("last_poll_at")
    rows = rows.withColumns({"at": at, "g": global_at})
    reason = ladder(
        ("invalid_global_observation", F.col("g").isNull()),
        ("missing_profile_observation", F.col("initialized").isNull() & F.col("last_poll_at").isNull()),
        ("profile_not_initialized", ~F.col("initialized")),
        ("profile_observation_error", F.coalesce("last_error", F.lit("")) != ""), ("invalid_profile_observation", F.col("at").isNull()),
        ("profile_observation_before_message", F.col("at") < F.col("last_ts")),
        ("profile_global_observation_skew", F.abs(F.unix_seconds("at") - F.unix_seconds("g")) > 86400),
    )
    rows = rows.withColumn("reason", reason)
    fine = F.col("reason").isNull() | (F.col("reason") == "profile_global_observation_skew")
    return rows.select(
        "account_profile", F.when(fine, F.col("at")).alias("observed_until"), "reason",
        F.when(F.col("reason").isNull(), "consistent").otherwise("inconsistent").alias("consistency_state")
    )


def read_bindings(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a binding list; fails if a required column is missing. A byte order mark is dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    if missing := [c for c in BINDING if c not in rows.columns]:
        raise ValueError(f"columns are missing: {missing}")
    names = dict(zip(BINDING, ("account", "phone", "raw_id", "confidence")))
    return rows.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in names.items()))


def read_orders(spark: SparkSession, *paths: str, chunk: int = arrays.CHUNK) -> DataFrame:
    """(source_file, synced_at, total_records, position, record) of order envelopes.

    Large files are read in several tasks. A record that is no object, or no JSON, is null.
    """
    rows = arrays.read_array(spark, *paths, key="records", chunk=chunk)
    rows = rows.withColumns({
        "s": F.from_json("shell", "synced_at string, total_records int"),
        "r": F.from_json("raw", f"{ORDER}, unread string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unread"}),
    })
    fine = F.col("raw").startswith("{") & F.col("r.unread").isNull()
    return rows.select("source_file", "s.synced_at", "s.total_records", "position", F.when(fine, F.col("r").dropFields("unread")).alias("record"))


def flatten_items(raw: DataFrame, text="value") -> DataFrame:
    """Items of a JSON text: a list, or the first list among records, chunks, items and data, or one object.

    Text items are content. Columns: title, content, source_ref, expires_at.
    """
    item = "title string, name string, content string, text string, policy string, answer string, fields map<string,string>, source_ref string, url string, expires_at string, effective_until string"
    lists = [F.get_json_object(text, f"$.{k}") for k in ("records", "chunks", "items", "data")]
    is_list = lambda c: F.when(F.ltrim(c).startswith("["), c)
    arr = F.coalesce(is_list(F.col(text)), *(is_list(c) for c in lists), F.concat(F.lit("["), F.col(text), F.lit("]")))
    rows = raw.withColumn("raw", F.explode_outer(F.from_json(arr, "array<string>"))).withColumn(
        "i", F.when(F.col("raw").startswith("{"), F.from_json("raw", item))
    )
    some = lambda *names: F.coalesce(*(F.nullif(F.trim(f"i.{c}"), F.lit("")) for c in names))
    fields = F.array_join(F.transform(F.map_entries("i.fields"), lambda e: F.concat(e.key, F.lit(": "), e.value)), " ")
    content = F.coalesce(some("content", "text", "policy", "answer"), F.nullif(fields, F.lit("")), F.when(F.col("i").isNull(), F.trim("raw")))
    return rows.select(
        *(c for c in raw.columns if c != text), F.coalesce(some("title", "name"), F.lit("")).alias("title"), content.alias("content"),
        some("source_ref", "url").alias("source_ref"),
        some("expires_at", "effective_until").alias("expires_at"),
    ).filter("content is not null and content <> ''")


def read_source(spark: SparkSession, path: str, fmt: str = "auto", **kind) -> DataFrame:
    """Export folder or live event file, told apart by what is there."""
    if fmt == "auto":
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fmt = "export" if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "messages.jsonl")) else "live"
    if fmt == "export":
        return read_export(spark, path, kind["secret"], kind["account"])
    return live_events(numbered_lines(spark, path), kind["accounts"], kind["secret"])
