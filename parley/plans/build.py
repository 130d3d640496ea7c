"""A build in one call: from an export's files to all tables, published by one manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, parse
from ..functions import text as tx
from ..operators import detail, identity, orders, sampling, scoring, turns
from ..session import stored
from ..sources import arrays, manifest, readers, snapshot

#: table -> its key and the columns that people set; they stay while the key and the guards do
DECIDED = {
    "style_pairs": (["pair_id"], ["review_status", "reviewed_at"], []),
    "identity_bindings": (["binding_id"], ["state", "reviewed_at"], ["phone_hmac"]),
    "role_calibration": (["message_key"], ["human_role", "reviewed_at"], ["predicted_role"]),
}


def _kept(fresh: DataFrame, old: DataFrame | None, key: list[str], columns: list[str], guards: list[str]) -> DataFrame:
    """``fresh`` with the decisions of ``old`` where a person made one on the same grounds."""
    if old is None:
        return fresh
    o = old.filter("reviewed_at is not null").select(*(F.col(c).alias(f"__o_{c}") for c in (*key, *columns, *guards)))
    same = F.lit(True)
    for c in (*key, *guards):
        same &= F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    there = F.col("__o_reviewed_at").isNotNull()
    return fresh.join(o, same, "left").select(*(F.when(there, F.col(f"__o_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in fresh.columns))


def export_tables(spark: SparkSession, folder: str, *, secret: str, account: str, limit_pairs: int = 500, calibration: int = 200) -> dict[str, DataFrame]:
    """Every table of an export, without what people decided before."""
    messages = stored(readers.read_export(spark, folder, secret, account), "messages")
    names = readers.read_index(spark, f"{folder}/conversation_index.json")
    names = names.withColumn("customer_key", keys.hmac_id(secret, "customer", F.lit(account), "conversation_id"))
    names = names.select("customer_key", tx.display_name("customer_key").alias("display_name"))
    last = messages.agg(F.max("ts").alias("t")).first()["t"]
    analysed = stored(scoring.analyze(messages, F.lit(last).cast("timestamp")), "analysed")
    files = messages.groupBy("customer_key").agg(F.min_by("source_file", F.struct("timestamp", "source_ordinal")).alias("source_file"))
    customers = analysed.join(names, "customer_key", "left").join(files, "customer_key").select(
        "customer_key", F.coalesce("display_name", F.concat(F.lit("客户-"), F.right("customer_key", F.lit(8)))).alias("display_name"), "last_active_at",
        "opportunity_score", "opportunity_level", "aftersales_priority", "summary", F.to_json("reasons").alias("reasons_json"),
        F.to_json("evidence_message_keys").alias("evidence_json"), F.to_json("memory").alias("memory_json"), "source_file",
    )

    pairs = turns.pair_turns(turns.merge_turns(messages))
    chosen = sampling.select_pairs(pairs, secret=secret, limit=limit_pairs)
    pair_id = keys.hmac_id(secret, "pair", "customer_key", F.array_join("trigger_keys", ","), F.array_join("reply_keys", ","))
    none, undated = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    style = chosen.select(pair_id.alias("pair_id"), "*", F.lit("pending").alias("review_status"), undated.alias("reviewed_at"))

    phones = messages.groupBy("customer_key").agg(F.array_distinct(F.flatten(F.collect_list(tx.mainland_phones("text")))).alias("phones"))
    states = identity.identifier_states(phones, key="customer_key", ids="phones")
    phone = F.when(F.col("identifier").isNotNull(), keys.hmac_id(secret, "phone", F.lit(account), "identifier"))
    bindings = states.select("customer_key", phone.alias("phone_hmac"), "state").select(
        keys.hmac_id(secret, "binding", F.lit(account), "customer_key", F.coalesce("phone_hmac", F.lit("missing"))).alias("binding_id"), "*",
        undated.alias("reviewed_at"),
    )
    sample = detail.calibration_sample(messages, limit=calibration).select(
        "message_key", "customer_key", F.col("role").alias("predicted_role"), none.alias("human_role"), undated.alias("reviewed_at")
    )
    return {
        "customers": customers, "messages": messages.drop("ts"), "style_pairs": style, "identity_bindings": bindings,
        "evidence": identity.evidence_rows(analysed, secret), "role_calibration": sample,
    }


def build_export(spark: SparkSession, folder: str, root: str, *, secret: str, account: str, tries: int = 3, **limits: int) -> manifest.Manifest:
    """Build an export's tables and publish them together under ``root``; gives the manifest.

    The same files, key and limits that the current tables came from change nothing. What
    people decided stays (see DECIDED); of the carried tables (reviews, drafts, feedback) the
    rows of customers that are gone go. Another key than that of the current tables is an
    error, for none of their ids would be met again. If the run fails, the current tables stay.
    """
    read = snapshot.file_digests(spark, f"{folder}/*").select("path", "sha256").orderBy("path").collect()  # a row for each file of the export
    now = manifest.load(spark, root)
    limit = ",".join(f"{k}={v}" for k, v in sorted(limits.items()))
    mark = keys.key_fingerprint(secret)
    told = "|".join([account, mark, limit, *(f"{r['path'].rsplit('/', 1)[-1]}:{r['sha256']}" for r in read)])
    run_id = spark.range(1).select(F.sha2(F.lit(told), 256)).first()[0]

    if (runs := manifest.read(spark, now, "build_runs")) is not None and runs.agg(F.max_by("run_id", "started_at")).first()[0] == run_id:
        return now  # imports may have been published since

    def build(now: manifest.Manifest | None) -> dict[str, DataFrame]:
        old = lambda name: manifest.read(spark, now, name)
        runs = old("build_runs")
        if runs is not None and runs.filter(F.col("key_fingerprint") != mark).limit(1).count():
            raise RuntimeError("the current tables were made with another key")
        made = export_tables(spark, folder, secret=secret, account=account, **limits)
        for name, rule in DECIDED.items():
            made[name] = _kept(made[name], old(name), *rule)
        for name in ("reviews", "drafts", "feedback"):
            if (rows := old(name)) is not None:
                made[name] = rows.join(made["customers"].select("customer_key"), "customer_key", "left_semi")
        this = spark.range(1).select(
            F.lit(run_id).alias("run_id"), F.lit(mark).alias("key_fingerprint"), F.lit(len(read)).alias("files"), F.current_timestamp().alias("started_at")
        )
        made["build_runs"] = this if runs is None else runs.unionByName(this)
        return made

    def gates(new: manifest.Manifest) -> dict[str, bool]:
        n = {name: sum(t.rows.values()) for name, t in new.tables.items()}
        return {"messages": n["messages"] > 0, "customers": 0 < n["customers"] <= n["messages"], "bindings": n["identity_bindings"] >= n["customers"]}

    return manifest.publish(spark, root, run_id, build, gates=gates, tries=tries)


def import_orders(
    spark: SparkSession, path: str, root: str, *, secret: str, namespace: str = "orders", rules: str = "1", chunk: int = arrays.CHUNK, tries: int = 3
) -> manifest.Manifest:
    """Put an order envelope's lines, quarantine and summary in place of those before, beside a build's tables; gives the manifest.

    The envelope is one file. It must carry ``synced_at`` with an offset and stay as it is while it is
    read; accepted and quarantined records must add up to its records. The same file under the same
    rules changes nothing. Without a build under ``root``, or with another key than its own, it is an error.
    """
    mark, now = keys.key_fingerprint(secret), manifest.load(spark, root)
    runs = manifest.read(spark, now, "build_runs")
    if runs is None:
        raise RuntimeError("an import needs a build's tables")
    if runs.filter(F.col("key_fingerprint") != mark).limit(1).count():
        raise RuntimeError("the current tables were made with another key")
    before = snapshot.signature(spark, path)
    if len(before) != 1:
        raise ValueError("an import reads one file")
    source_hash = arrays.digests(spark, path).first()["sha256"]
    rows = orders.quarantine(readers.read_orders(spark, path, chunk=chunk).withColumn("at", parse.synced_at("synced_at")))
    rows = stored(rows, "orders")
    if snapshot.signature(spark, path) != before:
        raise RuntimeError("the input changed while it was read")
    envelope = rows.agg(F.max("synced_at").alias("synced_at"), F.max("at").alias("at"), F.max("total_records").alias("total")).first()
    if envelope["at"] is None:
        raise ValueError("synced_at must be a time with an offset")
    rows = rows.filter("position is not null")  # an empty array has one row without
    ok, bad = rows.filter("reject_reason is null"), rows.filter("reject_reason is not null").select("position", "reject_reason")
    today = F.to_date(F.from_utc_timestamp("at", parse.ZONE))
    lines = stored(orders.normalize(ok.select("record.*", today.alias("today")), today="today", secret=secret, namespace=namespace), "lines")
    source, accepted, rejected = rows.count(), lines.count(), bad.count()
    orders.balanced(accepted, rejected, source)
    this = spark.range(1).select(
        orders.snapshot_id(secret, namespace, source_hash, envelope["synced_at"], rules).alias("snapshot_id"), F.lit(source_hash).alias("source_hash"),
        F.lit(envelope["synced_at"]).alias("synced_at"), F.lit(accepted).cast("long").alias("records"),
    )
    run_id = this.first()["snapshot_id"]

    def active(m: manifest.Manifest | None) -> bool:
        old = manifest.read(spark, m, "order_snapshots")
        return old is not None and old.filter(F.col("snapshot_id") == run_id).limit(1).count() > 0

    if active(now):
        return now
    summary = orders.import_summary(lines, source=source, quarantined=rejected, envelope=envelope["total"])
    made = {"orders": lines, "order_quarantine": bad, "order_quality": summary, "order_snapshots": this}
    return manifest.publish(spark, root, run_id, lambda _: made, tries=tries)
