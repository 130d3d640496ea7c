"""What the read side shows: projections, newest rows, examples, calibration, health, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import retrieval

DEFAULTS = {"display_name": "未命名客户", "opportunity_level": "low", "summary": "", "identity_binding_state": "unmatched"}
PAIR_DEFAULTS = {"trigger_text": "", "reply_text": "", "intent_stage": "unknown", "review_status": "pending", "split": "unassigned"}
GATES = ("m0_a", "m0_b", "m0_c", "m0_d", "integration")
STALE_DAYS = 14


def newest(rows: DataFrame, *, key: str, order: list[str], n: int, to="place") -> DataFrame:
    """The last n rows of each key, numbered from the oldest of them (``to``, from 1)."""
    back = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    held = rows.withColumn("__back", F.row_number().over(back)).filter(F.col("__back") <= n)
    return held.withColumn(to, (F.count("*").over(Window.partitionBy(key)) - F.col("__back") + 1).cast("int")).drop("__back")


def _filled(rows: DataFrame, defaults: dict[str, str], counts: tuple[str, ...], rest: tuple[str, ...]) -> DataFrame:
    """Just these columns: a null or empty one gets its default, a null count 0."""
    have = {c.lower() for c in rows.columns}
    text = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c) if c in have else F.lit(d).alias(c) for c, d in defaults.items()]
    number = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) if c in have else F.lit(0).alias(c) for c in counts]
    return rows.select(*(c for c in rest if c in have), *text, *number)


def public_customers(rows: DataFrame) -> DataFrame:
    """What may be shown of customers: listed columns alone, so that raw identifiers can't slip through."""
    shown = ("customer_key", "last_active_at", "aftersales_priority", "reasons", "evidence", "memory")
    return _filled(rows, DEFAULTS, ("opportunity_score", "identity_candidate_count"), shown).withColumn("order_binding_state", F.lit("unavailable"))


def public_pairs(rows: DataFrame) -> DataFrame:
    """What may be shown of reply pairs."""
    return _filled(rows, PAIR_DEFAULTS, (), ("pair_id", "customer_key", "context", "risk", "review_reasons", "created_at"))


def customer_messages(messages: DataFrame, *, key="customer_key", stamp="timestamp", ordinal="source_ordinal", text="text", n=50) -> DataFrame:
    """The last n messages of each customer, oldest first, redacted."""
    rows = newest(messages, key=key, order=[stamp, ordinal], n=n)
    return tx.with_redaction(rows, text, "__red").withColumn(text, F.col("__red.text")).drop("__red")


def binding_candidates(bindings: DataFrame, *, key="customer_key") -> DataFrame:
    """Shown identity candidates of customers, in order."""
    rows = bindings.filter("state <> 'missing'").select("binding_id", key, "masked_hint", "state", "reviewed_at")
    return rows.orderBy(key, "state", "masked_hint", "binding_id")


def reference_id(source: str, title: str, content: str) -> Column:
    """Id of a knowledge reference, by what it says."""
    said = F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("")) for c in (source, title, content)))
    where = F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("source"))
    return F.concat(F.lit("knowledge:"), where, F.lit(":"), F.substring(F.sha2(said, 256), 1, 16))


def grounding_refs(rows: DataFrame, *lists: str, key="customer_key", most=20) -> DataFrame:
    """(key, refs): items with an id of the arrays ``lists``, in order, ``most`` of them."""
    items = F.concat(*(F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) for c in lists))
    return rows.select(key, F.slice(F.filter(items, lambda r: F.coalesce(r["id"], F.lit("")) != ""), 1, most).alias("refs"))


def draft_grounding(requests: DataFrame, refs: DataFrame, *, qid="request_id", text="request_text") -> DataFrame:
    """(qid, grounding_missing): requests for changing facts without a reference; others need none."""
    have = refs.select(qid, F.lit(True).alias("__has")).distinct()
    missing = tx.asks_for_facts(text) & F.col("__has").isNull()
    return requests.join(have, qid, "left").select(qid, missing.alias("grounding_missing"))


def normalized_drafts(drafts: DataFrame) -> DataFrame:
    """Drafts as they are kept: clipped, flagged where nothing grounds them, with known references alone.

    drafts: (draft_id, draft_text, intent, needs_clarification, needs_human, risk_flags,
    wanted_refs, grounding_refs array<struct<id,...>>, grounding_missing). Empty drafts go.
    """
    text = F.trim(F.coalesce("draft_text", F.lit("")))
    missing = F.coalesce("grounding_missing", F.lit(False))
    risks = F.transform(F.coalesce("risk_flags", F.array().cast("array<string>")), lambda r: F.substring(r, 1, 120))
    risks = F.when(missing & ~F.array_contains(risks, "grounding_missing"), F.array_append(risks, F.lit("grounding_missing"))).otherwise(risks)
    wanted = F.coalesce("wanted_refs", F.array().cast("array<string>"))
    refs = F.filter("grounding_refs", lambda r: (F.size(wanted) == 0) | F.array_contains(wanted, r["id"]))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)) | missing
    kept = drafts.filter(text != "")
    return kept.select(
        "draft_id", F.substring(text, 1, 12000).alias("draft_text"),
        F.substring(F.coalesce(F.nullif(F.col("intent"), F.lit("")), F.lit("unknown")), 1, 120).alias("intent"),
        yes("needs_clarification").alias("needs_clarification"), yes("needs_human").alias("needs_human"), F.slice(risks, 1, 20).alias("risk_flags"),
        refs.alias("grounding_refs"),
    )


def style_examples(
    requests: DataFrame, pairs: DataFrame, *, qid="request_id", text="request_text", key="customer_key", newest_pairs=200, k=5, bonus=0.08
) -> DataFrame:
    """(qid, pair_id, score, rank): the k pairs most like each request.

    Of approved pairs the newest are candidates, and of these the ones of low risk; a pair
    of the same customer counts a little more, also where the texts share nothing. Ties: newer
    pairs first.
    """
    some = pairs.filter("review_status = 'approved'").orderBy(F.desc("created_at"), "pair_id").limit(newest_pairs).filter("risk_level = 'low'")
    held = F.broadcast(
        some.select("pair_id", "created_at", F.col(key).alias("__k"), tx.bigrams("trigger_text").alias("__b"))
    )  # newest_pairs rows at most
    asked = requests.select(qid, F.col(key).alias("__q"), tx.bigrams(text).alias("__a"))
    score = tx.jaccard_similarity(F.col("__a"), F.col("__b")) + F.when(F.col("__q") == F.col("__k"), bonus).otherwise(0.0)
    rows = asked.crossJoin(held).select(qid, "pair_id", "created_at", score.alias("score"))
    order = Window.partitionBy(qid).orderBy(F.desc(F.round("score", 9)), F.desc("created_at"), "pair_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(qid, "pair_id", F.round("score", 6).alias("score"), "rank")


def knowledge_search(
    queries: DataFrame, items: DataFrame, sources: DataFrame, as_of: Column, *, qid="query_id", query="query", k=8
) -> tuple[DataFrame, DataFrame]:
    """Hits of each query among items of ready sources that haven't expired; and (qid, grounding_missing).

    items: (item_id, source_id, title, content, expires_at); sources: see
    :func:`~.retrieval.source_status`, with id and title. An item without a title has its
    source's. Hits carry 1200 characters of content. Grounding is missing where nothing was
    found or an enabled source isn't ready.
    """
    state = retrieval.source_status(sources, as_of)
    ready = state.filter("status = 'ready'").select(F.col("id").alias("source_id"), F.col("title").alias("__title"))
    rows = retrieval.fresh(items, as_of).join(F.broadcast(ready), "source_id")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), "__title", "source_id")
    rows = rows.withColumn("title", title).withColumn("__said", F.concat_ws(" ", "title", "content"))
    hits = retrieval.overlap_search(queries, rows, qid=qid, query=query, iid="item_id", text="__said", k=max(1, min(k, 20)))
    shown = hits.join(rows.select("item_id", "source_id", "title", F.substring("content", 1, 1200).alias("content"), "source_ref"), "item_id")
    down = state.agg(F.coalesce(F.max(F.col("enabled") & (F.col("status") != "ready")), F.lit(False)).alias("__down"))
    without = retrieval.grounding_missing(queries, hits, qid=qid).crossJoin(F.broadcast(down))
    return shown, without.select(qid, (F.col("grounding_missing") | F.col("__down")).alias("grounding_missing"))


def calibration_list(rows: DataFrame, customers: DataFrame, messages: DataFrame, *, pending=False) -> DataFrame:
    """Calibration rows with what a reviewer needs, by time and id; ``pending``: those without a review."""
    if pending:
        rows = rows.filter("reviewer_role is null")
    shown = rows.join(customers.select("customer_key", "display_name"), "customer_key").join(
        messages.select("message_key", "timestamp", "text"), "message_key"
    )
    shown = tx.with_redaction(shown, "text", "__red").withColumn("text", F.col("__red.text")).drop("__red")
    return shown.orderBy("timestamp", "calibration_id")


def apply_labels(rows: DataFrame, labels: DataFrame, at: Column) -> DataFrame:
    """Calibration rows with the labels' roles; of several labels for a row the last in order of the file."""
    named = labels.withColumn("__n", F.monotonically_increasing_id())
    last = named.groupBy("calibration_id").agg(F.max_by("reviewer_role", "__n").alias("__role"))
    met = rows.join(last, "calibration_id", "left")
    return met.withColumns(
        {
            "reviewer_role": F.coalesce("__role", "reviewer_role"),
            "reviewed_at": F.when(F.col("__role").isNotNull(), at).otherwise(F.col("reviewed_at"))
        }
    ).drop("__role")


def calibration_sample(messages: DataFrame, *, limit=200) -> DataFrame:
    """Messages by month and role in turn, customers in turn within; timestamps are text, so a month is its first 7 characters."""
    from .sampling import stratified

    rows = messages.withColumn("month", F.substring("timestamp", 1, 7))
    return stratified(rows, strata=["month", "role"], member="customer_key", order=["timestamp", "message_key"], limit=limit)


def aftersales_order(rows: DataFrame, *, most=1000) -> DataFrame:
    """Customers with an open incident, by priority and score."""
    return rows.filter("aftersales_priority is not null").orderBy("aftersales_priority", F.desc("opportunity_score"), "customer_key").limit(most)


def health(counts: DataFrame, calibration: DataFrame, snapshot_at: Column, now: Column, *, default_secret: bool, weak_secret: bool) -> DataFrame:
    """One row: status, age of the snapshot, counts as a map, warnings.

    counts: (name, rows) as :func:`~.serving.health` gives; calibration: its one row.
    """
    age = F.greatest(F.lit(0), F.floor((F.unix_seconds(now) - F.unix_seconds(snapshot_at)) / 86400)).cast("int")
    stale = snapshot_at.isNull() | (age > STALE_DAYS)
    row = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "rows")))).alias("counts")).crossJoin(calibration)
    row = row.withColumns({"snapshot_age_days": F.when(snapshot_at.isNotNull(), age), "snapshot_stale": stale})
    warn = F.array_compact(F.array(
        F.when(F.lit(default_secret), "default_hmac_secret"), F.when(F.lit(weak_secret), "weak_hmac_secret"),
        F.when(F.col("snapshot_stale"), "snapshot_stale"),
        F.when(~F.col("gate_open"), "role_calibration_required"),
    ))
    out = row.withColumn("warnings", warn)
    return out.select(
        F.when(F.size("warnings") > 0, "degraded").otherwise("ok").alias("status"), "snapshot_age_days", "snapshot_stale", "counts", "warnings"
    )


def missing_gates(runs: DataFrame) -> list[str]:
    """Acceptance gates that the latest run (run_id, started_at, gates map<string,boolean>) lacks."""
    last = runs.agg(F.max_by("gates", F.struct("started_at", "run_id")).alias("g")).first()
    if last is None or last["g"] is None:
        return list(GATES)
    return [g for g in GATES if not last["g"].get(g)]


def accept(runs: DataFrame) -> None:
    """Fail unless all gates of the latest run are open."""
    if lacking := missing_gates(runs):
        raise RuntimeError(f"acceptance gates are not open: {', '.join(lacking)}")


def same_run(runs: DataFrame, *, key_fingerprint: str, config_hash: str) -> None:
    """Fail if the latest run was made with another key or configuration."""
    last = runs.agg(F.max_by(F.struct("key_fingerprint", "config_hash"), F.struct("started_at", "run_id")).alias("r")).first()
    if last is None or last["r"] is None:
        raise RuntimeError("there is no run")
    for name, told in (("key_fingerprint", key_fingerprint), ("config_hash", config_hash)):
        if last["r"][name] != told:
            raise RuntimeError(f"the latest run has another {name}")


def macro_scores(confusion: DataFrame, rows: DataFrame, *, predicted: str, human: str) -> DataFrame:
    """One row: macro-averaged precision, recall and F1 of :func:`~.serving.confusion`, and agreement."""
    macro = confusion.agg(*(F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    both = F.col(human).isNotNull() & F.col(predicted).isNotNull()
    agree = rows.agg(
        F.count_if(both).alias("compared"),
        F.round(F.count_if(F.col(human) == F.col(predicted)) / F.nullif(F.count_if(both), F.lit(0)), 6).alias("agreement")
    )
    return macro.crossJoin(agree)


def outcome_ratios(lines: DataFrame, *, key: str, paid="revenue_minor", refunded="refund_amount_minor", kind="refund_type") -> DataFrame:
    """Per key: paid lines, how many were kept, and the part of the revenue that was refunded; null without paid lines."""
    is_paid = F.col(paid) > 0
    kept = is_paid & (F.col(kind).isNull() | ~F.col(kind).isin("return", "return_taro", "cancel"))
    loss = F.sum(F.when(is_paid, F.least(F.coalesce(F.col(refunded), F.lit(0)), F.col(paid))))
    g = lines.groupBy(key).agg(
        F.count_if(is_paid).alias("paid"), F.count_if(kept).alias("retained"), F.sum(F.when(is_paid, F.col(paid))).alias("__all"),
        loss.alias("__loss")
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return g.select(key, "paid", "retained", ratio("retained", "paid").alias("retained_ratio"), ratio("__loss", "__all").alias("refund_loss_ratio"))


