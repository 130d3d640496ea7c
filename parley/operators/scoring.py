"""Opportunity score, after-sales state and memory of a customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..session import stored
from . import turns as tn


def _tail(arr: Column, n: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), n)


def priority_step(state: Column, closes: Column, rank: Column, key: Column) -> Column:
    """One message: state is (rank 0..2 or 9 for none, key of the incident)."""
    is_open = state["rank"] < 9
    takes = (rank < 9) & (rank <= state["rank"])
    none = F.struct(F.lit(9).alias("rank"), F.lit(None).cast("string").alias("key"))
    return F.when(is_open & closes, none).when(takes, F.struct(rank.alias("rank"), key.alias("key"))).otherwise(state)


def fold_priority(items: Column, start: Column | None = None) -> Column:
    """Last open incident of an ordered array of struct(closes, rank, key); null: nothing was open before."""
    if start is None:
        start = F.struct(F.lit(9).alias("rank"), F.lit(None).cast("string").alias("key"))
    return F.aggregate(items, start, lambda s, m: priority_step(s, m["closes"], m["rank"], m["key"]))


_KEPT = "\x00"  # stands for the incident that was open before
RANKS = (0, 1, 2, 9)


def fold_part(items: Column) -> Column:
    """What a part of a customer's messages does to each rank that may be open before it."""
    return F.array(
        *(fold_priority(items, F.struct(F.lit(r).alias("rank"), F.lit(_KEPT if r < 9 else None).cast("string").alias("key"))) for r in RANKS)
    )


def fold_parts(parts: Column, start: Column | None = None) -> Column:
    """:func:`fold_priority` of all messages, from an ordered array of struct(part, does)."""
    if start is None:
        start = F.struct(F.lit(9).alias("rank"), F.lit(None).cast("string").alias("key"))

    def step(s, p):
        out = F.get(p["does"], F.when(s["rank"] == 9, len(RANKS) - 1).otherwise(s["rank"]))
        return F.struct(out["rank"].alias("rank"), F.when(out["key"] == _KEPT, s["key"]).otherwise(out["key"]).alias("key"))

    return F.aggregate(parts, start, step)


def incident_rank(text, lexicon: lx.Lexicon) -> Column:
    return F.when(
        tx.contains_any(text, lexicon.p0), 0
    ).when(tx.contains_any(text, lexicon.p1), 1).when(tx.contains_any(text, lexicon.p2), 2).otherwise(9)


LAST = 8  # hits of a kind that anything shown goes back to
COUNTED = ("purchase", "urgency", "repeat", "rejection")


#: hits that depend on how near the end a message is, with what they look back over; the others add up
NEAR_END = {"rejection": 10, "objections": 20, "preferences": 20, "commitments": 20, "last_cust": 3, "recent": 8}
TAIL = 20  # messages of each role that the hits near the end look back over
ROWS = 250_000  # messages that one task holds, but for a customer with more
LISTED = 1_000_000  # customers whose keys one broadcast holds


def _dealt(messages: DataFrame) -> DataFrame:
    """Messages by customer, over more tasks than the session's where these would hold too many."""
    usual, tasks = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-messages.count() // ROWS)
    return messages.repartition(tasks, "k") if tasks > usual else messages


def carry(
    messages: DataFrame, before: DataFrame | None = None, *, key="customer_key", role="role", stamp="timestamp", at="ts", ordinal="source_ordinal",
    text="text", message_key="message_key", asker="customer", answerer="studio", lexicon: lx.Lexicon = lx.Lexicon(), part=1000
) -> DataFrame:
    """(k, ...): what scores need of each customer's messages, of a size that doesn't grow with them.

    With ``before``, an earlier result of this function, the messages must come after all that it
    covers, customer by customer, and the result covers both; customers without a new message are
    left out. Counts, last hits, turns and the open incident go on from there; the last ``TAIL``
    messages of each role are in the state, for a hit near the end may stop being one.

    Two shuffles by customer: ranks within the role, then the aggregation. It goes by parts of
    ``part`` messages, each of which leaves counts, its last few hits and what it does to an
    open incident, so that no history is ever held as a whole. States and lists of customers
    are joined by hashes, for each sort of a task holds memory of its own.
    """
    base = messages.select(
        F.col(key).alias("k"), F.col(role).alias("role"), F.col(stamp).alias("stamp"), F.col(at).alias("at"), F.col(ordinal).alias("o"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(message_key).cast("string").alias("key"), F.lit(False).alias("old")
    )
    base = _dealt(base)
    if before is not None:
        touched = before.join(base.select("k").distinct().hint("shuffle_hash"), "k", "left_semi")
        kept = touched.select("k", F.explode("tail").alias("m")).select("k", "m.role", "m.stamp", "m.at", "m.o", "m.text", "m.key", F.lit(True).alias("old"))
        base = base.unionByName(kept)
    base = tn.sessions(base, key="k", order=["stamp", "o"], at="at", gap_seconds=15 * 60, same="role")
    back = Window.partitionBy("k", "role").orderBy(F.desc("stamp"), F.desc("o"))
    base = base.withColumn("from_end", F.row_number().over(back))
    base = tx.with_redaction(base, "text", "red")
    cust, studio, new = F.col("role") == asker, F.col("role") == answerer, ~F.col("old")
    any_of = lambda words: tx.contains_any("text", words)
    entry = F.struct("stamp", "o", "key", F.col("red.text").alias("text"), "role")
    put = lambda cond: _tail(F.array_sort(F.collect_list(F.when(cond, entry))), LAST)
    ranked = F.struct("stamp", "o", any_of(lexicon.closure).alias("closes"), incident_rank("text", lexicon).alias("rank"), "key")
    near = {name: F.col("from_end") <= n for name, n in NEAR_END.items()}
    hits = {
        "purchase": new & cust & any_of(lexicon.purchase), "urgency": new & cust & any_of(lexicon.urgency),
        "repeat": new & cust & any_of(lexicon.repeat), "rejection": cust & near["rejection"] & any_of(lexicon.rejection),
        "objections": cust & near["objections"] & any_of(lexicon.objection), "preferences": cust & near["preferences"] & any_of(lexicon.preference),
        "commitments": studio & near["commitments"] & any_of(lexicon.commitment), "last_cust": cust & near["last_cust"], "recent": near["recent"],
    }
    whole = F.struct("stamp", "o", "at", "role", "text", "key")
    forth = Window.partitionBy("k").orderBy("stamp", "o")
    base = base.withColumn("part", F.floor((F.row_number().over(forth) - 1) / part))
    parts = base.groupBy("k", "part").agg(
        *(put(c).alias(name) for name, c in hits.items()), *(F.count_if(hits[c]).alias(f"n_{c}") for c in COUNTED),
        F.count_if(new & cust).alias("n_cust"), F.max("turn_no").alias("turn"), F.max(F.when(~new, F.col("turn_no"))).alias("old_turn"),
        F.max(F.struct("stamp", "o", "at", "role")).alias("last"), F.min(F.struct("stamp", "o", "at")).alias("first"),
        F.max(F.when(cust, F.struct("stamp", "o", any_of(lexicon.open_question).alias("q")))).alias("last_q"),
        fold_part(F.array_sort(F.collect_list(F.when(new & cust, ranked)))).alias("does"),
        F.collect_list(F.when(F.col("from_end") <= TAIL, whole)).alias("tail"),
    )
    end = fold_parts(F.array_sort(F.collect_list(F.struct("part", "does")))) if before is None else F.array_sort(F.collect_list(F.struct("part", "does")))
    rows = parts.groupBy("k").agg(
        *(_tail(F.array_sort(F.flatten(F.collect_list(name))), LAST).alias(name) for name in hits),
        *(F.sum(f"n_{c}").alias(f"n_{c}") for c in COUNTED),
        F.sum("n_cust").alias("n_cust"), (F.max("turn") - F.coalesce(F.max("old_turn"), F.lit(-1))).alias("n_turns"),
        F.max("last").alias("last"), F.min("first").alias("first"), F.max("last_q").alias("last_q"), end.alias("state"),
        F.array_sort(F.flatten(F.collect_list("tail"))).alias("tail"),
    )
    if before is None:
        return rows
    o = touched.select("k", F.struct(*(c for c in before.columns if c != "k")).alias("before"))
    rows, old = rows.join(o.hint("shuffle_hash"), "k", "left"), lambda c: F.col(f"before.{c}")
    none = F.struct(F.lit(9).alias("rank"), F.lit(None).cast("string").alias("key"))
    adds = [c for c in hits if c not in NEAR_END]
    return rows.withColumns({
        **{c: _tail(F.concat(F.coalesce(old(c), F.slice(c, 1, 0)), c), LAST) for c in adds},
        **{f"n_{c}": F.col(f"n_{c}") + F.coalesce(old(f"n_{c}"), F.lit(0)) for c in adds},
        "n_cust": F.col("n_cust") + F.coalesce(old("n_cust"), F.lit(0)), "n_turns": F.col("n_turns") + F.coalesce(old("n_turns"), F.lit(0)),
        "first": F.coalesce(old("first"), "first"), "state": fold_parts(F.col("state"), F.coalesce(old("state"), none)),
    }).drop("before")


def go_on(before: DataFrame, messages: DataFrame, history: DataFrame, **names) -> DataFrame:
    """:func:`carry` of the customers that ``messages`` touches, from their state and the new messages alone.

    Only customers with a message that doesn't come after all that was there are made again from
    ``history`` (all messages, the new ones included). Upsert the result by ``k``: what is read and
    written grows with the batch.
    """
    key, stamp, ordinal = names.get("key", "customer_key"), names.get("stamp", "timestamp"), names.get("ordinal", "source_ordinal")
    least = messages.groupBy(F.col(key).alias("k")).agg(F.min(F.struct(F.col(stamp).alias("stamp"), F.col(ordinal).alias("o"))).alias("least"))
    met = before.select("k", F.struct("last.stamp", "last.o").alias("most")).join(least.hint("shuffle_hash"), "k")
    late = stored(met.filter(F.col("least") <= F.col("most")).select(F.col("k").alias(key)), "late")
    late = F.broadcast(late) if late.count() <= LISTED else late.hint("shuffle_hash")
    on = carry(messages.join(late, key, "left_anti"), before, **names)
    return on.unionByName(carry(history.join(late, key, "left_semi"), **names))


def analyze(messages: DataFrame, snapshot_at, **names) -> DataFrame:
    """One row per customer: score, level, points, priority, queue, reasons, memory, evidence (see :func:`carry` for the names of columns)."""
    return score(carry(messages, **names), snapshot_at, **{k: v for k, v in names.items() if k in ("key", "asker")})


def score(rows: DataFrame, snapshot_at, *, key="customer_key", asker="customer") -> DataFrame:
    """Scores of :func:`carry`'s rows. snapshot_at is a column or literal timestamp."""
    snap = snapshot_at if isinstance(snapshot_at, Column) else F.lit(snapshot_at).cast("timestamp")
    days = lambda a, b: F.greatest(F.lit(0), F.floor((F.unix_seconds(a) - F.unix_seconds(b)) / 86400)).cast("long")
    n = F.col
    last_cust = F.col("last.role") == asker
    rows = rows.withColumns({"recency": days(snap, F.col("last.at")), "span": days(F.col("last.at"), F.col("first.at"))})
    urgent = F.least(F.lit(20), n("n_urgency") * 10)
    rows = rows.withColumns({
        "purchase_points": F.least(F.lit(35), n("n_purchase") * 9),
        "urgency_points": F.when(F.col("recency") <= 3, F.least(F.lit(20), urgent + 8)).when(
            F.col("recency") <= 14, F.least(F.lit(20), urgent + 4)
        ).otherwise(urgent),
        "interaction_points": F.least(F.lit(15), (F.floor(F.col("n_cust") / 3) + F.least(F.lit(8), F.floor(F.col("n_turns") / 4)))).cast("int"),
        "followup_points": F.least(
            F.lit(15),
            F.when(last_cust, 8).otherwise(0) + F.when(
                (n("n_purchase") > 0) & (last_cust | F.coalesce(F.col("last_q.q"), F.lit(False))), 7
            ).otherwise(0)
        ),
        "recurrence_points": F.least(F.lit(15), n("n_repeat") * 7 + F.when(F.col("span") >= 30, 4).otherwise(0)),
        "rejection_penalty": F.when(n("n_rejection") > 0, 30).otherwise(0),
    })
    raw = F.col("purchase_points") + F.col("urgency_points") + F.col(
        "interaction_points"
    ) + F.col("followup_points") + F.col("recurrence_points") - F.col("rejection_penalty")
    rows = rows.withColumn("opportunity_score", F.greatest(F.lit(0), F.least(F.lit(100), raw)))
    level = F.when(F.col("opportunity_score") >= 60, "high").when(F.col("opportunity_score") >= 35, "medium").otherwise("low")
    rank = F.col("state.rank")
    priority = F.when(rank < 9, F.concat(F.lit("P"), rank.cast("string")))
    keys = lambda c, k=5: F.transform(_tail(F.col(c), k), lambda m: m["key"])
    none = F.array().cast("array<string>")
    newest = F.when(last_cust, F.transform(_tail(F.col("last_cust"), 1), lambda m: m["key"])).otherwise(none)
    reason = lambda code, points, ev: F.struct(
        F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), points.cast("int").alias("points"), ev.alias("evidence")
    )
    reasons = F.array_compact(F.array(
        reason("purchase_intent", F.col("purchase_points"), keys("purchase")), reason("time_urgency", F.col("urgency_points"), keys("urgency")),
        reason("interaction", F.col("interaction_points"), keys("last_cust", 3)), reason("open_followup", F.col("followup_points"), newest),
        reason("recurrence", F.col("recurrence_points"), keys("repeat")),
        F.when(F.col("rejection_penalty") > 0, reason("explicit_rejection", -F.col("rejection_penalty"), keys("rejection"))),
        F.when(rank < 9, reason(F.concat(F.lit("unresolved_aftersales_p"), rank.cast("string")), F.lit(0), F.array("state.key"))),
    ))
    told = lambda c, k=3: F.transform(
        _tail(c, k), lambda m: F.struct(m["key"].alias("message_key"), m["text"].alias("text"), m["stamp"].alias("timestamp"))
    )
    context = F.transform(
        _tail(F.col("recent"), 8),
        lambda m: F.struct(m["key"].alias("message_key"), m["role"].alias("role"), m["stamp"].alias("timestamp"), m["text"].alias("text"))
    )
    memory = F.struct(
        told(F.when(n("n_purchase") > 0, F.col("purchase")).otherwise(F.col("last_cust"))).alias("current_needs"),
        told(F.col("objections")).alias("objections"), told(F.col("preferences")).alias("preferences"),
        F.when(last_cust, told(F.col("last_cust"), 1)).otherwise(F.array()).alias("pending_followups"),
        told(F.col("commitments")).alias("studio_commitments"), context.alias("recent_context"),
    )
    points = ["purchase_points", "urgency_points", "interaction_points", "followup_points", "recurrence_points", "rejection_penalty"]
    out = rows.select(
        F.col("k").alias(key), F.col("last.stamp").alias("last_active_at"), "opportunity_score", level.alias("opportunity_level"),
        priority.alias("aftersales_priority"), reasons.alias("reasons"), memory.alias("memory"), *points
    )
    queue = F.when(F.col("aftersales_priority").isNotNull(), "aftersales").otherwise("presales")
    summary = F.concat(
        F.when(F.col("aftersales_priority").isNotNull(), F.concat(F.lit("售后"), F.col("aftersales_priority"))).otherwise("售前"), F.lit("；"),
        F.col("opportunity_level"), F.lit("机会")
    )
    evidence = F.array_sort(F.array_distinct(F.flatten(F.transform("reasons", lambda r: r["evidence"]))))
    return out.withColumns({"queue": queue, "summary": summary, "evidence_message_keys": evidence})


def last_n_hits(rows: DataFrame, *, key: str, order: list[str], n: int, hit: Column, where: Column) -> DataFrame:
    """(key, hits): hits among the last n rows of ``where`` in each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.filter(where).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).groupBy(key).agg(F.count_if(hit).alias("hits"))
