"""Extensions that are specified, not part of the present service: cards and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hmac_id


def action_state(
    turns: DataFrame, *, key: str, asker: str, observed_until: Column, role="role", start="start_ts", end="end_ts", order="turn_no"
) -> DataFrame:
    """``turns`` with action: what followed a turn of the asker, as far as it was observed."""
    w = Window.partitionBy(key).orderBy(order)
    nxt_role, nxt_at = F.lead(role).over(w), F.lead(start).over(w)
    gap = F.unix_seconds(nxt_at) - F.unix_seconds(F.col(end))
    answered = nxt_role.isNotNull() & (nxt_role != asker) & (gap >= 0)
    seen = observed_until.isNotNull() & (F.unix_seconds(observed_until) >= F.unix_seconds(F.col(end)) + 86400)
    state = (
        F.when(F.col(role) != asker, F.when(F.lag(role).over(w) == F.col(role), "proactive_followup")).when(answered & (gap <= 1800), "immediate")
        .when(answered & (gap <= 86400), "delayed").when(seen, "no_reply").otherwise("unobserved")
    )
    return turns.withColumn("action", state)


def cards(turns: DataFrame, secret: str, *, key: str, asker: str, depth=8, role="role", order="turn_no", stamp="started_at") -> DataFrame:
    """A card per turn of the asker: id from what was known then, and up to ``depth`` turns before."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-depth, -1)
    before = F.collect_list(F.struct(order, role, "text")).over(w)
    rows = turns.withColumn("context", before).filter(F.col(role) == asker)
    return rows.select(hmac_id(secret, "card", key, stamp, order).alias("card_id"), key, order, "text", "context")


def tri_state(rows: DataFrame, facts: DataFrame, *, key: str, at: str, fact_at: str, days: dict[str, int], observed_until: Column) -> DataFrame:
    """``rows`` with a boolean per window: true if a fact falls in it, false once it is over, else null.

    A row's facts are found by the key; the window is a condition of the aggregate, so a row
    has one pass over its key's facts whatever the number of windows. Equal rows become one.
    """
    j = rows.join(
        facts.select(F.col(key).alias("__k"), F.col(fact_at).alias("__f")),
        (F.col(key) == F.col("__k")) & (F.col("__f") > F.col(at)) & (F.col("__f") <= F.col(at) + F.make_interval(days=F.lit(max(days.values())))),
        "left"
    )
    until = lambda n: F.col(at) + F.make_interval(days=F.lit(n))
    g = j.groupBy(*rows.columns).agg(*(F.max(F.coalesce(F.col("__f") <= until(n), F.lit(False))).alias(f"__{name}") for name, n in days.items()))
    return g.select(
        *rows.columns, *(F.when(F.col(f"__{name}"), True).when(observed_until >= until(n), False).alias(name) for name, n in days.items())
    )


def attribution(flags: dict[str, Column], order: list[str]) -> tuple[Column, Column]:
    """(state, flags): the first that holds in order, and all that hold."""
    state = F.when(flags[order[0]], order[0])
    for name in order[1:]:
        state = state.when(flags[name], name)
    return state.otherwise("unattributed"), F.array_compact(F.array(*(F.when(flags[n], n) for n in order)))
