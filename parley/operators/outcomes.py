"""Orders joined to cards by windows of local days, and what became of them in 30 days (specified, not part of the present service)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import ZONE

RETURNS = ("return", "return_taro")
FOLLOWED = (*RETURNS, "cancel", "exchange", "compensation")
OUTCOMES = ("retained_30d", "aftersale_30d", "exchange_30d", "compensation_30d")
FLAGS = ("same_day", "multiple_cards", "multiple_orders", "shared_phone_multiple_conversations")


def local_day(at: Column, zone: str = ZONE) -> Column:
    """Number of the local calendar day."""
    return F.unix_date(F.to_date(F.from_utc_timestamp(at, zone)))


def _after(orders: DataFrame, observed: Column, span: int) -> DataFrame:
    """Each order with its outcomes: true or false where known, null where not yet or not whole.

    What happens after ``span`` days doesn't count, and nothing is false or kept before all of
    them are observed. A return counts by its money, where that is whole.
    """
    day = F.unix_date("paid_on")
    over = observed > day + span
    kind = F.when(F.col("refund_type").isNull() | (F.unix_date("refund_on") > day + span), "none").otherwise(F.col("refund_type"))
    back, paid, still = F.col("refund_minor"), F.col("revenue_minor"), F.coalesce("aftersale_open", F.lit(False))
    whole = F.coalesce((back >= 0) & (back <= paid) & (paid > 0) & F.col("refund_on").isNotNull() & ~still, F.lit(False))
    returned = kind.isin(*RETURNS)
    retained = (
        F.when(kind == "cancel", False).when(returned & whole & (back >= paid), False).when(returned & whole & over, True)
        .when((kind == "exchange") & (F.coalesce(back, F.lit(0)) == 0) & ~still & over, True).when(kind.isin("none", "compensation") & over, True)
    )
    known = ~kind.isin("none", *FOLLOWED)
    happened = lambda what: F.when(what, True).when(known, None).when(over, False)
    lost = F.when(returned & whole, back).when(kind.isin("none", "exchange", "compensation") & over, 0)
    return orders.select(
        "key", day.alias("day"), retained.alias("retained_30d"), happened(kind.isin(*FOLLOWED)).alias("aftersale_30d"),
        happened(kind == "exchange").alias("exchange_30d"), happened(kind == "compensation").alias("compensation_30d"),
        lost.cast("long").alias("lost"), paid.alias("paid"), F.coalesce("anomalous", F.lit(False)).alias("anomalous"),
    )


def card_outcomes(
    cards: DataFrame, orders: DataFrame, *, observed_until: Column, days: dict[str, int] | None = None, span: int = 30, zone: str = ZONE
) -> DataFrame:
    """``cards`` with paid_1d, paid_3d and paid_7d, the outcomes of the first day paid, and attribution.

    cards: (card_id, key, customer_key, at, verified); orders: (key, paid_on, revenue_minor,
    refund_type, refund_minor, refund_on, aftersale_open, anomalous). A window of n days goes
    from the card's local day to the end of the nth after it; it is false once orders were
    observed beyond that end. Cards that aren't verified or have no key meet no order.

    Cards and orders are first summed by key and day; one sort of these days by key serves both
    looks, from cards to the orders after them and from orders to the cards before. So a key
    has as many rows there as it has days, whatever its number of cards and orders, and no card
    is paired with an order.
    """
    days = days or {"paid_1d": 1, "paid_3d": 3, "paid_7d": 7}
    far = max(days.values())
    observed = local_day(observed_until, zone)
    all_cards = cards.withColumn("__day", local_day(F.col("at"), zone))
    ok = F.coalesce(F.col("verified"), F.lit(False)) & F.col("key").isNotNull() & F.col("__day").isNotNull()

    card_days = all_cards.filter(ok).groupBy("key", F.col("__day").alias("day")).agg(
        F.count("*").alias("cards"), F.min("customer_key").alias("lo"), F.max("customer_key").alias("hi")
    )
    facts = _after(orders.filter(F.col("key").isNotNull() & F.col("paid_on").isNotNull() & (F.col("revenue_minor") > 0)), observed, span)
    lacks = lambda c: F.count(c) < F.count("*")
    any_true = lambda c: F.when(F.bool_or(c), True).when(lacks(c), None).otherwise(False)
    kept = F.when(~F.bool_and("retained_30d"), False).when(lacks("retained_30d"), None).otherwise(True)
    order_days = facts.groupBy("key", "day").agg(
        F.count("*").alias("orders"), kept.alias("retained_30d"), *(any_true(c).alias(c) for c in OUTCOMES[1:]),
        F.when(~lacks("lost"), F.sum("lost")).alias("lost"), F.sum("paid").alias("paid"), F.bool_or("anomalous").alias("anomalous"),
    )
    by_day = Window.partitionBy("key").orderBy("day")
    before, ahead = by_day.rangeBetween(-far, 0), by_day.rangeBetween(0, far)
    both = card_days.unionByName(order_days, allowMissingColumns=True)
    both = both.withColumn("met", F.sum("cards").over(before)).withColumn("low", F.min("lo").over(before)).withColumn("high", F.max("hi").over(before))
    first = F.when(F.col("orders").isNotNull(), F.struct("day", "met", (F.col("low") < F.col("high")).alias("shared"), *OUTCOMES, "lost", "paid", "anomalous"))
    both = both.withColumn("first", F.min(first).over(ahead)).withColumn("many", F.sum("orders").over(ahead))
    seen = both.filter("cards is not null").select(F.col("key").alias("__k"), F.col("day").alias("__d"), "first", "many")

    # cards without a key don't travel: they would all meet in one task
    matched = all_cards.filter(ok).join(seen, (F.col("key") == F.col("__k")) & (F.col("__day") == F.col("__d")), "left").drop("__k", "__d")
    rest = all_cards.filter(~ok).withColumn("first", F.lit(None).cast(seen.schema["first"].dataType)).withColumn("many", F.lit(None).cast("long"))
    rows = matched.withColumn("__ok", F.lit(True)).unionByName(rest.withColumn("__ok", F.lit(False)))
    paid = F.col("first").isNotNull()
    window = lambda n: F.when(F.col("__ok"), F.when(F.col("first.day") <= F.col("__day") + n, True).when(observed > F.col("__day") + n, False))
    named = dict(zip(FLAGS, (F.col("first.day") == F.col("__day"), F.col("first.met") > 1, F.col("many") > 1, F.col("first.shared"))))
    flags = F.array_compact(F.array(*(F.when(paid & cond, name) for name, cond in named.items())))
    state = (
        F.when(~F.col("__ok"), "identity_unverified").when(paid & F.col("first.anomalous"), "quality_unknown")
        .when(paid & (F.size("attribution_flags") > 0), "ambiguous").when(paid, "associated").otherwise("none")
    )
    out = rows.select("*", *(window(n).alias(name) for name, n in days.items()), *(F.col(f"first.{c}").alias(c) for c in OUTCOMES),
        F.round(F.col("first.lost") / F.col("first.paid"), 6).alias("refund_loss_ratio"), flags.alias("attribution_flags"))
    return out.withColumn("attribution_state", state).drop("first", "many", "__day", "__ok")
