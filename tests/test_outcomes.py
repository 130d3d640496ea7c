"""Windows of local days and outcomes of 30 days."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parley.operators import outcomes

CARDS = "card_id int, key string, customer_key string, at timestamp, verified boolean"
ORDERS = "key string, paid_on date, revenue_minor long, refund_type string, refund_minor long, refund_on date, aftersale_open boolean, anomalous boolean"


def told(spark, cards, orders, until="2024-03-20 00:00:00"):
    c, o = spark.createDataFrame(cards, CARDS), spark.createDataFrame(orders, ORDERS)
    out = outcomes.card_outcomes(c, o, observed_until=F.lit(until).cast("timestamp"))
    return {r["card_id"]: r for r in out.collect()}


def day(n):
    return dt.date(2024, 1, 10) + dt.timedelta(n)


def order(key, n, kind=None, back=None, back_on=None, still=False, bad=False):
    return (key, day(n), 1000, kind, back, back_on, still, bad)


def test_windows_end_with_local_days(spark):
    at = dt.datetime(2024, 1, 9, 16, 30)  # 00:30 of the 10th in the zone
    keys = {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "f": 7, "g": 8, "h": -1}
    got = told(spark, [(i, k, k, at, True) for i, k in enumerate(keys)], [order(k, n) for k, n in keys.items()])
    assert [[got[i][f"paid_{n}d"] for n in (1, 3, 7)] for i in range(8)] == [
        [True] * 3, [True] * 3, [False, True, True], [False, True, True], [False, False, True], [False, False, True], [False] * 3, [False] * 3
    ]
    assert got[0]["attribution_state"] == "ambiguous" and got[0]["attribution_flags"] == ["same_day"]
    assert got[1]["attribution_state"] == "associated" and got[6]["attribution_state"] == "none"
    early = told(spark, [(1, "x", "x", at, True)], [], "2024-01-13 15:59:59")[1]  # the 13th isn't over
    assert [early[f"paid_{n}d"] for n in (1, 3, 7)] == [False, None, None]
    assert told(spark, [(1, "x", "x", at, True)], [], "2024-01-13 16:00:00")[1]["paid_3d"] is False


KINDS = [
    (None, None, None, False, (True, False, False, False, 0.0)), ("cancel", None, None, False, (False, True, False, False, None)),
    ("return", 1000, 5, False, (False, True, False, False, 1.0)), ("return", 300, 5, False, (True, True, False, False, 0.3)),
    ("return", None, 5, False, (None, True, False, False, None)), ("return", 2000, 5, False, (None, True, False, False, None)),
    ("return_taro", 300, 5, True, (None, True, False, False, None)), ("return", 1000, 40, False, (True, False, False, False, 0.0)),
    ("exchange", None, None, False, (True, True, True, False, 0.0)), ("exchange", None, None, True, (None, True, True, False, 0.0)),
    ("compensation", None, None, False, (True, True, False, True, 0.0)), ("other", None, None, False, (None, None, None, None, None)),
]


def test_outcomes_by_kind(spark):
    at = dt.datetime(2024, 1, 9, 4)
    rows = [order(f"k{i}", 2, kind, back, back_on and day(2 + back_on), still) for i, (kind, back, back_on, still, _) in enumerate(KINDS)]
    cards = [(i, f"k{i}", "c", at, True) for i in range(len(KINDS))]
    fields = (*outcomes.OUTCOMES, "refund_loss_ratio")
    got = told(spark, cards, rows)
    assert [tuple(got[i][f] for f in fields) for i in range(len(KINDS))] == [k[-1] for k in KINDS]
    soon = told(spark, cards, rows, "2024-01-20 00:00:00")
    assert not any(soon[i][f] is False for i in range(len(KINDS)) for f in outcomes.OUTCOMES[1:]) and soon[0]["retained_30d"] is None
    assert soon[1]["retained_30d"] is False and soon[8]["exchange_30d"] is True


def test_shared_phones_and_unverified_cards(spark):
    at = dt.datetime(2024, 1, 9, 4)
    cards = [(1, "p", "c1", at, True), (2, "p", "c2", at, True), (3, "p", "c3", at, False), (4, None, "c4", at, True), (5, "q", "c5", at, None), (6, "r", "c6", at, True)]
    got = told(spark, cards, [order("p", 1), order("p", 2), order("q", 1), order("r", 1, bad=True), order(None, 1)])
    assert got[1]["attribution_flags"] == got[2]["attribution_flags"] == ["multiple_cards", "multiple_orders", "shared_phone_multiple_conversations"]
    assert {got[i]["attribution_state"] for i in (3, 4, 5)} == {"identity_unverified"} and got[5]["paid_7d"] is None
    assert got[6]["attribution_state"] == "quality_unknown" and got[1]["attribution_state"] == "ambiguous"
    assert told(spark, [], []) == {}


def test_one_phone_of_many_orders(spark):
    """Rows that meet are days of a key, not its cards times its orders."""
    n = 100_000
    orders = spark.range(n).select(
        F.lit("hot").alias("key"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")).alias("paid_on"), F.lit(100).cast("long").alias("revenue_minor"),
        F.lit(None).cast("string").alias("refund_type"), F.lit(None).cast("long").alias("refund_minor"), F.lit(None).cast("date").alias("refund_on"),
        F.lit(False).alias("aftersale_open"), F.lit(False).alias("anomalous"),
    )
    cards = spark.range(20_000).select(
        F.col("id").cast("int").alias("card_id"), F.lit("hot").alias("key"), F.col("id").cast("string").alias("customer_key"),
        F.timestamp_seconds(1704067200 + F.col("id") % 60 * 86400).alias("at"), F.lit(True).alias("verified"),
    )
    out = outcomes.card_outcomes(cards, orders, observed_until=F.lit("2024-06-01").cast("timestamp"))
    r = out.agg(F.count("*").alias("n"), F.count_if("paid_1d").alias("paid"), F.count_if(F.array_contains("attribution_flags", "multiple_orders")).alias("many")).first()
    assert tuple(r) == (20_000, 20_000, 20_000)
