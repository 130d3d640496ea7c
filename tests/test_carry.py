"""Scores carried on from a kept state against scores of all messages."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import scoring

COLUMNS = "customer_key string, role string, timestamp string, source_ordinal long, text string, message_key string"
WORDS = ["多少钱", "怎么买", "今天", "急", "还要", "上次", "不要了", "太贵", "喜欢", "安排", "退款", "投诉", "坏了", "解决了", "谢谢", "在吗", ""]
SNAP = "2026-08-01 00:00:00"


def chat(seed, n, customers):
    rng, now = random.Random(seed), dt.datetime(2026, 6, 1)
    for i in range(n):
        now += dt.timedelta(minutes=rng.choice([0, 1, 5, 14, 15, 16, 300]))
        who = f"c{min(rng.randrange(customers * 2), customers - 1)}"  # the last one has more than half
        text = None if rng.random() < 0.02 else "".join(rng.choices(WORDS, k=rng.randint(1, 3)))
        yield (who, rng.choice(["customer", "customer", "studio"]), now.strftime("%Y-%m-%d %H:%M:%S"), i, text, f"m{i}")


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("ts", F.col("timestamp").cast("timestamp"))


def shown(df):
    return {r["customer_key"]: str(r) for r in df.collect()}


@pytest.mark.parametrize("cuts,late", [((150, 290), ()), ((5, 10, 11), (3, 200))])
def test_carried_scores_equal_scores_of_all(spark, cuts, late):
    rows = list(chat(len(cuts), 300, 4))
    rows.append(("alone", "studio", "2026-06-01 00:00:00", 1000, "在吗", "m1000"))
    held = [rows[i] for i in late]  # these come with the last batch
    days = [rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)))]
    days = [[r for r in d if r not in held] for d in days]
    days[-1] += held
    state = scoring.carry(frame(spark, days[0]), part=7)
    state, seen = spark.createDataFrame(state.collect(), state.schema), days[0]
    for day in days[1:]:
        seen = seen + day
        fresh = scoring.go_on(state, frame(spark, day), frame(spark, seen), part=7)
        assert {r["k"] for r in fresh.select("k").collect()} == {r[0] for r in day}  # no other customer is made
        both = fresh.unionByName(state.join(fresh.select("k"), "k", "left_anti"))
        state = spark.createDataFrame(both.collect(), both.schema)
    assert shown(scoring.score(state, SNAP)) == shown(scoring.analyze(frame(spark, rows), SNAP))
    assert max(len(r["tail"]) for r in state.collect()) <= 2 * scoring.TAIL


def test_history_is_read_for_late_customers_alone(spark):
    rows = list(chat(9, 120, 3))
    state = scoring.carry(frame(spark, rows[:100]))
    state = spark.createDataFrame(state.collect(), state.schema)
    want = shown(scoring.score(scoring.go_on(state, frame(spark, rows[100:]), frame(spark, rows)), SNAP))
    # nobody is late: the same without any history
    assert shown(scoring.score(scoring.go_on(state, frame(spark, rows[100:]), frame(spark, [])), SNAP)) == want
    assert scoring.go_on(state, frame(spark, []), frame(spark, rows)).count() == 0


def test_states_are_joined_without_sorts(spark, monkeypatch):
    rows = list(chat(5, 160, 6))
    late = rows.pop(20)
    state = scoring.carry(frame(spark, rows[:90]))
    state = spark.createDataFrame(state.collect(), state.schema)
    monkeypatch.setattr(scoring, "ROWS", 10, raising=False)  # more tasks than the session's
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    try:
        fresh = scoring.go_on(state, frame(spark, [*rows[90:], late]), frame(spark, [*rows, late]))
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "REPARTITION_BY_NUM" in plan
        both = fresh.unionByName(state.join(fresh.select("k"), "k", "left_anti"))
        assert shown(scoring.score(both, SNAP)) == shown(scoring.analyze(frame(spark, [*rows, late]), SNAP))
    finally:
        for n in names:
            spark.conf.unset(n)
