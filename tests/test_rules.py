"""Rules on authored rows: redaction, keys, live events, ladders, orders, scoring, selection."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from parley.functions import keys, parse
from parley.functions import text as tx
from parley.operators import identity, orders, sampling, scoring, serving
from parley.operators import turns as tn
from parley.sources import readers, sinks


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make("t").alias("x")).first()["x"]


@pytest.mark.parametrize("secret", ["s", "k" * 64, "long " * 30])
def test_hmac_is_pythons(spark, secret):
    got = one(spark, "客户", lambda c: keys.hmac_id(secret, "customer", c))
    want = hmac.new(secret.encode(), "customer\x1f客户".encode(), hashlib.sha256).hexdigest()[:24]
    assert got == "customer_" + want


def test_phones_and_trackings(spark):
    assert one(spark, "打13800138000或13800138000，不是138001380001", tx.mainland_phones) == ["13800138000"]
    assert one(spark, "+86 138-0013-8000", tx.normalize_phone) == "13800138000"
    assert one(spark, "SF1234567890 和 1234567890", tx.tracking_numbers) == ["SF1234567890"]
    assert one(spark, None, tx.tracking_numbers) == []


def test_redaction(spark):
    text, flags = tx.redacted("电话13800138000，邮箱a@b.com")
    assert "13800138000" not in text and {"phone", "email"} <= set(flags)
    assert tx.redacted(None) == ("", [])
    assert tx.redacted("可以退款")[0] == "[退款结论]"
    df = tx.with_redaction(spark.createDataFrame([("打13800138000",), (None,)], "t string"), "t", "r")
    assert [r["r"]["text"] for r in df.collect()] == [tx.redacted("打13800138000")[0], ""]


def test_parse(spark):
    assert one(spark, "1,299.005", parse.money_minor)["value"] == 129901
    assert one(spark, "x", parse.money_minor)["error"] == "invalid"
    assert one(spark, "1970/01/01", parse.source_date)["error"] == "epoch_placeholder"
    assert str(one(spark, "2026/07/01", parse.source_date)["value"]) == "2026-07-01"
    assert one(spark, "2026-07-01T10:00:00", parse.synced_at) is None


def test_turn_gap_is_inclusive_and_roles_break(spark):
    rows = [
        ("c", "customer", "2026-07-01 10:00:00", 1, "a"), ("c", "customer", "2026-07-01 10:15:00", 2, "b"),
        ("c", "customer", "2026-07-01 10:30:01", 3, "c"), ("c", "studio", "2026-07-01 10:30:02", 4, "d")
    ]
    df = spark.createDataFrame(
        rows, "customer_key string, role string, timestamp string, source_ordinal int, text string"
    ).withColumn("ts", F.col("timestamp").cast("timestamp")).withColumn("message_key", F.col("text"))
    got = tn.merge_turns(df).orderBy("turn_no").collect()
    assert [r["message_keys"] for r in got] == [["a", "b"], ["c"], ["d"]] and got[0]["text"] == "a\nb"


def event(i, **kw):
    base = {
        "event_id": f"e{i}", "account_profile": "p", "message_timestamp": 1782871200, "message_time": "2026-07-01T10:00:00+08:00",
        "conversation_id": "w", "conversation_name": "n", "chat_type": "private", "sender": "", "message_type": "文本", "text": "你好"
    }
    return json.dumps(base | kw, ensure_ascii=False)


def test_live_ladder(spark):
    lines = [
        "", "{", "[1]", event(1, event_id=""), event(2), event(2), event(2, text="另"), event(3, account_profile="q"), event(4, chat_type="group"),
        event(5, message_type="image"), event(6, text=" "), event(7, sender="x"), event(8, message_time="2026-07-01T10:05:00+08:00"), event(4)
    ]
    df = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines)], "source_file string, ordinal long, line string")
    acc = spark.createDataFrame([("p", "a", "me")], "account_profile string, account_id string, self_sender string")
    got = [r["reject_reason"] for r in readers.live_events(df, acc, "s").orderBy("ordinal").collect()]
    assert got == [
        "blank_line", "invalid_json", "invalid_record", "missing_event_id", None, "duplicate_exact", "duplicate_conflict", "unknown_profile",
        "non_private", "non_text", "empty_text", "unknown_sender", "timestamp_mismatch", "duplicate_conflict"
    ]
    assert sum(r["rows"] for r in readers.accounting(readers.live_events(df, acc, "s")).collect()) == len(lines)


def test_evidence_ladder(spark):
    o = spark.createDataFrame(
        [("13800000001", "SF00000001"), ("13800000002", "SF00000002"), ("13800000003", "SF00000002")], "phone string, tracking_no string"
    )
    conv = [
        (1, ["13800000001"], []), (2, ["13800000001", "13800000002"], []), (3, [], ["SF00000001"]), (4, [], ["SF00000002"]),
        (5, ["13800000002"], ["SF00000001"]), (6, ["13900000000"], [])
    ]
    got = {
        r["key"]: r["rule"] for r in identity.evidence_ladder(
            spark.createDataFrame(conv, "key int, direct array<string>, trackings array<string>"), o
        ).collect()
    }
    assert got == {
        1: "customer_phone_order_exact", 2: "customer_phone_order_conflict", 3: "customer_tracking_order_exact",
        4: "customer_tracking_order_conflict", 5: "customer_evidence_conflict", 6: None
    }


def test_bindings(spark):
    rows = [
        ("a", "13800000001", "w1", "0.95"), ("a", "13800000001", "w2", "0.82"), ("a", "13800000001", "w2", "0.95"),
        ("a", "13800000001", "w3", "0.99"), ("a", "13800000002", "w3", "0.99"), ("z", "1", "w", "1"), ("a", "1", "", "1"), ("a", "1", "w", "1"),
        ("a", "13800000001", "w", "2")
    ]
    df = identity.binding_rows(
        spark.createDataFrame(rows, "account string, phone string, raw_id string, confidence string"),
        spark.createDataFrame([("a", "A")], "alias string, account_id string")
    )
    assert {r["reason"]: r["rows"] for r in readers.accounting(df).collect()} == {
        "accepted": 5, "unknown_accounts": 1, "missing_raw_id": 1, "invalid_phones": 1, "invalid_confidence": 1
    }
    assert sorted(r["state"] for r in identity.binding_links(df, "s").collect()) == ["approved", "conflict", "review"]


def test_order_flags(spark):
    row = {
        "record_id": "1", "pay_date": "1970-01-01", "revenue": "5", "refund_type": "退", "refund_date": "2027-01-01", "refund_amount": None,
        "return_status": "处理中", "phone": None, "refund_reason": "李四说退", "customer_name": "李四"
    }
    df = spark.createDataFrame([row], ", ".join(f"{k} string" for k in row)).withColumn("today", F.lit("2026-07-01").cast("date"))
    got = orders.normalize(df, today="today", secret="s").first()
    assert got["quality_flags"] == ["aftersale_open", "future_refund_on", "incomplete_customer_payment", "invalid_paid_on", "missing_refund_amount"]
    assert got["paid_on"] is None and got["revenue_minor"] is None and str(got["refund_on"]) == "2027-01-01" and "李四" not in got["refund_reason"]


def test_after_sales_closure(spark):
    texts = [("customer", "要退款"), ("studio", "解决了"), ("customer", "快递到哪"), ("customer", "解决了"), ("customer", "快递单号")]
    df = spark.createDataFrame(
        [("c", r, f"2026-07-01 10:0{i}:00", i, t, f"m{i}") for i, (r, t) in enumerate(texts)],
        "customer_key string, role string, timestamp string, source_ordinal int, text string, message_key string"
    )
    got = scoring.analyze(df.withColumn("ts", F.col("timestamp").cast("timestamp")), "2026-07-02 00:00:00").first()
    assert got["aftersales_priority"] == "P2" and got["reasons"][-1]["evidence"] == ["m4"]


@pytest.mark.parametrize("part", [1, 3, 1000])
def test_scores_do_not_depend_on_parts(spark, part):
    import random

    rng = random.Random(8)
    words = ["想要下单", "多少钱", "尽快", "解决了", "退款", "破损", "快递到哪", "再来一个", "不需要", "太贵", "喜欢这个", "我帮你查", "好的", "可以了", "售后", "在吗？"]
    rows = [
        (
            f"c{i % 3}", rng.choice(["customer", "studio"]), f"2026-07-{1 + i // 40:02d} {10 + i % 12}:00:00", i,
            rng.choice(words) + rng.choice(words), f"m{i}"
        ) for i in range(150)
    ]
    df = spark.createDataFrame(
        rows, "customer_key string, role string, timestamp string, source_ordinal int, text string, message_key string"
    ).withColumn("ts", F.col("timestamp").cast("timestamp"))
    got = {r["customer_key"]: r for r in scoring.analyze(df, "2026-07-09 00:00:00", part=part).collect()}
    for c in ("c0", "c1", "c2"):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[3]))
        said, state = [r for r in mine if r[1] == "customer"], None
        hits = lambda group, rs: [r[5] for r in rs if any(w in r[4] for w in group)]
        x = scoring.lx.Lexicon()
        for r in said:
            if state and hits(x.closure, [r]):
                state = None
                continue
            rank = next((k for k, g in enumerate((x.p0, x.p1, x.p2)) if hits(g, [r])), None)
            if rank is not None and (state is None or rank <= state[0]):
                state = (rank, r[5])
        assert got[c]["aftersales_priority"] == (f"P{state[0]}" if state else None)
        assert got[c]["purchase_points"] == min(35, 9 * len(hits(x.purchase, said))) and got[c]["rejection_penalty"] == (
            30 if hits(x.rejection, said[-10:]) else 0
        )
        by = {r["code"]: r["evidence"] for r in got[c]["reasons"]}
        assert by["purchase_intent"] == hits(x.purchase, said)[-5:] and by["interaction"] == [r[5] for r in said][-3:] and by["recurrence"] == hits(x.repeat, said)[-5:]
        if state:
            assert by[f"unresolved_aftersales_p{state[0]}"] == [state[1]]
        assert [m["message_key"] for m in got[c]["memory"]["objections"]] == hits(x.objection, said[-20:])[-3:]


def test_splits_do_not_leak(spark):
    pairs = [(f"c{i}", f"问题{i % 7}怎么办", f"回复内容{'甲乙丙丁'[i % 4]}", 8 + i % 4, f"2026-07-01T{i:02d}") for i in range(24)]
    df = spark.createDataFrame(pairs, "customer_key string, trigger_text string, reply_text string, quality_score int, timestamp string")
    got = sampling.select_pairs(df, secret="s", limit=10).collect()
    assert len(got) <= 10
    by_reply = {}
    for r in got:
        assert r["split"] == by_reply.setdefault(r["reply_text"], r["split"])


def test_serving(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "k int, v int")
    assert [r["k"] for r in serving.page(df, ["v", "k"], limit=3, offset=2).collect()] == [6, 9, 1]
    with pytest.raises(ValueError):
        serving.page(df, ["k"], limit=201)
    root = f"file://{tmp_path}"
    sinks.publish(df.limit(3), root, "t")
    sinks.publish(df, root, "t")
    assert sinks.current(spark, root, "t").count() == 10
    new = spark.createDataFrame([(1, 99), (50, 5)], "k int, v int")
    assert sinks.upsert(df, new, ["k"]).count() == 11 and sinks.insert_or_ignore(df, new, ["k"]).count() == 11


def test_lines_are_numbered_over_splits(spark, tmp_path):
    from parley.sources.readers import numbered_lines

    want = {}
    for name, n in (("a.jsonl", 4000), ("b.jsonl", 3), ("c.jsonl", 0)):
        lines = [f"{name} {i} " + "x" * (i % 37) if i % 11 else "" for i in range(n)]
        (tmp_path / name).write_bytes("\r\n".join(lines).encode() + b"\r\n" * (n > 0))
        want |= {(name, i + 1): x for i, x in enumerate(lines)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = numbered_lines(spark, f"file://{tmp_path}")
        assert rows.rdd.getNumPartitions() > 4
        got = {(r["source_file"], r["ordinal"]): r["line"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_only_texts_beyond_ascii_go_to_python_for_their_normal_form(spark):
    import unicodedata

    some = [None, "", "plain [a] 12", "ﬁne １２", "é à", "㈱ café", "\U0001d400x"]
    df = spark.createDataFrame([(t,) for t in some], "t string").select("t", tx.nfkc("t").alias("n"))
    assert [r["n"] for r in df.collect()] == [t if t is None else unicodedata.normalize("NFKC", t) for t in some]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE(t#" in plan and "pandas" not in plan.lower()
