"""Readers, imports and the read side on small files: counts and states that the rules fix."""

import json
import re

import pytest
from pyspark.sql import functions as F

from parley.functions import keys, lexicons, parse
from parley.functions import text as tx
from parley.operators import detail, identity, orders, sampling, serving
from parley.sources import readers, sinks, snapshot

SECRET = "fixture-secret"


def put(path, name, data):
    text = data if isinstance(data, str) else json.dumps(data, ensure_ascii=False)
    (path / name).write_text(text, encoding="utf-8")
    return f"file://{path}/{name}"


def jsonl(rows):
    return "".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows)


# ----- export -----------------------------------------------------------------


def message(conv, minute, status, text, **more):
    return {
        "conversation_id": conv, "conversation_type": "friend", "message_id": minute,
        "timestamp": f"2026-07-0{1 if conv == 'a' else 2}T{10 if conv == 'a' else 9:02d}:{minute:02d}:00", "message_type": "text",
        "render_type": "x", "text": text, "raw_payload": {"status": status}
    } | more


EXPORT = [
    message("a", 0, 3, "请问怎么订？电话13800138000。"), message("a", 4, 3, "我明天要用。"), message("a", 10, 2, "您好，可以先确认规格。"), message("a", 12, 2, "价格请以报价为准。"),
    message("a", 13, 2, "图", message_type="image"), message("a", 14, 1, "系统"), message("a", 15, 3, " \x00 "), message("z", 1, 3, "不在名单里"),
    message("g", 1, 3, "群里", conversation_type="group"), message("b", 0, 3, "在吗"), message("b", 5, 2, "在的"), message("b", 10, 3, "好"),
]
INDEX = [
    {"conversation_id": "a", "conversation_type": "friend", "remark": "旧名"}, {"conversation_id": "b", "conversation_type": "friend"},
    {"conversation_id": "g", "conversation_type": "group"},
    {"conversation_id": "", "conversation_type": "friend"}, {"conversation_id": "a", "conversation_type": "friend", "remark": "新名"},
]


def test_export_is_read(spark, tmp_path):
    put(tmp_path, "messages.jsonl", jsonl(EXPORT))
    put(tmp_path, "conversation_index.json", INDEX)
    rows = readers.read_export(spark, f"file://{tmp_path}", SECRET, "acc").collect()
    assert len(rows) == 7 and len({r["customer_key"] for r in rows}) == 2
    assert sorted(r["role"] for r in rows) == ["customer"] * 4 + ["studio"] * 3
    assert (min(r["timestamp"] for r in rows), max(r["timestamp"] for r in rows)) == ("2026-07-01T10:00:00", "2026-07-02T09:10:00")
    assert {r["source_ordinal"] for r in rows} == {1, 2, 3, 4, 10, 11, 12} and len({r["message_key"] for r in rows}) == 7
    index = {r["conversation_id"]: r["remark"] for r in readers.read_index(spark, f"file://{tmp_path}/conversation_index.json").collect()}
    assert index == {"a": "新名", "b": None}
    auto = readers.read_source(spark, f"file://{tmp_path}", secret=SECRET, account="acc")
    assert auto.count() == 7


@pytest.mark.parametrize("bad", ["{", json.dumps(message("a", 0, 3, "x", timestamp="gestern"))])
def test_export_fails_on_a_bad_line(spark, tmp_path, bad):
    put(tmp_path, "messages.jsonl", jsonl([*EXPORT, bad]))
    put(tmp_path, "conversation_index.json", INDEX)
    with pytest.raises(Exception):  # noqa: B017  Spark's own error
        readers.read_export(spark, f"file://{tmp_path}", SECRET, "acc").collect()


@pytest.mark.parametrize(
    "summary,want",
    [
        (None, "data"), ({"first_timestamp": "2026-01-01T00:00:00Z", "last_timestamp": "2026-02-01T00:00:00Z"}, "told"),
        ({"first_timestamp": "2026-01-01T00:00:00Z"}, "data"), ("{", "data")
    ]
)
def test_window_of_an_export(spark, tmp_path, summary, want):
    if summary is not None:
        put(tmp_path, "summary.json", summary)
    first, last = readers.read_window(spark, f"file://{tmp_path}", F.lit("2025-01-01").cast("timestamp"), F.lit("2025-02-01").cast("timestamp"))
    got = spark.range(1).select(first.cast("string").alias("a"), last.cast("string").alias("b")).first()
    assert got == (("2026-01-01 00:00:00", "2026-02-01 00:00:00") if want == "told" else ("2025-01-01 00:00:00", "2025-02-01 00:00:00"))


def test_shared_phones(spark):
    rows = [("a", "电话13800138000"), ("b", "打 13800138000"), ("c", "13900139000 谢谢"), ("d", "没有")]
    df = spark.createDataFrame(rows, "customer_key string, text string").withColumn("ids", tx.mainland_phones("text"))
    states = [r["state"] for r in identity.identifier_states(df, key="customer_key", ids="ids").collect()]
    assert sorted(states) == ["ambiguous_shared", "ambiguous_shared", "candidate_unique", "missing"]


# ----- live events ------------------------------------------------------------


def event(i, profile="profile-a", at=1783908000, conv="raw-a", sender="", text="你好", shown=None, **more):
    from datetime import datetime, timedelta, timezone

    local = datetime.fromtimestamp(at, timezone(timedelta(hours=8))).strftime("%Y-%m-%d %H:%M:%S")
    base = {
        "schema_version": "1", "event_id": f"event-{i}", "account_profile": profile, "message_timestamp": at, "message_time": shown or local,
        "conversation_id": conv, "conversation_name": "虚构", "chat_type": "private", "sender": sender, "message_type": "文本", "text": text
    }
    return base | more


LIVE = [
    event(1, text="想了解，详细地址：某学校"), event(2, at=1783908300, sender="studio-a", text="联系人：某某，studio-a 和 raw-a。"),
    event(3, "profile-b", 1783911600, "raw-b"), event(4, "profile-b", 1783911900, "raw-b", "studio-b"),
    event(1, text="想了解，详细地址：某学校"), event(1, text="另一个"), event(5, sender="nobody"), event(6, "profile-x"), event(7, shown="2026-07-13 23:00:00"),
    event(8, message_type="图片"), event(9, chat_type="group"), event(10, chat_type="group"),
]
ACCOUNTS = {
    "version": 1,
    "accounts": {
        p: {
            "canonical_account_id": f"acc-{p[-1]}", "self_sender": f"studio-{p[-1]}", "binding_account_alias": f"fixture-{p[-1]}", "state": "approved"
        } for p in ("profile-a", "profile-b", "profile-d")
    }
}
STATE = {
    "status": "stopped", "last_success_at": "2026-07-13T12:00:00+08:00",
    "accounts": {
        "profile-a": {"initialized": True, "last_poll_at": "2026-07-13T12:00:00+08:00", "last_error": ""},
        "profile-b": {"initialized": True, "last_poll_at": "2026-07-13T12:00:01+08:00", "last_error": ""}
    }
}


@pytest.fixture
def live(spark, tmp_path):
    accounts = readers.read_accounts(spark, put(tmp_path, "accounts.json", ACCOUNTS))
    lines = readers.numbered_lines(spark, put(tmp_path, "events.jsonl", jsonl(LIVE)))
    return readers.live_events(lines, accounts, SECRET), accounts, tmp_path


def test_live_counts(spark, live):
    rows, accounts, folder = live
    assert {r["reason"]: r["rows"] for r in readers.accounting(rows).collect()} == {
        "accepted": 4, "duplicate_exact": 1, "duplicate_conflict": 1, "unknown_sender": 1, "unknown_profile": 1, "timestamp_mismatch": 1,
        "non_text": 1, "non_private": 2
    }
    ok = rows.filter("reject_reason is null").orderBy("ordinal").collect()
    assert len({r["customer_key"] for r in ok}) == 2 and [r["evidence"] for r in ok] == ["empty_sender", "configured_self_sender"] * 2
    assert ok[0]["timestamp"] == "2026-07-13T10:00:00+08:00"
    assert ok[0]["text"] == "想了解，[地址]" and "studio-a" not in ok[1]["text"] and "raw-a" not in ok[1]["text"] and "[微信号]" in ok[1]["text"]
    want = keys.hmac_id(SECRET, "message", F.lit("event-1"), F.lit("2026-07-13T10:00:00+08:00"), keys.content_digest(F.lit("想了解，详细地址：某学校")))
    assert ok[0]["message_key"] == spark.range(1).select(want.alias("k")).first()["k"]
    last = rows.filter("reject_reason is null").groupBy("account_profile").agg(F.max("ts").alias("last_ts"))
    state = readers.read_state(spark, put(folder, "state.json", STATE))
    seen = {
        r["account_profile"]: (r["observed_until"] is not None, r["reason"]) for r in readers.observations(
            accounts, state, last, F.lit("2026-07-13 04:00:00").cast("timestamp")
        ).collect()
    }
    assert seen == {"profile-a": (True, None), "profile-b": (True, None), "profile-d": (False, "missing_profile_observation")}
    again = readers.read_source(spark, f"file://{folder}/events.jsonl", accounts=accounts, secret=SECRET)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_ids_met_on_rejected_lines_count(spark):
    lines = [json.dumps(event(1, chat_type="group")), json.dumps(event(1))]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "source_file string, ordinal long, line string")
    acc = spark.createDataFrame([("profile-a", "a", "me")], "account_profile string, account_id string, self_sender string")
    assert [r["reject_reason"] for r in readers.live_events(df, acc, SECRET).orderBy("ordinal").collect()] == ["non_private", "duplicate_conflict"]


# ----- bindings ---------------------------------------------------------------

CSV = """账号,客户手机号,客户名称,微信原始ID,微信号/alias,绑定置信度,匹配依据
fixture-a,13800138000,甲,raw-a,x,0.95,精确
fixture-b,13800138000,乙,raw-b,x,0.95,精确
fixture-a,13900139000,丙,raw-c,x,0.95,精确
fixture-a,13700137000,丙,raw-c,x,0.95,精确
fixture-a,13600136000,丁,,x,0.95,昵称
unknown,13500135000,戊,raw-u,x,0.95,未知
fixture-a,not-a-phone,己,raw-i,x,0.95,非法
fixture-a,13400134000,庚,raw-r,x,0.82,低
"""


def test_binding_list(spark, tmp_path, live):
    rows, accounts, _ = live
    table = readers.read_bindings(spark, put(tmp_path, "b.csv", "﻿" + CSV))
    assert {r["confidence"]: r["rows"] for r in identity.confidence_histogram(table).collect()} == {"0.82": 1, "0.95": 7}
    checked = identity.binding_rows(table, identity.registry(accounts))
    assert {r["reason"]: r["rows"] for r in readers.accounting(checked).collect()} == {
        "accepted": 5, "unknown_accounts": 1, "missing_raw_id": 1, "invalid_phones": 1
    }
    found = identity.binding_links(checked, SECRET)
    got = found.collect()
    assert sorted(r["state"] for r in got) == ["approved", "approved", "conflict", "review"]
    assert len(
        {r["phone_hmac"] for r in got if r["state"] == "approved"}
    ) == 1 and [r["phone_hmac"] for r in got if r["state"] == "conflict"] == [None]

    refs = rows.filter("reject_reason is null").select(
        "customer_key", F.col("account_profile").alias("profile_id"), "account_id", "raw_hash"
    ).distinct()
    none = spark.createDataFrame(
        [], "link_id string, raw_hash string, phone_hmac string, state string, source_hash string, version string, reviewed_at string"
    )
    links, counts = identity.import_bindings(found, refs, none, SECRET, "hash-1")
    assert tuple(counts.first()) == (2, 2) and {r["state"] for r in links.collect()} == {"approved"}
    reviewed = links.withColumns({"state": F.lit("rejected"), "reviewed_at": F.lit("2026-07-14")})
    for source, state in (("hash-1", "rejected"), ("hash-2", "approved")):  # another file: the decision no longer holds
        assert {r["state"] for r in identity.import_bindings(found, refs, reviewed, SECRET, source)[0].collect()} == {state}


def test_least_confidence_decides(spark):
    rows = [
        ("fixture-a", "13800138000", "raw-a", "0.95"), ("fixture-a", "+86 138 0013 8000", "raw-a", "0.82"),
        ("fixture-a", "13800138000", "raw-b", "0.9500")
    ]
    df = spark.createDataFrame(rows, "account string, phone string, raw_id string, confidence string")
    got = identity.binding_links(identity.binding_rows(df, spark.createDataFrame([("fixture-a", "A")], "alias string, account_id string")), SECRET)
    assert sorted((str(r["confidence"]), r["state"]) for r in got.collect()) == [("0.8200", "review"), ("0.9500", "approved")]


def test_registry_refuses_a_repeated_alias(spark):
    df = spark.createDataFrame(
        [("x", "A", "approved"), ("x", "B", "approved"), ("", "C", "approved"), ("x", "D", "draft")],
        "binding_account_alias string, account_id string, state string"
    )
    with pytest.raises(Exception, match="unique"):
        identity.registry(df).collect()
    assert identity.registry(df.filter("account_id <> 'B'")).collect() == [("x", "A")]


def test_missing_columns_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="missing"):
        readers.read_bindings(spark, put(tmp_path, "b.csv", "账号,x\n1,2\n"))
    with pytest.raises(ValueError, match="missing"):
        readers.read_labels(spark, put(tmp_path, "l.csv", "calibration_id,x\n1,2\n"))
    labels = readers.read_labels(spark, put(tmp_path, "ok.csv", "﻿calibration_id,reviewer_role\nc1, studio \nc2,customer\n"))
    assert [tuple(r) for r in labels.orderBy("calibration_id").collect()] == [("c1", "studio"), ("c2", "customer")]
    with pytest.raises(Exception, match="reviewer_role"):
        readers.read_labels(spark, put(tmp_path, "bad.csv", "calibration_id,reviewer_role\nc1,boss\n")).collect()


# ----- evidence ladder --------------------------------------------------------


def test_evidence_links(spark, tmp_path):
    say = lambda i, conv, name, text, **kw: event(i, "aolai", 1783908000 + i, conv, text=text, conversation_name=name, **kw)
    rows = [
        say(1, "raw-phone", "甲 下单客户", "我的号码是 13800138000"), say(2, "raw-tracking", "乙 相册客户", "发货单号 SF1234567890"),
        say(3, "raw-none", "普通", "我的号码是 13800138000"),
        say(4, "raw-conflict", "丙 下单客户", "13900139000，也可能 13700137000"), say(5, "raw-name", "丁 下单客户", "请查订单"),
        say(6, "raw-phone", "甲 下单客户", "收到", sender="studio-aolai"),
        say(7, "raw-none", "普通", "", sender="stranger"), say(6, "raw-phone", "重复", "13711111111"),
    ]
    one, two = ({
        "synced_at": "2026-07-13T12:00:00+08:00", "total_records": len(r),
        "records": [{"record_id": str(i), "phone": p, "tracking_no": t} for i, (p, t) in enumerate(r)]
    } for r in (
        [("13800138000", "YT9876543210"), ("13900139000", "JD1234567890"), ("13700137000", "ZT1234567890")],
        [("13600136000", "SF1234567890"), ("13800138000", "YT9876543210")]))
    env = readers.read_orders(spark, put(tmp_path, "one.json", one), put(tmp_path, "two.json", two))
    lines = env.select("record.phone", "record.tracking_no")
    assert lines.count() == 5
    events = readers.numbered_lines(spark, put(tmp_path, "e.jsonl", jsonl(rows))).select(
        "ordinal", F.from_json("line", readers.EVENT).alias("e")
    ).select("ordinal", "e.*")
    acc = spark.createDataFrame([("aolai", "A", "studio-aolai")], "account_profile string, account_id string, self_sender string")
    seen = identity.identity_events(events, acc)
    assert sorted(r["ordinal"] for r in seen.collect()) == [1, 2, 3, 4, 5, 6]
    refs = seen.select(
        F.concat(F.lit("c-"), "raw_id").alias("customer_key"), F.col("account_profile").alias("profile_id"),
        identity.raw_hash(SECRET, raw_id="raw_id").alias("raw_hash")
    ).distinct()
    eligibility, links = identity.evidence_links(seen, refs, lines, SECRET, target="aolai")
    n = {r["eligibility"]: r["count"] for r in eligibility.groupBy("eligibility").count().collect()}
    assert n == {"album_customer": 1, "order_customer": 3, "order_ineligible": 1}
    got = sorted((r["customer_key"], r["state"], r["match_method"], str(r["confidence"])) for r in links.collect())
    assert got == [
        ("c-raw-conflict", "conflict", "customer_phone_order_conflict", "0.0000"),
        ("c-raw-phone", "approved", "customer_phone_order_exact", "1.0000"),
        ("c-raw-tracking", "approved", "customer_tracking_order_exact", "0.9800")
    ]


def test_a_phone_without_orders_still_conflicts_with_trackings(spark):
    o = spark.createDataFrame(
        [("13800000001", "SF00000001"), ("13800000002", "SF00000002"), ("13800000003", "SF00000002")], "phone string, tracking_no string"
    )
    conv = [
        (1, ["13911111111"], ["SF00000001"]), (2, ["13911111111", "13922222222"], []), (3, ["13911111111"], ["SF00000002"]),
        (4, ["13800000001"], ["SF00000001"]), (5, [], ["SF00000002"]), (6, ["13911111111"], ["ZZ99999999"])
    ]
    got = {
        r["key"]: r["rule"] for r in identity.evidence_ladder(
            spark.createDataFrame(conv, "key int, direct array<string>, trackings array<string>"), o
        ).collect()
    }
    assert got == {
        1: "customer_evidence_conflict", 2: "customer_phone_order_conflict", 3: "customer_evidence_conflict", 4: "customer_phone_order_exact",
        5: "customer_tracking_order_conflict", 6: None
    }


# ----- orders -----------------------------------------------------------------


def test_order_envelope(spark, tmp_path):
    records = [{"record_id": f"r{i}", "pay_date": "2026-07-01", "revenue": 199 + i} for i in range(9)]
    records += [
        {"record_id": "normal", "pay_date": "2026/07/02", "revenue": "199.00", "phone": "13800138000"},
        {"record_id": "supplier", "pay_amount": 5, "is_paid": True}
    ]
    bad = [7, {"record_id": ""}, {"record_id": "normal", "revenue": 1}]
    rows = readers.read_orders(
        spark, put(tmp_path, "o.json", {"synced_at": "2026-07-13T12:00:00+08:00", "total_records": 14, "records": records + bad})
    )
    checked = orders.quarantine(rows).cache()
    assert {r["reason"]: r["rows"] for r in readers.accounting(checked).collect()} == {
        "accepted": 11, "not_object": 1, "missing_record_id": 1, "repeated_record_id": 1
    }
    orders.balanced(11, 3, checked.count())
    with pytest.raises(ValueError):
        orders.balanced(11, 2, checked.count())
    ok = checked.filter("reject_reason is null").select("record.*").withColumn("today", F.lit("2026-07-13").cast("date"))
    got = {r["record_id"]: r for r in orders.normalize(ok, today="today", secret=SECRET).collect()}
    assert got["normal"]["revenue_minor"] == 19900 and str(got["normal"]["paid_on"]) == "2026-07-02" and got["normal"]["phone_hmac"]
    assert got["supplier"]["paid_on"] is None and got["supplier"]["revenue_minor"] is None and got["supplier"]["quality_flags"] == []


def test_snapshot_is_activated_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.range(3)
    ids = [
        spark.range(1).select(
            orders.snapshot_id(SECRET, "orders", h, "2026-07-13T12:00:00+08:00", "v1").alias("i")
        ).first()["i"] for h in ("h1", "h1", "h2")
    ]
    assert ids[0] == ids[1] != ids[2]
    assert sinks.activate(df, ids[0], root, "orders") and not sinks.activate(df, ids[1], root, "orders")
    assert sinks.activate(spark.range(5), ids[2], root, "orders") and sinks.current(spark, root, "orders").count() == 5


def test_a_crash_between_versions_leaves_the_old_one(spark, tmp_path):
    root = f"file://{tmp_path}"
    sinks.publish(spark.range(3), root, "t")
    (tmp_path / "t" / "_pointers" / ".000000000009-x").write_text("file:///nowhere")  # written, not yet renamed
    assert sinks.current(spark, root, "t").count() == 3
    sinks.publish(spark.range(4), root, "t")
    assert sinks.current(spark, root, "t").count() == 4 and sinks.current(spark, root, "other") is None


def test_stable_copy(spark, tmp_path):
    src = put(tmp_path, "in.json", [1, 2])
    to = snapshot.stable_copy(spark, src, f"file://{tmp_path}/copy.json")
    assert [r["sha256"] for r in snapshot.file_digests(spark, to).collect()] == [r["sha256"] for r in snapshot.file_digests(spark, src).collect()]
    assert len(snapshot.signature(spark, src)) == 1
    assert sinks.guard_output("/a/b", "/a/b/c") == "/a/b/c"
    for path in ("/a/bc", "/a/b/../c"):
        with pytest.raises(ValueError):
            sinks.guard_output("/a/b", path)
    sinks.write_lines(spark.createDataFrame([(2, "b"), (1, "a")], "k int, line string"), f"file://{tmp_path}/lines", "line", ["k"])
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/lines").collect()] == ["a", "b"]


# ----- knowledge --------------------------------------------------------------


def test_knowledge(spark):
    items = [
        {"title": "退款规则", "content": "退款在三天内处理", "expires_at": "2099-01-01"}, {"title": "旧", "content": "退款规则旧版", "expires_at": "2020-01-01"},
        "退货地址见说明", {"name": "表", "fields": {"周期": "七天"}}
    ]
    raw = spark.createDataFrame(
        [
            ("s", json.dumps(items, ensure_ascii=False)), ("n", json.dumps({"chunks": items[:1]}, ensure_ascii=False)),
            ("o", json.dumps({"content": "一条"}, ensure_ascii=False))
        ],
        "source_id string, value string"
    )
    flat = readers.flatten_items(raw)
    assert sorted((r["source_id"], r["title"], r["content"]) for r in flat.collect()) == sorted(
        [("s", "退款规则", "退款在三天内处理"), ("s", "旧", "退款规则旧版"), ("s", "", "退货地址见说明"), ("s", "表", "周期: 七天"), ("n", "退款规则", "退款在三天内处理"), ("o", "", "一条")]
    )
    now = F.lit("2026-07-13 00:00:00").cast("timestamp")
    ready = spark.createDataFrame([("s", "规则", True, True, 60)], "id string, title string, enabled boolean, configured boolean, max_age_seconds int")
    item = flat.filter("source_id = 's'").withColumn("item_id", F.concat_ws("/", "title", "content"))
    q = spark.createDataFrame([("q", "退款规则")], "query_id string, query string")
    hits, missing = detail.knowledge_search(q, item.filter("title in ('退款规则', '旧')"), ready.withColumn("modified", now), now)
    assert [r["title"] for r in hits.collect()] == ["退款规则"] and missing.first()["grounding_missing"] is False
    hits, missing = detail.knowledge_search(q, item, ready.withColumn("modified", F.lit(None).cast("timestamp")), now)
    assert hits.count() == 0 and missing.first()["grounding_missing"] is True


# ----- names, times, redaction, selection -------------------------------------


def test_names(spark):
    rows = [
        ("k" * 30 + "12345678", "13800138000", "店主 a@b.com", ""), ("k" * 30 + "12345678", "13800138000", "", None),
        ("k", "  小王\n\n 123456 ", "x", "x")
    ]
    df = spark.createDataFrame(rows, "key string, remark string, display_name string, nick_name string")
    got = [(r[0], r[1]) for r in df.select(tx.display_name("key"), tx.known_names()).collect()]
    assert got == [("店主 [邮箱]", ["店主 a@b.com"]), ("客户-12345678", []), ("小王 [编号]", ["小王 123456"])]
    assert tx.checked_identifier("a.b:c-1") == "a.b:c-1"
    for bad in ("", "a b", "x" * 161, "é"):
        with pytest.raises(ValueError):
            tx.checked_identifier(bad)


def test_phone_scopes_differ(spark):
    p = F.lit("13800138000")
    a, b, c, d = spark.range(1).select(
        keys.phone_hmac(SECRET, p), keys.phone_hmac(SECRET, p, F.lit("x")), keys.phone_hmac(SECRET, p, F.lit("y")),
        keys.phone_hmac(SECRET, F.lit(None).cast("string"))
    ).first()
    assert len({a, b, c}) == 3 and d is None
    assert keys.key_fingerprint("a") != keys.key_fingerprint("b") and keys.key_fingerprint("a") == keys.key_fingerprint("a")


def test_times_in_zones(spark):
    one = lambda c: str(spark.range(1).select(c.cast("string")).first()[0])
    assert one(
        parse.instant_or_seconds(F.lit("2026-07-01T10:00:00Z"))
    ) == "2026-07-01 10:00:00" and one(parse.instant_or_seconds(F.lit("2026-07-01 10:00:00"))) == "2026-07-01 02:00:00"
    assert one(parse.instant_or_seconds(F.lit("soon"))) == "None" and one(parse.instant(F.lit("2026-07-01T10:00:00"))) == "2026-07-01 10:00:00"


def plain_redaction(text):
    """The rules once more, without gates: every pattern in order on the whole text."""
    out, flags = (text or "").replace("\0", "").strip(), set()
    for label, p in lexicons.REDACTIONS:
        out, n = re.compile(p).subn(lexicons.LABELS[label], out)
        flags |= {label} if n else set()
    pieces, at = [], 0
    for m in re.finditer(lexicons.LOOSE_ADDRESS, out):
        hit = re.search(r"\d", m[0])
        flags |= {"address"} if hit else set()
        pieces += [out[at : m.start()], "[地址]" if hit else m[0]]
        at = m.end()
    out = "".join([*pieces, out[at:]])
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", out))[:4000], sorted(flags)


def test_redaction_equals_the_rules(spark):
    import random

    rng = random.Random(4)
    parts = ["电话", "13800138000", "北京市朝阳区", "建国路88号", "联系人：", "李四", "王先生", "a@b.com", "https://x.cn/1", "微信号abc_def12", "WX: hello_world1", "100元", "2026-07-01", "7.1", "SF1234567890", "有货", "已发货", "退款", "保证明天到", "详细地址：某处，",
             "，", "。", "\n\n\n\n", " \t ", "hello", "world " * 12, "省", "12", "小区", "室", "姓名", "11010119900101123X", "0571-88888888", "٣٤", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["", None, "plain text", "x " * 4000, "号" * 200]
    got = [
        tuple(r) for r in tx.with_redaction(
            spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "r"
        ).orderBy("i").select("r.text", "r.flags").collect()
    ]
    want = [plain_redaction(t) for t in texts]
    assert [(t, list(f)) for t, f in got] == want
    assert [tx.redacted(t) for t in texts] == want


def test_selection_equals_plain_code(spark):
    import hashlib
    import hmac
    import random

    rng = random.Random(5)
    rows = [
        (
            f"c{rng.randint(0, 25)}", f"trigger {i % 60}", f"reply {'abcdefgh'[rng.randint(0, 7)] * 3}{rng.randint(0, 99)}", rng.randint(8, 12),
            f"2026-07-{i:03d}"
        ) for i in range(300)
    ]
    df = spark.createDataFrame(
        rows, "customer_key string, trigger_text string, reply_text string, quality_score int, timestamp string"
    ).repartition(7)
    split = lambda c: keys.split_of(int(hmac.new(SECRET.encode(), c.encode(), hashlib.sha256).hexdigest()[:8], 16) % 100)
    level = lambda t: hashlib.sha256(re.sub(r"[^0-9a-z\[\]#]+", "", re.sub(r"\d+", "#", t.lower())).encode()).hexdigest()[:24]

    def plain(limit, cap):
        left, seen = [], set()
        for r in sorted(rows, key=lambda r: (-r[3], r[4], r[0])):
            if (k := level(r[1] + "\x1f" + r[2])) not in seen:
                seen.add(k)
                left.append(r)
        groups = {}
        for r in left:
            groups.setdefault(level(r[2]), []).append(r)
        filled, kept = {"train": 0, "validation": 0, "test": 0}, []
        for k in sorted(groups, key=lambda k: (-max(r[3] for r in groups[k]), k)):
            have = {s: [r for r in groups[k] if split(r[0]) == s] for s in filled}
            own = min((filled[s] / sampling.RATIOS[s], s != keys.split_of(int(k[:8], 16) % 100), s) for s in filled if have[s])[2]
            filled[own] += min(len(have[own]), max(1, cap))
            kept += have[own][: max(1, cap)]
        queues = {}
        for s in ("train", "validation", "test"):
            mine = {}
            for r in kept:
                if split(r[0]) == s:
                    mine.setdefault(r[0], []).append(r)
            turns = [sorted(v, key=lambda r: (-r[3], r[4])) for _, v in sorted(mine.items())]
            queues[s] = [t[i] for i in range(max(map(len, turns), default=0)) for t in turns if i < len(t)]
        quota = {"train": int(limit * 0.7), "validation": int(limit * 0.15)}
        quota["test"] = limit - sum(quota.values())
        out = [r for s, q in queues.items() for r in q[: quota[s]]]
        rest = {s: q[quota[s] :] for s, q in queues.items()}
        while len(out) < limit and any(rest.values()):
            for s in rest:
                if rest[s] and len(out) < limit:
                    out.append(rest[s].pop(0))
        return sorted((r[4], r[0]) for r in out)

    for limit, cap in ((40, 3), (12, 0), (1000, 2)):
        got = [(r["timestamp"], r["customer_key"]) for r in sampling.select_pairs(df, secret=SECRET, limit=limit, cap=cap).collect()]
        assert got == plain(limit, cap)


def test_read_side(spark, tmp_path):
    msgs = spark.createDataFrame(
        [("c", f"2026-07-{i:02d}", i, f"电话13800138000 {i}") for i in range(1, 32)] * 2,
        "customer_key string, timestamp string, source_ordinal int, text string"
    ).dropDuplicates()
    got = detail.customer_messages(msgs, n=20).orderBy("place").collect()
    assert [r["source_ordinal"] for r in got] == list(range(12, 32)) and all("13800138000" not in r["text"] for r in got)
    b = spark.createDataFrame(
        [("b1", "c", "1******8000", "review", None), ("b2", "c", None, "missing", None)],
        "binding_id string, customer_key string, masked_hint string, state string, reviewed_at string"
    )
    assert [r["binding_id"] for r in detail.binding_candidates(b).collect()] == ["b1"]
    runs = spark.createDataFrame(
        [("r1", "2026-07-01", dict.fromkeys(detail.GATES, True), "k", "h"), ("r2", "2026-07-02", {"m0_a": True}, "k2", "h")],
        "run_id string, started_at string, gates map<string,boolean>, key_fingerprint string, config_hash string"
    )
    assert detail.missing_gates(runs) == list(detail.GATES[1:]) and detail.missing_gates(runs.limit(0)) == list(detail.GATES)
    with pytest.raises(RuntimeError):
        detail.accept(runs)
    detail.accept(runs.filter("run_id = 'r1'"))
    detail.same_run(runs, key_fingerprint="k2", config_hash="h")
    for told in ({"key_fingerprint": "k", "config_hash": "h"}, {"key_fingerprint": "k2", "config_hash": "x"}):
        with pytest.raises(RuntimeError):
            detail.same_run(runs, **told)
    pairs = spark.createDataFrame(
        [("p1", "approved", "low", "你好"), ("p2", "approved", "high", "x"), ("p3", "pending", "low", "x")],
        "pair_id string, review_status string, risk_level string, trigger_text string"
    )
    assert [r["pair_id"] for r in serving.chatml_ready(pairs, True).collect()] == ["p1"] and serving.chatml_ready(pairs, False).count() == 0
    gate = serving.calibration(spark.range(250).selectExpr("1 as p", "1 as h"), predicted="p", human="h")
    assert [tuple(r) for r in serving.gates(role=gate).collect()] == [("role", True)]
    rows = spark.createDataFrame(
        [("c", [("x", 1, ["m1", "m2"]), ("y", 2, [])])], "customer_key string, reasons array<struct<code:string,points:int,evidence:array<string>>>"
    )
    assert [(r["kind"], r["message_keys"]) for r in identity.evidence_rows(rows, SECRET).collect()] == [("x", ["m1", "m2"])]


def test_reviews_are_kept_by_guards(spark):
    fresh = spark.createDataFrame(
        [("l1", "r", "p", "s", "review"), ("l2", "r", "p2", "s", "review"), ("l3", "r", None, "s", "review")],
        "link_id string, raw_hash string, phone_hmac string, source_hash string, state string"
    )
    old = spark.createDataFrame(
        [("l1", "r", "p", "s", "rejected"), ("l2", "r", "other", "s", "rejected"), ("l3", "r", None, "s", "approved_human")], fresh.schema
    )
    assert {
        r["link_id"]: r["state"] for r in identity.keep_reviews(fresh, old).collect()
    } == {"l1": "rejected", "l2": "review", "l3": "approved_human"}


def test_hidden_keys_and_changing_facts(spark):
    from parley.session import ship

    ship(spark)
    one = json.dumps(
        {
            "a": 1, "Phone": "13800138000", "list": [{"WeChatId": 1, "b": "电话13800138000"}],
            "deep": {"headimgurl": 1, "x": {"user_name": 1, "username": 2}}
        },
        ensure_ascii=False
    )
    df = spark.createDataFrame([(one,), ("{",), (None,)], "j string")
    got = [tuple(r) for r in df.select(tx.public_json("j"), tx.public_json("j", True)).collect()]
    assert json.loads(got[0][0]) == {"a": 1, "list": [{"b": "电话13800138000"}], "deep": {"x": {"user_name": 1}}} and got[1:] == [(None, None)] * 2
    assert json.loads(got[0][1])["list"] == [{"b": "电话[手机号]"}]
    asked = spark.createDataFrame([(1, "什么时候发货"), (2, "Refund please"), (3, "你好"), (4, "多少钱")], "request_id int, request_text string")
    refs = spark.createDataFrame([(4, "r")], "request_id int, id string")
    assert {r[0]: r[1] for r in detail.draft_grounding(asked, refs).collect()} == {1: True, 2: True, 3: False, 4: False}
    ids = spark.createDataFrame([("\u3000ｗｘ１ ",), ("a\tb",), (" ",), (None,)], "t string")
    assert [r[0] for r in ids.select(tx.raw_identifier("t")).collect()] == ["wx1", None, None, None]


def test_recorded_copy(spark, tmp_path):
    src = put(tmp_path, "in.json", {"a": 1})
    assert [r["length"] for r in snapshot.recorded_copy(spark, src, f"file://{tmp_path}/held.json").collect()] == [len('{"a": 1}')]


def test_selection_without_a_secret(spark):
    """Each reply template stays with its first customer, three pairs of it at most; customers take turns."""
    rows = [(f"c{i % 4}", f"trigger {chr(97 + i % 26)}{i}", f"reply {'abc'[i % 3] * 4}", 8 + (i * 7) % 5, f"2026-07-{i:03d}") for i in range(60)]
    df = spark.createDataFrame(rows, "customer_key string, trigger_text string, reply_text string, quality_score int, timestamp string").repartition(5)
    level = lambda t: re.sub(r"[^0-9a-z\[\]#]+", "", re.sub(r"\d+", "#", t.lower()))
    left, seen, groups = [], set(), {}
    for r in sorted(rows, key=lambda r: (-r[3], r[4], r[0])):
        if (k := level(r[1] + "\x1f" + r[2])) not in seen:
            seen.add(k)
            left.append(r)
    for r in left:
        groups.setdefault(level(r[2]), []).append(r)
    kept = [r for g in groups.values() for r in [x for x in g if x[0] == g[0][0]][:3]]
    mine = {}
    for r in sorted(kept, key=lambda r: (-r[3], r[4])):
        mine.setdefault(r[0], []).append(r)
    turns = [v[i] for i in range(9) for _, v in sorted(mine.items()) if i < len(v)]
    for limit in (3, 7, 100):
        got = [(r["timestamp"], r["customer_key"]) for r in sampling.select_pairs(df, limit=limit).collect()]
        assert got == sorted((r[4], r[0]) for r in turns[:limit])
