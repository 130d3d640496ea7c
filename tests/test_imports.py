"""Order envelopes beside a build's tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from parley.functions import keys
from parley.plans import build
from parley.sources import manifest as mf
from parley.sources import snapshot

SECRET = "fixture-secret"
GOOD = [
    {"record_id": "1", "phone": "13800138000", "pay_date": "2026-07-02", "revenue": "199.00"},
    {"record_id": "2", "pay_date": "2026-07-02", "revenue": "50", "refund_type": "仅退款", "refund_amount": "10", "refund_date": "2026-07-03"},
    {"record_id": "3", "pay_date": "2026-07-14", "revenue": "9"},  # after the day of the snapshot in Shanghai
]
BAD = [7, {"record_id": ""}, {"record_id": "1"}]


def envelope(tmp_path, records, name="o.json", **more):
    text = json.dumps({"synced_at": "2026-07-12T23:30:00Z", "total_records": len(records), "records": records} | more, ensure_ascii=False)
    (tmp_path / name).write_text(text, encoding="utf-8")
    return f"file://{tmp_path}/{name}", hashlib.sha256(text.encode()).hexdigest()


def built(spark, root):
    runs = spark.range(1).select(F.lit("run").alias("run_id"), F.lit(keys.key_fingerprint(SECRET)).alias("key_fingerprint"), F.current_timestamp().alias("started_at"))
    return mf.publish(spark, root, "run", lambda _: {"build_runs": runs, "customers": spark.range(3)})


def test_orders_are_imported_once(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    path, sha = envelope(tmp_path, GOOD + BAD, total_records=9)
    with pytest.raises(RuntimeError):
        build.import_orders(spark, path, root, secret=SECRET)  # no build
    built(spark, root)
    with pytest.raises(RuntimeError):
        build.import_orders(spark, path, root, secret="other")
    m = build.import_orders(spark, path, root, secret=SECRET, chunk=64)
    read = lambda name: mf.read(spark, m, name)
    lines = {r["record_id"]: r for r in read("orders").collect()}
    assert set(lines) == {"1", "2", "3"} and lines["1"]["phone_hmac"] and "future_paid_on" in lines["3"]["quality_flags"]
    assert {(r["position"], r["reject_reason"]) for r in read("order_quarantine").collect()} == {
        (3, "not_object"), (4, "missing_record_id"), (5, "repeated_record_id")
    }
    told = {(r["kind"], r["name"]): r["rows"] for r in read("order_quality").collect()}
    want = {"source_records": 6, "quarantined_records": 3, "lines": 3, "envelope_total": 9, "envelope_total_matches": 0, "paid": 2, "phone_hmac": 1, "refunded": 1}
    assert {n: v for (k, n), v in told.items() if k == "total"} == want
    assert sum(v for (k, _), v in told.items() if k == "refund_type") == 3 and told["refund_type", "none"] == 2
    one = read("order_snapshots").first()
    assert (one["source_hash"], one["records"]) == (sha, 3) and read("customers").count() == 3
    assert build.import_orders(spark, path, root, secret=SECRET).number == m.number  # the same again changes nothing
    again, _ = envelope(tmp_path, GOOD[:1], name="p.json")
    m = build.import_orders(spark, again, root, secret=SECRET)
    assert read("orders").count() == 1 and read("order_quarantine").count() == 0


def test_imports_that_fail_leave_what_was_there(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/out"
    now = built(spark, root)
    for records, more in ((GOOD, {"synced_at": "2026-07-12T23:30:00"}), (GOOD, {"synced_at": None}), ({}, {})):
        with pytest.raises(ValueError):
            build.import_orders(spark, envelope(tmp_path, records, name="bad.json", **more)[0], root, secret=SECRET)
    path, _ = envelope(tmp_path, GOOD)
    told = iter([[("f", 1, 1)], [("f", 2, 2)]])
    monkeypatch.setattr(snapshot, "signature", lambda *_: next(told))
    with pytest.raises(RuntimeError, match="changed"):
        build.import_orders(spark, path, root, secret=SECRET)
    monkeypatch.undo()
    assert mf.load(spark, root).number == now.number
    m = build.import_orders(spark, envelope(tmp_path, [], name="e.json")[0], root, secret=SECRET)
    assert mf.read(spark, m, "orders").count() == 0
