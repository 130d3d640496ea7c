"""From an export's files to published tables."""

import json

import pytest
from pyspark.sql import functions as F

from parley.plans import build
from parley.sources import manifest as mf

SECRET = "fixture-secret"


def message(conv, minute, status, text, **more):
    return {
        "conversation_id": conv, "conversation_type": "friend", "message_id": minute, "timestamp": f"2026-07-0{1 if conv == 'a' else 2}T10:{minute:02d}:00",
        "message_type": "text", "render_type": "x", "text": text, "raw_payload": {"status": status},
    } | more


FIRST = [
    message("a", 0, 3, "请问怎么订？电话13800138000。"), message("a", 4, 3, "我明天要用。"), message("a", 10, 2, "您好，可以先确认规格。"),
    message("a", 12, 2, "价格请以报价为准。"), message("a", 13, 2, "图", message_type="image"), message("b", 0, 3, "在吗，电话13800138000"),
    message("b", 5, 2, "在的"), message("b", 10, 3, "好"), message("c", 1, 3, "你好"),
]


def export(folder, rows, convs="abc"):
    folder.mkdir(exist_ok=True)
    (folder / "messages.jsonl").write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    index = [{"conversation_id": c, "conversation_type": "friend", "remark": f"客人{c}"} for c in convs]
    (folder / "conversation_index.json").write_text(json.dumps(index, ensure_ascii=False), encoding="utf-8")
    return f"file://{folder}"


def test_build_is_published_as_a_whole(spark, tmp_path, monkeypatch):
    root, kind = f"file://{tmp_path}/out", {"secret": SECRET, "account": "acc"}
    folder = export(tmp_path / "in", FIRST)
    first = build.build_export(spark, folder, root, **kind)
    count = {n: sum(t.rows.values()) for n, t in first.tables.items()}
    assert count["customers"] == 3 and count["messages"] == 8 and count["style_pairs"] >= 1 and count["role_calibration"] == 8 and count["build_runs"] == 1
    table = lambda m, n: {r[0]: r for r in mf.read(spark, m, n).collect()}
    people = table(first, "customers")
    assert all(k.startswith("customer_") for k in people) and {r["display_name"] for r in people.values()} == {"客人a", "客人b", "客人c"}
    assert sorted(r["state"] for r in table(first, "identity_bindings").values()) == ["ambiguous_shared", "ambiguous_shared", "missing"]
    shown = json.dumps([r.asDict() for n in ("customers", "style_pairs", "identity_bindings") for r in table(first, n).values()], default=str, ensure_ascii=False)
    assert "13800138000" not in shown
    assert all(r["customer_key"] in people for n in ("messages", "style_pairs", "evidence") for r in table(first, n).values())

    # the same again changes nothing
    assert build.build_export(spark, folder, root, **kind).number == first.number == 0

    # people decide; reviews are written
    undecided = mf.read(spark, first, "style_pairs")
    pair = undecided.filter(F.col("trigger_text").contains("怎么订")).first()["pair_id"]
    decided = undecided.withColumn("review_status", F.when(F.col("pair_id") == pair, "approved").otherwise(F.col("review_status"))).withColumn(
        "reviewed_at", F.when(F.col("pair_id") == pair, F.lit("2026-07-03").cast("timestamp"))
    )
    reviews = mf.read(spark, first, "customers").select(F.concat(F.lit("r"), "customer_key").alias("review_id"), "customer_key")
    mf.publish(spark, root, "review", lambda now: {"style_pairs": decided, "reviews": reviews})

    # a crash between tables, and a broken line, leave all as it was
    folder = export(tmp_path / "in", [*FIRST[:-1], message("a", 40, 3, "谢谢，下次再来")], "ab")
    with monkeypatch.context() as m:
        m.setattr(build.identity, "evidence_rows", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            build.build_export(spark, folder, root, **kind)
    export(tmp_path / "bad", FIRST)
    (tmp_path / "bad" / "messages.jsonl").write_text("{broken\n", encoding="utf-8")
    with pytest.raises(Exception):
        build.build_export(spark, f"file://{tmp_path}/bad", root, **kind)
    assert mf.load(spark, root).number == 1

    # new files: the gone customer goes with all that is theirs, decisions stay
    second = build.build_export(spark, folder, root, **kind)
    assert second.number == 2 and len(table(second, "customers")) == 2 and len(table(second, "reviews")) == 2
    assert table(second, "style_pairs")[pair]["review_status"] == "approved" and second.tables["build_runs"].rows == {"": 2}
    assert {r["customer_key"] for r in table(second, "messages").values()} == set(table(second, "customers"))

    with pytest.raises(RuntimeError, match="another key"):
        build.build_export(spark, folder, root, secret="other", account="acc")
    (tmp_path / "in" / "messages.jsonl").write_text("", encoding="utf-8")
    with pytest.raises(RuntimeError, match="gates"):
        build.build_export(spark, folder, root, **kind)
    assert mf.load(spark, root).number == 2
