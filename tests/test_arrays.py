"""Elements of JSON arrays from ranges of any size against one parser."""

import json
import random

import pytest

from parley.operators import orders
from parley.sources import arrays, readers


def value(rng, depth=0):
    text = "".join(rng.choices(['"', "\\", "[", "]", "{", "}", ",", ":", "单", "é", " ", "\n", "a", "\\\\\\"], k=rng.randint(0, 12)))
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 4:
        return [text, rng.randint(-9, 9), None, True][kind]
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {text + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 3))}


def got(df):
    rows = df.select("source_file", "position", "raw").collect()
    return {(r["source_file"].rsplit("/", 1)[1], r["position"]): r["raw"] and json.loads(r["raw"]) for r in rows}, len(rows)


@pytest.mark.parametrize("chunk,block", [(13, 7), (64, 1 << 20), (1 << 20, 11)])
def test_ranges_of_any_size(spark, tmp_path, monkeypatch, chunk, block):
    rng, want, found = random.Random(chunk), {}, {}
    for i in range(4):
        items = [value(rng) for _ in range(rng.choice([0, 1, 25]) if i else 0)]
        whole = {"note": value(rng), "records ": [1], "in": {"records": [2]}, "records": items, "total_records": len(items), "after": [[value(rng)]]}
        text = json.dumps(whole, ensure_ascii=bool(i % 2), indent=rng.choice([None, 1]))
        (tmp_path / f"f{i}.json").write_text(("﻿" if i == 1 else "") + text, encoding="utf-8")
        want |= {(f"f{i}.json", n): x for n, x in enumerate(items)} or {(f"f{i}.json", None): None}
    # the rules on their own, range by range, with blocks of any size
    monkeypatch.setattr(arrays, "BLOCK", block)
    for f in arrays.files(spark, f"file://{tmp_path}/*.json"):
        (_, size, at), = arrays._head(f, "records")
        inside, depth, position = False, 0, 0
        for s in range(at, size, chunk):
            for b in arrays._read(f, at, s, min(s + chunk, size), inside, depth, position):
                for r in b.to_pylist():
                    place = (f.rsplit("/", 1)[1], r["position"])
                    assert place not in found
                    found[place] = r["raw"] and json.loads(r["raw"])
            (_, _, flips, delta, least, commas), = arrays._scan(f, at, s, min(s + chunk, size))
            if depth + least[inside] < 0:
                (_, shell), = arrays._shell(f, at, s, inside, depth)
                assert json.loads(shell)["records"] == []
                break
            position += commas[inside] * (depth + least[inside] == 0)
            depth, inside = depth + delta[inside], inside ^ flips
    assert found == want


def test_one_file_in_several_tasks(spark, tmp_path):
    rng = random.Random(5)
    items = [{"record_id": f"r{i}", "phone": '"}],[{' * rng.randint(0, 4), "deep": value(rng)} for i in range(3000)]
    text = json.dumps({"synced_at": "2026-07-13T12:00:00+08:00", "records": items, "total_records": 3000}, ensure_ascii=False)
    (tmp_path / "o.json").write_text(text, encoding="utf-8")
    df = arrays.read_array(spark, f"file://{tmp_path}/o.json", key="records", chunk=len(text) // 6)
    assert df.rdd.getNumPartitions() >= 6
    rows, n = got(df)
    assert n == 3000 and [rows["o.json", i] for i in range(3000)] == items
    env = readers.read_orders(spark, f"file://{tmp_path}/o.json", chunk=50_000)
    assert {(r["synced_at"], r["total_records"]) for r in env.collect()} == {("2026-07-13T12:00:00+08:00", 3000)}
    assert env.filter("record.record_id = 'r' || position").count() == 3000


def test_bad_records_and_files(spark, tmp_path):
    put = lambda name, text: ((tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode()), f"file://{tmp_path}/{name}")[1]
    rows = readers.read_orders(spark, put("bad.json", '{"records":[{"record_id":"a"},{"record_id": tru},7,,{"record_id":"b"}]}'))
    told = {r["position"]: (r["record"] and r["record"]["record_id"], r["reject_reason"]) for r in orders.quarantine(rows).collect()}
    assert told == {0: ("a", None), 1: (None, "not_object"), 2: (None, "not_object"), 3: (None, "not_object"), 4: ("b", None)}
    for name, text in (("open.json", '{"records":[{"a":1}'), ("none.json", '{"rows":[1]}'), ("list.json", "[1]"), ("void.json", ""), ("text.json", '{"records":"["}')):
        with pytest.raises(ValueError):
            readers.read_orders(spark, put(name, text))
    for name, text in (("utf.json", b'{"records":["\xff"]}'), ("shell.json", '{"records":[1], oops}')):
        with pytest.raises(Exception):  # noqa: B017  Spark's own error
            readers.read_orders(spark, put(name, text)).collect()
    with pytest.raises(FileNotFoundError):
        arrays.read_array(spark, f"file://{tmp_path}/missing.json")
    assert got(arrays.read_array(spark, put("root.json", " [ 1 , [2,3] ]")))[0] == {("root.json", 0): 1, ("root.json", 1): [2, 3]}
