"""Packing, phrases and periodic runs against brute force."""

import collections
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.llm import collocations, packing, periodic

SCHEMA = "doc_id long, text string, lang string, source string, ids int, row int, runs string, sequence_id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r[:3], "s", 1, 2, "x", "y") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns named as the operators' own."""
    long = " ".join(f"w{i % 700}" for i in range(9_000))
    rows = [
        (1, "a b a b a b a b c", "en"), (1, "a b a b a b a b c", "en"), (1, "other words", "de"), (None, "x " * 40, None), (None, None, None),
        (2, "", "en"), (3, None, "en"), (4, " \t\n ", "en"), (5, long, "en"), (6, "<|endoftext|> is text", "en"), (7, "Ünï  çödé  日本", "fr"),
    ]
    return rows, frame(spark, rows)


# ----- periodic runs ---------------------------------------------------------


def plain_runs(t, periods=4, shortest=6):
    """Every maximal stretch of each period, least period first."""
    seen = {}
    for q in range(1, len(t) // periods + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j - i + q >= max(shortest, periods * q) and j > i:
                seen.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in seen.items())


texts = st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=60), st.integers(0, 9), st.integers(1, 9)), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts, st.sampled_from([(4, 6), (2, 2), (3, 5)]))
def test_runs_equal_all_stretches(some, kind):
    seqs = [[t[i] if i < a else t[a + (i - a) % p] for i in range(len(t)) if i < a or a + (i - a) % p < len(t)] for t, a, p in some]
    found = collections.defaultdict(list)
    for k, *run in zip(*(x.tolist() for x in periodic.runs_of([np.array(s, np.int64) for s in seqs], *kind))):
        found[k].append(tuple(run))
    assert [found[k] for k in range(len(seqs))] == [sorted(plain_runs(s, *kind), key=lambda r: (r[0], r[2])) for s in seqs]


def test_a_long_text_of_one_word_and_nested_runs():
    one = np.zeros(50_000, np.int64)
    assert [x.tolist() for x in periodic.runs_of([one])] == [[0], [0], [50_000], [1]]
    nested = ([1] * 8 + [2]) * 5
    assert list(zip(*(x.tolist() for x in periodic.runs_of([np.array(nested)])[1:]))) == sorted(
        [(9 * k, 8, 1) for k in range(5)] + [(0, 45, 9)], key=lambda r: (r[0], r[2])
    )


def test_refinement_takes_few_steps_per_place(monkeypatch):
    """Smaller halves: the splitting places of a Fibonacci word sum to n log n at most."""
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    seen, refine = [], periodic.Refinement._refine
    monkeypatch.setattr(periodic.Refinement, "_refine", lambda self, small, level: (seen.append(len(small)), refine(self, small, level))[1])
    periodic.runs_of([np.array(b)])
    assert sum(seen) <= len(b) * np.log2(len(b))


def test_runs_cases(spark, odd):
    rows, docs = odd
    got = periodic.find_runs(docs).select("row.doc_id", "row.text", "row.runs", "words", F.col("runs").alias("found"), "collapsed").collect()
    assert len(got) == len(rows) and {r["runs"] for r in got} == {"x"}
    for r in got:
        w = (r["text"] or "").encode().split()
        want = sorted(plain_runs(w) if len(w) < 200 else [(0, 9000, 700)], key=lambda x: (x[0], x[2]))
        assert r["words"] == len(w) and [tuple(x) for x in r["found"]] == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["collapsed"].encode() == b" ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic.find_runs(docs.filter("doc_id > 99")).count() == 0


# ----- packing ---------------------------------------------------------------


def check_packing(pieces, docs, capacity):
    """Every id in one piece, sequences gapless and full or a power of two; gives the padding."""
    encoder = packing.encoder(packing.default_tokenizer())
    want = collections.Counter()
    for d, t, *_ in docs:
        want[d, tuple([*encoder.whole.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    ids = {id(r): tuple(np.frombuffer(bytes(r["ids"]), "<u2").tolist()) for r in pieces}
    for (d, tokens), n in want.items():
        for r in by[d]:
            assert r["length"] == len(ids[id(r)]) > 0
        at = collections.Counter((r["start"], ids[id(r)]) for r in by[d] if tokens[r["start"] : r["start"] + r["length"]] == ids[id(r)])
        assert sum(len(i) * k for (_, i), k in at.items()) >= n * len(tokens)
    assert sum(r["length"] for r in pieces) == sum(len(t) * n for (_, t), n in want.items())
    short = 0
    for rows in seq.values():
        upto = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == upto
            upto += r["length"]
        assert upto <= capacity
        short += 0 if upto & (upto - 1) == 0 else capacity - upto
    return short


@pytest.mark.parametrize("capacity", [2048, 64, 48])
def test_packing_cases(spark, odd, capacity):
    rows, docs = odd
    pieces = packing.pack(docs, capacity=capacity, group=4).collect()
    assert check_packing(pieces, rows, capacity) == 0
    assert packing.pack(docs.filter("doc_id > 99")).count() == 0


def test_packing_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = packing.op11_packing(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    encoder = packing.encoder(packing.default_tokenizer())
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert set(by) == set(docs)
    for d, pieces in by.items():
        ids = np.array([*encoder.whole.encode(docs[d] or "", add_special_tokens=False).ids, 1], "<u4")
        upto = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == upto and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[upto : upto + r["length"]])
            upto += r["length"]
        assert upto == len(ids)


def test_costs_are_even():
    rng = random.Random(4)
    lengths = [rng.randint(1, 900) for _ in range(600)]
    cost, size = collections.Counter(), collections.Counter()
    for _, _, n, s, _ in packing.fill(lengths):
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
        size[s] += n
    full = [cost[s] for s in cost if size[s] == 2048]
    assert max(full) < 1.1 * min(full)
    first, at = [], 0  # in order of arrival, for comparison
    for n in lengths:
        if at + n > 2048:
            first.append(0.0)
            at = 0
        first = first or [0.0]
        first[-1] += packing.LINEAR * n + packing.QUADRATIC * n * n
        at += n
    assert max(full) - min(full) < (max(first) - min(first)) / 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab'st1!,. \n\té日👍  \x1c") + ["the", "<|endoftext|>"]), max_size=20).map("".join))
def test_ids_by_parts_equal_those_of_the_whole(text):
    encoder = packing.encoder(packing.default_tokenizer())
    assert np.frombuffer(encoder.encode(text), "<u2").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


# ----- phrases ---------------------------------------------------------------


def test_slots_are_minimal_and_know_their_keys():
    rng = np.random.default_rng(3)
    h, v = rng.integers(0, 1 << 63, 20_000).astype(np.uint64), rng.integers(0, 1 << 32, 20_000).astype(np.uint32)
    h[:5000] = h[5000:10_000]  # equal in the first part only
    slots, order = collocations.Slots.build(h, v)
    assert sorted(slots.find(h, v).tolist()) == list(range(len(h))) and (slots.find(h, v)[order] == np.arange(len(h))).all()
    again = collocations.Slots.of(dict(zip(("sizes", "bits", "h", "v"), slots.row())))
    assert (again.find(h, v) == slots.find(h, v)).all() and (slots.find(h ^ np.uint64(1), v) == -1).all()
    assert 8 * len(slots.bits) * 8 < 5 * len(h) * 8
    none, _ = collocations.Slots.build(h[:0], v[:0])
    assert (none.find(h[:3], v[:3]) == -1).all()


def phrase_rows(seed, n):
    rng = random.Random(seed)
    words = ["of", "the", "a", "in", "New", "York", "city", "hall", "été", "x\x1cy"]
    for i in range(n):
        w = [rng.choice(words[: rng.choice([3, 6, 10])]) for _ in range(rng.randint(0, 60))]
        yield i // 2, "".join(x + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".\r\n"]) for x in w) or None, rng.choice(["en", "de", None])


@pytest.mark.parametrize("deal,mappers", [(1 << 20, 2), (200, 5), (50, 1)])
def test_phrases_equal_sql(spark, monkeypatch, deal, mappers):
    monkeypatch.setattr(collocations, "SLICE", 3000)
    monkeypatch.setattr(collocations, "READ", 20)
    rows = list(phrase_rows(deal, 300))
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    c.executemany("insert into documents values (?, ?, ?)", rows)
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = sorted(c.execute(f"select {', '.join(cols)} from ({collocations.ORACLE['op12_collocations']})").fetchall())
    got = collocations.collocations(frame(spark, rows), deal=deal, mappers=mappers).select(*cols)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_filters_that_are_full_change_nothing(spark, monkeypatch):
    rows = list(phrase_rows(9, 200))
    want = sorted(map(tuple, collocations.collocations(frame(spark, rows), longest=4, least=3).collect()))
    monkeypatch.setattr(collocations.Sieve, "has", lambda self, h, v: np.ones(len(h), bool))
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), longest=4, least=3).collect())) == want
    assert any(len(r[2].split(" ")) == 4 for r in want)


def test_phrases_cases(spark, odd):
    rows, docs = odd
    got = collocations.collocations(docs, least=2, top=3)
    assert got.count() <= 9 and {r["lang"] for r in got.collect()} >= {"en", "und"}
    assert collocations.collocations(docs.filter("doc_id > 99")).count() == 0


def test_distinct_keys_are_those_of_unique_and_faster():
    rng = np.random.default_rng(3)
    for keys in (np.empty(0, np.int64), rng.integers(0, 50, 1000), rng.integers(0, 1 << 62, 500), np.array([0, 0, (1 << 63) - 1])):
        want = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        assert all(np.array_equal(a, b) for a, b in zip(collocations.distinct(keys), want))
    assert collocations.Slice([b"a b, a", b"c"], "x").words == [b"a", b"b", b"\xff", b"c"]
    assert collocations.Slice([b"a b a"], "x").stop == -1
