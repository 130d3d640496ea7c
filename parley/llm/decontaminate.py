"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact similarity.

An item of L shingles (five words each) is looked for in all windows of L shingles by the
weighted Jaccard similarity of the two multisets of shingles. A shingle's weight is
16 ln(1 + N/df), rounded, over the N items; shingles of no item have df 1.

1. Windows that share a shingle with the item are listed from the item's shingles in the
   document; the weight of those in a window bounds what both share, and windows that cannot
   reach the similarity by it go.
2. Fingerprints. Window and item have 64-bit SimHashes of their weighted shingles. Of two
   fingerprints within ``RADIUS`` one of ``BLOCKS`` blocks differs in ``RADIUS // BLOCKS`` bits or less:
   pairs that meet in no block go, then those farther apart than the radius. The blocks lose no
   pair within the radius. At similarity 0.8 the radius is 4 standard deviations of the
   distance away: of 4,151 windows of similarity 0.80 to 0.82 none was farther than 20 (3 %
   were farther than 14).
3. What is left is compared exactly.

Items are broadcast in blocks of at most ``ITEMS`` items and ``ITEM_WORDS`` words. Where there
are more, a first pass over all documents keeps those that hold a shingle of any item, by a
Bloom filter of ``BLOOM_BITS`` bits for each shingle (at most ``BLOOM_MB``); only these are stored and
passed once for each block, so that a benchmark of any size can be used.

Defined results: null and empty texts match nothing; long texts are searched whole; of an item's
equally similar windows the first in the text is reported; a document with fewer shingles than
an item is one window as a whole; texts with fewer than five words have one shingle, the
whole sequence, and so match items of just these words; null or empty items match nothing;
equal items are all reported; equal rows get equal results; other columns are kept as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, drop_stored, gram_hashes, packed, ship, store, words_of

ITEMS, ITEM_WORDS = 1000, 200_000
SPAN = 4096  # windows fingerprinted at once
BLOOM_BITS, BLOOM_MB = 12, 256
RADIUS, BLOCKS = 22, 4
_SHIFTS = np.arange(64, dtype=np.uint64)


class Index:
    """Items of one block: shingles with weights, and the items that hold each."""

    def __init__(self, items: list[tuple[int, str]], total: int, df: dict[int, int], words: int, similarity: float):
        self.words, self.similarity = words, similarity
        cache = WordHash()
        self.rest = max(1, round(16 * math.log(1 + total)))  # weight of a shingle of no item
        self.ids = [i for i, _ in items]
        grams = [gram_hashes(words_of(t), cache, words) for _, t in items]
        self.counts = [Counter(g.tolist()) for g in grams]
        weight = {h: max(1, round(16 * math.log(1 + total / df[h]))) for c in self.counts for h in c}
        self.grams = np.array(sorted(weight), np.uint64)
        self.weights = np.array([weight[h] for h in sorted(weight)], np.int64)
        self.sums = [sum(c * weight[h] for h, c in x.items()) for x in self.counts]
        self.size = np.array([len(g) for g in grams], np.int64)
        self.prints = np.array([self.fingerprints(g, self.weight_of(g), np.zeros(1, np.int64), len(g))[0] for g in grams], np.uint64)
        pairs = sorted((h, i) for i, c in enumerate(self.counts) for h in c)
        self.owners = np.array([i for _, i in pairs], np.int64)
        self.first = np.searchsorted(np.array([h for h, _ in pairs], np.uint64), self.grams, "left")
        self.last = np.append(self.first[1:], len(pairs))

    def places(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        return at, self.grams[at] == g

    def weight_of(self, g: np.ndarray) -> np.ndarray:
        at, known = self.places(g)
        return np.where(known, self.weights[at], self.rest)

    @staticmethod
    def fingerprints(g: np.ndarray, w: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """SimHash of the windows of ``size`` shingles at ``starts`` (ascending)."""
        out = np.empty(len(starts), np.uint64)
        for at in range(0, len(starts), SPAN):
            s = starts[at : at + SPAN]
            lo, hi = int(s[0]), int(s[-1]) + size
            if hi - lo > 4 * SPAN + size:  # far apart: window by window
                for k, x in enumerate(s.tolist()):
                    out[at + k] = Index.fingerprints(g[x : x + size], w[x : x + size], np.zeros(1, np.int64), size)[0]
                continue
            signs = ((g[lo:hi, None] >> _SHIFTS) & np.uint64(1)).astype(np.int64) * 2 - 1
            sums = np.zeros((hi - lo + 1, 64), np.int64)
            np.cumsum(signs * w[lo:hi, None], axis=0, out=sums[1:])
            bits = (sums[s - lo + size] - sums[s - lo]) > 0
            out[at : at + len(s)] = (bits.astype(np.uint64) << _SHIFTS).sum(1, dtype=np.uint64)
        return out

    def matches(self, text: str | None, cache: WordHash) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, Hamming distance, similarity): each item's best window."""
        if not text or not len(self.grams):
            return []
        named = words_of(text)
        g = gram_hashes(named, cache, self.words)
        if not len(g):
            return []
        at, known = self.places(g)
        hits = np.flatnonzero(known)
        if not len(hits):
            return []
        w = np.where(known, self.weights[at], self.rest)
        best: dict[int, tuple[float, int, int, int]] = {}
        lo, n = self.first[at[hits]], self.last[at[hits]] - self.first[at[hits]]
        who = self.owners[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        where = np.repeat(hits, n)
        share = np.bincount(who, w[where], len(self.ids))
        least = self.similarity * np.array(self.sums) - 1e-6  # what both must share
        may = np.flatnonzero((share > 0) & (share >= least))
        if not len(may):
            return []
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(w)])
        order = np.argsort(who, kind="stable")
        who, where = who[order], where[order]
        for i in may.tolist():
            own = where[np.searchsorted(who, i, "left") : np.searchsorted(who, i, "right")]
            span = min(int(self.size[i]), len(g))
            starts = np.unique(np.concatenate([np.clip(own - span + 1, 0, len(g) - span), own.clip(max=len(g) - span)]))
            held = np.zeros(len(g) + 1, np.int64)
            held[own + 1] = w[own]
            held = np.cumsum(held)
            # all windows between those edges, as far as the bound lets them through
            x = np.arange(starts[0], starts[-1] + 1)
            bound = held[x + span] - held[x]
            x = x[(bound > 0) & (bound >= least[i]) & (bound >= self.similarity * (total[x + span] - total[x]) - 1e-6)]
            x = x[self.near(g, w, x, span, i)]
            top = (0.0, 0)
            for k in x.tolist():
                sim = self.alike(g[k : k + span].tolist(), w[k : k + span].tolist(), i)
                if sim >= self.similarity and sim > top[0]:
                    top = (sim, k)
                    if sim == 1.0:
                        break
            if top[0] > 0:
                k = top[1]
                print_ = self.fingerprints(g[k : k + span], w[k : k + span], np.zeros(1, np.int64), span)[0]
                best[i] = (top[0], k, span, int(np.bitwise_count(print_ ^ self.prints[i])))
        return [(i, x, min(span + self.words - 1, len(named)), d, sim) for i, (sim, x, span, d) in sorted(best.items())]

    def near(self, g: np.ndarray, w: np.ndarray, starts: np.ndarray, span: int, item: int) -> np.ndarray:
        """Which windows have fingerprints within the radius of the item's."""
        if not len(starts):
            return np.empty(0, bool)
        apart = self.fingerprints(g, w, starts, span) ^ self.prints[item]
        return within(apart)

    def alike(self, grams: list[int], weights: list[int], item: int) -> float:
        mine, w = Counter(grams), dict(zip(grams, weights))
        theirs = self.counts[item]
        both = sum(min(c, theirs[h]) * w[h] for h, c in mine.items() if h in theirs)
        own = sum(c * w[h] for h, c in mine.items())
        return both / (own + self.sums[item] - both)


def within(apart: np.ndarray) -> np.ndarray:
    """Differences of fingerprints that lie within the radius: first by block, then as a whole."""
    size = 64 // BLOCKS
    blocks = (apart[:, None] >> (np.arange(BLOCKS, dtype=np.uint64) * np.uint64(size))) & np.uint64((1 << size) - 1)
    met = (np.bitwise_count(blocks) <= RADIUS // BLOCKS).any(1)
    out = np.zeros(len(apart), bool)
    out[met] = np.bitwise_count(apart[met]) <= RADIUS
    return out


def _df(rows: DataFrame, words: int) -> DataFrame:
    """(h, n): items that hold each shingle."""

    def count(batches):
        cache = WordHash()
        for b in batches:
            found = [np.unique(gram_hashes(words_of(t), cache, words)) for t in b.column(0).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    ship(rows.sparkSession)
    return store(rows.select("t").mapInArrow(count, "h long").groupBy("h").agg(F.count("*").alias("n")), "item-shingles")


def indexes(benchmark: DataFrame, *, item_id="item_id", text="text", words=5, similarity=0.8) -> Iterator[Index]:
    """Indexes of the items, block by block."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter(F.col("t").rlike(r"[^\x20\x09-\x0D]"))
    total = rows.count()
    if not total:
        return
    df = _df(rows, words)

    def index(block: list[tuple[int, str]]) -> Index:
        cache = WordHash()
        own = np.unique(np.concatenate([gram_hashes(words_of(t), cache, words) for _, t in block]))
        wanted = rows.sparkSession.createDataFrame(pa.table({"h": own.view(np.int64)}))
        got = df.join(wanted, "h").toArrow()
        counts = dict(zip(got.column("h").to_numpy().view(np.uint64).tolist(), got.column("n").to_pylist()))
        return Index(block, total, counts, words, similarity)

    block, size = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        n = len(words_of(r["t"]))
        if block and (len(block) >= ITEMS or size + n > ITEM_WORDS):
            yield index(block)
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    if block:
        yield index(block)
    drop_stored(df)


class Bloom:
    """Which 64-bit hashes may be in a set; all that are, are found."""

    def __init__(self, hashes: Iterator[np.ndarray], n: int):
        self.bits = max(64, min(BLOOM_MB << 23, n * BLOOM_BITS))
        self.held = np.zeros(self.bits // 8 + 1, np.uint8)
        for h in hashes:
            for at in self._places(h):
                np.bitwise_or.at(self.held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        size = np.uint64(self.bits)
        return [((h >> np.uint64(s)) ^ (h << np.uint64(17 * k + 1))) % size for k, s in enumerate((0, 11, 23))]

    def any_of(self, h: np.ndarray) -> bool:
        at = [p.astype(np.int64) for p in self._places(h)]
        return bool(np.logical_and.reduce([(self.held[p >> 3] >> (p & 7).astype(np.uint8)) & 1 for p in at]).any()) if len(h) else False


def _shortened(rows: DataFrame, benchmark: DataFrame, *, text="text", words=5, **_) -> DataFrame:
    """``rows`` (with ``text``) as they are for a benchmark of one block; else those with a shingle of any item, stored."""
    items = benchmark.select(F.col(text).alias("t")).filter(F.col("t").rlike(r"[^\x20\x09-\x0D]"))
    size = items.agg(F.count("*").alias("n"), F.sum(F.size(F.split("t", r"[\x20\x09-\x0D]+"))).alias("w")).first()
    if size["n"] <= ITEMS and (size["w"] or 0) <= ITEM_WORDS:
        return rows
    df = _df(items, words)
    n = df.count()
    blocks = (np.array([r["h"] for r in part], np.int64).view(np.uint64) for part in _chunks(df.select("h").toLocalIterator(), 100_000))
    held = rows.sparkSession.sparkContext.broadcast(Bloom(blocks, n))
    drop_stored(df)

    def run(batches):
        bloom, cache = held.value, WordHash()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                yield b.filter(pa.array([bool(t) and bloom.any_of(gram_hashes(words_of(t), cache, words)) for t in texts], pa.bool_()))

    return store(rows.mapInArrow(run, rows.schema), "suspects")


def _chunks(rows: Iterator, n: int) -> Iterator[list]:
    while part := list(islice(rows, n)):
        yield part


_FOUND = "item_id long, first_word int, n_words int, hamming int, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", **kind) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, hamming, similarity): each item in each document, once."""
    ship(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], f"doc_id long, {_FOUND}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    rows = _shortened(rows, benchmark, **kind)
    for index in indexes(benchmark, **kind):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            ix, cache = held.value, WordHash()
            for b in batches:
                got = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in ix.matches(t, cache)]
                cols = list(zip(*got)) if got else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cols[0], pa.int64()), pa.array([ix.ids[i] for i in cols[1]], pa.int64()), pa.array(cols[2], pa.int32()),
                        pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "first_word", "n_words", "hamming", "similarity"],
                )

        out = out.unionByName(rows.mapInArrow(run, f"doc_id long, {_FOUND}"))
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, *, text="text", **kind) -> DataFrame:
    """Rows of ``docs`` in which no item was found."""
    ship(docs.sparkSession)
    for index in indexes(benchmark, **kind):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            ix, cache = held.value, WordHash()
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    b = whole.slice(at, 1000)
                    texts = b.column(b.schema.get_field_index("text")).to_pylist()
                    yield b.filter(pa.array([not ix.matches(t, cache) for t in texts], pa.bool_())).select(["row"])

        rows = packed(docs, text=text)
        docs = rows.mapInArrow(run, rows.select("row").schema).select("row.*")
    return docs


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: five-word shingles, similarity 0.8 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE: dict[str, str] = {}
