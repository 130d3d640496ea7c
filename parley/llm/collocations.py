"""Phrase collocation mining: counts by slot of minimal perfect hashes over Apriori-safe candidates.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
``[^\\x20\\x09]+``; all counts are by language. Words are counted first. Then, level by level:

1. Candidates of k words are the phrases met whose first and last k - 1 words may both be
   frequent, as a Bloom filter says (it errs to one side only, so no frequent phrase is lost).
2. Their keys are dealt by hash into shards of about DEAL occurrences, and each shard gets a
   minimal perfect hash (bit arrays of rising level, ranks by population count) and its keys
   in order of slot.
3. Each shard's occurrences, summed in the slices of text they come from, go to MAPPERS
   mappers; a mapper finds their slots, compares the stored keys and counts by ``bincount``
   into one array; the arrays of a shard are summed in pairs, as a tree.
4. What is frequent stays, under a minimal perfect hash of its own, with its counts.

The parts of frequent phrases are frequent, so both sides of every cut are read by slot from
the tables of the levels below, each request meeting its shard's table.

A key has 96 bits: 64 for shard and slot and 32 more; among 10^11 phrases two share one with
probability 10^-7. The filters that the driver gathers and broadcasts have BLOOM_BITS bits
(16 MB) at most; with more keys than they can tell apart, candidates are more and results
the same. Nothing else passes the driver but counts. A slice's text has SLICE bytes or one
text; a frequent phrase is one entry of a slice, however often it occurs there.

Defined results: null texts count as empty, a null language as ``und``; texts without a word
and an empty table give nothing; repeated rows count each for themselves; long texts go
whole; equal scores are ordered by count, then phrase; other columns don't matter, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, mix, ship, store

DEAL = 1 << 20  # phrase occurrences of a shard, about
MAPPERS = 2  # arrays that are counted for a shard and then summed
READ = 1 << 15  # requests for counts that one group answers
SLICE = 6_000_000  # bytes of text whose phrases are summed before they travel
BLOOM_BITS = 1 << 27
GAMMA = 2.0  # bits of a level for each key that is left
_BREAK = b"\xff"  # in no text: no byte of UTF-8
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10)


# ----- words and phrases of a slice of text ----------------------------------


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all texts in order, with a break wherever a piece ends."""
    return _BREAK.join(texts).translate(_LOWER).replace(_BREAK, b" \xff ").split()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``np.unique`` gives of keys of 0 and more, with first places, inverse and counts.

    A key and its place share one number where they fit, for plain numbers sort many times
    faster than places by key do.
    """
    n, bits = len(keys), len(keys).bit_length()
    if not n or int(keys.max()).bit_length() + bits > 63:
        return np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    both = np.sort(keys << bits | np.arange(n))
    key, place = both >> bits, both & ((1 << bits) - 1)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    at, inverse = np.flatnonzero(new), np.empty(n, np.int64)
    inverse[place] = np.cumsum(new) - 1
    return key[at], place[at], inverse, np.diff(at, append=n)


@dataclass
class Level:
    """Distinct phrases of one length in a slice: keys, counts and a first place of each."""

    h: np.ndarray
    v: np.ndarray
    count: np.ndarray
    first: np.ndarray


class Slice:
    """Words of some texts of one language as numbers, and keys of their phrases."""

    def __init__(self, texts: list[bytes], lang: str):
        numbers = pa.array(tokens(texts), pa.binary()).dictionary_encode()
        self.code = numbers.indices.to_numpy().astype(np.int64)
        self.words = numbers.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.stop = numbers.dictionary.index(pa.scalar(_BREAK, pa.binary())).as_py()
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), ">u8").astype(np.uint64).reshape(-1, 2)
        self.a, self.b = both[:, 0], both[:, 1]
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))

    def levels(self, longest: int, maybe: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, Level]]:
        """(k, phrases of k words) for k from 2; ``maybe`` says which keys of a level may be frequent."""
        with np.errstate(over="ignore"):
            h, v = mix(self.seed + self.a), mix(self.seed + self.b)
            known = maybe(1, h, v)
            if self.stop >= 0:
                known[self.stop] = False
            number, good, width = self.code, known[self.code], len(self.words)
            for k in range(2, longest + 1):
                at = np.flatnonzero(good[:-1] & good[1:])
                uniq, first, inverse, count = distinct(number[at] * width + self.code[at + k - 1])
                before, last = uniq // width, uniq % width
                h, v = mix(h[before] + self.a[last]), mix(v[before] + self.b[last])
                yield k, Level(h, v, count, at[first])
                if k < longest:
                    good, number = np.zeros(len(good), bool), np.zeros(len(good), np.int64)
                    number[at], good[at] = inverse, maybe(k, h, v)[inverse]

    def phrase(self, at: int, k: int) -> bytes:
        return b" ".join([self.words[c] for c in self.code[at : at + k].tolist()])


def short(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(32)).astype(np.uint32)


def keys_of(langs: list[str], phrases: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of phrases of one length."""
    if not phrases:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    k = len(phrases[0])
    h = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in langs), np.uint64, len(langs))
    v = h.copy()
    with np.errstate(over="ignore"):
        for i in range(k):
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p[i]) for p in phrases), ">u8").astype(np.uint64).reshape(-1, 2)
            h, v = mix(h + both[:, 0]), mix(v + both[:, 1])
    return h, short(v)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


# ----- minimal perfect hash --------------------------------------------------


class Slots:
    """Keys (h, v) -> slots 0 to n - 1, each key's its own; keys by slot tell others apart."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, h: np.ndarray, v: np.ndarray):
        self.sizes, self.bits, self.h, self.v = sizes, bits, h, v
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def _place(h: np.ndarray, v: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(h ^ mix(v.astype(np.uint64) + np.uint64(level << 33))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray, v: np.ndarray) -> tuple[Slots, np.ndarray]:
        """The hash of distinct keys, and the place in them of each slot's key."""
        left, sizes, parts = np.arange(len(h)), [], []
        while len(left):
            if len(sizes) > 200:
                raise ValueError("keys repeat")
            size = -(-int(GAMMA * len(left)) // 64) * 64 + 64
            at = cls._place(h[left], v[left], len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            flags = np.zeros(size, bool)
            flags[at[alone]] = True
            parts.append(np.packbits(flags, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone]
        found = cls(np.array(sizes, np.int64), np.concatenate([np.empty(0, np.uint64), *parts]), h, v)
        order = np.argsort(found._slots(h, v))
        found.h, found.v = h[order], v[order]
        return found, order

    def _slots(self, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = base + self._place(h[left], v[left], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.rank[at[hit] >> 6] + below
            left, base = left[~hit], base + size
            if not len(left):
                break
        return out

    def find(self, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for those whose slot holds another key."""
        s = self._slots(h, v)
        if len(self.h):
            s[(s < 0) | (self.h[s] != h) | (self.v[s] != v)] = -1
        return s

    def row(self) -> list[bytes]:
        return [self.sizes.tobytes(), self.bits.tobytes(), self.h.tobytes(), self.v.tobytes()]

    @classmethod
    def of(cls, row: dict) -> Slots:
        return cls(*(np.frombuffer(row[n], t) for n, t in (("sizes", np.int64), ("bits", np.uint64), ("h", np.uint64), ("v", np.uint32))))


SLOTS = "sizes binary, bits binary, h binary, v binary"


# ----- passes over the texts -------------------------------------------------


def _slices(b: pa.RecordBatch) -> Iterator[Slice | tuple]:
    """(lang, texts) of about SLICE bytes."""
    langs, texts = b.column("lang").to_pylist(), b.column("text").cast(pa.binary())
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    order = sorted(range(len(langs)), key=langs.__getitem__)
    some, held = [], 0
    for k, i in enumerate(order):
        some.append(i)
        held += int(size[i])
        if held >= SLICE or k + 1 == len(order) or langs[order[k + 1]] != langs[i]:
            yield langs[i], [t for t in texts.take(pa.array(some)).to_pylist() if t]
            some, held = [], 0


def _words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) by language; a null word has the sum of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, texts in _slices(b):
                words, n = pa.array(tokens(texts), pa.binary()).value_counts().flatten()
                some = pc.not_equal(words, pa.scalar(_BREAK, pa.binary()))
                words, n = words.filter(some).cast(pa.string()), n.filter(some)
                if len(n):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * (len(n) + 1)), pa.concat_arrays([pa.nulls(1, pa.string()), words]), pa.concat_arrays([pa.array([pc.sum(n).as_py()], pa.int64()), n])],
                        names=["lang", "word", "n"],
                    )

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _parts(shard: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """Shards met, and each column's bytes for each of them."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(shard))
    return shard[at].tolist(), [[c[a:z].tobytes() for a, z in zip(at.tolist(), ends.tolist())] for c in (c[order] for c in columns)]


class Sieve:
    """Bloom filter of the frequent keys of one level."""

    HASHES = 4

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    @staticmethod
    def places(h: np.ndarray, v: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            step = mix(v.astype(np.uint64)) | np.uint64(1)
            return [(h + np.uint64(i) * step & mask).astype(np.int64) for i in range(Sieve.HASHES)]

    def has(self, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self.places(h, v, self.mask):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found


def _sieve(table: DataFrame, keys: int) -> Sieve:
    """The filter over all keys of a stored level."""
    bits = min(BLOOM_BITS, max(1 << 16, 1 << (16 * keys).bit_length()))
    block, mask = 1 << 16, np.uint64(bits - 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, v in zip(b.column("h").to_pylist(), b.column("v").to_pylist()):
                at = np.unique(np.concatenate(Sieve.places(np.frombuffer(h, np.uint64), np.frombuffer(v, np.uint32), mask)))
                blocks, [inside] = _parts(at // block, (at % block).astype(np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(inside, pa.binary())], names=["block", "at"])

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        flags = np.zeros(block, bool)
        for at in rows.column("at").to_pylist():
            flags[np.frombuffer(at, np.uint16)] = True
        return pa.table({"block": [key[0].as_py()], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    found = table.select("h", "v").mapInArrow(spread, "block long, at binary").groupBy("block").applyInArrow(gather, "block long, bits binary")
    for r in found.toLocalIterator():
        out[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = np.frombuffer(r["bits"], np.uint8)
    return Sieve(out)


def _deal(docs: DataFrame, k: int, shards: int, mappers: int, sieves) -> DataFrame:
    """(shard, mapper, h, v, n) of each slice's candidates of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turn = sieves.value, TaskContext.get().partitionId()
        for b in batches:
            for lang, texts in _slices(b):
                for j, x in Slice(texts, lang).levels(k, lambda j, h, v: held[j].has(h, short(v))):
                    if j == k and len(x.h):
                        turn += 1
                        of, (h, v, n) = _parts(shard_of(x.h, shards), x.h, short(x.v), x.count.astype(np.uint32))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(of, pa.int64()), pa.array([turn % mappers] * len(of), pa.int64()), *(pa.array(c, pa.binary()) for c in (h, v, n))],
                            names=["shard", "mapper", "h", "v", "n"],
                        )

    return docs.mapInArrow(run, "shard long, mapper long, h binary, v binary, n binary")


def _joined(rows: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)


def _made(shard: int, h: np.ndarray, v: np.ndarray, **more: np.ndarray) -> pa.Table:
    """One row: shard, slots, and ``more`` in order of slot."""
    slots, order = Slots.build(h, v)
    return pa.table(
        {"shard": [shard], **{n: [x] for n, x in zip(("sizes", "bits", "h", "v"), slots.row())}, **{n: [x[order].tobytes()] for n, x in more.items()}}
    )


def _candidates(dealt: DataFrame) -> DataFrame:
    """Each shard's distinct keys under a minimal perfect hash."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        h, v = _joined(rows, "h", np.uint64), _joined(rows, "v", np.uint32)
        order = np.lexsort((v, h))
        h, v = h[order], v[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (v[1:] != v[:-1])])
        return _made(key[0].as_py(), h[new], v[new])

    return dealt.select("shard", "h", "v").groupBy("shard").applyInArrow(build, f"shard long, {SLOTS}")


def _counts(dealt: DataFrame, slots: DataFrame, mappers: int, least: int) -> DataFrame:
    """Each shard's frequent keys and counts, by slot: mappers count into arrays, which are summed in pairs."""

    def count(key: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        mine = Slots.of(table.slice(0, 1).to_pylist()[0])
        at = mine.find(_joined(rows, "h", np.uint64), _joined(rows, "v", np.uint32))
        ok = at >= 0
        n = np.bincount(at[ok], weights=_joined(rows, "n", np.uint32)[ok], minlength=len(mine.h)).astype(np.int64)
        return pa.table({"shard": [key[0].as_py()], "mapper": [key[1].as_py()], "n": [n.tobytes()]})

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x, np.int64) for x in rows.column("n").to_pylist())
        return pa.table({"shard": [key[0].as_py()], "mapper": [key[1].as_py()], "n": [n.tobytes()]})

    def keep(key: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        mine = Slots.of(table.slice(0, 1).to_pylist()[0])
        n = sum((np.frombuffer(x, np.int64) for x in rows.column("n").to_pylist()), np.zeros(len(mine.h), np.int64))
        ok = n >= least
        return _made(key[0].as_py(), mine.h[ok], mine.v[ok], n=n[ok])

    each = slots.withColumn("mapper", F.explode(F.sequence(F.lit(0), F.lit(mappers - 1)).cast("array<long>")))
    arrays = dealt.groupBy("shard", "mapper").cogroup(each.groupBy("shard", "mapper")).applyInArrow(count, "shard long, mapper long, n binary")
    while mappers > 2:
        mappers = -(-mappers // 2)
        half = arrays.select("shard", F.floor(F.col("mapper") / 2).cast("long").alias("mapper"), "n")
        arrays = half.groupBy("shard", "mapper").applyInArrow(add, "shard long, mapper long, n binary")
    return arrays.groupBy("shard").cogroup(slots.groupBy("shard")).applyInArrow(keep, f"shard long, {SLOTS}, n binary")


def _word_table(words: DataFrame, shards: int) -> DataFrame:
    """The frequent words as a level: slots and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, v = keys_of(b.column("lang").to_pylist(), [[w] for w in b.column("word").cast(pa.binary()).to_pylist()])
            of, parts = _parts(shard_of(h, shards), h, v, b.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int64()), *(pa.array(c, pa.binary()) for c in parts)], names=["shard", "h", "v", "n"]
            )

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        return _made(key[0].as_py(), _joined(rows, "h", np.uint64), _joined(rows, "v", np.uint32), n=_joined(rows, "n", np.int64))

    return words.mapInArrow(run, "shard long, h binary, v binary, n binary").groupBy("shard").applyInArrow(build, f"shard long, {SLOTS}, n binary")


def _named(docs: DataFrame, tables: DataFrame, shards: dict[int, int], longest: int, sieves) -> DataFrame:
    """(lang, phrase, a) of the frequent phrases of two words and more.

    Slices send the phrases that may be frequent with their keys; each shard's table tells
    which are, and takes one of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sieves.value
        for b in batches:
            for lang, texts in _slices(b):
                part = Slice(texts, lang)
                for k, x in part.levels(longest, lambda j, h, v: held[j].has(h, short(v))):
                    may = held[k].has(x.h, short(x.v))
                    h, v, first = x.h[may], short(x.v)[may], x.first[may]
                    of = shard_of(h, shards[k])
                    order = np.argsort(of, kind="stable")
                    names = [part.phrase(i, k) for i in first[order].tolist()]
                    of, (h, v) = _parts(of[order], h[order], v[order])
                    ends = np.cumsum([0] + [len(x) // 4 for x in v]).tolist()
                    if of:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([k] * len(of), pa.int64()), pa.array(of, pa.int64()), pa.array([lang] * len(of)),
                                pa.array(h, pa.binary()), pa.array(v, pa.binary()),
                                pa.array([b"\n".join(names[i:j]) for i, j in zip(ends, ends[1:])], pa.binary()),
                            ],
                            names=["level", "shard", "lang", "h", "v", "phrases"],
                        )

    def choose(key: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        langs, phrases, count = [], [], []
        for row in table.to_pylist():
            mine, n = Slots.of(row), np.frombuffer(row["n"], np.int64)
            new = np.ones(len(n), bool)
            for lang, h, v, names in zip(*(rows.column(c).to_pylist() for c in ("lang", "h", "v", "phrases"))):
                at = mine.find(np.frombuffer(h, np.uint64), np.frombuffer(v, np.uint32))
                take = np.flatnonzero((at >= 0) & new[at])
                if len(take):
                    split = names.split(b"\n")
                    phrases += [split[i] for i in take.tolist()]
                    langs += [lang] * len(take)
                    count.append(n[at[take]])
                    new[at[take]] = False
        counts = np.concatenate([np.empty(0, np.int64), *count])
        return pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "a": counts})

    sent = docs.mapInArrow(run, "level long, shard long, lang string, h binary, v binary, phrases binary")
    return sent.groupBy("level", "shard").cogroup(tables.groupBy("level", "shard")).applyInArrow(choose, "lang string, phrase string, a long")


def _read(named: DataFrame, tables: DataFrame, shards: dict[int, int]) -> DataFrame:
    """(lang, phrase, a, role, n): the counts of the parts of its k-th cut (roles 2k - 1 and 2k), read by slot.

    A word may be a part of any share of all phrases: its shard's table goes to as many groups
    as there are READ requests.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, phrases = b.column("lang").to_pylist(), b.column("phrase").cast(pa.binary()).to_pylist()
            want: dict[int, list[tuple[int, int, list[bytes]]]] = {}
            for i, p in enumerate(phrases):
                w = p.split(b" ")
                for k in range(1, len(w)):
                    want.setdefault(k, []).append((i, 2 * k - 1, w[:k]))
                    want.setdefault(len(w) - k, []).append((i, 2 * k, w[k:]))
            for level, asked in want.items():
                i, role, words = zip(*asked)
                h, v = keys_of([langs[x] for x in i], list(words))
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).take(at) for c in ("lang", "phrase", "a")), pa.array(role, pa.int64()), pa.array([level] * len(i), pa.int64()),
                        pa.array(shard_of(h, shards[level])), pa.array(h.view(np.int64)), pa.array(v.view(np.int32)),
                    ],
                    names=["lang", "phrase", "a", "role", "level", "shard", "h", "v"],
                )

    def answer(key: tuple, asked: pa.Table, table: pa.Table) -> pa.Table:
        h, v = asked.column("h").to_numpy().view(np.uint64), asked.column("v").to_numpy().view(np.uint32)
        n = np.zeros(len(h), np.int64)
        for row in table.to_pylist():
            at = Slots.of(row).find(h, v)
            n[at >= 0] = np.frombuffer(row["n"], np.int64)[at[at >= 0]]
        return asked.select(["lang", "phrase", "a", "role"]).append_column("n", pa.array(n))

    group = ["level", "shard", "part"]
    asked = named.mapInArrow(ask, "lang string, phrase string, a long, role long, level long, shard long, h long, v int")
    load = asked.groupBy("level", "shard").agg(F.ceil(F.count("*") / READ).alias("parts"))
    asked = asked.join(load, ["level", "shard"]).withColumn("part", F.pmod(F.xxhash64("lang", "phrase"), "parts")).drop("parts")
    spread = tables.join(load, ["level", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return asked.groupBy(*group).cogroup(spread.groupBy(*group)).applyInArrow(answer, "lang string, phrase string, a long, role long, n long")


def collocations(
    docs: DataFrame, *, text="text", lang="lang", least: int = 10, longest: int = 3, top: int = 2000, covered: int = 50,
    deal: int = DEAL, mappers: int = MAPPERS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Phrases of 2 to ``longest`` words with a count ``a`` of ``least`` at least; ``l`` and ``r``
    count the parts at the cut of the lowest score floor(1,000,000 a a / (l r)); ``n`` counts the
    language's words. Phrases go that lie in a longer one with ``covered`` percent of their count.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = store(_words(texts).filter((F.col("n") >= least) | F.col("word").isNull()), "words")
    size = words.agg(F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("all"), F.count("word").alias("frequent")).first()
    total, frequent = size["all"] or 0, size["frequent"]
    shards = dict.fromkeys(range(1, longest + 1), max(1, -(-total // deal)))
    tables = {1: store(_word_table(words.filter("word is not null"), shards[1]), "level-1")}
    sieves = {1: _sieve(tables[1], frequent)}
    for k in range(2, longest + 1):
        dealt = _deal(texts, k, shards[k], mappers, spark.sparkContext.broadcast(sieves))
        if k > 2:  # far fewer; the keys of all pairs would need more room than the texts, so pairs are made twice
            dealt = store(dealt, "dealt")
        slots = store(_candidates(dealt), "candidates")
        tables[k] = store(_counts(dealt, slots, mappers, least), f"level-{k}")
        drop_stored(dealt, slots)
        n = tables[k].agg(F.sum(F.length("v") / 4).cast("long").alias("n")).first()["n"] or 0
        sieves = {**sieves, k: _sieve(tables[k], n)}
    leveled = None
    for k, t in tables.items():
        t = t.withColumn("level", F.lit(k).cast("long"))
        leveled = t if leveled is None else leveled.unionByName(t)
    named = store(_named(texts, leveled.filter("level > 1"), shards, longest, spark.sparkContext.broadcast(sieves)), "named")
    read = _read(named, leveled, shards).groupBy("lang", "phrase", "a")
    found = store(read.agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("c")), "phrases")
    drop_stored(named, *tables.values())

    big = lambda c: c.cast("decimal(15,0)")  # noqa: E731  of products of these, 38 digits hold all
    cuts = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(F.split("phrase", " ")) - 1), lambda k: _cut(k, big)))
    scored = found.withColumn("best", F.element_at(cuts, 1)).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    inner = None
    for k in range(3, longest + 1):
        for j in range(2, k):
            w = F.split("phrase", " ")
            within = F.array(*(F.array_join(F.slice(w, i + 1, j), " ") for i in range(k - j + 1)))
            part = found.filter(F.size(w) == k).select("lang", F.explode(within).alias("phrase"), F.col("a").alias("over"))
            inner = part if inner is None else inner.unionByName(part)
    if inner is not None:
        most = inner.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
        scored = scored.join(most, ["lang", "phrase"], "left").filter((F.col("over") * 100 < F.col("a") * covered) | F.col("over").isNull())
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    sums = words.filter("word is null").select("lang", "n")
    return ranked.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(k, big):
    """(score, k, l, r) of the k-th cut."""
    left, right = F.col("c")[(2 * k - 1).cast("long")], F.col("c")[(2 * k).cast("long")]
    score = F.call_function("div", big(F.lit(1_000_000)) * (big(F.col("a")) * big(F.col("a"))), big(left) * big(right))
    return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's 2000 strongest phrases of two or three words."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


QUERIES = {"op12_collocations": op12_collocations}
ORACLE = {
    "op12_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: words[i:i + k - 1])) AS ws
  FROM w, (VALUES (1), (2), (3)) AS ks(k)),
f AS (SELECT lang, k, ws, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.k, c.ws, c.a, cut, l.a AS l, r.a AS r,
    (1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f l ON l.lang = c.lang AND l.ws = c.ws[:c.cut] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[c.cut + 1:]),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) AS pick FROM cuts) WHERE pick = 1),
inner2 AS (
  SELECT lang, ws, max(a) AS over FROM (
    SELECT lang, ws[:2] AS ws, a FROM c WHERE k = 3 UNION ALL SELECT lang, ws[2:] AS ws, a FROM c WHERE k = 3) GROUP BY lang, ws),
kept AS (
  SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, b.l, b.r, b.score
  FROM best b LEFT JOIN inner2 i ON i.lang = b.lang AND i.ws = b.ws WHERE i.over IS NULL OR 100 * i.over < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
}
