"""Language ID by cross-parsing entropy over suffix automata.

A suffix automaton of a bounded sample of labelled text is built per language. A text is
parsed greedily into the longest pieces that occur in a language's sample; the number of
pieces, times the logarithm of the sample's size and over the text's length, estimates
the cross entropy, and the language with the least wins.

Every language has an alphabet of its own: all letters of its sample. Its automaton is a
dense table where that is small and a sorted list of edges where it is not (scripts with
thousands of letters); both give the same parse.

The whole text is parsed as one. To do so for many texts at once, each is cut into segments
of ``SEGMENT`` characters that are parsed side by side, as if a piece began at each start.
Then the parse of each segment's end is carried on into the next one until a piece begins
where the next segment's own parse begins one, too: from there on both are equal.

Bounds (documented parameters): at most ``chars_per_lang`` characters of sample per
language and ``total_chars`` over all of them, so the model's size doesn't grow with the
corpus.

Defined results: a null text, or one with no letter (of any plane), gets ``und`` and score
0; ties go to the language first in order; a letter that a language's sample lacks is a
piece alone there, of ``NEW`` bits more; without any labelled text every document gets ``und``; texts
that repeat count once when the sample is drawn; repeated rows get equal results; other
columns are kept, but for lang_pred, score and bits, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, ship, without

SEGMENT = 512
POINTS = 0x110000
DENSE = 16_000_000  # entries of a transition table up to which it is dense
HEAD = 64  # of a segment, in which two parses mostly have met
BATCH = 1_000_000  # characters parsed at once, but for a longer text: each takes some 40 bytes meanwhile
NEW = 20  # bits of a letter that a language's sample lacks, beside those of its piece


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(POINTS)), bool, POINTS)


def squeeze(classes: np.ndarray) -> np.ndarray:
    """Drop all but the first of each run of non-letters."""
    if len(classes) < 2:
        return classes
    keep = np.ones(len(classes), bool)
    keep[1:] = (classes[1:] != 0) | (classes[:-1] != 0)
    return classes[keep]


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Edges by state, of the automaton of all substrings of ``seq``; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in seq:
        cur = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return edges


class Automaton:
    """Parses many texts at once. Classes: 0 no letter, 1 to ``width - 2`` letters, the last any other letter.

    States are what :meth:`walk` gives; ``begin`` is that of a text not begun, where any letter
    begins a piece. A dense table has the next state for each state and class, or, as its
    complement, the state after a new piece has begun with that letter.
    """

    def __init__(self, edges: list[dict[int, int]], width: int):
        self.width, dead = width, len(edges)  # the dead state has no edges: a letter the language lacks is a piece alone
        pairs = sorted((s * width + c, t) for s, out in enumerate(edges) for c, t in out.items())
        self.keys, self.to = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        first = np.full(width, dead, np.int64)
        for c, t in edges[0].items():
            first[c] = t
        self.table = None
        if (dead + 1) * width <= DENSE:
            table = np.tile(~(first * width), dead + 1)
            table[self.keys] = self.to * width
            self.table, self.begin = table.astype(np.int32), dead * width
        else:
            self.first, self.begin = first.astype(np.int32), dead

    def walk(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and whether a piece begins with this letter."""
        if self.table is not None:
            out = self.table[state + c]
            return out ^ (out >> 31), out < 0
        key = state.astype(np.int64) * self.width + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.to[at], self.first[c]).astype(np.int32), ~known


class Model:
    """Letter test, alphabets and an automaton per language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        self.is_letter = letter_table()
        seqs = {x: [letters(t) for t in samples[x]] for x in self.langs}
        own = {x: (a := np.unique(np.concatenate(s)))[self.is_letter[a]] for x, s in seqs.items()}
        every = np.unique(np.concatenate([*own.values(), np.empty(0, np.uint32)])).astype(np.int64)
        # class of a code point among all letters met, then of such a class in one language
        self.known = np.where(self.is_letter, len(every) + 1, 0).astype(np.int32)
        self.known[every] = np.arange(1, len(every) + 1)
        self.parts, self.automata, self.bits = [], [], []
        for x in self.langs:
            to = np.full(len(every) + 2, len(own[x]) + 1, np.int32)
            to[0] = 0
            to[self.known[own[x].astype(np.int64)]] = np.arange(1, len(own[x]) + 1)
            seq = np.concatenate([np.zeros(1, np.int32), *(np.append(squeeze(to[self.known[p]]), 0) for p in seqs[x])])
            seq = squeeze(seq)
            self.parts.append(to)
            self.automata.append(Automaton(suffix_automaton(seq.tolist()), len(own[x]) + 2))
            self.bits.append(math.log2(max(2, len(seq))))

    def pieces(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language] -> pieces of the greedy parse. Texts: classes among all letters, squeezed."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        segs = -(-sizes // SEGMENT)
        if not segs.sum():
            return out
        owner = np.repeat(np.arange(len(texts)), segs)
        grid = np.full((len(owner), SEGMENT), -1, np.int32)
        at = 0
        for t, k in zip(texts, segs.tolist()):
            if k:
                grid[at : at + k].reshape(-1)[: len(t)] = t
                at += k
        size = (grid >= 0).sum(1)
        order = np.argsort(-size, kind="stable")  # live segments stay in front
        cols, fill = np.ascontiguousarray(grid[order].T), size[order]
        live = [int(np.searchsorted(-fill, -i, "left")) for i in range(int(fill[0]))]
        follows = np.zeros(len(owner), bool)  # not the first of its text
        follows[1:] = owner[1:] == owner[:-1]
        for j, (to, a) in enumerate(zip(self.parts, self.automata)):
            starts = np.zeros((SEGMENT, len(owner)), bool)  # where pieces begin, by sorted segment
            state, classes = np.full(len(owner), a.begin, np.int32), to[cols]
            for i, n in enumerate(live):
                state[:n], starts[i, :n] = a.walk(state[:n], classes[i, :n])
            count, end = np.empty(len(owner), np.int64), np.empty(len(owner), np.int32)
            count[order], end[order] = starts.sum(0), state
            place = np.empty(len(owner), np.int64)
            place[order] = np.arange(len(owner))
            self._carry(a, to, grid, size, follows, starts, place, count, end)
            out[:, j] = np.bincount(owner, count, len(texts)).astype(np.int64)
        return out

    @staticmethod
    def _carry(a: Automaton, to, grid, size, follows, starts, place, count, end) -> None:
        """Make ``count`` and ``end`` those of parses that go on over segments' starts."""
        own_end, own_count = end.copy(), count.copy()
        head = np.cumsum(starts[:HEAD], axis=0, dtype=np.int32)  # parses meet early, as a rule
        go = np.flatnonzero(follows)
        while len(go):
            state, more = end[go - 1].copy(), np.zeros(len(go), np.int64)
            met = np.full(len(go), -1, np.int64)
            todo = np.arange(len(go))
            for i in range(int(size[go].max())):
                todo = todo[(met[todo] < 0) & (size[go[todo]] > i)]
                if not len(todo):
                    break
                nxt, new = a.walk(state[todo], to[grid[go[todo], i]])
                same = new & starts[i, place[go[todo]]]
                met[todo[same]] = i
                more[todo] += new & ~same
                state[todo] = nxt
            hit, at = met >= 0, place[go]
            # pieces of the segment's own parse from where both meet
            before = np.where(met > 0, head[np.clip(met, 1, HEAD) - 1, at], 0)
            for k in np.flatnonzero(met > HEAD).tolist():
                before[k] = np.count_nonzero(starts[: met[k], at[k]])
            count[go] = more + np.where(hit, own_count[go] - before, 0)
            now = np.where(hit, own_end[go], state)
            changed = go[now != end[go]]  # the segment after it has to be carried on from another state
            end[go] = now
            go = changed + 1
            go = go[go < len(follows)]
            go = go[follows[go]]

    def missing(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language] -> letters that the language's sample lacks."""
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        flat = np.concatenate(texts) if texts else np.empty(0, np.int32)
        at = [np.flatnonzero((to == a.width - 1)[flat]) for to, a in zip(self.parts, self.automata)]
        return np.stack([np.bincount(owner[x], minlength=len(texts)) for x in at], 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, confidence and bits per character of each text."""
        seqs, ok = [], []
        for t in texts:
            points = letters(t) if t else np.empty(0, np.uint32)
            ok.append(bool(self.langs) and bool(self.is_letter[points].any()))
            seqs.append(squeeze(self.known[points]) if ok[-1] else np.empty(0, np.int32))
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        n = np.maximum(1, np.fromiter(map(len, seqs), np.int64, len(seqs)))
        bits = (self.pieces(seqs) * np.array(self.bits) + NEW * self.missing(seqs)) / n[:, None]
        best = bits.argmin(1)
        least = bits[np.arange(len(texts)), best]
        sure = 1.0 / np.exp(-8.0 * (bits - least[:, None])).sum(1)
        return (
            [self.langs[b] if o else "und" for b, o in zip(best.tolist(), ok)],
            [s if o else 0.0 for s, o in zip(sure.tolist(), ok)],
            [x if o else 0.0 for x, o in zip(least.tolist(), ok)],
        )


def sample(train: DataFrame, *, text="text", lang="lang", chars_per_lang=40_000, total_chars=400_000) -> list:
    """(lang, text, u) of a bounded sample; each language has one text at least.

    Distinct texts are known by a hash, so copies weigh nothing. A threshold on that hash lets
    through about four times what is needed, in texts of a fourth of the bound at most where
    a language has such; its least text always passes. Of these each language's first are
    taken, in order of hash, until the bound is reached.
    """
    rows = train.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    distinct = rows.groupBy("lang", "h").agg(F.max(F.length("text")).alias("n"))
    short = F.col("n") <= chars_per_lang // 4
    # texts of a fourth of the bound at most come first; the order within is that of the hash
    unit = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    sizes = distinct.groupBy("lang").agg(
        F.sum("n").alias("all"), F.sum(F.when(short, F.col("n"))).alias("fit"), F.min(F.struct(~short, unit, "h")).alias("least")
    )
    have = {r["lang"]: r for r in sizes.collect()}
    if not have:
        return []
    each = max(2_000, min(chars_per_lang, total_chars // len(have)))
    keep = F.lit(False)
    for x, r in have.items():
        share = min(1.0, 4 * each / max(1, r["fit"] or r["all"]))
        small = F.length("text") <= (chars_per_lang // 4 if r["fit"] else 1 << 30)
        keep |= (F.col("lang") == x) & ((small & (unit < share)) | (F.col("h") == r["least"]["h"]))
    got = rows.filter(keep).dropDuplicates(["lang", "text"]).select("lang", F.substring("text", 1, each).alias("text"), unit.alias("u"))
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("u", "text").rowsBetween(Window.unboundedPreceding, -1))
    return got.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < each).select("lang", "text", "u").collect()


def fit(train: DataFrame, **kind) -> Model:
    """Model from a bounded sample of rows with a language."""
    samples: dict[str, list[str]] = {}
    for r in sorted(sample(train, **kind), key=lambda r: (r["u"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return Model(samples)


def _batches(b: pa.RecordBatch, text: str, within: str | None = None) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of about BATCH characters, 1000 rows at most and one at least, with their texts."""
    column = b.column(b.schema.get_field_index(within or text))
    if within:
        column = pc.struct_field(column, [column.type.get_field_index(text)])
    at = size = 0
    for k, n in enumerate(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), 1):
        size += n
        if size >= BATCH or k - at >= 1000 or k == b.num_rows:
            yield b.slice(at, k - at), column.slice(at, k - at).to_pylist()
            at, size = k, 0


def identify(docs: DataFrame, model: Model, *, text="text", within: str | None = None) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and bits (cross entropy per character).

    ``within``: the struct column that has the text, if no column of its own does.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ("lang_pred", "score", "bits")
    base = without(docs, *names)
    if within:  # as Spark finds it, whatever its case
        text = next(f.name for f in base.schema[within].dataType if f.name.lower() == text.lower())
    schema = base.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "bits": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for b, texts in _batches(whole, text, within):
                got = m.predict(texts)
                cols = [*b.columns, pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *names])

    return base.mapInArrow(run, schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from those whose crc32 of the id mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.filter(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLE: dict[str, str] = {}
