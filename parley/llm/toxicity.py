"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns words into symbols: *insult* and *threat* stems with a weight, *target* (second
person and like pronouns), *negation* and *reported speech* markers, or other. Insult stems are
learned: whole words and word beginnings of ``STEM`` letters that labelled documents show with far
greater odds in toxic ones, weighted by the logarithm of these odds; the closed classes are fixed
lists in four languages. A clause ends at punctuation, a line break or ``CLAUSE`` words.

Five transducers read a clause's symbols, each the output of the one before: negation rewrites
what it denies, reported speech what somebody is said to have said, target what is aimed at
somebody (before or after the word), insult and threat turn what is left into weights of
patterns. They are tables of arcs and are composed into one automaton (:func:`compose`), over
which a clause runs once. So what counts is the clause that an insult or threat stands in, not
the word alone.

A document's features are the weights of its clauses by pattern, as log2(1 + sum). Their own
weights and an intercept are fitted by logistic regression with the labelled sample; the score
is its probability, so texts without any match get the low score of the intercept.

Bounds: the sample has about ``SAMPLE`` documents of each label (all, if fewer), drawn by a
hash of the text; at most ``STEMS`` stems are kept.

Defined results: null and empty texts have no clause and get the intercept's score; long texts
are read whole; a word of several classes has the first of insult, threat, target, negation and
reported speech; stems of equal odds go by support, then by name; without labels of both kinds
nothing is learned and every score is 0; equal texts get equal scores; other columns are kept as
they are, but for score and predicted, which are replaced.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, ship, store, without

SAMPLE = 6_000
STEMS = 4_000
STEM = range(4, 9)
SUPPORT, RATIO = 0.01, 0.002  # least part of toxic texts with a stem; clean rate over toxic rate at most
CHANCES = 50_000
CLAUSE = 24
WINDOW = 4  # words over which negation and aim reach
# Closed word classes in English, German, French and Spanish.
TARGET = {
    "you", "your", "yours", "yourself", "u", "he", "she", "they", "them", "him", "her",
    "du", "dich", "dir", "dein", "deine", "deiner", "ihr", "euch", "euer", "eure", "sie", "er",
    "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos", "il", "elle",
    "tú", "ti", "tu", "tus", "usted", "ustedes", "vosotros", "vosotras", "él", "ella",
}
NEGATION = {
    "not", "never", "no", "isn't", "aren't", "wasn't", "don't", "doesn't", "won't", "cannot", "can't", "without",
    "nicht", "nie", "niemals", "kein", "keine", "keiner", "ohne", "pas", "jamais", "ne", "aucun", "sans", "nunca", "jamás", "ni", "sin",
}
REPORTED = {
    "said", "says", "told", "called", "calls", "wrote", "writes", "claims", "claimed", "quoted", "allegedly",
    "sagte", "sagt", "nannte", "nennt", "schrieb", "behauptet", "angeblich", "dit", "disait", "appelle", "appelait", "écrit", "prétend",
    "dijo", "dice", "llamó", "llama", "escribió", "afirma",
}
THREAT = {
    "kill", "hurt", "destroy", "beat", "murder", "burn", "stab", "töten", "schlagen", "umbringen", "vernichten", "verprügeln",
    "tuer", "frapper", "détruire", "brûler", "matar", "golpear", "destruir", "quemar",
}
FEATURES = ("insult", "aimed", "repeated", "denied", "reported", "threat", "threat_aimed", "threat_unmeant")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:,\n()\"]")
_ENDS = frozenset(".!?;:,\n()\"")


# ----- transducers -------------------------------------------------------------

SYMBOLS = "oitgnr"  # other, insult, threat, target, negation, reported speech


class Transducer:
    """Arcs (state, symbol) -> (state, symbol, weights by feature). A symbol without an arc passes as it is."""

    def __init__(self, start, arc):
        self.start, self.arc = start, arc

    def step(self, state, symbol: str):
        return self.arc(state, symbol) or (state, symbol, {})

    def run(self, symbols: str) -> tuple[str, dict[str, float]]:
        """Output and summed weights of one clause."""
        state, out, total = self.start, [], {}
        for x in symbols:
            state, y, w = self.step(state, x)
            out.append(y)
            for k, v in w.items():
                total[k] = total.get(k, 0.0) + v
        return "".join(out), total


def negation(reach: int = WINDOW) -> Transducer:
    """Insults and threats within ``reach`` words after a negation: i -> d, t -> u."""

    def arc(left, x):
        if x == "n":
            return reach, x, {}
        return max(0, left - 1), {"i": "d", "t": "u"}.get(x, x) if left else x, {}

    return Transducer(0, arc)


def reported_speech() -> Transducer:
    """Whatever follows a verb of saying in its clause: i -> q, t -> v."""
    return Transducer(False, lambda on, x: (on or x == "r", {"i": "q", "t": "v"}.get(x, x) if on else x, {}))


def target(reach: int = WINDOW) -> Transducer:
    """Within ``reach`` words after a target: i -> I, t -> T. A target after an insult or threat that has none: g -> J, K."""

    def arc(state, x):
        left, waiting = state
        if x == "g":
            return (reach, ""), {"i": "J", "t": "K"}.get(waiting, x), {}
        after = max(0, left - 1)
        if x in "it" and left:
            return (after, ""), x.upper(), {}
        return (after, x if x in "it" else waiting), x, {}

    return Transducer((0, ""), arc)


def insult() -> Transducer:
    """Weights of insults; the second of a clause counts as repeated."""
    gives = {"i": {}, "I": {"aimed": 1.0}, "d": {"denied": 1.0}, "q": {"reported": 1.0}}

    def arc(met, x):
        if x == "J":
            return met, "o", {"aimed": 1.0}
        if x in gives:
            more = {"repeated": 1.0} if met == 1 else {}
            return min(2, met + 1), "o", {"insult": 1.0} | gives[x] | more
        return None

    return Transducer(0, arc)


def threat() -> Transducer:
    """Weights of threats: plain, aimed, or denied or reported."""
    gives = {"t": "threat", "T": "threat_aimed", "K": "threat_aimed", "u": "threat_unmeant", "v": "threat_unmeant"}
    return Transducer(0, lambda s, x: (s, "o", {gives[x]: 1.0}) if x in gives else None)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One transducer that does what ``second`` does to the output of ``first``."""

    def arc(state, x):
        a, y, w = first.step(state[0], x)
        b, z, v = second.step(state[1], y)
        return (a, b), z, {k: w.get(k, 0.0) + v.get(k, 0.0) for k in {*w, *v}}

    return Transducer((first.start, second.start), arc)


PARTS = (negation, reported_speech, target, insult, threat)


class Table:
    """A transducer's arcs, of the states that clauses can reach, by number."""

    def __init__(self, t: Transducer):
        number, todo = {t.start: 0}, [t.start]
        self.next: list[list[int]] = []
        self.weights: list[list[tuple[tuple[int, float], ...]]] = []
        while todo:
            state = todo.pop(0)
            row, gains = [], []
            for x in SYMBOLS:
                to, _, w = t.step(state, x)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
                gains.append(tuple((FEATURES.index(k), v) for k, v in sorted(w.items())))
            self.next.append(row)
            self.weights.append(gains)


def grammar_table() -> Table:
    whole = PARTS[0]()
    for part in PARTS[1:]:
        whole = compose(whole, part())
    return Table(whole)


def stems_of(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in STEM if len(word) >= n)]


class Grammar:
    """Lexicon of stems, the composed automaton and the weights of the patterns."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.sizes = sorted({len(s) for s in stems if not s.endswith("$")})
        self.heads = frozenset(s.removesuffix("$")[:3] for s in stems)
        self.usual = sum(stems.values()) / len(stems) if stems else 1.0
        self.table = grammar_table()
        self.weights, self.bias = np.zeros(len(FEATURES)), -20.0

    def strength(self, word: str) -> float:
        """Log odds of the best stem that the word has; 0: none."""
        if word[:3] not in self.heads:
            return 0.0
        got = self.stems.get(word + "$", 0.0)
        for n in self.sizes:
            if n > len(word):
                break
            got = max(got, self.stems.get(word[:n], 0.0))
        return got

    def symbol(self, word: str) -> tuple[int, float]:
        """Number of the word's symbol, and its weight: 1 for an insult of usual odds and for a threat."""
        if (s := self.strength(word)) > 0:
            return 1, s / self.usual
        for k, words in ((2, THREAT), (3, TARGET), (4, NEGATION), (5, REPORTED)):
            if word in words:
                return k, 1.0
        return 0, 1.0

    def features(self, text: str | None) -> np.ndarray:
        out = [0.0] * len(FEATURES)
        if text:
            tokens = TOKEN.findall(text.lower())
            symbols = {w: self.symbol(w) for w in set(tokens)}
            hot = {w for w, (k, _) in symbols.items() if k in (1, 2)}
            if hot:
                clause: list[str] = []
                for w in tokens:
                    if w in _ENDS or len(clause) >= CLAUSE:
                        if not hot.isdisjoint(clause):
                            self.clause([symbols[x] for x in clause], out)
                        clause = []
                    if w not in _ENDS:
                        clause.append(w)
                if not hot.isdisjoint(clause):
                    self.clause([symbols[x] for x in clause], out)
        return np.log2(1.0 + np.array(out))

    def clause(self, symbols: list[tuple[int, float]], out: list[float]) -> None:
        """One run over the composed automaton; a pattern weighs as much as the word it is about."""
        state, last = 0, 1.0
        for k, weight in symbols:
            if k in (1, 2):
                last = weight
            for f, v in self.table.weights[state][k]:
                out[f] += v * last
            state = self.table.next[state][k]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ self.weights + self.bias, -40, 40)))


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, both labels weighing the same in sum."""
    n, k = x.shape
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum())) * min(n, 2000)
    a = np.hstack([x, np.ones((n, 1))])
    b = np.zeros(k + 1)
    r = np.diag([ridge] * k + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + r, a.T @ (w * (y - p)) - r @ b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b[:k], float(b[k])


def draw(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="toxic") -> DataFrame:
    """(text, y): about SAMPLE distinct texts of each label.

    Ids and hashes of texts choose the sample; only the chosen texts are moved. The list of
    ids is cut at four times SAMPLE, which bounds the broadcast.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text is not null").withColumn("h", F.xxhash64("text"))
    y = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    known = store(own.select("id", "h").join(y, "id").groupBy("h", "y").agg(F.min("id").alias("id")), "labelled")
    have = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    u = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, min(1.0, SAMPLE / have.get(1, 1))).otherwise(min(1.0, SAMPLE / have.get(0, 1)))
    pick = known.filter(u < share).orderBy("h", "y").limit(4 * SAMPLE)
    return store(own.join(F.broadcast(pick), ["id", "h"]).dropDuplicates(["h", "y"]).select("text", "y"), "sample")


def fit(docs: DataFrame, labels: DataFrame, **names) -> Grammar:
    """Grammar from documents and labels of 0 or 1."""
    rows = sample = draw(docs, labels, **names)
    drawn = {r["y"]: float(r["n"]) for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(drawn) < 2:
        return Grammar({})
    n1, n0 = drawn[1], drawn[0]
    # words by label, in tasks; then their beginnings, from the far fewer distinct words
    words = sample.select("y", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).filter("w <> ''")
    words = words.groupBy("w").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    parts = F.concat(
        F.array(F.concat("w", F.lit("$"))), F.array_compact(F.array(*(F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in STEM)))
    )
    stems = words.select(F.explode(parts).alias("s"), "bad", "good").groupBy("s").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.05) / n1) - F.log((F.col("good") + 0.5) / n0)
    # a stem must be met in several toxic documents and hardly elsewhere: in so many that of
    # CHANCES stems with no meaning less than one has all its documents among the toxic ones
    by_chance = math.log(CHANCES) / math.log((n1 + n0) / n1)
    strong = stems.filter(
        (F.col("bad") >= max(3.0, SUPPORT * n1, min(by_chance, n1 / 5))) & (F.col("good") * n1 <= F.col("bad") * n0 * RATIO)
    ).withColumn("odds", odds)
    kept = strong.filter("odds > 1").orderBy(F.desc("odds"), F.desc("bad"), "s").limit(STEMS).collect()
    grammar = Grammar({r["s"]: float(r["odds"]) for r in kept})
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        g = held.value
        for b in batches:
            f = np.array([g.features(t) for t in b.column(0).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, i]) for i in range(len(FEATURES))), b.column(1)], names=[*FEATURES, "y"])

    found = sample.mapInArrow(run, ", ".join(f"{f} double" for f in FEATURES) + ", y int")
    table = found.groupBy(*FEATURES, "y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), *FEATURES, "y").limit(4 * SAMPLE).collect()
    x = np.array([[r[f] for f in FEATURES] for r in table for _ in range(r["n"])])
    y = np.array([r["y"] for r in table for _ in range(r["n"])])
    if len(set(y.tolist())) == 2:
        grammar.weights, grammar.bias = _fit(x, y)
    return grammar


def score(docs: DataFrame, grammar: Grammar, *, text="text", threshold=0.7) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (score >= threshold)."""
    base = without(docs, "score", "predicted")
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(grammar)
    schema = base.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches):
        g = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                f = np.array([g.features(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]).reshape(-1, len(FEATURES))
                s = g.score(f)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names, "score", "predicted"]
                )

    return base.mapInArrow(run, schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of those whose crc32 of the id mod 3 is 1 are not used."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out)
    grammar = fit(docs, labels)
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), grammar).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE: dict[str, str] = {}
