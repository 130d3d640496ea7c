"""Cost-balanced packing of documents into token sequences.

A document's tokens are its text's ids and one end id. What fills whole sequences is cut off
from the front of a long document, each such piece a sequence by itself. The rest, shorter
than a sequence, is dealt by a hash into groups of about GROUP sequences, whose number grows
with the input. In a group the pieces are taken by descending cost, where n tokens cost
``linear * n + quadratic * n * n``, and each goes to the lowest-cost sequence that has room
for it. A piece for which no room is left as a whole is cut: the sequence with most room gets
its front, and its rest queues up again. Room and tokens of a group are equal: all sequences
are full but the last ones, whose sizes are the powers of two that make up the remainder, so
that no token of padding is needed.

Only the rests travel, as ids of two bytes (four, where the vocabulary needs it). Texts are
tokenised once: the pieces are stored in the shared folder before they are dealt out.

Tokenising uses the file's own steps. For a byte-level file, text is cut before each single
space that a word follows, which no token crosses; what stands between is looked up among
those met before (a bounded table in each worker), and new ones go through the file's
pre-tokeniser and model. Other files, texts with other white space at a cut and texts with
a special token go through the tokeniser as a whole.

Defined results: a null text counts as empty, and an empty one is its end id alone; equal
costs are taken in order of arrival, equal sequences by number; repeated rows and repeated or
null ids are documents of their own; very long texts give as many pieces as they need; an
empty table gives an empty table; the result has the id and its own columns, other columns
of the input don't matter, whatever their names.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import ship, store

CAPACITY = 2048  # tokens of a sequence
END = 1  # id that ends a document
LINEAR = 1.0  # cost of a token
QUADRATIC = 1.0 / (6 * 768)  # cost of a pair of tokens: attention against the rest of a layer of width 768
GROUP = 128  # sequences packed together
KNOWN = 600_000  # parts of text remembered in a worker


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """text -> ids as little-endian unsigned numbers of ``width`` bytes."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(file)
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        pre = self.whole.pre_tokenizer
        self.by_parts = (
            isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space and self.whole.normalizer is None
            and self.whole.truncation is None and self.whole.padding is None and not any(" " in s for s in self.special)
        )
        self.parts, self.marks = _Parts(self), {}

    def word(self, word: str) -> bytes:
        """Ids of one word of the pre-tokeniser."""
        ids = [t.id for t in self.whole.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def split(self, text: str) -> bytes:
        """Ids of a stretch of text that is cut where no token crosses."""
        return b"".join([self.word(word) for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)])

    def mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self.split(mark)
        return self.marks[mark]

    def all_of(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of ``text``, as the tokeniser gives them without its special tokens."""
        if not text:
            return b""
        if not self.by_parts or any(s in text for s in self.special):
            return self.all_of(text)
        first, *rest = text.split(" ")
        # an empty part or one that starts with white space: the space before it may join more of it
        if not all(rest) or _starts_blank(rest):
            return self.all_of(text)
        return (self.split(first) if first else b"") + b"".join(map(self.parts.__getitem__, rest))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else 256 and on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
    return [others.get(b, chr(b)) for b in range(256)]


_BYTES = _byte_letters()


def _letters(text: str) -> str:
    """Letters of a space and a word."""
    return _BYTES[32] + (text[1:] if text.isascii() else "".join([_BYTES[b] for b in text[1:].encode()]))


def _starts_blank(parts: list[str]) -> bool:
    return any(map(str.isspace, {p[0] for p in parts}))


class _Parts(dict):
    """What follows a space -> its ids with the space.

    The pre-tokeniser needn't be asked where letters and at most one mark are all there is.
    """

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, part: str) -> bytes:
        if part.isalpha():
            got = self.encoder.word(_letters(" " + part))
        elif part[-1] in ".,;:!?" and part[:-1].isalpha():
            got = self[part[:-1]] + self.encoder.mark(part[-1])
        else:
            got = self.encoder.split(" " + part)
        if len(self) >= KNOWN:
            self.clear()
        self[part] = got
        return got


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """The worker's encoder of a file; its table lasts from task to task."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def fill(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) for pieces no longer than a sequence; all room is used.

    The sequences are as many full ones as the total makes, and powers of two for the rest
    (for a capacity that is no power of two too).
    """
    total = sum(lengths)
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range((total % capacity).bit_length())) if total % capacity >> b & 1]
    room = np.array(sizes, np.int64)
    # a short sequence starts with the linear cost of what it lacks, so that it doesn't draw all first pieces
    cost = linear * (capacity - room).astype(np.float64)
    queue = [(-n, k, 0) for k, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    out = []
    while queue:
        n, k, start = heapq.heappop(queue)
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        s = int(fits.argmin())
        if room[s] < n:  # in none as a whole
            s = int(room.argmax())
        take = min(n, int(room[s]))
        out.append((k, start, take, s, sizes[s] - int(room[s])))
        room[s] -= take
        cost[s] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(queue, (take - n, k, start + take))
    return out


PIECE = "part long, no long, start long, length long, doc_tokens long, ids binary"
PLACED = "start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


def _cut(docs: DataFrame, file: str, capacity: int, end: int) -> DataFrame:
    """(doc_id, part, no, start, length, doc_tokens, ids) of each document's whole sequences and rest.

    ``part`` and ``no`` tell pieces apart: task and running number. The result is to be stored.
    """
    ship(docs.sparkSession)
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(PIECE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, no = encoder(file), TaskContext.get().partitionId(), 0
        w = enc.width
        last, step = end.to_bytes(w, "little"), capacity * w
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
            for a, z in _slices(size):
                rows, start, length, tokens, ids = [], [], [], [], []
                for k, text in enumerate(b.column("text").slice(a, z - a).to_pylist()):
                    whole = enc.encode(text or "") + last
                    for at in range(0, len(whole), step):
                        piece = whole[at : at + step]
                        rows.append(a + k)
                        start.append(at // w)
                        length.append(len(piece) // w)
                        tokens.append(len(whole) // w)
                        ids.append(piece)
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(rows)), pa.array(np.full(n, part, np.int64)), pa.array(np.arange(no, no + n)),
                        *(pa.array(x, pa.int64()) for x in (start, length, tokens)), pa.array(ids, pa.binary()),
                    ],
                    names=schema.names,
                )
                no += n

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _slices(size: np.ndarray, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Borders of slices of about ``most`` bytes, 1000 rows at most and one at least."""
    a = held = 0
    for k, n in enumerate(size.tolist(), 1):
        held += n
        if held >= most or k - a >= 1000 or k == len(size):
            yield a, k
            a, held = k, 0


def pack(
    docs: DataFrame, *, doc_id="doc_id", text="text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END,
    linear: float = LINEAR, quadratic: float = QUADRATIC, group: int = GROUP,
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset) of each piece.

    ``ids`` are little-endian unsigned numbers of two bytes (four for vocabularies of over
    65,536); ``start`` counts the document's ids before the piece, ``offset`` those before it
    in its sequence.
    """
    file = tokenizer or default_tokenizer()
    pieces = store(_cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), file, capacity, end), "pieces")
    rests = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-(rests.agg(F.sum("length").alias("n")).first()["n"] or 0) // (capacity * group)))
    schema = StructType([pieces.schema["doc_id"], *StructType.fromDDL(PLACED)])
    # whole sequences have even numbers, those of groups odd ones
    whole = pieces.filter(F.col("length") == capacity).select(
        "doc_id", "start", "length", "doc_tokens", "ids", ((F.col("part") * (1 << 32) + F.col("no")) * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )

    def together(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("no", "ascending")]).combine_chunks()
        ids, length = rows.column("ids").to_pylist(), rows.column("length").to_pylist()
        placed = fill(length, capacity, linear, quadratic)
        piece, start, n, seq, offset = (list(x) for x in zip(*placed))
        of = rows.select(["doc_id", "start", "doc_tokens"]).take(pa.array(piece))
        width = [len(ids[k]) // length[k] for k in piece]
        columns = [
            of.column("doc_id"), pc.add(of.column("start"), pa.array(start, pa.int64())), pa.array(n, pa.int64()), of.column("doc_tokens"),
            pa.array([ids[k][s * w : (s + m) * w] for k, s, m, w in zip(piece, start, n, width)], pa.binary()),
            pa.array([((key[0].as_py() << 24) + s) * 2 + 1 for s in seq], pa.int64()), pa.array(offset, pa.int64()),
        ]
        return pa.table(columns, names=schema.names)

    dealt = rests.withColumn("group", F.pmod(F.xxhash64("part", "no"), F.lit(groups)))
    return whole.unionByName(dealt.groupBy("group").applyInArrow(together, schema))


def wide_ids(pieces: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ids_crc32 of the pieces' ids as unsigned numbers of 32 bits."""
    schema = StructType([*pieces.select(*keep).schema.fields, StructField("ids_crc32", LongType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = []
            for ids, n in zip(b.column("ids").to_pylist(), b.column("length").to_pylist()):
                crc.append(zlib.crc32(np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(crc, pa.int64())], names=schema.names)

    return pieces.mapInArrow(run, schema)


def op11_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens: each piece with its place and a digest of its ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return wide_ids(pack(docs), ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"])


QUERIES = {"op11_packing": op11_packing}
ORACLE: dict[str, str] = {}
