"""N-gram Jaccard join by grouped prefixes.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct
word shingles. All work is on distinct sets, so copies cost nothing after the first step:

1. Shingle order. Any order of shingles that all documents share gives right prefixes; rare
   first gives short candidate lists. Tasks count the shingles they meet, pass on those met
   ``LOCAL`` times or more, and the most frequent (at most ``COMMON`` of them, so the
   broadcast has a fixed bound) go last; the rest is in order of hash.
2. Groups. A set of n shingles keeps its first ``n - ceil(percent*n/100) + 1`` as prefix: linked
   sets share one of these. Sets with the same prefix and size are one group, and only groups
   enter the inverted index; shingles that one group alone has drop out there.
3. Group pairs. Groups that meet in a list make a pair if their sizes fit, and, where both have
   one member, if their parity sketches are near (the Hamming distance of two sketches never
   exceeds the size of the sets' symmetric difference, so no link is lost). In lists of up to
   ``SMALL`` members all groups pair up; in longer ones each group meets the list's leaders of
   about its size, those whose prefixes are shared most.
4. Members. Pairs are expanded: all members of both groups, or, with a leader, its first member.
   A group's own members pair up in the same way. Sketches are compared again, pairs of large
   sets, where parities tell little, are also held against counts of hash cells, and the whole
   sets of what is left are compared.
5. Links make components. Whatever a long list still holds outside its largest component is
   compared with all of it, in rounds, until every pair that shares a prefix shingle is linked,
   refuted or in one component: the components are exact.
6. :func:`jaccard_links` then compares what the long lists still hold within one component, too:
   all pairs that link are found and counted.

No step collects a list: leaders are aggregates, and joins on lists are plain ones, which Spark
splits where a list is hot.

Defined results: null and empty texts, or texts without words, have n_shingles 0 and are
linked with nothing; fewer words than a shingle has make one shingle of the whole sequence;
equal sets are linked; equal rows get equal results; a null doc_id takes part in links and
stays null, and never is a component's smallest id unless it is alone (then the component
is null). Sets and prefixes are told apart by 128 bits; a set's id is one half of them, and ids
that two sets share are made anew. Shingles are 64-bit hashes within the comparison of two sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, components, drop_stored, gram_hashes, packed, ship, store, words_of

LOCAL = 3  # times a task must meet a shingle to report it
LEAST = 6  # reports below this sum are dropped
COMMON = 1_000_000  # shingles in the broadcast at most
CHUNK = 3_000_000  # shingles that a task counts at once
SMALL = 16  # members in a list of which all pairs are taken
LEADERS = 2
LANES = 8  # 64-bit lanes of a parity sketch
MANY = 100_000  # rows that repeat up to which their list is broadcast (about 50 bytes each)
LARGE, CELLS = 1000, 2048  # sets above LARGE shingles also have counts of CELLS hash cells


def sets_of(text: str | None, cache: WordHash, n: int) -> np.ndarray:
    return np.unique(gram_hashes(words_of(text), cache, n)) if text else np.empty(0, np.uint64)


def _texts(b: pa.RecordBatch, name: str, step: int = 500) -> Iterator[tuple[pa.RecordBatch, list]]:
    for at in range(0, b.num_rows, step):
        part = b.slice(at, step)
        yield part, part.column(part.schema.get_field_index(name)).to_pylist()


def common_shingles(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """Sorted hashes of the most frequent shingles, COMMON at most."""

    def count(batches):
        cache, held, size = WordHash(), [], 0

        def flush():
            if not held:
                return None
            v, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(v[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], names=["s", "c"])

        for b in batches:
            for _, texts in _texts(b, "text"):
                for t in texts:
                    x = sets_of(t, cache, n)
                    held.append(x)
                    size += len(x)
                    if size >= CHUNK:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    ship(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text")).filter("text is not null").mapInArrow(count, "s long, c long")
    sums = store(rows.groupBy("s").agg(F.sum("c").alias("c")).filter(F.col("c") >= LEAST), "common")
    steps = sums.groupBy(F.floor(F.log2("c") * 4).alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("k")).collect()
    total, bar = 0, None
    for r in steps:
        if total + r["n"] > COMMON:
            break
        total, bar = total + r["n"], r["c"]
    found = np.empty(0, np.uint64)
    if bar is not None:
        found = np.sort(np.array(sums.filter(F.col("c") >= bar).select("s").toArrow().column(0).to_numpy()).view(np.uint64))
    drop_stored(sums)
    return found


_LANE_NAMES = [f"k{i}" for i in range(LANES)]
_DOC = f"id long, th string, n int, sid long, s2 long, p1 long, p2 long, prefix array<long>, cells binary, {', '.join(f'{k} long' for k in _LANE_NAMES)}"


def _digest(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """128 bits as two longs."""
    return np.frombuffer(xxhash.xxh3_128_digest(x.tobytes(), seed), np.int64)


def _describe(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, common, id_bits: int) -> DataFrame:
    """Per document: size, digests of set and prefix, prefix and parity sketch."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(common)
    mask = np.int64((1 << id_bits) - 1 if id_bits < 64 else -1)

    def run(batches):
        cache, last = WordHash(), held.value
        for b in batches:
            for part, texts in _texts(b, "text"):
                ns, digests, prefixes, cells, lanes = [], [], [], [], []
                for t in texts:
                    x = sets_of(t, cache, n)
                    size = len(x)
                    ns.append(size)
                    if not size:
                        digests.append((0, 0, 0, 0)), prefixes.append([]), cells.append(None), lanes.append(np.zeros(LANES, np.uint64))
                        continue
                    p = size - (percent * size + 99) // 100 + 1
                    at = np.searchsorted(last, x) if len(last) else np.zeros(size, np.int64)
                    often = last[np.minimum(at, len(last) - 1)] == x if len(last) else np.zeros(size, bool)
                    order = np.concatenate([x[~often], x[often]])[:p]
                    own = _digest(x)
                    digests.append((own[0] & mask, own[1], *_digest(order, size)))
                    prefixes.append(order.view(np.int64))
                    cells.append(
                        (
                            np.bincount((x >> np.uint64(53)).astype(np.int64), minlength=CELLS) & 255
                        ).astype(np.uint8).tobytes() if size > LARGE else None
                    )
                    odd = (np.bincount((x >> np.uint64(55)).astype(np.int64), minlength=64 * LANES) & 1).astype(np.uint8)
                    lanes.append(np.packbits(odd).view(np.uint64))
                lane, four = np.array(lanes, np.uint64).reshape(-1, LANES).view(np.int64), np.array(digests, np.int64).reshape(-1, 4)
                cols = [
                    *(part.column(part.schema.get_field_index(c)) for c in ("id", "th")), pa.array(ns, pa.int32()),
                    *(pa.array(np.ascontiguousarray(four[:, i])) for i in range(4))
                ]
                cols += [
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array(cells, pa.binary()),
                    *(pa.array(np.ascontiguousarray(lane[:, i])) for i in range(LANES))
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "th", "n", "sid", "s2", "p1", "p2", "prefix", "cells", *_LANE_NAMES])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.md5(text).alias("th"), F.col(text).alias("text")).mapInArrow(run, _DOC)


def _with_own_ids(held: DataFrame) -> DataFrame:
    """``held`` with another sid for sets that share one; there are hardly ever any."""
    twice = held.filter("n > 0").groupBy("sid").agg(
        F.min("s2").alias("lo"), F.max("s2").alias("hi")
    ).filter("lo <> hi").select("sid", F.lit(True).alias("shared"))
    twice = store(twice, "shared-ids")
    if not twice.limit(1).count():
        return held
    new = F.when(F.col("shared"), F.xxhash64("sid", "s2")).otherwise(F.col("sid"))
    return store(held.join(twice, "sid", "left").withColumn("sid", new).select(*held.columns), "described")


def _whole_sets(docs: DataFrame, doc_id: str, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """(sid, s): whole sets of the wanted (sid, s2, rep) rows; rep is a row's (id, th)."""
    ship(docs.sparkSession)

    def run(batches):
        cache = WordHash()
        for b in batches:
            for part, texts in _texts(b, "text"):
                sets = [sets_of(t, cache, n) for t in texts]
                ids, other = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("sid", "s2"))
                ok = [i for i, x in enumerate(sets) if len(x) and int(_digest(x)[1]) == other[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in ok], pa.int64()), pa.array([sets[i].view(np.int64) for i in ok], pa.list_(pa.int64()))],
                    names=["sid", "s"]
                )

    texts = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.md5(text).alias("th"), F.col(text).alias("text")
    ).filter("text is not null").alias("t")
    wanted = wanted.select("sid", "s2", "rep.id", "rep.th").alias("w")
    met = texts.join(wanted, F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.th") == F.col("w.th")))
    return met.select("sid", "s2", "text").mapInArrow(run, "sid long, s array<long>").dropDuplicates(["sid"])


def _fit(percent: int):
    """Sizes leave room for a link."""
    n, m = F.col("a.n").cast("long"), F.col("b.n").cast("long")
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _near(percent: int):
    """Sizes fit and the sketches' distance leaves room for a link."""
    apart = F.lit(0)
    for k in _LANE_NAMES:
        apart = apart + F.bit_count(F.col(f"a.{k}").bitwiseXOR(F.col(f"b.{k}")))
    # 100*i >= p*(n+m-i) with i = (n+m-d)/2 gives d*(100+p) <= (n+m)*(100-p)
    return _fit(percent) & (apart * (100 + percent) <= (F.col("a.n").cast("long") + F.col("b.n")) * (100 - percent))


def _pair(*more):
    """Columns (a, b, na, nb) of two sets that aliases a and b stand for, the smaller sid first."""
    first = F.col("a.sid") < F.col("b.sid")
    return (
        F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b"),
        F.when(first, F.col("a.n")).otherwise(F.col("b.n")).alias("na"), F.when(first, F.col("b.n")).otherwise(F.col("a.n")).alias("nb"), *more,
    )


def _sieved(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Pairs of large sets but for those whose cells' counts differ by more than a link allows."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for i in (4, 5))
            d = np.abs(x - y)
            apart = np.minimum(d, 256 - d).sum(1, dtype=np.int64)
            size = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            yield b.filter(pa.array(apart * (100 + percent) <= size * (100 - percent))).select(["a", "b", "na", "nb"])

    left = pairs.join(cells.select(F.col("sid").alias("a"), F.col("cells").alias("x")), "a")
    both = left.join(cells.select(F.col("sid").alias("b"), F.col("cells").alias("y")), "b")
    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, na int, nb int")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of the pairs whose whole sets link."""
    left = pairs.join(sets.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * inter >= percent * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def _group_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct (ga, gb, whole): groups that meet in a list; gb is a leader where ``whole`` is false."""
    alone = (F.col("a.members") == 1) & (F.col("b.members") == 1)
    fits = F.when(alone, _near(percent)).otherwise(_fit(percent))
    short = lists.filter(F.col("w") <= SMALL)
    x, y = short.alias("a"), short.alias("b")
    both = x.join(y, (F.col("a.key") == F.col("b.key")) & (F.col("a.g") < F.col("b.g")) & fits)
    pairs = both.select(F.col("a.g").alias("ga"), F.col("b.g").alias("gb"), F.lit(True).alias("whole"))
    long = lists.filter(F.col("w") > SMALL).withColumn("band", F.floor(F.log("n") / F.lit(0.25)).cast("int"))
    own = ["g", "n", "members", *_LANE_NAMES]
    lead = long.groupBy("key", F.col("band").alias("of")).agg(
        F.max(F.struct("hits", F.xxhash64("g").alias("x"), *own)).alias("l0"),
        F.max(F.struct(F.xxhash64("g", F.pmod(F.col("key"), F.lit(4))).alias("x"), *own)).alias("l1")
    )
    lead = lead.select("key", "of", F.explode(F.array(*(F.struct(*(F.col(f"{l}.{c}").alias(c) for c in own)) for l in ("l0", "l1")))).alias("l"))
    lead = lead.select("key", F.explode(F.array(F.col("of") - 1, F.col("of"), F.col("of") + 1)).alias("band"), "l.*").alias("b")
    led = long.alias("a").join(
        lead, (F.col("a.key") == F.col("b.key")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.g") != F.col("b.g")) & fits
    )
    return pairs.unionByName(led.select(F.col("a.g").alias("ga"), F.col("b.g").alias("gb"), F.lit(False).alias("whole"))).distinct()


def _expanded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): member pairs of group pairs and of groups of several, sizes and sketches fitting."""
    own = ["sid", "g", "n", *_LANE_NAMES]
    member = sets.select(*own, "members")
    left = pairs.join(member.select(*(F.col(c).alias(f"a_{c}") for c in own)), F.col("ga") == F.col("a_g"))
    both = left.join(
        member.select(*(F.col(c).alias(f"b_{c}") for c in own)), (F.col("gb") == F.col("b_g")) & (F.col("whole") | (F.col("b_sid") == F.col("gb")))
    )
    across = both.select(
        F.struct(*(F.col(f"a_{c}").alias(c) for c in own)).alias("a"), F.struct(*(F.col(f"b_{c}").alias(c) for c in own)).alias("b")
    ).filter(_near(percent)).select(*_pair())
    some = member.filter("members > 1")
    x, y = some.alias("a"), some.alias("b")
    with_all = (F.col("a.members") <= SMALL) & (F.col("a.sid") < F.col("b.sid"))
    with_first = (F.col("a.members") > SMALL) & (F.col("b.sid") == F.col("b.g")) & (F.col("a.sid") != F.col("b.sid"))
    small = x.filter(F.col("members") <= SMALL).alias("a").join(y, (F.col("a.g") == F.col("b.g")) & with_all & _near(percent)).select(*_pair())
    first = y.filter("sid = g").alias("b")
    large = x.filter(F.col("members") > SMALL).alias("a").join(first, (F.col("a.g") == F.col("b.g")) & with_first & _near(percent)).select(*_pair())
    return across.unionByName(small).unionByName(large).distinct()


def _linked(docs: DataFrame, doc_id: str, text: str, words: int, percent: int, every: bool, id_bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, n_shingles, component_id, sid, label) per row, and the (a, b) of linked sets, all of them if ``every``."""
    held = store(_describe(docs, doc_id, text, words, percent, common_shingles(docs, text, words), id_bits), "described")
    held = _with_own_ids(held)
    full = held.filter("n > 0")
    sets = full.groupBy("sid", "s2", "n", "p1", "p2", *_LANE_NAMES).agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("rep"))
    sets = store(sets, "distinct")
    # a group goes by its smallest set, so that no digest stands for it
    groups = store(sets.groupBy("p1", "p2", "n").agg(F.min("sid").alias("g"), F.count("*").alias("members")), "groups")
    sets = store(sets.join(groups, ["p1", "p2", "n"]).drop("p1", "p2"), "sets")

    # inverted index of groups; lists that one group alone is in drop out
    firsts = sets.filter("sid = g").select("sid", "s2", "g")
    prefixes = store(full.select("sid", "s2", "prefix").join(firsts, ["sid", "s2"]).groupBy("g").agg(F.first("prefix").alias("prefix")), "prefixes")
    index = prefixes.select("g", F.explode("prefix").alias("key"))
    df = store(index.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "df")
    token = store(index.join(df.select("key"), "key"), "index")
    drop_stored(prefixes, df)
    hits = token.groupBy("g").agg(F.count("*").alias("hits"))
    lists = token.join(hits, "g").join(sets.filter("sid = g").drop("sid", "s2", "rep"), "g")
    lists = store(lists, "lists")
    drop_stored(token)
    sizes = lists.groupBy("key").agg(F.sum("members").alias("w"))
    lists = store(lists.join(sizes, "key"), "sized-lists")
    cells = store(full.filter(F.col("n") > LARGE).groupBy("sid").agg(F.first("cells").alias("cells")), "cells")
    large = F.least("na", "nb") > LARGE
    tried = store(_expanded(store(_group_pairs(lists, percent), "group-pairs"), sets, percent), "pairs")

    def verify(cand: DataFrame) -> DataFrame:
        cand = store(cand.filter(~large).select("a", "b").unionByName(_sieved(cand.filter(large), cells, percent).select("a", "b")), "sieved")
        nodes = cand.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        whole = store(_whole_sets(docs, doc_id, text, words, sets.join(nodes, "sid").select("sid", "s2", "rep")), "whole")
        out = store(_verified(cand, whole, percent), "links")
        drop_stored(whole, cand)
        return out

    links = verify(tried)
    label = components(links)
    # members of long lists, and of groups that are long lists by themselves
    long = lists.filter(F.col("w") > SMALL).select("key", "g").join(sets.select("g", "sid"), "g").select(F.lit(0).alias("kind"), "key", "sid")
    own = sets.filter(F.col("members") > SMALL).select(F.lit(1).alias("kind"), F.col("g").alias("key"), "sid")
    long = store(long.unionByName(own), "long")
    drop_stored(lists)
    facts = sets.select("sid", "n", *_LANE_NAMES)
    on = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.key") == F.col("b.key"))
    while True:  # what long lists still hold outside their largest component, in full
        named = long.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        shares = named.groupBy("kind", "key", "label").agg(F.count("*").alias("c")).groupBy("kind", "key").agg(
            F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels")
        )
        apart = store(shares.filter("labels > 1").select("kind", "key", F.col("m.label").alias("main")), "apart")
        here = store(named.join(apart, ["kind", "key"]).join(facts, "sid"), "named")
        few, all_ = here.filter("label <> main").alias("a"), here.alias("b")
        once = (F.col("b.label") == F.col("b.main")) | (F.col("a.sid") < F.col("b.sid"))
        rest = few.join(all_, on & (F.col("a.label") != F.col("b.label")) & once & _near(percent)).select(*_pair()).distinct()
        more = store(rest.join(tried, ["a", "b"], "left_anti"), "rest")
        drop_stored(here, apart)
        fresh = verify(more) if more.limit(1).count() else None
        if fresh is None or not fresh.limit(1).count():
            break
        tried = store(tried.unionByName(more), "pairs")
        links = store(links.unionByName(fresh), "links")
        label = components(links)

    if every:  # pairs within one component that no leader was in
        here = long.join(facts, "sid")
        rest = here.alias("a").join(here.alias("b"), on & (F.col("a.sid") < F.col("b.sid")) & _near(percent)).select(*_pair()).distinct()
        links = store(links.unionByName(verify(store(rest.join(tried, ["a", "b"], "left_anti"), "rest"))), "links")

    of = sets.select("sid", "rep").join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = of.groupBy("label").agg(F.min("rep.id").alias("component_id"))
    by_set = of.select("sid", "label").join(least, "label").select("sid", "component_id", "label")
    none = held.filter("n = 0").select(
        "id", "th", "n", F.lit(None).cast("long").alias("sid"), F.col("id").alias("component_id"), F.lit(None).cast("long").alias("label")
    )
    out = full.select("id", "th", "n", "sid").join(by_set, "sid").select("id", "th", "n", "sid", "component_id", "label").unionByName(none)
    return out.select("id", "th", F.col("n").cast("long").alias("n_shingles"), "component_id", "sid", "label"), links


def jaccard_components(docs: DataFrame, *, doc_id="doc_id", text="text", words=5, percent=80, id_bits=64) -> DataFrame:
    """(id, th, n_shingles, component_id, sid, label) per row of ``docs``.

    th is the text's MD5; label, the component's smallest sid, tells components with equal or
    null ids apart. id_bits is for tests: fewer bits make sets share ids.

    See the module's head for the method and the cases.
    """
    return _linked(docs, doc_id, text, words, percent, False, id_bits)[0]


def jaccard_links(docs: DataFrame, *, doc_id="doc_id", text="text", words=5, percent=80) -> tuple[DataFrame, DataFrame]:
    """:func:`jaccard_components` with n_links, the other rows that a row is linked with; and all linked pairs (a, b) of distinct sets.

    Work and result grow with the pairs that share a prefix shingle, so with the square of a
    group of variants; rows with equal sets are counted, not paired.
    """
    rows, links = _linked(docs, doc_id, text, words, percent, True, 64)
    rows = store(rows, "linked")
    copies = rows.filter("sid is not null").groupBy("sid").agg(F.count("*").alias("copies"))
    ways = links.select(F.col("a").alias("sid"), F.col("b").alias("far")).unionByName(links.select(F.col("b").alias("sid"), F.col("a").alias("far")))
    far = ways.join(copies.select(F.col("sid").alias("far"), "copies"), "far").groupBy("sid").agg(F.sum("copies").alias("others"))
    counts = copies.join(far, "sid", "left").select("sid", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.join(counts, "sid", "left").select(*rows.columns, F.coalesce("n_links", F.lit(0)).alias("n_links")), links


def one_of_each(docs: DataFrame, *, doc_id="doc_id", text="text", words=5, percent=80) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id.

    Documents without words all stay. Of rows that repeat an id and text one stays, of a
    component without any id one, and of different texts of the smallest id that with the least hash.
    """
    found = store(jaccard_components(docs, doc_id=doc_id, text=text, words=words, percent=percent), "components")
    keep = found.filter("n_shingles > 0").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("k"))
    keep = keep.select("k.id", "k.th").alias("k")
    rows = packed(docs, id=doc_id, text=text).select("row", F.col("id").cast("long").alias("id"), F.md5("text").alias("th"), "text")
    met = rows.alias("r").join(keep, F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.th") == F.col("k.th"))).select("r.row", "r.id", "r.th")
    twice = found.groupBy("id", "th").agg(F.count("*").alias("c")).filter("c > 1 and th is not null").drop("c")
    again = F.col("m.id").eqNullSafe(F.col("t.id")) & (F.col("m.th") == F.col("t.th"))
    # only rows that repeat need to be told apart, and no text of the others is moved again
    once = met.alias("m").join(F.broadcast(twice).alias("t") if twice.limit(MANY + 1).count() <= MANY else twice.alias("t"), again, "left")
    once = once.select("m.row", "m.id", "m.th", F.col("t.th").isNotNull().alias("repeats"))
    bare = rows.filter(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("row")
    kept = once.filter("not repeats").select("row").unionByName(once.filter("repeats").dropDuplicates(["id", "th"]).select("row"))
    return kept.unionByName(bare).select("row.*")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their four-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, words=4, percent=85).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLE = {
    "op9_jaccard_join": r"""
with recursive w as (
  select row_number() over () as r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents
), g as (
  select r, doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) end as s
  from w
), e as (select r, len(s) as n, unnest(s) as t from g),
hits as (
  select a.r as a, b.r as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
  from e a join e b on a.t = b.t and a.r < b.r group by 1, 2
), links as (
  select a, b from hits where 100 * c >= 85 * (na + nb - c)
), both_ways as (select a, b from links union select b, a from links),
reach as (
  select r as a, r as b from g
  union
  select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a
)
select g.doc_id, cast(len(g.s) as bigint) as n_shingles, min(o.doc_id) as component_id
from reach join g on g.r = reach.a join g o on o.r = reach.b
group by g.r, g.doc_id, len(g.s)
""",
}
