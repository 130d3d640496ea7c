"""Mixing sources to target weights by Poisson replication.

A source with ``n`` characters (one more per document, so none is empty) gets the share
``n**alpha / sum(n**alpha)`` of an output of ``scale`` times the input, or its share of given
weights; its mean repetition rate is that share's size over its own.
Each document is repeated k times, k being the inverse Poisson distribution of that mean at
a uniform number hashed from seed and id. No mean is cut: one over ``MAX_RATE`` is drawn as
the sum of as many draws of an equal part, each at a number of its own. Copies are dealt out
by a hash and sorted by it: a global shuffle that any later run repeats exactly.

Defined results: a null source is a source of its own; sources without a given weight get
none; a null id draws by its text; rows with equal ids draw alike and repeated rows each for
themselves; copies of one hash (rows with equal ids) stand side by side in any order; null
texts count as empty, long ones by their length; an empty table gives an empty table; other
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

SEED = 20
MAX_RATE = 16.0  # mean of one draw; larger means are sums of draws
TERMS = 90  # of the distribution: beyond it at mean 16 lies less than 1e-30
MANY = 10_000  # sources up to which rates are broadcast (each about 1 kB)
SALTS = 32


def _unit(*parts: Column) -> Column:
    """52 bits of an MD5, as a number from 0 to 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(SEED)), *parts)), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def rates(docs: DataFrame, *, text="text", source="source", alpha=0.5, scale=1.0, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, mean, cdf, draws) of each source: a document gets the sum of ``draws`` numbers of that mean."""
    n = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)) + 1).cast("double").alias("n"))
    if weights is None:
        share = n.withColumn("w", F.pow("n", F.lit(float(alpha))))
    else:
        w = F.lit(0.0)
        for k, v in weights.items():
            w = F.when(F.col("source") == k, F.lit(float(v))).otherwise(w)
        share = n.withColumn("w", w)
    total = share.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    whole = F.coalesce(F.lit(float(scale)) * F.col("all_n") * F.col("w") / F.nullif(F.col("all_w"), F.lit(0.0)) / F.col("n"), F.lit(0.0))
    draws = F.greatest(F.lit(1), F.ceil(F.col("whole") / MAX_RATE)).cast("int")
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.array(F.exp(-F.col("mean"))).alias("c"), F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("s")),
        lambda a, k: F.struct(
            F.array_append(a.c, a.s + a.p * F.col("mean") / k).alias("c"), (a.p * F.col("mean") / k).alias("p"),
            (a.s + a.p * F.col("mean") / k).alias("s")
        ),
    ).c
    return share.join(F.broadcast(total)).withColumn("whole", whole).withColumn("draws", draws).withColumn(
        "mean", F.col("whole") / F.col("draws")
    ).withColumn("cdf", cdf).select("source", "mean", "cdf", "draws")


def replicate(docs: DataFrame, rate: DataFrame, *, doc_id="doc_id", text="text", source="source") -> DataFrame:
    """(row, copy, copies, at) of each copy, ``row`` having all columns, dealt out and sorted by ``at``."""
    rows = packed(docs, id=doc_id, text=text, source=source)
    rows = rows.withColumn(
        "key", F.coalesce(F.col("id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    ).withColumn("u", _unit("key")).drop("id", "text")
    rows, rate = rows.alias("r"), rate.alias("t")
    same = F.col("r.source").eqNullSafe(F.col("t.source"))
    if rate.limit(MANY + 1).count() <= MANY:
        joined = rows.join(F.broadcast(rate), same)
    else:  # each source's rate once for each part of its rows
        parts = rate.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("t")
        own = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).alias("r")
        joined = own.join(parts, same & (F.col("r.part") == F.col("t.salt")))
    drawn = lambda u: F.size(F.filter("cdf", lambda c: c <= u))
    more = F.aggregate(F.sequence(F.lit(1), F.col("draws") - 1), F.lit(0), lambda a, j: a + drawn(_unit(F.col("key"), j.cast("string"))))
    copies = drawn(F.col("u")) + F.when(F.col("draws") > 1, more).otherwise(0)
    many = joined.select("row", "key", copies.alias("copies")).filter("copies > 0")
    many = many.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = F.md5(F.concat_ws("|", F.lit("at"), F.lit(str(SEED)), "key", F.col("copy").cast("string")))
    dealt = many.select("row", "copy", "copies", F.conv(F.substring(at, 1, 13), 16, 10).cast("long").alias("at"))
    return dealt.repartition("at").sortWithinPartitions("at")


def mix(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", **kind) -> DataFrame:
    """``docs`` replicated and shuffled; the columns of ``docs``."""
    return replicate(docs, rates(docs, text=text, source=source, **kind), doc_id=doc_id, text=text, source=source).select("row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Copies of every document, shuffled whole, sources weighted by the square root of their size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = replicate(docs, rates(docs))
    size = F.coalesce(F.length("row.text"), F.lit(0)).alias("chars")
    return rows.select("row.doc_id", "row.source", "copy", "copies", F.col("at").alias("shuffle_key"), size)


QUERIES = {"op2_mixing": op2_mixing}
ORACLE = {
    "op2_mixing": f"""
with recursive n as (
  select source, cast(sum(coalesce(length(text), 0) + 1) as double) as n from documents group by source
), m as (
  select source, 1.0 * (select sum(n) from n) * pow(n, 0.5) / (select sum(pow(n, 0.5)) from n) / n as whole from n
), q as (
  select source, greatest(1, ceil(whole / {MAX_RATE})) as draws, whole / greatest(1, ceil(whole / {MAX_RATE})) as mean from m
), c as (
  select source, mean, 0 as k, exp(-mean) as p, exp(-mean) as s from q
  union all
  select source, mean, k + 1, p * mean / (k + 1), s + p * mean / (k + 1) from c where k < {TERMS}
), d as (
  select doc_id, documents.source, coalesce(length(text), 0) as chars, coalesce(cast(doc_id as varchar), md5(coalesce(text, ''))) as key,
         unnest(range(cast(draws as bigint))) as draw
  from documents join q on documents.source is not distinct from q.source
), u as (
  select doc_id, source, chars, key, draw,
         cast(cast('0x' || substr(md5('{SEED}|' || key || case when draw = 0 then '' else '|' || draw end), 1, 13) as bigint) as double) / 4503599627370496.0 as u
  from d
), e as (
  select u.doc_id, u.source, u.chars, u.key, cast(count(*) as int) as copies
  from u join c on u.source is not distinct from c.source and c.s <= u.u group by all
), x as (
  select doc_id, source, chars, key, copies, unnest(range(copies)) as copy from e
)
select doc_id, source, cast(copy as int) as copy, copies, cast(chars as int) as chars,
       cast('0x' || substr(md5('at|{SEED}|' || key || '|' || copy), 1, 13) as bigint) as shuffle_key
from x
"""
}
