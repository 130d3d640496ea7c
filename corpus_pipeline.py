"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontaminate, jaccard, language, mixing, shards
from parley.llm.common import crc_mod, packed, store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter go.

    The language of documents that have none is filled in; given ones stay. The model learns
    from documents whose crc32 of the id mod 4 is not 2, as the query does. All columns are
    kept, whatever their names.
    """
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs.filter(~held_out))
    found = language.identify(packed(docs), model, within="row")  # texts go to Python once
    if model.langs:
        found = found.filter("lang_pred <> 'und'")
    filled = F.coalesce("row.lang", "lang_pred").alias("lang")
    return found.select(*(filled if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh the square root of their size."""
    return mixing.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard (0 to 7) and slot, copies together and sizes even; columns of these names are replaced."""
    return shards.shard(docs, shards=8)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_weights),
    ("sharding", sharding),
]
#: SQL can express neither the language model nor label propagation; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
