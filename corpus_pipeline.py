"""The corpus pipeline: each stage applies one training-data operator to all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.llm import decontamination, langid, mixing, sharding, similar
from quantspark.llm.rows import fresh, shared_table, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Language ID: documents without a recognised language go."""
    model = langid.train(docs)
    name = fresh(docs, "language")
    found = docs.withColumn(name, langid.language(model, spark)(F.col("text")))
    return found.filter(langid.is_known(F.col(name))).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Near-dedup: of each component of texts with five-word similarity from 0.8 the document with the smallest id stays."""
    return similar.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Benchmark decontamination: documents that reach the coverage limit go."""
    name = fresh(docs, "hit")
    found = docs.withColumn(name, decontamination.hits(table(spark, folder, "benchmark"))(F.col("text")))
    return found.filter(~decontamination.contaminated(F.col(name))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Mixing: documents appear as often as their source's target asks, none more than twice."""
    return mixing.mixed(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sharding: the shard and place of every row."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Languages, fingerprints and the tree's cuts have no SQL form; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read by the next."""
    docs = table(spark, folder, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if i + 1 < len(STAGES):
            docs = shared_table(docs)
    return docs
