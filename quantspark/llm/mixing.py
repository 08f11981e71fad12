"""Mixing sources to target weights by repetition rates.

Words are totalled per source, every source gets a target (its weight's share of a budget, at most ``most``
times its own words, what is left over is shared again by weight), and target / words is its repetition
rate. A document appears floor(rate) times plus one more with the probability of the fraction, drawn from a
hash of its id, so that reruns agree.

Defined cases: a null text has no words; a null source is a source of its own, last in order; a source
without words has target 0 and keeps nothing; repeated rows draw alike; a null id draws as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.rows import fresh, stage

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2.0
#: Sources in a broadcast table at most; above that the join is left to Spark (shuffled, skew split).
BROADCAST_SOURCES = 10_000
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the md5 of seed and id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**12))


def weighted(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Give the sources (source, source_size) their weights, repeating in code point order, null last.

    The rank comes from range partitions: a place inside the partition plus the rows of those before.
    """
    spark = totals.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = stage(totals.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # one row per partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    ranked = dealt.withColumn("place", place).join(F.broadcast(before), "part")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") + F.col("before"), F.lit(len(weights))) + 1).cast("int"))
    return stage(ranked.select("source", "source_size", weight.alias("weight")))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """source, source_size, target: shares of budget x all words, none above most x its own.

    Each round shares what the full sources leave among the others; a full source stays full, since the
    share per weight only rises. A round is one aggregate over the source table.
    """
    table = weighted(totals, weights)
    full = most * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        at_limit = F.col("weight") * F.lit(level) >= full
        filled, open_weight = table.agg(
            F.sum(F.when(at_limit, full).otherwise(0.0)), F.sum(F.when(at_limit, 0.0).otherwise(F.col("weight")))
        ).first()
        risen = (budget * total - filled) / open_weight if open_weight else level
        if risen <= level:
            break
        level = risen
    return table.select("source", "source_size", F.least(F.col("weight") * F.lit(level), full).alias("target"))


def copies(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with columns size, source_size, target, copies in a struct column ``mix``.

    ``options`` go to :func:`targets`.
    """
    name = fresh(docs, "mix")
    sized = docs.withColumn(name, F.struct(F.col(source).alias("source"), size.alias("size")))
    totals = sized.groupBy(F.col(f"{name}.source").alias("source")).agg(F.sum(f"{name}.size").alias("source_size"))
    shares = stage(targets(totals, **options))
    few = shares.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    shares = shares.toDF("_source", "_source_size", "_target")
    joined = sized.join(F.broadcast(shares) if few else shares, F.col(f"{name}.source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    whole = F.floor(rate)
    times = whole + (draw(F.col(key)) < rate - whole).cast("long")
    mix = F.struct(F.col(f"{name}.size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), times.alias("copies"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], mix.alias(name))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix, repeats as rows of their own. All columns stay."""
    found = copies(docs, n_words(F.col(text)), source, key, **options)
    times = F.col(f"{found.columns[-1]}.copies").cast("int")
    held = found.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.explode(F.array_repeat(F.lit(1), times)).alias("one"))
    return held.select("row.*")
