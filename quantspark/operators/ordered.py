"""Ordered scans over logs whose keys may be arbitrarily hot.

A plain window puts all rows of a key into one task. Here the log is range
partitioned by (key, order), so a hot key spreads over many equal chunks.
Each chunk is scanned on its own, a small table of chunk totals is combined
in order, and the totals before a chunk are added back to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.session import stage

_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)


def in_chunks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Number the range partitions of ``df`` in ``_chunk``.

    The numbering must not change between uses, so the result is staged.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, *keys, *order).withColumn("_chunk", F.spark_partition_id()))


def _inside(keys, order, descending=False):
    cols = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    return Window.partitionBy(*keys, "_chunk").orderBy(*cols)


def running(chunked: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per key in order, across chunks."""
    here = _inside(keys, order).rowsBetween(*_UPTO)
    local = chunked.select("*", *[F.sum(c).over(here).alias(f"_l_{n}") for n, c in sums.items()])
    totals = chunked.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*_BEFORE)
    offsets = totals.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    joined = local.join(offsets, [*keys, "_chunk"])
    return joined.select(*chunked.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def running_min_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Minimum of ``value`` over all earlier rows of the key, across chunks (NULL for the first)."""
    here = _inside(keys, order).rowsBetween(*_BEFORE)
    lows = df.groupBy(*keys, "_chunk").agg(F.min(value).alias("_m"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*_BEFORE)
    offsets = lows.select(*keys, "_chunk", F.min("_m").over(earlier).alias("_o"))
    local = df.select("*", F.min(value).over(here).alias("_l"))
    return local.join(offsets, [*keys, "_chunk"]).withColumn(out, F.least("_l", "_o")).drop("_l", "_o")


def affine_final(df: DataFrame, keys: list[str], order: list[str], scale: Column, add: Column, out: str) -> DataFrame:
    """Final value of ``x -> scale * x + add`` applied row by row from zero, one row per key.

    The result is the sum of every ``add`` times the scales after it. Scales
    multiply within a chunk and then between chunks.
    """
    after = _inside(keys, order, descending=True).rowsBetween(*_BEFORE)
    rows = df.select(*keys, "_chunk", *order, scale.alias("_a"), add.alias("_b"))
    weighed = rows.withColumn("_w", F.col("_b") * F.coalesce(F.product("_a").over(after), F.lit(1.0)))
    chunks = weighed.groupBy(*keys, "_chunk").agg(F.product("_a").alias("_a"), F.sum("_w").alias("_b"))
    later = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(*_BEFORE)
    final = chunks.withColumn("_w", F.col("_b") * F.coalesce(F.product("_a").over(later), F.lit(1.0)))
    return final.groupBy(*keys).agg(F.sum("_w").alias(out))


def following(chunked: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``value`` of the key's next row in order, across chunks (NULL for the last row)."""
    here = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    heads = chunked.groupBy(*keys, "_chunk").agg(F.min_by(value, F.struct(*order)).alias("_h"))
    next_head = F.lead("_h").over(Window.partitionBy(*keys).orderBy("_chunk"))
    offsets = heads.select(*keys, "_chunk", next_head.alias("_h"))
    local = chunked.select("*", F.lead(F.struct(value)).over(here).alias("_v"))
    joined = local.join(offsets, [*keys, "_chunk"])
    return joined.withColumn(out, F.when(F.col("_v").isNotNull(), F.col(f"_v.{value}")).otherwise(F.col("_h"))).drop("_v", "_h")
