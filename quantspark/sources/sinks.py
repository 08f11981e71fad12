"""Writers: append-only logs, keyed upserts and stored aggregates, all as partitioned parquet.

Upserts rewrite only the partitions they touch. The merged rows are staged
first, so a failed write never reads what it is replacing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.operators.macro import upsert_bucketed
from quantspark.operators.panel import upsert_panel
from quantspark.operators.portfolio import pop_last_trade
from quantspark.session import stage


#: Folders of a log whose key has any number of values.
BUCKETS = 64
_BUCKET = "_bucket"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def append_log(df: DataFrame, path: str, key: str = "ticker", buckets: int | None = BUCKETS) -> None:
    """Add rows to a log; existing rows are never touched and no rows is no work.

    Rows lie in ``buckets`` folders by hash of the key, read by :func:`read_log`; a write makes few files a folder
    and splits a hot one. ``buckets=None`` makes a folder per value, for keys with few values.
    """
    if df.isEmpty():
        return
    if buckets is None:
        return df.write.mode("append").partitionBy(key).parquet(path)
    dealt = df.withColumn(_BUCKET, _bucket(F.col(key), buckets)).hint("rebalance", _BUCKET)
    dealt.write.mode("append").partitionBy(_BUCKET).parquet(path)


def read_log(spark: SparkSession, path: str, key: str = "ticker", value: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A log written in buckets; of one key if ``value`` is given, from that key's folder alone."""
    rows = spark.read.parquet(path)
    if value is not None:
        rows = rows.filter((F.col(_BUCKET) == _bucket(F.lit(value), buckets)) & (F.col(key) == value))
    return rows.drop(_BUCKET)


def overwrite_partitions(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def write_panel(new: DataFrame, path: str) -> None:
    """Insert or replace panel rows per (date, ticker); only touched dates are rewritten."""
    spark = new.sparkSession
    if not _exists(spark, path):
        return overwrite_partitions(new, path, "date")
    fresh = stage(new)
    touched = spark.read.parquet(path).join(F.broadcast(fresh.select("date").distinct()), "date", "left_semi")
    overwrite_partitions(stage(upsert_panel(touched, fresh)), path, "date")


def write_narratives(new: DataFrame, path: str) -> None:
    """Store refreshed narratives: one row per week or month bucket and series."""
    spark = new.sparkSession
    fresh = stage(new)
    rows = fresh
    if _exists(spark, path):
        old = spark.read.parquet(path).drop("bucket")
        touched = old.join(F.broadcast(fresh.select("series_key").distinct()), "series_key", "left_semi")
        rows = touched.unionByName(fresh, allowMissingColumns=True)
    overwrite_partitions(stage(upsert_bucketed(rows)), path, "series_key")


def write_aggregates(cusips: DataFrame, holders: DataFrame, path: str) -> None:
    """Store both holdings aggregates by bucket, so later reads prune by bucket end."""
    overwrite_partitions(cusips, f"{path}/cusip_agg", "bucket_end")
    overwrite_partitions(holders, f"{path}/holder_agg", "bucket_end")


def undo_last_trade(spark: SparkSession, path: str, portfolio: str) -> None:
    """Drop the last trade of one portfolio, rewriting only its partition."""
    log = spark.read.parquet(path).filter(F.col("portfolio") == portfolio)
    left = stage(pop_last_trade(log, portfolio))
    if not left.isEmpty():
        return overwrite_partitions(left, path, "portfolio")
    location = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/portfolio={portfolio}")
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
