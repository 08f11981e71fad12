"""Which months of an ever-growing archive may hold a link: one Bloom filter a month, kept as a table.

A filter is rows (month, word, bits) of 64 bits each, made by an aggregate and appended beside the archive;
several rows of one word count as their union, so repeated batches do no harm. A link is looked up by an
equi-join on its words. Only the links that some month may hold, and only those months of the archive, are then
read and compared, so false positives cost time and never an answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.session import stage

#: Bits of one month's filter and bits set per link; one link in a thousand is a false hit at about 5 million links a month.
BITS = 1 << 26
PROBES = 5


def exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def _month(seen: str = "seen_date"):
    return F.date_format(seen, "yyyy-MM")


def probes(links: DataFrame, bits: int = BITS, *keep: str) -> DataFrame:
    """One row per word of a link: (``keep``, word, mask, words), where ``words`` counts the link's rows."""
    places = F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(i), "link"), F.lit(bits)) for i in range(PROBES)]))
    spread = links.filter("link is not null").select(*keep, F.posexplode(places).alias("_i", "_at"), F.size(places).alias("words"))
    return spread.select(*keep, F.floor(F.col("_at") / 64).alias("word"), F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("mask"), "words")


def add(seen: DataFrame, filters: str, bits: int = BITS) -> None:
    """Add the links of ``seen`` (link, seen_date) to the filters of their months."""
    rows = probes(seen.select("link", _month().alias("month")), bits, "month").groupBy("month", "word").agg(F.bit_or("mask").alias("bits"))
    rows.write.mode("append").partitionBy("month").parquet(filters)


def maybe_held(links: DataFrame, filters: DataFrame, bits: int = BITS) -> DataFrame:
    """(link, month) wherever the month's filter has all bits of the link; every link that the month holds is among them."""
    asked = probes(links.select("link").distinct(), bits, "link")
    met = asked.join(filters, "word").filter((F.col("bits").bitwiseAND(F.col("mask"))) == F.col("mask"))
    # A bit may be in several rows of the filter; it counts once.
    once = met.groupBy("link", "month", "word", "mask").agg(F.max("words").alias("words"))
    return once.groupBy("link", "month").agg(F.count("*").alias("n"), F.max("words").alias("words")).filter("n = words").select("link", "month")


def held(links: DataFrame, archive: str, filters: str, bits: int = BITS) -> DataFrame:
    """The links of ``links`` that the archive has. An archive without filters gets them first."""
    spark = links.sparkSession
    if not exists(spark, archive):
        return links.select("link").limit(0)
    if not exists(spark, filters):
        add(spark.read.parquet(archive).select("link", "seen_date"), filters, bits)
    index = spark.read.schema("word long, bits long, month string").parquet(filters)
    hits = stage(maybe_held(links, index, bits))
    months = [r.month for r in hits.select("month").distinct().collect()]  # one name a month of the archive
    seen = spark.read.parquet(archive).filter(_month().isin(months)).select("link")
    return seen.join(hits.select("link").distinct(), "link", "left_semi").distinct()
