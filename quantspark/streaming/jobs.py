"""Incremental versions of article intake, bars, counts and narratives; ``stateful`` has alerts and marks.

Every job takes a streaming (or static) DataFrame. State is keyed and bounded
by watermarks or by one row per key, never by the length of the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.operators.articles import recent_articles
from quantspark.session import stage
from quantspark.sources.sinks import append_log, write_narratives
from quantspark.streaming import membership


def bars_from_ticks(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Last price per ticker and window, of equal times the highest. ``ticks`` is (ticker, ts, price)."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "ticker")
        .agg(F.max_by("price", F.struct("ts", "price")).alias("close"), F.count("*").alias("ticks"))
        .select("ticker", F.col("w.start").alias("ts"), "close", "ticks")
    )


def claim_counts(claims: DataFrame) -> DataFrame:
    """Running counts by source and ticker (update mode)."""
    return claims.groupBy("source", "ticker").count()


def new_articles(articles: DataFrame, late: str = "183 days") -> DataFrame:
    """Each link once. Event time is the publication, but never later than the arrival: a date in the far
    future must not move the watermark past everything that follows. Undated articles take the arrival."""
    now = F.current_timestamp()
    dated = articles.withColumn("event_time", F.least(F.coalesce(F.col("published").cast("timestamp"), now), now))
    return dated.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["link"])


def ingest_articles(articles: DataFrame, archive: str, checkpoint: str, as_of):
    """Append unseen recent articles to the archive.

    The archive never forgets a link, also beyond the watermark, so every batch asks the monthly filters
    beside it (``<archive>_filters``) and compares only with the months that may hold one of its links. The
    filters are written before the rows, so a batch that breaks off in between is found again when it is
    repeated. Runs over what has landed, then stops.
    """
    filters = f"{archive.rstrip('/')}_filters"

    def store(batch: DataFrame, _: int) -> None:
        recent = stage(recent_articles(batch, as_of).withColumn("seen_date", F.lit(as_of).cast("date")))
        fresh = stage(recent.join(membership.held(recent, archive, filters), "link", "left_anti"))
        if not fresh.isEmpty():
            membership.add(fresh, filters)
            append_log(fresh, archive, "seen_date", None)

    return new_articles(articles).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_narratives(refreshes: DataFrame, table: str, checkpoint: str):
    """Keep one narrative per bucket as refreshes arrive."""
    return (
        refreshes.writeStream.foreachBatch(lambda batch, _: write_narratives(batch, table))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
