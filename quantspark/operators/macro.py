"""Macro series: tiles, history windows, headline selection and bucketed narratives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.functions.dates import bucket_key
from quantspark.operators.ordered import following, in_chunks

#: Columns of a series configuration row.
SERIES_CONFIG = (
    "key string, ord int, label string, cadence string, unit string, transform string, delta_format string, chart_days int, extra_chart_days int"
)


def yoy_rows(series: DataFrame, rows: int = 12) -> DataFrame:
    """Percent change against the value ``rows`` rows earlier; series hold one row per day."""
    before = F.lag("value", rows).over(Window.partitionBy("key").orderBy("d"))
    return series.withColumn("value", (F.try_divide("value", before) - 1) * 100).filter("value is not null")


def level_series(series: DataFrame, config: DataFrame) -> DataFrame:
    """Series as displayed: levels, or the year-over-year change where configured."""
    named = series.join(F.broadcast(config.select("key", "transform")), "key")
    level = named.filter("transform <> 'yoy_pct'").drop("transform")
    return level.unionByName(yoy_rows(named.filter("transform = 'yoy_pct'").drop("transform")))


def _delta(latest, prior, kind):
    change = F.when((kind == "pct_change") & (prior != 0), (F.try_divide(latest, prior) - 1) * 100).otherwise(latest - prior)
    return F.when(prior.isNotNull(), change)


def macro_tiles(series: DataFrame, config: DataFrame) -> DataFrame:
    """Latest value per series and its change: against a week ago, or the row before for monthly series.

    Histories are the rows newer than the configured windows; one row per
    day and series bounds every array.
    """
    rows = level_series(series, config)
    last = Window.partitionBy("key")
    tagged = (
        rows.withColumn("_last", F.max("d").over(last))
        .withColumn("_n", F.row_number().over(last.orderBy(F.col("d").desc())))
        .join(F.broadcast(config.drop("transform")), "key")
    )
    pair = F.struct("d", "value")
    newer = lambda days: F.when(F.col("d") > F.expr(f"date_sub(_last, {days})"), pair)
    latest, week, before = (
        F.max(F.when(F.col("_n") == 1, F.col("value"))),
        F.max(F.when(F.col("d") <= F.date_sub("_last", 7), pair)).getField("value"),
        F.max(F.when(F.col("_n") == 2, F.col("value"))),
    )
    keys = ["key", "ord", "label", "cadence", "unit", "delta_format"]
    out = tagged.groupBy(*keys).agg(
        F.max("_last").alias("as_of"), latest.alias("value"), week.alias("_week"), before.alias("_before"),
        F.sort_array(F.collect_list(newer("chart_days"))).alias("history"),
        F.sort_array(F.collect_list(newer("extra_chart_days"))).alias("history_extra"),
    )
    prior = F.when(F.col("cadence") == "weekly", F.col("_week")).otherwise(F.col("_before"))
    return out.withColumn("delta", _delta(F.col("value"), prior, F.col("delta_format"))).drop("_week", "_before").orderBy("ord")


def delta_over_window(tiles: DataFrame, history: str = "history_extra") -> DataFrame:
    """Latest value and the change over the whole stored window."""
    last, first = F.try_element_at(history, F.lit(-1)), F.try_element_at(history, F.lit(1))
    prior = F.when(F.size(history) > 1, first.getField("value"))
    return tiles.select(
        "key", last.getField("value").alias("window_value"), _delta(last.getField("value"), prior, F.col("delta_format")).alias("window_delta")
    )


def macro_sections(tiles: DataFrame) -> DataFrame:
    """Weekly tiles first, then the monthly ones, each in configured order."""
    section = F.when(F.col("cadence") == "weekly", 1).otherwise(2)
    return tiles.withColumn("section", section).orderBy("section", "ord")


def axis_range(history):
    """Low, middle and high of a history array."""
    values = F.transform(history, lambda p: p["value"])
    low, high = F.array_min(values), F.array_max(values)
    return F.struct(low.alias("low"), ((low + high) / 2).alias("mid"), high.alias("high"))


def diverse_headlines(headlines: DataFrame, limit: int = 25, max_per_domain: int = 2) -> DataFrame:
    """First ``limit`` headlines in relevance order with at most ``max_per_domain`` per domain.

    Both ranks are cut by their limit before the shuffle, so a hot domain
    never reaches one task whole.
    """
    by_domain = Window.partitionBy("domain").orderBy("ord")
    kept = headlines.withColumn("_d", F.row_number().over(by_domain)).filter(F.col("_d") <= max_per_domain).drop("_d")
    return kept.orderBy("ord").limit(limit)


def upsert_bucketed(narratives: DataFrame) -> DataFrame:
    """Stored narratives after replaying refreshes in ``seq`` order.

    A refresh in the same week (or month) as the latest row of its series and
    period replaces that row, so a row survives exactly if the next refresh of
    its series and period falls in another bucket.
    """
    keys = ["series_key", "period"]
    rows = narratives.withColumn("period", F.coalesce("period", F.lit("week"))).withColumn("bucket", bucket_key(F.col("date"), F.col("period")))
    after = following(in_chunks(rows, keys, ["seq"]), keys, ["seq"], "bucket", "_next")
    return after.filter(~F.col("_next").eqNullSafe(F.col("bucket"))).drop("_next", "_chunk")


def latest_narrative(narratives: DataFrame) -> DataFrame:
    from quantspark.operators.thesis import latest_per_key

    rows = narratives.withColumn("period", F.coalesce("period", F.lit("week")))
    return latest_per_key(rows, ["series_key", "period"], ["seq"])
