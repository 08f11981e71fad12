"""Overnight against intraday, weekday averages and the average shape of a trading day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.operators.timeseries import daily_returns, with_previous_row


def decompose_returns(bars: DataFrame) -> DataFrame:
    """Overnight (previous close to open) and intraday (open to close) return of each bar."""
    return with_previous_row(bars).select(
        "ticker", "d",
        (F.try_divide("open", "prev_close") - 1).alias("overnight"),
        (F.try_divide("close", "open") - 1).alias("intraday"),
    )


def overnight_summary(bars: DataFrame) -> DataFrame:
    """Compounded overnight, intraday and total return over days where both legs exist."""
    paired = decompose_returns(bars).filter("overnight is not null and intraday is not null")
    return paired.groupBy("ticker").agg(
        (F.product(1 + F.col("overnight")) - 1).alias("overnight_return"),
        (F.product(1 + F.col("intraday")) - 1).alias("intraday_return"),
    ).withColumn("total_return", (1 + F.col("overnight_return")) * (1 + F.col("intraday_return")) - 1)


def weekday_effect(bars: DataFrame) -> DataFrame:
    """Mean daily return by weekday, Monday (1) to Friday (5)."""
    weekday = F.weekday("d") + 1
    return (
        daily_returns(bars)
        .filter("ret is not null")
        .groupBy("ticker", weekday.alias("weekday"))
        .agg(F.avg("ret").alias("mean_return"), F.count("*").alias("n"))
        .filter("weekday <= 5")
    )


def average_intraday_path(bars: DataFrame, zone: str | None = None) -> DataFrame:
    """Mean return since the day's first bar by time of day, over all days.

    ``ts`` is UTC; ``zone`` gives the exchange's wall clock. The first bar per
    day comes from an aggregate, so no day is collected into one window.
    """
    local = F.from_utc_timestamp("ts", zone) if zone else F.col("ts")
    rows = bars.filter("close is not null").select(
        "ticker", "close", local.alias("local"), F.to_date(local).alias("day"), F.date_format(local, "HH:mm").alias("time")
    )
    opening = rows.groupBy("ticker", "day").agg(F.min_by("close", "local").alias("_open"))
    return (
        rows.join(opening, ["ticker", "day"])
        .groupBy("ticker", "time")
        .agg(F.avg(F.try_divide(F.col("close"), F.col("_open")) - 1).alias("mean_return"), F.count("*").alias("days"))
    )
