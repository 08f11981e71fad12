"""Returns, slices and technical indicators over long daily bars.

``bars`` is ``(ticker, d, open, close, volume)`` with one row per ticker and
day, so every window partitioned by ticker is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.operators.asof import benchmark_lookup, with_benchmark_return
from quantspark.session import stage

def _by_day():
    return Window.partitionBy("ticker").orderBy("d")


def _days_back(n: int):
    """Calendar-day frame ``[d - n, d]``."""
    return Window.partitionBy("ticker").orderBy(F.unix_date("d")).rangeBetween(-n, 0)


def slice_dates(df: DataFrame, start=None, end=None, on: str = "d") -> DataFrame:
    if start is not None:
        df = df.filter(F.col(on) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(on) <= F.lit(end).cast("date"))
    return df


def missing_tickers(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """Requested tickers that have no priced bar."""
    present = bars.filter("close is not null").select("ticker")
    return requested.select("ticker").distinct().join(present, "ticker", "left_anti")


def drop_empty_tickers(requested: DataFrame, bars: DataFrame) -> DataFrame:
    return requested.select("ticker").distinct().join(bars.filter("close is not null").select("ticker"), "ticker", "left_semi")


def pick_union(picked: DataFrame, typed: str, benchmark: str) -> DataFrame:
    """Picked tickers, the typed comma list and the benchmark: upper, trimmed, distinct."""
    spark = picked.sparkSession
    extra = (
        spark.range(1)
        .select(F.explode(F.split(F.lit(f"{typed},{benchmark}"), ",")).alias("ticker"))
    )
    both = picked.select("ticker").unionByName(extra)
    return both.select(F.upper(F.trim("ticker")).alias("ticker")).filter("ticker <> ''").distinct()


def panel_intersect(picks: DataFrame, panel: DataFrame) -> DataFrame:
    """Picked tickers that occur in the panel."""
    return picks.select("ticker").distinct().join(panel.select("ticker"), "ticker", "left_semi")


def calendar(bars: DataFrame) -> DataFrame:
    """The shared calendar of a price frame: each day with the row before it."""
    days = bars.filter("close is not null").select("d").distinct()
    return days.withColumn("prev_d", F.lag("d").over(Window.orderBy("d")))


def with_previous_row(bars: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Add ``prev_close``: the close on the previous *calendar row*.

    The ticker's own previous quote counts only if it lies on the row before
    this one in the calendar shared by all tickers; otherwise it is NULL.
    """
    priced = bars.filter("close is not null")
    days = calendar(priced) if days is None else days
    own = priced.withColumn("_pd", F.lag("d").over(_by_day())).withColumn("_pc", F.lag("close").over(_by_day()))
    return (
        own.join(F.broadcast(days), "d")
        .withColumn("prev_close", F.when(F.col("_pd") == F.col("prev_d"), F.col("_pc")))
        .drop("_pd", "_pc", "prev_d")
    )


def daily_returns(bars: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Close-to-close return against the previous calendar row, never filled forward."""
    return with_previous_row(bars, days).withColumn("ret", F.try_divide("close", "prev_close") - 1)


def cumulative_return(bars: DataFrame) -> DataFrame:
    """Close over the ticker's first close, minus one."""
    priced = bars.filter("close is not null")
    return priced.withColumn("cum", F.try_divide(F.col("close"), F.first("close").over(_by_day())) - 1)


def range_return(bars: DataFrame, start=None, end=None) -> DataFrame:
    return (
        slice_dates(bars.filter("close is not null"), start, end)
        .groupBy("ticker")
        .agg(
            F.min("d").alias("first_d"),
            F.max("d").alias("last_d"),
            (F.try_divide(F.max_by("close", "d"), F.min_by("close", "d")) - 1).alias("total_return"),
        )
    )


def compare_vs_benchmark(bars: DataFrame, benchmark: str, start=None, end=None) -> DataFrame:
    """Total return per ticker and its gap to the benchmark, best first."""
    totals = range_return(bars, start, end).select("ticker", "total_return")
    base = totals.filter(F.col("ticker") == benchmark).select("total_return").scalar()
    return (
        totals.filter(F.col("ticker") != benchmark)
        .withColumn("vs_benchmark", F.col("total_return") - base)
        .orderBy(F.col("total_return").desc_nulls_last(), "ticker")
    )


def momentum(bars: DataFrame, benchmark: DataFrame, days_back: int, suffix: str = "") -> DataFrame:
    """Trailing return ending at each bar and the same minus the benchmark, in percent.

    The window is ``[d - days_back, d]`` and needs two rows on each side.
    """
    frame = _days_back(days_back)
    priced = bars.filter("close is not null")
    spans = (
        priced.withColumn("_fd", F.first("d").over(frame))
        .withColumn("_fc", F.first("close").over(frame))
        .withColumn("_ret", F.when(F.col("_fd") < F.col("d"), F.try_divide("close", "_fc") - 1))
        .withColumnRenamed("_fd", "_start")
    )
    lookup = stage(benchmark_lookup(priced.select("d"), benchmark))
    return (
        with_benchmark_return(spans, lookup, "_start", "d", "_bench", min_rows=2)
        .withColumn(f"momentum{suffix}", F.col("_ret") * 100)
        .withColumn(f"relative_strength{suffix}", (F.col("_ret") - F.col("_bench")) * 100)
        .drop("_start", "_fc", "_ret", "_bench")
    )


def price_vs_ma(bars: DataFrame, n: int = 50) -> DataFrame:
    """Close against the mean of the last ``n`` rows, in percent; NULL with fewer rows."""
    frame = _by_day().rowsBetween(1 - n, 0)
    ready = F.count("close").over(frame) == n
    return bars.filter("close is not null").withColumn(
        "price_vs_ma", F.when(ready, (F.try_divide(F.col("close"), F.avg("close").over(frame)) - 1) * 100)
    )


def relative_volume(bars: DataFrame, short: int = 10, long: int = 60) -> DataFrame:
    """Short average volume over long average volume, in percent; needs ``long`` rows."""
    # Bars without volume form their own partition, so row frames count traded bars only.
    traded = Window.partitionBy("ticker", F.col("volume").isNotNull()).orderBy("d")
    recent, base = traded.rowsBetween(1 - short, 0), traded.rowsBetween(1 - long, 0)
    ready = F.count("volume").over(base) == long
    ratio = F.try_divide(F.avg("volume").over(recent), F.nullif(F.avg("volume").over(base), F.lit(0.0)))
    return bars.withColumn("relative_volume", F.when(ready, (ratio - 1) * 100))


def technicals(bars: DataFrame, benchmark: DataFrame, momentum_weeks: int = 12, ma: int = 50) -> DataFrame:
    """Momentum, relative strength, price against average and relative volume at every bar."""
    return momentum(relative_volume(price_vs_ma(bars, ma)), benchmark, momentum_weeks * 7)


def latest_technicals(bars: DataFrame, benchmark: DataFrame, momentum_weeks: int = 12, ma: int = 50) -> DataFrame:
    """One row per ticker at its own last bar: 7-day, 2-week and long momentum, average, volume."""
    frame = _days_back(7)
    rows = technicals(bars, benchmark, momentum_weeks, ma)
    rows = momentum(rows, benchmark, 14, "_2w")
    rows = rows.withColumn(
        "return_7d",
        F.when(F.first("d").over(frame) < F.col("d"), (F.try_divide(F.col("close"), F.first("close").over(frame)) - 1) * 100),
    )
    keep = ["close", "return_7d", "momentum_2w", "relative_strength_2w", "momentum", "relative_strength", "price_vs_ma", "relative_volume"]
    return (
        rows.groupBy("ticker")
        .agg(F.max("d").alias("d"), F.max_by(F.struct(*keep), "d").alias("_r"))
        .select("ticker", "d", *[F.col(f"_r.{c}").alias(c) for c in keep])
    )


def volume_spikes(bars: DataFrame, since, mult: float = 2.0, window: int = 60) -> DataFrame:
    """Days on or after ``since`` whose volume is ``mult`` times the mean of the previous rows."""
    before = _by_day().rowsBetween(-window, -1)
    return (
        bars.filter("volume is not null")
        .withColumn("_n", F.count("volume").over(before))
        .withColumn("avg_before", F.avg("volume").over(before))
        .filter((F.col("_n") == window) & (F.col("avg_before") != 0) & (F.col("volume") >= mult * F.col("avg_before")))
        .filter(F.col("d") >= F.lit(since).cast("date"))
        .select("ticker", "d", "volume", ((F.col("volume") / F.col("avg_before") - 1) * 100).alias("vs_avg_pct"))
    )


def recent_dips(bars: DataFrame, since, drop: float = 0.05) -> DataFrame:
    return (
        daily_returns(bars)
        .filter((F.col("ret") <= -drop) & (F.col("d") >= F.lit(since).cast("date")))
        .select("ticker", "d", (F.col("ret") * 100).alias("drop_pct"))
        .orderBy(F.col("d").desc(), "drop_pct")
    )


def signal_bundle(bars: DataFrame, earnings: DataFrame, as_of) -> DataFrame:
    """Deterministic signals per ticker at ``as_of`` from its own last 40 days of closes."""
    today = F.lit(as_of).cast("date")
    recent = bars.filter("close is not null").filter((F.col("d") <= today) & (F.col("d") >= F.date_sub(today, 40)))
    ranked = recent.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("d").desc())))

    def step(k):
        return F.max(F.when(F.col("_n") == k, F.col("close")))

    one, five, month = F.col("_c1") / F.col("_c2") - 1, F.col("_c1") / F.col("_c6") - 1, F.col("_c1") / F.col("_c21") - 1
    prices = ranked.groupBy("ticker").agg(*[step(k).alias(f"_c{k}") for k in (1, 2, 6, 21)]).select(
        "ticker",
        (F.round(five, 4) * 100).alias("trailing_return_5d_pct"),
        (F.round(month, 4) * 100).alias("trailing_return_1m_pct"),
        F.when(one <= -0.03, F.round(one * 100, 2)).alias("dip_today_pct"),
    )
    last = (
        earnings.filter("reported_eps is not null and surprise_pct is not null")
        .groupBy("ticker")
        .agg(F.max("earnings_date").alias("_e"), F.max_by("surprise_pct", "earnings_date").alias("_s"))
        .withColumn("_age", F.datediff(today, "_e"))
        .filter(F.col("_age").between(0, 10))
        .select("ticker", F.round("_s", 2).alias("recent_earnings_surprise_pct"), F.col("_age").alias("days_since_earnings"))
    )
    return prices.join(last, "ticker", "full_outer")


def latest_price(bars: DataFrame, as_of, max_age_days: int = 7) -> DataFrame:
    """Last close on or before ``as_of`` per ticker, at most ``max_age_days`` old."""
    today = F.lit(as_of).cast("date")
    return (
        bars.filter("close is not null")
        .filter((F.col("d") <= today) & (F.col("d") >= F.date_sub(today, max_age_days)))
        .groupBy("ticker")
        .agg(F.max_by("close", "d").alias("price"), F.max("d").alias("price_d"))
    )


def indicator_history(panel: DataFrame, metric: str, since) -> DataFrame:
    return panel.filter((F.col("d") >= F.lit(since).cast("date")) & F.col(metric).isNotNull()).select("ticker", "d", F.col(metric).alias("value"))
