"""Rebalancing studies: schedules, eligibility, weights, equity curves and their statistics.

Every step is set-wise. Schedules and calendars have one row per day, so the
unpartitioned windows and broadcasts over them are bounded by the calendar.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.functions.sampling import permuted, round_keys
from quantspark.operators.asof import asof
from quantspark.operators.timeseries import calendar, daily_returns
from quantspark.session import stage

#: A strategy turns rebalance dates and bars into ``(date, ticker, w)`` rows.
WeightFunction = Callable[[DataFrame, DataFrame], DataFrame]

TRADING_DAYS_PER_YEAR = 252  # fixed value

_PERIODS = {"ME": ("month", 1), "QE": ("quarter", 3), "YE": ("year", 12)}


def rebalance_dates(days: DataFrame, freq: str | int = "ME", anchor=None) -> DataFrame:
    """First trading day on/after each target date; duplicates collapse.

    A string names calendar period ends; an integer steps that many calendar
    days from ``anchor`` (default: the first day).
    """
    span = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    if isinstance(freq, int):
        start = F.lit(anchor).cast("date") if anchor is not None else F.col("lo")
        targets = span.filter(start <= F.col("hi")).select(
            F.explode(F.sequence(start, F.col("hi"), F.make_interval(days=F.lit(freq)))).alias("target")
        )
    else:
        unit, months = _PERIODS[freq]
        starts = F.sequence(F.trunc("lo", unit), F.trunc("hi", unit), F.make_interval(months=F.lit(months)))
        targets = span.select(F.explode(starts).alias("s")).select(F.last_day(F.add_months("s", months - 1)).alias("target"))
    one = F.lit(1).alias("_k")
    found = asof(targets.select("target", one), days.select("d", one), ["_k"], "target", "d", {"d": "date"}, "forward")
    return found.filter("date is not null").select("date").distinct()


def eligible(bars: DataFrame, dates: DataFrame, lookback_days: int) -> DataFrame:
    """Tickers quoted on every calendar row of the trailing window, with their trailing return.

    The calendar itself must reach back to the start of the window.
    """
    priced = bars.filter("close is not null")
    days = calendar(priced).select("d")
    by_day = Window.orderBy(F.unix_date("d"))
    full = (
        days.withColumn("_rows", F.count("*").over(by_day.rangeBetween(-lookback_days, 0)))
        .withColumn("_first", F.min("d").over(by_day.rangeBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("_first") <= F.date_sub("d", lookback_days))
        .join(dates.select(F.col("date").alias("d")), "d", "left_semi")
    )
    frame = Window.partitionBy("ticker").orderBy(F.unix_date("d")).rangeBetween(-lookback_days, 0)
    own = priced.withColumn("_n", F.count("close").over(frame)).withColumn("_start", F.first("close").over(frame))
    return (
        own.join(F.broadcast(full), "d")
        .filter("_n = _rows")
        .select(F.col("d").alias("date"), "ticker", (F.try_divide("close", "_start") - 1).alias("trailing_return"))
    )


def top_n(pool: DataFrame, n: int, direction: str = "best") -> DataFrame:
    """The ``n`` best (or worst) tickers per date by trailing return; ties by ticker."""
    order = F.col("trailing_return").asc() if direction == "worst" else F.col("trailing_return").desc()
    rank = F.row_number().over(Window.partitionBy("date").orderBy(order, "ticker"))
    return pool.withColumn("rank", rank).filter(F.col("rank") <= n)


def equal_weight(picks: DataFrame, *by: str) -> DataFrame:
    """One over the number of picks per date (and per any further key)."""
    n = F.count("*").over(Window.partitionBy("date", *by))
    return picks.withColumn("w", 1 / n).select(*by, "date", "ticker", "w")


def picks_by_rebalance(bars: DataFrame, dates: DataFrame, lookback_days: int, n: int, direction: str = "best") -> DataFrame:
    return top_n(eligible(bars, dates, lookback_days), n, direction).select("date", "rank", "ticker", "trailing_return")


def top_n_strategy(lookback_days: int, n: int, direction: str = "best") -> WeightFunction:
    return lambda dates, bars: equal_weight(top_n(eligible(bars, dates, lookback_days), n, direction))


def equal_weight_strategy(lookback_days: int) -> WeightFunction:
    return lambda dates, bars: equal_weight(eligible(bars, dates, lookback_days))


def custom_strategy(weigh: Callable[[dt.date, pd.DataFrame], dict[str, float]], lookback_days: int) -> WeightFunction:
    """A strategy written as a plain function of (date, history) that returns weights by ticker.

    ``history`` has a row per day of the ``lookback_days`` up to the date and a column of closes per ticker. Every
    rebalance date is a task of its own, which holds only that slice; tickers without a weight are not held.
    """

    def one(key: tuple, slice_: pd.DataFrame) -> pd.DataFrame:
        history = slice_.pivot(index="d", columns="ticker", values="close").sort_index()
        found = [(key[0], str(t), float(w)) for t, w in weigh(key[0], history).items() if w == w]
        return pd.DataFrame(found, columns=["date", "ticker", "w"]).astype({"w": "float64"})

    def weights(dates: DataFrame, bars: DataFrame) -> DataFrame:
        # A row per rebalance date and day of its window, bounded by the schedule.
        spans = dates.select("date", F.explode(F.sequence(F.date_sub("date", lookback_days), "date")).alias("d"))
        slices = bars.filter("close is not null").select("ticker", "d", "close").join(F.broadcast(spans), "d")
        return slices.groupBy("date").applyInPandas(one, "date date, ticker string, w double")

    return weights


def random_picks(pool: DataFrame, n: int, trials: int) -> DataFrame:
    """``trials`` independent draws of ``n`` tickers per date without replacement (all of them if there are fewer).

    The tickers of a date are numbered once. A keyed permutation of the numbers, one per (trial, date), names the
    drawn ones, so the plan holds trials x n rows per date and never trials x pool.
    """
    numbered = stage(pool.select("date", "ticker", F.row_number().over(Window.partitionBy("date").orderBy("ticker")).alias("_place")))
    sizes = numbered.groupBy("date").agg(F.max("_place").alias("_m"))
    drawn = sizes.select("date", "_m", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    keyed = drawn.withColumn("_keys", round_keys(F.concat_ws("|", F.col("trial").cast("string"), F.col("date").cast("string"))))
    turns = F.transform(permuted(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_m")) - 1), F.col("_m"), F.col("_keys")), lambda x: x + 1)
    return keyed.select("date", "trial", F.explode(turns).alias("_place")).join(numbered, ["date", "_place"]).select("date", "ticker", "trial")


def _schedule(days: DataFrame, dates: DataFrame, start) -> DataFrame:
    """Each day of the curve with the rebalance in force and flags for cost and day zero."""
    merged = days.select("d").join(dates.select(F.col("date").alias("d"), F.col("date").alias("_reb")), "d", "left")
    in_order = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = merged.withColumn("date", F.last("_reb", ignorenulls=True).over(in_order))
    if start is not None:
        held = held.filter(F.col("d") >= F.lit(start).cast("date"))
    first = F.col("d") == F.min("d").over(Window.partitionBy())
    return held.select("d", "date", first.alias("_first"), (F.col("_reb").isNotNull() & ~first).alias("_charged"))


def equity_curves(bars: DataFrame, weights: DataFrame, dates: DataFrame, start=None, cost_bps: float = 0.0) -> DataFrame:
    """``(label, d, equity)`` for weights ``(label, date, ticker, w)``.

    Weights chosen on a rebalance day use that day's close, earn that day's
    return and hold until the next one. Missing returns count as zero; the
    first day is exactly one and bears no cost.
    """
    returns = daily_returns(bars).filter("ret is not null").select("ticker", "d", "ret")
    plan = _schedule(calendar(bars).select("d"), dates, start)
    held = weights.join(F.broadcast(plan.select("d", "date")), "date")
    earned = held.join(returns, ["ticker", "d"]).groupBy("label", "d").agg(F.sum(F.col("w") * F.col("ret")).alias("_r"))
    labels = weights.select("label").distinct()
    # Days are bounded by the calendar; labels are the curves asked for.
    grid = labels.select("label", F.inline(plan.agg(F.collect_list(F.struct("d", "_first", "_charged"))).scalar()))
    day = (
        grid.join(earned, ["label", "d"], "left")
        .withColumn("_r", F.coalesce("_r", F.lit(0.0)) - F.when(F.col("_charged"), F.lit(cost_bps / 10_000)).otherwise(0.0))
        .withColumn("_r", F.when(F.col("_first"), 0.0).otherwise(F.col("_r")))
    )
    growth = F.product(1 + F.col("_r")).over(Window.partitionBy("label").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    return day.select("label", "d", growth.alias("equity"))


def backtest(bars: DataFrame, strategy: WeightFunction, freq: str | int = "ME", start=None, cost_bps: float = 0.0, label: str = "strategy") -> DataFrame:
    """Equity curve of one strategy on its own schedule."""
    dates = stage(rebalance_dates(calendar(bars).select("d"), freq, start))
    weights = stage(strategy(dates, bars).withColumn("label", F.lit(label)))
    return equity_curves(bars, weights, dates, start, cost_bps)


def buy_and_hold(bars: DataFrame, label: str = "ticker") -> DataFrame:
    first = F.first("close").over(Window.partitionBy("ticker").orderBy("d"))
    return bars.filter("close is not null").select(F.col("ticker").alias("label"), "d", F.try_divide("close", first).alias("equity"))


def random_average(bars: DataFrame, lookback_days: int, n: int, freq: str | int, start, trials: int = 1000, cost_bps: float = 0.0) -> DataFrame:
    """Mean equity over ``trials`` random-pick portfolios on the same schedule."""
    dates = stage(rebalance_dates(calendar(bars).select("d"), freq, start))
    return _random_average(bars, eligible(bars, dates, lookback_days), dates, n, start, trials, cost_bps)


def _random_average(bars, pool, dates, n, start, trials, cost_bps) -> DataFrame:
    weights = stage(equal_weight(random_picks(pool, n, trials), "trial").withColumnRenamed("trial", "label"))
    return equity_curves(bars, weights, dates, start, cost_bps).groupBy("d").agg(F.avg("equity").alias("equity"))


def drawdown(curves: DataFrame) -> DataFrame:
    peak = F.max("equity").over(Window.partitionBy("label").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    return curves.withColumn("drawdown", F.col("equity") / peak - 1)


def performance_summary(curves: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """Total return, annual growth, volatility, Sharpe ratio and worst drawdown per curve."""
    before = F.lag("equity").over(Window.partitionBy("label").orderBy("d"))
    rows = drawdown(curves).withColumn("_r", F.try_divide("equity", before) - 1)
    stats = rows.groupBy("label").agg(
        (F.max_by("equity", "d") / F.min_by("equity", "d")).alias("_growth"),
        (F.datediff(F.max("d"), F.min("d")) / 365.25).alias("_years"),
        F.stddev_samp("_r").alias("_sd"),
        F.avg("_r").alias("_mean"),
        F.min("drawdown").alias("max_drawdown"),
    )
    yearly = F.sqrt(F.lit(float(TRADING_DAYS_PER_YEAR)))
    return stats.select(
        "label",
        (F.col("_growth") - 1).alias("total_return"),
        F.when(F.col("_years") > 0, F.pow("_growth", F.try_divide(F.lit(1.0), F.col("_years"))) - 1).alias("cagr"),
        (F.col("_sd") * yearly).alias("volatility"),
        F.when(F.col("_sd") != 0, yearly * (F.col("_mean") - risk_free / TRADING_DAYS_PER_YEAR) / F.col("_sd")).alias("sharpe"),
        "max_drawdown",
    )


def momentum_study(bars: DataFrame, benchmark: DataFrame, lookback_days: int, n: int, freq: str | int, start, trials: int = 1000, cost_bps: float = 0.0) -> DataFrame:
    """Curves of the momentum picks, the whole universe, random picks and the benchmark."""
    # Schedule, pool and weights hold a few rows per rebalance and feed several branches.
    dates = stage(rebalance_dates(calendar(bars).select("d"), freq, start))
    pool = stage(eligible(bars, dates, lookback_days))
    weights = stage(
        equal_weight(top_n(pool, n)).withColumn("label", F.lit("momentum"))
        .unionByName(equal_weight(pool).withColumn("label", F.lit("equal_weight")))
    )
    curves = equity_curves(bars, weights, dates, start, cost_bps)
    random = _random_average(bars, pool, dates, n, start, trials, cost_bps).select(F.lit("random").alias("label"), "d", "equity")
    held = benchmark.filter(F.col("d") >= F.lit(start).cast("date")).withColumn("ticker", F.lit("benchmark"))
    return curves.unionByName(random).unionByName(buy_and_hold(held))
