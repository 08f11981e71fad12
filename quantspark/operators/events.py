"""Event studies: buying dips, drift after earnings, beat streaks and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.operators.asof import asof, benchmark_lookup, with_benchmark_return
from quantspark.operators.ordered import in_chunks, running
from quantspark.operators.timeseries import daily_returns
from quantspark.session import stage


def _close_out(entries: DataFrame, bars: DataFrame, benchmark: DataFrame, cost_bps: float) -> DataFrame:
    """Attach exit, benchmark over the same span and net returns; drop incomplete trades.

    ``entries`` has ticker, buy_date, buy_price and the exit target ``_target``.
    """
    priced = bars.filter("close is not null")
    exits = asof(entries, priced, ["ticker"], "_target", "d", {"close": "sell_price"}, "forward", when_as="sell_date")
    done = exits.filter("sell_date is not null")
    lookup = stage(benchmark_lookup(priced.select("d"), benchmark))
    spans = with_benchmark_return(done, lookup, "buy_date", "sell_date")
    return (
        spans.filter("benchmark_return is not null")
        .withColumn("stock_return", F.try_divide("sell_price", "buy_price") - 1 - F.lit(cost_bps / 10_000))
        .withColumn("excess_return", F.col("stock_return") - F.col("benchmark_return"))
        .drop("_target")
    )


def _dips(bars: DataFrame, drop: float) -> DataFrame:
    return (
        daily_returns(bars)
        .filter(F.col("ret") <= -drop)
        .select("ticker", F.col("d").alias("buy_date"), F.col("close").alias("buy_price"), F.col("ret").alias("drop_that_day"))
    )


def dip_trades(bars: DataFrame, benchmark: DataFrame, drop: float, hold_days: int, cost_bps: float = 0.0) -> DataFrame:
    """Buy at the close of a day that fell by ``drop``, sell on/after ``hold_days`` calendar days."""
    entries = _dips(bars, drop).withColumn("_target", F.date_add("buy_date", hold_days))
    return _close_out(entries, bars, benchmark, cost_bps).select(
        "ticker", "buy_date", "buy_price", "sell_date", "sell_price",
        "drop_that_day", "stock_return", "benchmark_return", "excess_return",
    )


def pending_dips(bars: DataFrame, drop: float, hold_days: int) -> DataFrame:
    """Dips whose holding period runs past the ticker's last bar."""
    last = bars.filter("close is not null").groupBy("ticker").agg(F.max("d").alias("_last"))
    return (
        _dips(bars, drop)
        .join(last, "ticker")
        .filter(F.col("_last") < F.date_add("buy_date", hold_days))
        .select("ticker", "buy_date", "buy_price", "drop_that_day", F.datediff("_last", "buy_date").alias("days_held_so_far"))
    )


def surprise_pct(reported: Column, estimate: Column) -> Column:
    """Surprise in percent of the estimate's size; NULL without either number or with an estimate of zero."""
    return F.try_divide(reported - estimate, F.abs(estimate)) * 100


def trade_summary(trades: DataFrame, *by: str) -> DataFrame:
    """Count, means and the compounded return of stock and benchmark legs."""
    return trades.groupBy(*by).agg(
        F.count("*").alias("trades"),
        F.avg("stock_return").alias("mean_return"),
        F.avg("excess_return").alias("mean_excess"),
        (F.product(1 + F.col("stock_return")) - 1).alias("compounded_return"),
        (F.product(1 + F.col("benchmark_return")) - 1).alias("compounded_benchmark"),
    )


def pead_trades(
    earnings: DataFrame, bars: DataFrame, benchmark: DataFrame,
    threshold: float, hold_days: int, direction: str = "beat", cost_bps: float = 0.0,
) -> DataFrame:
    """Buy on the first bar strictly after a report that beat (or missed) by ``threshold`` percent."""
    surprise = F.col("surprise_pct")
    wanted = surprise > threshold if direction == "beat" else surprise < -threshold
    reports = earnings.filter(wanted).select("ticker", F.to_date("earnings_date").alias("earnings_date"), "surprise_pct")
    priced = bars.filter("close is not null")
    entries = (
        asof(reports, priced, ["ticker"], "earnings_date", "d", {"close": "buy_price"}, "forward", strict=True, when_as="buy_date")
        .filter("buy_date is not null")
        .withColumn("_target", F.date_add("buy_date", hold_days))
    )
    return _close_out(entries, bars, benchmark, cost_bps).select(
        "ticker", "earnings_date", "surprise_pct", "buy_date", "buy_price", "sell_date", "sell_price",
        "stock_return", "benchmark_return", "excess_return",
    )


def concat_trades(since, **studies: DataFrame) -> DataFrame:
    """Trades of several studies bought from ``since`` on, in order of purchase, with the study's name and their running number.

    Equal days go by study, ticker and selling day. The numbers run over all trades, so they come from range
    partitions and the counts of the partitions before; no task holds the whole log.
    """
    columns = ["ticker", "buy_date", "buy_price", "sell_date", "sell_price", "stock_return", "benchmark_return", "excess_return"]
    parts = [trades.select(F.lit(name).alias("study"), *columns) for name, trades in studies.items()]
    log = reduce(DataFrame.unionByName, parts).filter(F.col("buy_date") >= F.lit(since).cast("date"))
    order = ["buy_date", "study", "ticker", "sell_date", "buy_price", "sell_price"]
    return running(in_chunks(log, [], order), [], order, {"seq": F.lit(1)}).drop("_chunk")


def streak_trades(
    earnings: DataFrame, bars: DataFrame, benchmark: DataFrame,
    threshold: float, hold_days: int, cost_bps: float = 0.0,
) -> DataFrame:
    """Both previous reports beat: buy on the last bar strictly before the next report.

    The holding period counts from the report, not from the purchase.
    """
    by_date = Window.partitionBy("ticker").orderBy("earnings_date")
    reports = (
        earnings.withColumn("earnings_date", F.to_date("earnings_date"))
        .withColumn("prior_surprise_1", F.lag("surprise_pct", 1).over(by_date))
        .withColumn("prior_surprise_2", F.lag("surprise_pct", 2).over(by_date))
        .filter((F.col("prior_surprise_1") > threshold) & (F.col("prior_surprise_2") > threshold))
        .select("ticker", "earnings_date", "prior_surprise_1", "prior_surprise_2")
    )
    priced = bars.filter("close is not null")
    entries = (
        asof(reports, priced, ["ticker"], "earnings_date", "d", {"close": "buy_price"}, "backward", strict=True, when_as="buy_date")
        .filter("buy_date is not null")
        .withColumn("_target", F.date_add("earnings_date", hold_days))
    )
    return _close_out(entries, bars, benchmark, cost_bps).select(
        "ticker", "earnings_date", "prior_surprise_1", "prior_surprise_2", "buy_date", "buy_price",
        "sell_date", "sell_price", "stock_return", "benchmark_return", "excess_return",
    )


def surprise_board(earnings: DataFrame) -> DataFrame:
    """Last four surprises per ticker, oldest first and left-padded, with the next report date."""
    reported = F.col("reported_eps").isNotNull() & F.col("surprise_pct").isNotNull()
    newest = Window.partitionBy("ticker", reported).orderBy(F.col("earnings_date").desc())

    def nth(k):
        return F.max(F.when(reported & (F.col("_n") == k), F.col("surprise_pct")))

    return (
        earnings.withColumn("_n", F.row_number().over(newest))
        .groupBy("ticker")
        .agg(
            nth(4).alias("reports_ago_4"),
            nth(3).alias("reports_ago_3"),
            nth(2).alias("reports_ago_2"),
            nth(1).alias("last_report"),
            F.min(F.when(F.col("reported_eps").isNull(), F.to_date("earnings_date"))).alias("next_earnings_date"),
        )
    )


def reported_recently(earnings: DataFrame, as_of, days: int = 7) -> DataFrame:
    today = F.lit(as_of).cast("date")
    day = F.to_date("earnings_date")
    return (
        earnings.filter("reported_eps is not null and surprise_pct is not null")
        .filter(day.between(F.date_sub(today, days), today))
        .select("ticker", day.alias("earnings_date"), "eps_estimate", "reported_eps", "surprise_pct")
    )


def upcoming_reports(earnings: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Next unreported date within ``days`` and its estimate."""
    today = F.lit(as_of).cast("date")
    return (
        earnings.filter("reported_eps is null")
        .filter(F.to_date("earnings_date").between(today, F.date_add(today, days)))
        .groupBy("ticker")
        .agg(F.min(F.to_date("earnings_date")).alias("earnings_date"), F.min_by("eps_estimate", "earnings_date").alias("eps_estimate"))
    )


def earnings_span(earnings: DataFrame) -> DataFrame:
    return earnings.agg(F.min(F.to_date("earnings_date")).alias("first_report"), F.max(F.to_date("earnings_date")).alias("last_report"))
