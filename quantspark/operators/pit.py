"""Analyst, insider and split data, live and as known at past dates.

Raw logs are first aggregated to one row per (ticker, day) or (ticker, firm,
day), so every later window is bounded by the calendar even if one ticker
holds most of a log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.operators.asof import asof

DAYS_PER_MONTH = 30.44  # fixed value


def is_buy() -> Column:
    return F.coalesce(F.col("transaction").rlike("(?i)buy|purchase"), F.lit(False))


def is_sale() -> Column:
    return F.coalesce(F.col("transaction").rlike("(?i)sale"), F.lit(False))


def tag_insider(tx: DataFrame) -> DataFrame:
    return tx.withColumn("is_buy", is_buy()).withColumn("is_sale", is_sale())


def insider_lookback(tx: DataFrame, as_of, months: int, min_value: float | None = None) -> DataFrame:
    """Filings of the last ``months`` (as whole days), optionally only sizable ones."""
    recent = tx.filter(F.col("start_date") >= F.date_sub(F.lit(as_of).cast("date"), int(months * DAYS_PER_MONTH)))
    return recent if min_value is None else recent.filter(F.col("value") >= min_value)


def _net_dollars() -> Column:
    bought = F.sum(F.when(is_buy(), F.col("value")))
    sold = F.sum(F.when(is_sale(), F.col("value")))
    return F.coalesce(bought, F.lit(0.0)) - F.coalesce(sold, F.lit(0.0))


def insider_summary(tx: DataFrame) -> DataFrame:
    return tx.groupBy("ticker").agg(
        F.count("*").alias("filings"),
        F.count_if(is_buy()).alias("buys"),
        F.count_if(is_sale()).alias("sales"),
        _net_dollars().alias("net_value"),
    ).orderBy(F.col("net_value").desc(), "ticker")


def _trailing(grid: DataFrame, daily: DataFrame, frames: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Sums of ``daily`` columns over day offsets ``[lo, hi]`` relative to each grid date.

    ``frames`` maps an output name to (column, lo, hi). ``_any`` tells whether
    the ticker occurs in the log at all.
    """
    columns = sorted({c for c, _, _ in frames.values()})
    probes = grid.select("ticker", F.col("date").alias("d"), F.lit(True).alias("_probe"), *[F.lit(None).cast("double").alias(c) for c in columns])
    facts = daily.select("ticker", "d", F.lit(False).alias("_probe"), *[F.col(c).cast("double").alias(c) for c in columns])
    by_day = Window.partitionBy("ticker").orderBy(F.unix_date("d"))
    out = probes.distinct().unionByName(facts).withColumn("_any", F.max((~F.col("_probe")).cast("int")).over(Window.partitionBy("ticker")) == 1)
    for name, (column, lo, hi) in frames.items():
        out = out.withColumn(name, F.coalesce(F.sum(column).over(by_day.rangeBetween(lo, hi)), F.lit(0.0)))
    return out.filter("_probe").select("ticker", F.col("d").alias("date"), "_any", *frames)


def insider_flow_as_of(grid: DataFrame, tx: DataFrame, window_days: int = 180) -> DataFrame:
    """Net insider dollars in ``(date - window, date]``: NULL without any filing, zero if none fall inside."""
    daily = tx.groupBy("ticker", F.col("start_date").alias("d")).agg(_net_dollars().alias("net"))
    sums = _trailing(grid, daily, {"insider_flow": ("net", 1 - window_days, 0)})
    return sums.select("ticker", "date", F.when(F.col("_any"), F.col("insider_flow")).alias("insider_flow"))


def upgrades_as_of(grid: DataFrame, actions: DataFrame, window_days: int = 90) -> DataFrame:
    """Net upgrades in the trailing window and their change against the window before it."""
    net = F.count_if(F.col("action") == "up") - F.count_if(F.col("action") == "down")
    daily = actions.groupBy("ticker", F.to_date("grade_date").alias("d")).agg(net.alias("net"))
    frames = {"net_upgrades": ("net", 1 - window_days, 0), "_before": ("net", 1 - 2 * window_days, -window_days)}
    sums = _trailing(grid, daily, frames)
    return sums.select(
        "ticker", "date", "net_upgrades",
        F.when(F.col("_any"), F.col("net_upgrades") - F.col("_before")).alias("revisions_trend"),
    )


def split_factor(rows: DataFrame, splits: DataFrame, on: str = "d", out: str = "split_factor") -> DataFrame:
    """Product of the ratios of all splits strictly after each row's date (one if none)."""
    probes = rows.select("ticker", F.col(on).alias("_t")).distinct().select("ticker", "_t", F.lit(1).alias("_side"), F.lit(None).cast("double").alias("ratio"))
    events = splits.select("ticker", F.col("split_d").alias("_t"), F.lit(0).alias("_side"), "ratio")
    later = Window.partitionBy("ticker").orderBy(F.col("_t").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    factor = (
        probes.unionByName(events)
        .withColumn(out, F.coalesce(F.product("ratio").over(later), F.lit(1.0)))
        .filter("_side = 1")
        .select("ticker", F.col("_t").alias(on), out)
    )
    return rows.join(factor, ["ticker", on], "left")


def analyst_consensus(actions: DataFrame, splits: DataFrame, max_age_days: int = 540) -> DataFrame:
    """Per ticker and day on which it changes: sum and count of live, split-adjusted targets.

    A firm's action is live from its date until the firm acts again or the
    action is ``max_age_days`` old. Each live target opens with +1 and closes
    with -1, so a running sum per ticker gives the consensus at any date
    without pairing firms with dates.
    """
    latest = actions.groupBy("ticker", "firm", F.to_date("grade_date").alias("d")).agg(F.max_by("target", "seq").alias("target"))
    following = F.lead("d").over(Window.partitionBy("ticker", "firm").orderBy("d"))
    live = latest.withColumn("until", F.least(F.coalesce(following, F.date_add("d", max_age_days)), F.date_add("d", max_age_days)))
    priced = split_factor(live.filter("target > 0"), splits).withColumn("target", F.col("target") / F.col("split_factor"))
    steps = priced.select(
        "ticker",
        F.inline(F.array(
            F.struct(F.col("d").alias("day"), F.col("target").alias("dt"), F.lit(1).alias("dn")),
            F.struct(F.col("until").alias("day"), (-F.col("target")).alias("dt"), F.lit(-1).alias("dn")),
        )),
    ).groupBy("ticker", "day").agg(F.sum("dt").alias("dt"), F.sum("dn").alias("dn"))
    so_far = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("ticker", F.col("day").alias("d"), F.sum("dt").over(so_far).alias("targets"), F.sum("dn").over(so_far).alias("firms"))


def analyst_upside_as_of(grid: DataFrame, actions: DataFrame, splits: DataFrame, max_age_days: int = 540) -> DataFrame:
    """Mean live target against ``price`` in percent; ``grid`` is (ticker, date, price)."""
    consensus = analyst_consensus(actions, splits, max_age_days)
    at = asof(grid, consensus, ["ticker"], "date", "d", {"targets": "_t", "firms": "_n"})
    upside = (F.try_divide(F.col("_t") / F.col("_n"), F.nullif(F.col("price"), F.lit(0.0))) - 1) * 100
    return at.select("ticker", "date", F.when(F.col("_n") > 0, upside).alias("analyst_upside"))


def analyst_summary(actions: DataFrame, prices: DataFrame, since, until) -> DataFrame:
    """Actions of a period by ticker with the mean target and its gap to the latest price."""
    day = F.to_date("grade_date")
    recent = actions.filter(day.between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    totals = recent.groupBy("ticker").agg(
        F.count("*").alias("actions"),
        F.count_if(F.col("action") == "up").alias("up"),
        F.count_if(F.col("action") == "down").alias("down"),
        F.avg(F.when(F.col("target") > 0, F.col("target"))).alias("avg_target"),
        F.max(day).alias("last_action"),
    )
    return (
        totals.withColumn("maintain", F.col("actions") - F.col("up") - F.col("down"))
        .join(prices.select("ticker", "price"), "ticker", "left")
        .withColumn("upside_pct", (F.try_divide("avg_target", "price") - 1) * 100)
    )


def analyst_candidates(actions: DataFrame, prices: DataFrame, as_of, since, min_upside_pct: float = 20.0) -> DataFrame:
    """Tickers with no net downgrades and at least ``min_upside_pct`` to the mean target."""
    summary = analyst_summary(actions, prices, since, as_of)
    return summary.filter((F.col("up") + F.col("maintain") >= F.col("down")) & (F.col("upside_pct") >= min_upside_pct)).select(
        "ticker", F.col("upside_pct").alias("score")
    )


def net_upgrades_live(actions: DataFrame, today, days: int = 90) -> DataFrame:
    recent = actions.filter(F.to_date("grade_date") >= F.date_sub(F.lit(today).cast("date"), days))
    net = F.count_if(F.col("action") == "up") - F.count_if(F.col("action") == "down")
    return recent.groupBy("ticker").agg(net.cast("double").alias("net_upgrades"))


def revisions_trend_live(trend: DataFrame) -> DataFrame:
    """Bullish share now minus three months ago, in points; NULL if a total is zero."""
    total = F.col("strongBuy") + F.col("buy") + F.col("hold") + F.col("sell") + F.col("strongSell")
    share = F.try_divide(F.col("strongBuy") + F.col("buy"), total)
    at = lambda p: F.max(F.when(F.col("period") == p, share))
    return trend.groupBy("ticker").agg(((at("0m") - at("-3m")) * 100).alias("revisions_trend"))


def ownership_ranking(holders: DataFrame) -> DataFrame:
    """Mean holding and mean change per ticker, largest change first."""
    return holders.groupBy("ticker").agg(
        F.count("*").alias("holders"),
        F.avg("pct_held").alias("mean_pct_held"),
        F.avg("pct_change").alias("mean_pct_change"),
        F.max("date_reported").alias("last_reported"),
    ).orderBy(F.abs("mean_pct_change").desc_nulls_last(), "ticker")
