"""Point-in-time factor panel: one row per (date, ticker) with fifteen factors and the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.operators import facts as fa
from quantspark.operators import pit
from quantspark.operators.asof import asof
from quantspark.operators.timeseries import technicals
from quantspark.session import stage

FACTOR_COLUMNS = [
    "revenue_growth", "earnings_growth", "trailing_pe", "price_to_sales", "operating_margin", "fcf_margin",
    "momentum", "relative_strength", "price_vs_ma", "relative_volume",
    "analyst_upside", "net_upgrades", "revisions_trend", "institutional_flow", "insider_flow",
]
_FLOWS = ["revenue", "net_income", "eps_diluted", "operating_income", "operating_cash_flow"]
_PER_SHARE = {"eps_diluted": "divide", "shares_outstanding": "multiply"}


def panel_grid(tickers: DataFrame, dates: DataFrame) -> DataFrame:
    """Every (date, ticker): the dates travel as one array, so no cross join is planned."""
    return tickers.select("ticker").distinct().select("ticker", F.explode(dates.agg(F.collect_set("date")).scalar()).alias("date"))


def forward_return(grid: DataFrame, bars: DataFrame, days: DataFrame, horizon: int = 30) -> DataFrame:
    """Return from the first shared trading day on/after a date to the first on/after date + horizon.

    NULL unless the ticker is quoted on both days.
    """
    one = F.lit(1).alias("_k")
    dates = grid.select("date").distinct().select("date", F.date_add("date", horizon).alias("_to"), one)
    calendar = days.select("d", one)
    legs = asof(dates, calendar, ["_k"], "date", "d", {"d": "_in"}, "forward")
    legs = asof(legs, calendar, ["_k"], "_to", "d", {"d": "_out"}, "forward").select("date", "_in", "_out")
    quotes = bars.filter("close is not null").select("ticker", "d", "close")
    entry = quotes.select("ticker", F.col("d").alias("_in"), F.col("close").alias("_p0"))
    exit_ = quotes.select("ticker", F.col("d").alias("_out"), F.col("close").alias("_p1"))
    return (
        grid.join(F.broadcast(legs), "date")
        .join(entry, ["ticker", "_in"], "left")
        .join(exit_, ["ticker", "_out"], "left")
        .select("ticker", "date", ((F.try_divide("_p1", F.nullif("_p0", F.lit(0.0))) - 1) * 100).alias("forward_return"))
    )


def fundamentals_as_of(grid: DataFrame, history: DataFrame, splits: DataFrame) -> DataFrame:
    """TTM flows now and a year ago and the latest share count, split-adjusted per contributing period."""
    adjusted = stage(fa.adjust_for_splits(history, splits, _PER_SHARE))
    flows = adjusted.filter(F.col("concept").isin(*_FLOWS))
    probes = grid.withColumn("concept", F.explode(F.array(*[F.lit(c) for c in _FLOWS])))
    timed = fa.yoy_ttm(probes, flows)
    at = lambda c, v: F.max(F.when(F.col("concept") == c, F.col(v)))
    wide = timed.groupBy("ticker", "date").agg(
        *[at(c, "ttm").alias(f"{c}_ttm") for c in _FLOWS],
        at("revenue", "yoy_pct").alias("revenue_growth"),
        at("net_income", "yoy_pct").alias("earnings_growth"),
    )
    shares = fa.instant_timeline(adjusted.filter("concept = 'shares_outstanding'"))
    return asof(wide, shares, ["ticker"], "date", "d", {"value": "shares"})


def build_panel(
    grid: DataFrame, history: DataFrame, bars: DataFrame, benchmark: DataFrame, actions: DataFrame, insider: DataFrame,
    splits: DataFrame, flow: DataFrame, momentum_weeks: int = 12, ma: int = 50, forward_days: int = 30,
) -> DataFrame:
    """Every feature uses only what was known at its date; ``forward_return`` looks ahead by design.

    ``flow`` is the institutional-flow timeline (ticker, d, institutional_flow).
    Each source is joined to the grid once by an as-of lookup or a trailing
    window, all keyed by ticker.
    """
    tech = {c: c for c in ("momentum", "relative_strength", "price_vs_ma", "relative_volume")}
    priced = stage(asof(grid, technicals(bars, benchmark, momentum_weeks, ma), ["ticker"], "date", "d", {"close": "price", **tech}))
    base = fundamentals_as_of(grid, history, splits)
    days = bars.filter("close is not null").select("d").unionByName(benchmark.select("d")).distinct()
    panel = priced
    for side in (
        base,
        pit.analyst_upside_as_of(priced.select("ticker", "date", "price"), actions, splits),
        pit.upgrades_as_of(grid, actions),
        asof(grid, flow, ["ticker"], "date", "d", {"institutional_flow": "institutional_flow"}),
        pit.insider_flow_as_of(grid, insider),
        forward_return(grid, bars, days, forward_days),
    ):
        panel = panel.join(side, ["ticker", "date"], "left")
    zero = F.lit(0.0)
    price, revenue = F.nullif("price", zero), F.nullif("revenue_ttm", zero)
    cap = F.nullif(price * F.nullif("shares", zero), zero)
    return (
        panel.withColumn("trailing_pe", F.when(F.col("eps_diluted_ttm") > 0, price / F.col("eps_diluted_ttm")))
        .withColumn("price_to_sales", cap / revenue)
        .withColumn("operating_margin", F.col("operating_income_ttm") / revenue)
        .withColumn("fcf_margin", F.col("operating_cash_flow_ttm") / revenue)
        .withColumn("net_upgrades", F.coalesce("net_upgrades", zero))
        .select("date", "ticker", *FACTOR_COLUMNS, "forward_return")
    )


def upsert_panel(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows win over existing ones with the same (date, ticker)."""
    kept = existing.join(new.select("date", "ticker"), ["date", "ticker"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
