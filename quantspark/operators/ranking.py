"""Factor table, percentile ranks, category scores and the composite rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.operators.ordered import in_chunks, running
from quantspark.operators.pit import is_buy, is_sale, net_upgrades_live, revisions_trend_live
from quantspark.operators.timeseries import momentum
from quantspark.session import stage

# Categories with their factors, and the factors where less is better.
FACTOR_CATEGORIES: dict[str, list[str]] = {
    "Growth": ["revenue_growth", "earnings_growth"],
    "Valuation": ["forward_pe", "peg_ratio", "ev_to_revenue"],
    "Quality": ["operating_margin", "fcf_margin"],
    "Momentum": ["momentum", "relative_strength", "relative_volume"],
    "Sentiment": ["analyst_upside", "revisions_trend", "net_upgrades"],
    "Ownership": ["institutional_flow", "insider_flow", "low_short_interest"],
}
LOWER_IS_BETTER = {"forward_pe", "peg_ratio", "ev_to_revenue"}
HEADLINE_FACTOR = {
    "Growth": "revenue_growth", "Valuation": "forward_pe", "Quality": "operating_margin",
    "Sentiment": "analyst_upside", "Ownership": "institutional_flow",
}
MIN_NOTABLE_CHANGE_PCT = 5.0

FACTORS = [f for names in FACTOR_CATEGORIES.values() for f in names]


def info_number(key: str) -> Column:
    return F.col("info")[key].try_cast("double")


def _nonzero(value: Column) -> Column:
    """Zero counts as missing."""
    return F.nullif(value, F.lit(0.0))


def current_price() -> Column:
    return F.coalesce(_nonzero(info_number("currentPrice")), info_number("regularMarketPrice"))


def upside_pct() -> Column:
    return (F.try_divide(_nonzero(info_number("targetMeanPrice")), _nonzero(current_price())) - 1) * 100


def info_factors(info: DataFrame) -> DataFrame:
    """Typed projection of the schemaless snapshot."""
    traded = _nonzero(F.coalesce(_nonzero(info_number("volume")), info_number("regularMarketVolume")))
    return info.select(
        "ticker",
        info_number("revenueGrowth").alias("revenue_growth"),
        info_number("earningsGrowth").alias("earnings_growth"),
        info_number("forwardPE").alias("forward_pe"),
        info_number("pegRatio").alias("peg_ratio"),
        info_number("enterpriseToRevenue").alias("ev_to_revenue"),
        info_number("operatingMargins").alias("operating_margin"),
        F.try_divide(_nonzero(info_number("operatingCashflow")), _nonzero(info_number("totalRevenue"))).alias("fcf_margin"),
        F.try_divide(traded, _nonzero(info_number("averageVolume"))).alias("relative_volume"),
        upside_pct().alias("analyst_upside"),
        (-info_number("shortPercentOfFloat") * 100).alias("low_short_interest"),
    )


def factor_table(
    info: DataFrame, trend: DataFrame, actions: DataFrame, insider: DataFrame, holders: DataFrame,
    bars: DataFrame, benchmark: DataFrame, today, momentum_weeks: int = 12,
) -> DataFrame:
    """Sixteen raw factors per ticker of ``info``."""
    price = momentum(bars.filter(F.col("d") <= F.lit(today).cast("date")), benchmark, momentum_weeks * 7)
    latest = price.groupBy("ticker").agg(F.max_by(F.struct("momentum", "relative_strength"), "d").alias("_m")).select(
        "ticker", "_m.momentum", "_m.relative_strength"
    )
    bought, sold = F.sum(F.when(is_buy(), F.col("value"))), F.sum(F.when(is_sale(), F.col("value")))
    flow = insider.groupBy("ticker").agg((F.coalesce(bought, F.lit(0.0)) - F.coalesce(sold, F.lit(0.0))).alias("insider_flow"))
    held = holders.groupBy("ticker").agg((F.avg("pct_change") * 100).alias("institutional_flow"))
    table = info_factors(info)
    for side in (latest, revisions_trend_live(trend), net_upgrades_live(actions, today), held, flow):
        table = table.join(side, "ticker", "left")
    return table.withColumn("net_upgrades", F.coalesce("net_upgrades", F.lit(0.0))).select("ticker", *FACTORS)


def _factor_order(factors: list[str]) -> Column:
    """Value whose ascending order runs from worst to best."""
    lower = F.col("factor").isin(*sorted(LOWER_IS_BETTER))
    return F.when(lower, -F.col("value")).otherwise(F.col("value"))


def percentile_ranks(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Long ``(by, ticker, factor, value, pct)``: average rank over the non-missing count, times 100.

    Equal values are counted first, so ties are one row. The distinct values are range partitioned and
    counted in two levels, within each range and over the ranges before it; a factor of one date may thus
    have any number of tickers.
    """
    factors = [c for c in table.columns if c in FACTORS]
    long = stage(table.unpivot([*by, "ticker"], factors, "factor", "value").withColumn("_o", _factor_order(factors)))
    group = [*by, "factor"]
    counts = long.filter("_o is not null").groupBy(*group, "_o").agg(F.count("*").alias("_n"))
    chunked = in_chunks(counts, group, ["_o"])
    totals = chunked.groupBy(*group).agg(F.sum("_n").alias("_all"))
    upto = running(chunked, group, ["_o"], {"_upto": F.col("_n")}).join(totals, group)
    pct = (F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("_all") * 100
    return long.join(upto.select(*group, "_o", pct.alias("pct")), [*group, "_o"], "left").select(*by, "ticker", "factor", "value", "pct")


def category_scores(ranks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean rank per category, one column each; NULL when all its factors are missing."""
    means = [F.avg(F.when(F.col("factor").isin(*names), F.col("pct"))).alias(c) for c, names in FACTOR_CATEGORIES.items()]
    return ranks.groupBy(*by, "ticker").agg(*means)


def composite_score(scores: DataFrame, weights: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean of categories; a missing one takes the universe mean of its date.

    The means come from one aggregate over the staged scores, not from a window over the universe.
    """
    total = sum(weights.get(c, 0.0) for c in FACTOR_CATEGORIES)
    if total == 0:
        return scores.withColumn("composite", F.lit(None).cast("double"))
    scores = stage(scores)
    means = F.struct(*[F.avg(c).alias(c) for c in FACTOR_CATEGORIES]).alias("_mean")
    if by:
        filled = scores.join(scores.groupBy(*by).agg(means), list(by))
    else:
        filled = scores.withColumn("_mean", scores.agg(means).scalar())
    parts = [F.coalesce(F.col(c), F.col(f"_mean.{c}")) * (weights.get(c, 0.0) / total) for c in FACTOR_CATEGORIES]
    composite = parts[0]
    for part in parts[1:]:
        composite = composite + part
    return filled.withColumn("composite", composite).drop("_mean")


def rank_universe(table: DataFrame, weights: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    scored = composite_score(category_scores(percentile_ranks(table, by), by), weights, by)
    return scored.orderBy(*by, F.col("composite").desc_nulls_last(), "ticker")


def fundamental_factors(table: DataFrame, info: DataFrame) -> DataFrame:
    """Nested category -> factor map without momentum and missing values, and the fair-value anchor."""
    pairs = []
    for category, names in FACTOR_CATEGORIES.items():
        if category != "Momentum":
            inner = [x for f in names for x in (F.lit(f), F.col(f))]
            pairs += [F.lit(category), F.map_filter(F.create_map(*inner), lambda _, v: v.isNotNull())]
    anchor = info.select(
        "ticker", info_number("targetMeanPrice").alias("fair_value_estimate"), current_price().alias("current_price"),
        F.round(upside_pct(), 1).alias("implied_return_pct"),
    )
    return table.select("ticker", F.create_map(*pairs).alias("factors")).join(anchor, "ticker", "left")


def factor_changes(snapshots: DataFrame) -> DataFrame:
    """Moves of at least five percent of a factor against the ticker's previous snapshot.

    ``snapshots`` is (ticker, d, seq, factors map); both values must exist.
    """
    numbered = snapshots.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy("d", "seq")))
    flat = numbered.select("ticker", "d", "_n", F.explode("factors").alias("category", "inner")).select(
        "ticker", "d", "_n", "category", F.explode("inner").alias("factor", "value")
    )
    before = flat.select("ticker", (F.col("_n") + 1).alias("_n"), "category", "factor", F.col("value").alias("previous"))
    delta = F.round(F.try_divide(F.col("value") - F.col("previous"), F.abs("previous")) * 100, 1)
    return (
        flat.join(before, ["ticker", "_n", "category", "factor"])
        .filter("previous <> 0")
        .withColumn("delta_pct", delta)
        .filter(F.abs("delta_pct") >= MIN_NOTABLE_CHANGE_PCT)
        .select("ticker", "d", "category", "factor", "previous", F.col("value").alias("current"), "delta_pct")
    )


def headline_factor(category: str, factors: Column) -> Column:
    """The category's preferred factor, else the first present one."""
    inner = factors[category]
    return F.coalesce(inner[HEADLINE_FACTOR[category]], F.element_at(F.map_values(inner), 1)) if category in HEADLINE_FACTOR else F.element_at(F.map_values(inner), 1)
