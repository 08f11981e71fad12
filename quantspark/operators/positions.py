"""Positions opened and closed on ticker theses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.functions.text import stable_id

# Profiles with their thresholds, and the smallest trade.
RISK_PROFILES = {"conservative": (0.75, 0.85), "balanced": (0.60, 0.75), "aggressive": (0.50, 0.65)}
CONCENTRATION_PROFILES = {"diversified": (0.03, 0.015, 12), "balanced": (0.05, 0.025, 8), "concentrated": (0.10, 0.05, 4)}
HORIZON_PROFILES = {"short_term": (7, 90), "long_term": (90, 730), "any": (7, 730)}
MIN_TRADE_DOLLARS = 50.0


def _lookup(profiles: dict, column: str, default: str, names: list[str]):
    chosen = F.coalesce(F.col(column), F.lit(default))
    out = []
    for i, name in enumerate(names):
        pairs = [x for k, v in profiles.items() for x in (F.lit(k), F.lit(float(v[i])))]
        out.append(F.create_map(*pairs)[chosen].alias(name))
    return out


def strategies(portfolios: DataFrame) -> DataFrame:
    """Resolve profile names (missing ones mean balanced / any) to thresholds."""
    return portfolios.select(
        "*",
        *_lookup(RISK_PROFILES, "risk_profile", "balanced", ["confidence_min", "confidence_full"]),
        *_lookup(CONCENTRATION_PROFILES, "concentration", "balanced", ["pct_full", "pct_half", "max_positions"]),
        *_lookup(HORIZON_PROFILES, "horizon", "any", ["horizon_min", "horizon_max"]),
    )


def load_positions(events: DataFrame) -> DataFrame:
    """Current state of each position: its last creation and the last close after it.

    Closes without a creation are ignored. One aggregation, so hot ids combine map-side.
    """
    created = ["portfolio", "ticker", "created", "entry_confidence", "expected_horizon_days", "rule"]
    closed = ["closed_date", "actual_return_pct", "close_reason"]
    is_new = F.col("event") == "created"
    state = events.groupBy("id").agg(
        F.max(F.when(is_new, F.struct("seq", *created))).alias("_c"),
        F.max(F.when(F.col("event") == "closed", F.struct("seq", *closed))).alias("_x"),
    ).filter("_c is not null")
    after = F.coalesce(F.col("_x.seq") > F.col("_c.seq"), F.lit(False))
    return state.select(
        "id", *[F.col(f"_c.{c}").alias(c) for c in created],
        F.when(after, "closed").otherwise("open").alias("status"),
        F.when(after, F.col("_x.closed_date")).alias("closed_date"),
        F.when(after, F.col("_x.actual_return_pct")).alias("actual_return_pct"),
        F.when(after, F.coalesce(F.col("_x.close_reason"), F.lit("horizon"))).alias("close_reason"),
    )


def position_closes(state: DataFrame, held: DataFrame, prices: DataFrame, theses: DataFrame, profiles: DataFrame, as_of) -> DataFrame:
    """Open positions to close: horizon passed, else thesis no longer long or confident enough.

    ``held`` is (portfolio, ticker, shares, avg_cost); the return is against
    average cost. The horizon review comes first, so it names the reason.
    """
    due = F.datediff(F.lit(as_of).cast("date"), "created") >= F.col("expected_horizon_days")
    known = F.col("confidence").isNotNull()
    weak = known & ((F.col("confidence") < F.col("confidence_min")) | ~F.col("direction").eqNullSafe("long"))
    return (
        state.filter("status = 'open'")
        .join(theses.select("ticker", "direction", "confidence"), "ticker", "left")
        .join(profiles.select("portfolio", "confidence_min"), "portfolio", "left")
        .withColumn("_due", due)
        .filter(F.col("_due") | weak)
        .join(held.select("portfolio", "ticker", "shares", "avg_cost"), ["portfolio", "ticker"])
        .join(prices.select("ticker", "price"), "ticker")
        .select(
            "id", "portfolio", "ticker", "shares", "price",
            ((F.try_divide("price", "avg_cost") - 1) * 100).alias("actual_return_pct"),
            F.when(F.col("_due"), "horizon").otherwise("invalidated").alias("close_reason"),
        )
    )


def open_positions_on_theses(profiles: DataFrame, theses: DataFrame, held: DataFrame, prices: DataFrame, cash: DataFrame, as_of) -> DataFrame:
    """Entries of one day, ticker by ticker, against each portfolio's cash and position cap.

    Held tickers that lose their thesis free cash and a slot for the tickers
    after them. The list folded per portfolio has one entry per thesis, which
    the tracked universe bounds. Buying and selling at the mark leaves the
    portfolio's value unchanged, so it is computed once.
    """
    marked = held.join(prices.select("ticker", "price"), "ticker", "left")
    worth = marked.groupBy("portfolio").agg(F.sum(F.col("shares") * F.col("price")).alias("_h"), F.count("*").alias("_n"))
    # One array of theses meets each portfolio row, so no cross join is planned.
    offered = theses.join(prices.select("ticker", "price"), "ticker", "left")
    bundle = offered.agg(F.sort_array(F.collect_list(F.struct("ticker", "direction", "confidence", "expected_horizon_days", "price"))))
    owned = marked.groupBy("portfolio").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "shares"))).alias("_owned"))
    base = (
        profiles.join(cash.select("portfolio", "cash"), "portfolio")
        .join(worth, "portfolio", "left")
        .join(owned, "portfolio", "left")
        .withColumn("_theses", bundle.scalar())
        .withColumn("_value", F.col("cash") + F.coalesce("_h", F.lit(0.0)))
        .withColumn("_n", F.coalesce("_n", F.lit(0)).cast("double"))
    )

    def step(state, t):
        mine = F.coalesce(F.col("_owned")[t["ticker"]], F.lit(0.0))
        weak = (t["confidence"] < F.col("confidence_min")) | ~t["direction"].eqNullSafe("long")
        sell = (mine > 0) & weak & t["price"].isNotNull()
        pct = F.when(t["confidence"] >= F.col("confidence_full"), F.col("pct_full")).when(t["confidence"] >= F.col("confidence_min"), F.col("pct_half"))
        unit = F.least(F.col("_value") * pct, state["cash"])
        buy = (
            (mine <= 0) & t["direction"].eqNullSafe("long")
            & t["expected_horizon_days"].between(F.col("horizon_min"), F.col("horizon_max"))
            & pct.isNotNull() & (state["n"] < F.col("max_positions")) & (unit >= MIN_TRADE_DOLLARS) & t["price"].isNotNull()
        )
        bought = F.struct(t["ticker"].alias("ticker"), unit.alias("unit"), t["price"].alias("price"), t["confidence"].alias("confidence"), t["expected_horizon_days"].alias("horizon"))
        return (
            F.when(sell, F.struct((state["cash"] + mine * t["price"]).alias("cash"), (state["n"] - 1).alias("n"), state["log"].alias("log")))
            .when(buy, F.struct((state["cash"] - unit).alias("cash"), (state["n"] + 1).alias("n"), F.concat(state["log"], F.array(bought)).alias("log")))
            .otherwise(state)
        )

    entry = "array<struct<ticker:string,unit:double,price:double,confidence:double,horizon:int>>"
    start = F.struct(F.col("cash").alias("cash"), F.col("_n").alias("n"), F.array().cast(entry).alias("log"))
    done = base.withColumn("_end", F.aggregate("_theses", start, step)).select("portfolio", F.explode("_end.log").alias("e"))
    day = F.lit(as_of).cast("date")
    return done.select(
        stable_id(F.col("portfolio"), F.col("e.ticker"), day.cast("string")).alias("id"), "portfolio", "e.ticker",
        (F.col("e.unit") / F.col("e.price")).alias("shares"), "e.price", F.col("e.confidence").alias("entry_confidence"),
        F.col("e.horizon").alias("expected_horizon_days"), day.alias("created"),
    )
