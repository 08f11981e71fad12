"""Trade logs: replayed positions, lot matching, validation and daily valuation.

``trades`` is (portfolio, ticker, rule, d, action, shares, price, seq); state
is always derived from the log, in order of (d, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.operators.asof import asof
from quantspark.operators.ordered import affine_final, in_chunks, running, running_min_before
from quantspark.session import stage

# Holdings below this are closed; cash and share checks allow this slack.
CLOSED_BELOW, SLACK = 1e-9, 1e-6
ORDER = ["d", "seq"]


def _is_buy() -> Column:
    return F.col("action") == "BUY"


def signed_shares() -> Column:
    return F.when(_is_buy(), F.col("shares")).otherwise(-F.col("shares"))


def signed_cash() -> Column:
    value = F.col("shares") * F.col("price")
    return F.when(_is_buy(), -value).otherwise(value)


def cash_balance(trades: DataFrame, portfolios: DataFrame) -> DataFrame:
    """``portfolios`` is (portfolio, initial_cash, created)."""
    flows = trades.groupBy("portfolio").agg(F.sum(signed_cash()).alias("_flow"))
    return portfolios.join(flows, "portfolio", "left").select(
        "portfolio", "initial_cash", (F.col("initial_cash") + F.coalesce("_flow", F.lit(0.0))).alias("cash")
    )


def positions(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Open holdings per key with average cost and the start of the open lot.

    A sale lowers the cost basis in proportion to the shares held before it.
    Pass ``["portfolio", "rule", "ticker"]`` to track each rule on its own.
    """
    keys = keys or ["portfolio", "ticker"]
    log = trades.select(*keys, *ORDER, "action", "shares", "price")
    held = running(in_chunks(log, keys, ORDER), keys, ORDER, {"held": signed_shares()})
    before = F.col("held") - signed_shares()
    keep = F.when(~_is_buy() & (before != 0), F.try_divide(before - F.col("shares"), before)).otherwise(F.lit(1.0))
    paid = F.when(_is_buy(), F.col("shares") * F.col("price")).otherwise(F.lit(0.0))
    cost = affine_final(held, keys, ORDER, keep, paid, "_cost")
    opens = _is_buy() & (before <= CLOSED_BELOW)
    state = held.groupBy(*keys).agg(
        F.sum(signed_shares()).alias("shares"),
        F.max(F.when(opens, F.struct("d", "seq"))).alias("_open"),
    )
    return (
        state.filter(F.col("shares") > CLOSED_BELOW)
        .join(cost, keys)
        .select(*keys, "shares", (F.col("_cost") / F.col("shares")).alias("avg_cost"), F.col("_open.d").alias("entry_date"))
    )


def closed_trades(trades: DataFrame) -> DataFrame:
    """First-in-first-out pairs of buys and sales per (portfolio, rule, ticker).

    A sale with nothing open is ignored: with S the running count of buys
    minus sales, it is one that takes S below every earlier value and zero.
    The k-th buy then pairs with the k-th accepted sale by an equi-join.
    """
    keys = ["portfolio", "rule", "ticker"]
    buy, sale = F.when(_is_buy(), 1).otherwise(0), F.when(_is_buy(), 0).otherwise(1)
    log = trades.select(*keys, *ORDER, "action", "shares", "price")
    counted = running(in_chunks(log, keys, ORDER), keys, ORDER, {"_buys": buy, "_sales": sale})
    counted = counted.withColumn("_s", F.col("_buys") - F.col("_sales"))
    walked = running_min_before(counted, keys, ORDER, "_s", "_low")
    ignored = F.greatest(F.lit(0), -F.least(F.col("_low"), F.col("_s")))
    ignored_before = F.greatest(F.lit(0), -F.coalesce(F.col("_low"), F.lit(0)))
    buys = walked.filter(_is_buy()).select(
        *keys, F.col("_buys").alias("_k"), F.col("d").alias("buy_date"), F.col("price").alias("buy_price"), "shares"
    )
    sales = walked.filter(~_is_buy() & (ignored == ignored_before)).select(
        *keys, (F.col("_sales") - ignored).alias("_k"), F.col("d").alias("sell_date"), F.col("price").alias("sell_price")
    )
    return (
        buys.join(sales, [*keys, "_k"], "left")
        .withColumn("return_pct", F.try_divide("sell_price", "buy_price") - 1)
        .withColumn("pnl", (F.col("sell_price") - F.col("buy_price")) * F.col("shares"))
        .withColumn("hold_days", F.datediff("sell_date", "buy_date"))
        .withColumn("status", F.when(F.col("sell_date").isNull(), "open").otherwise("closed"))
        .drop("_k")
    )


def rule_pnl(pairs: DataFrame) -> DataFrame:
    return pairs.filter("status = 'closed'").groupBy("rule").agg(
        F.count("*").alias("trades"), F.avg("return_pct").alias("mean_return"), F.sum("pnl").alias("total_pnl")
    )


def mark_open_trades(pairs: DataFrame, prices: DataFrame) -> DataFrame:
    """Value open lots at ``prices`` (ticker, price); without a quote they stay at their buy price."""
    mark = F.when(F.col("status") == "open", F.coalesce("price", "buy_price")).otherwise(F.col("sell_price"))
    return (
        pairs.join(prices.select("ticker", "price"), "ticker", "left")
        .withColumn("sell_price", mark)
        .withColumn("return_pct", F.try_divide("sell_price", "buy_price") - 1)
        .withColumn("pnl", (F.col("sell_price") - F.col("buy_price")) * F.col("shares"))
        .drop("price")
    )


def valued_positions(held: DataFrame, prices: DataFrame) -> DataFrame:
    """Positions at the latest price, falling back to average cost."""
    return (
        held.join(prices.select("ticker", "price"), "ticker", "left")
        .withColumn("current_price", F.coalesce("price", "avg_cost"))
        .withColumn("market_value", F.col("shares") * F.col("current_price"))
        .withColumn("unrealized_pl", (F.col("current_price") - F.col("avg_cost")) * F.col("shares"))
        .withColumn("unrealized_pl_pct", F.try_divide("current_price", "avg_cost") - 1)
        .drop("price")
    )


def portfolio_totals(trades: DataFrame, portfolios: DataFrame, prices: DataFrame) -> DataFrame:
    """Cash, holdings, total and return since inception per portfolio."""
    holdings = valued_positions(positions(trades), prices).groupBy("portfolio").agg(F.sum("market_value").alias("holdings_value"))
    return (
        cash_balance(trades, portfolios)
        .join(holdings, "portfolio", "left")
        .withColumn("holdings_value", F.coalesce("holdings_value", F.lit(0.0)))
        .withColumn("total_value", F.col("cash") + F.col("holdings_value"))
        .withColumn("total_return", F.try_divide("total_value", "initial_cash") - 1)
    )


def violations(trades: DataFrame, portfolios: DataFrame) -> DataFrame:
    """Trades a careful ledger would refuse, with the reason.

    Checks the action, positive amounts, cash before a buy and shares before
    a sale, all against the log as written.
    """
    base = trades.join(portfolios.select("portfolio", "initial_cash"), "portfolio", "left")
    cash = running(in_chunks(base, ["portfolio"], ORDER), ["portfolio"], ORDER, {"_cash": signed_cash()})
    by_ticker = ["portfolio", "ticker"]
    both = running(in_chunks(cash.drop("_chunk"), by_ticker, ORDER), by_ticker, ORDER, {"_held": signed_shares()})
    cost = F.col("shares") * F.col("price")
    reason = (
        F.when(~F.col("action").isin("BUY", "SELL"), "unknown action")
        .when((F.col("shares") <= 0) | (F.col("price") <= 0), "amounts must be positive")
        .when(_is_buy() & (cost > F.col("initial_cash") + F.col("_cash") - signed_cash() + SLACK), "not enough cash")
        .when(~_is_buy() & (F.col("shares") > F.col("_held") - signed_shares() + SLACK), "not enough shares")
    )
    return both.withColumn("reason", reason).filter("reason is not null").select(*trades.columns, "reason")


def valuation_history(trades: DataFrame, portfolios: DataFrame, bars: DataFrame, until) -> DataFrame:
    """Cash, holdings and total for every calendar day from creation (or first trade) to ``until``.

    Trades shrink to one row per (portfolio, ticker, day) first; grids hold
    one row per day, so windows are bounded by the calendar. Prices carry
    forward; a ticker without any price yet counts as zero.
    """
    end = F.lit(until).cast("date")
    daily = stage(trades.groupBy("portfolio", "ticker", "d").agg(F.sum(signed_shares()).alias("_q"), F.sum(signed_cash()).alias("_c")))
    first = daily.groupBy("portfolio").agg(F.min("d").alias("_first"))
    spans = portfolios.join(first, "portfolio", "left").withColumn("start", F.least("created", "_first"))
    days = spans.select("portfolio", "initial_cash", "start", F.explode(F.sequence("start", end)).alias("d"))
    flows = daily.groupBy("portfolio", "d").agg(F.sum("_c").alias("_c"))
    so_far = Window.partitionBy("portfolio").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    cash = days.join(flows, ["portfolio", "d"], "left").select(
        "portfolio", "d", (F.col("initial_cash") + F.sum(F.coalesce("_c", F.lit(0.0))).over(so_far)).alias("cash")
    )
    moved = daily.select("portfolio", "ticker", "d", "_q")
    # Days exist only between trades that leave shares: a closed position costs nothing.
    per_ticker = Window.partitionBy("portfolio", "ticker").orderBy("d")
    lots = moved.filter(F.col("d") <= end).select(
        "portfolio", "ticker", "d", F.sum("_q").over(per_ticker.rowsBetween(Window.unboundedPreceding, 0)).alias("_held"),
        F.coalesce(F.date_sub(F.lead("d").over(per_ticker), 1), end).alias("_until"),
    )
    held = lots.filter(F.abs("_held") > CLOSED_BELOW).select("portfolio", "ticker", F.explode(F.sequence("d", "_until")).alias("d"), "_held")
    known = bars.filter(F.col("close").isNotNull() & (F.col("d") >= spans.agg(F.min("start")).scalar()))
    priced = asof(held, known, ["ticker"], "d", "d", {"close": "_p"}, bounded=False)
    worth = priced.groupBy("portfolio", "d").agg(F.sum(F.col("_held") * F.col("_p")).alias("holdings_value"))
    return (
        cash.join(worth, ["portfolio", "d"], "left")
        .withColumn("holdings_value", F.coalesce("holdings_value", F.lit(0.0)))
        .withColumn("total_value", F.col("cash") + F.col("holdings_value"))
    )


def pop_last_trade(trades: DataFrame, portfolio: str) -> DataFrame:
    """The log without the last trade of one portfolio."""
    mine = F.col("portfolio") == portfolio
    last = trades.filter(mine).agg(F.max(F.struct("d", "seq"))).scalar()
    return trades.filter(F.coalesce(~mine | (F.struct("d", "seq") != last), F.lit(True)))
