"""Trading rules for many portfolios at once: candidates, exits, ranked entries and greedy fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.operators.timeseries import calendar, daily_returns
from quantspark.session import stage

#: Columns of a rule configuration row.
RULE_CONFIG = "rule string, rule_order int, top_n int, hold_days int, unit_size double, exit_on_signal_loss boolean"


def business_gap_is_empty(as_of: Column, report: Column) -> Column:
    """No weekday lies strictly between the two dates."""
    between = F.when(F.datediff(report, as_of) >= 2, F.sequence(F.date_add(as_of, 1), F.date_sub(report, 1)))
    return F.coalesce(F.size(F.filter(between, lambda d: F.weekday(d) < 5)) == 0, F.lit(True))


def dip_candidates(bars: DataFrame, as_of, drop: float = 0.05) -> DataFrame:
    """Tickers that fell by ``drop`` on ``as_of``; empty unless that is a trading day of the frame."""
    today = F.lit(as_of).cast("date")
    # The date filter reaches the scan of the bars; ten days of them are then staged for both uses.
    recent = stage(bars.filter((F.col("d") <= today) & (F.col("d") >= F.date_sub(today, 10))))
    return (
        daily_returns(recent, calendar(recent))
        .filter((F.col("d") == today) & (F.col("ret") <= -drop))
        .select("ticker", F.abs("ret").alias("score"))
    )


def streak_candidates(earnings: DataFrame, as_of, low: float = 0.0, high: float = 2.0) -> DataFrame:
    """Two mild beats in a row, on the last business day before the next report.

    Scored by closeness to the middle of the range, at least 0.01.
    """
    today = F.lit(as_of).cast("date")
    middle, half = (low + high) / 2, max((high - low) / 2, 1e-9)
    upcoming = earnings.filter(F.to_date("earnings_date") > today).groupBy("ticker").agg(F.min(F.to_date("earnings_date")).alias("_next"))
    due = upcoming.filter(business_gap_is_empty(today, F.col("_next")))
    past = earnings.join(due, "ticker").filter((F.to_date("earnings_date") < F.col("_next")) & F.col("reported_eps").isNotNull())
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("earnings_date").desc()))
    two = past.withColumn("_r", back).filter("_r <= 2").groupBy("ticker").agg(
        F.count("surprise_pct").alias("_c"), F.min("surprise_pct").alias("_lo"), F.max("surprise_pct").alias("_hi"), F.avg("surprise_pct").alias("_avg")
    )
    score = F.greatest(1.0 - F.abs(F.col("_avg") - middle) / half, F.lit(0.01))
    return two.filter((F.col("_c") == 2) & (F.col("_lo") >= low) & (F.col("_hi") <= high)).select("ticker", score.alias("score"))


def rule_exits(held: DataFrame, candidates: DataFrame, config: DataFrame, as_of) -> DataFrame:
    """Positions to sell: held long enough, or no longer a candidate of a rule that needs it.

    ``held`` is (portfolio, rule, ticker, shares, avg_cost, entry_date);
    ``candidates`` is (rule, ticker, score).
    """
    today = F.lit(as_of).cast("date")
    live = candidates.select("rule", "ticker", F.lit(True).alias("_live")).distinct()
    expired = F.datediff(today, "entry_date") >= F.col("hold_days")
    dropped = F.col("exit_on_signal_loss") & F.col("_live").isNull()
    return (
        held.join(config, "rule")
        .join(live, ["rule", "ticker"], "left")
        .filter(expired | dropped)
        .select("portfolio", "rule", "ticker", "shares", "avg_cost", F.when(expired, "max hold reached").otherwise("no longer qualifies").alias("reason"))
    )


def ranked_entries(portfolios: DataFrame, held: DataFrame, candidates: DataFrame, config: DataFrame) -> DataFrame:
    """Fresh candidates within each rule's free slots and their percentile within the rule."""
    mine = held.groupBy("portfolio", "rule").agg(F.count("*").alias("_held"))
    # Of a rule's best ``top_n`` at most as many are held as slots are taken, so no later one can be bought.
    best = F.row_number().over(Window.partitionBy("rule").orderBy(F.col("score").desc(), "ticker"))
    offers = candidates.join(config, "rule").withColumn("_best", best).filter("_best <= top_n").drop("_best")
    open_slots = (
        portfolios.select("portfolio", F.explode(config.agg(F.collect_list("rule")).scalar()).alias("rule"))
        .join(mine, ["portfolio", "rule"], "left")
    )
    fresh = (
        open_slots.join(offers, "rule")
        .withColumn("_slots", F.col("top_n") - F.coalesce("_held", F.lit(0)))
        .join(held.select("portfolio", "rule", "ticker"), ["portfolio", "rule", "ticker"], "left_anti")
    )
    within = Window.partitionBy("portfolio", "rule")
    ranked = fresh.withColumn("_r", F.row_number().over(within.orderBy(F.col("score").desc(), "ticker"))).filter("_r <= _slots")
    n = F.count("*").over(within)
    return ranked.withColumn("percentile", F.when(n > 1, 1.0 - (F.col("_r") - 1) / n).otherwise(1.0)).select(
        "portfolio", "rule", "rule_order", "ticker", "score", "percentile", "unit_size", F.col("_r").alias("rank")
    )


def greedy_fill(entries: DataFrame, cash: DataFrame) -> DataFrame:
    """Walk entries by percentile and take each whose unit fits the cash left, skipping the rest.

    An order-dependent fold per portfolio. Its list is bounded by the sum of
    the rules' slots, so it stays small whatever the log holds.
    """
    sort_key = F.struct((-F.col("percentile")).alias("p"), "rule_order", "rank", "rule", "ticker", "score", "unit_size", "price")
    lists = entries.filter("price is not null").groupBy("portfolio").agg(F.sort_array(F.collect_list(sort_key)).alias("_list"))
    start = F.struct(F.col("cash").alias("left"), F.filter("_list", lambda _: F.lit(False)).alias("taken"))

    def step(state, entry):
        fits = entry["unit_size"] <= state["left"] + 1e-6
        return F.when(
            fits, F.struct((state["left"] - entry["unit_size"]).alias("left"), F.concat(state["taken"], F.array(entry)).alias("taken"))
        ).otherwise(state)

    done = lists.join(cash.select("portfolio", "cash"), "portfolio").withColumn("_end", F.aggregate("_list", start, step))
    bought = done.select("portfolio", F.explode("_end.taken").alias("e"))
    return bought.select(
        "portfolio", "e.rule", "e.ticker", (F.col("e.unit_size") / F.col("e.price")).alias("shares"), F.col("e.price").alias("price"), F.col("e.score").alias("score")
    )


def rule_entries(portfolios: DataFrame, held: DataFrame, candidates: DataFrame, config: DataFrame, prices: DataFrame, cash: DataFrame) -> DataFrame:
    """Purchases of one day for every portfolio from its shared cash."""
    ranked = ranked_entries(portfolios, held, candidates, config)
    return greedy_fill(ranked.join(prices.select("ticker", "price"), "ticker", "left"), cash)


def rule_day(portfolios: DataFrame, held: DataFrame, candidates: DataFrame, config: DataFrame, prices: DataFrame, cash: DataFrame, as_of) -> DataFrame:
    """Trades of one day for all portfolios: exits first, then entries from the cash and slots they free.

    A position without a price today is not sold; a ticker sold today may be bought again.
    """
    due = rule_exits(held, candidates, config, as_of)
    sold = stage(due.join(prices.select("ticker", "price"), "ticker").filter("price is not null"))
    left = held.join(sold.select("portfolio", "rule", "ticker"), ["portfolio", "rule", "ticker"], "left_anti")
    freed = sold.groupBy("portfolio").agg(F.sum(F.col("shares") * F.col("price")).alias("_freed"))
    money = cash.join(freed, "portfolio", "left").select("portfolio", (F.col("cash") + F.coalesce("_freed", F.lit(0.0))).alias("cash"))
    bought = rule_entries(portfolios, left, candidates, config, prices, money)
    row = ["portfolio", "rule", "ticker", "action", "shares", "price", "reason"]
    sales = sold.withColumn("action", F.lit("SELL")).select(*row)
    return sales.unionByName(bought.withColumn("action", F.lit("BUY")).withColumn("reason", F.lit(None).cast("string")).select(*row))
