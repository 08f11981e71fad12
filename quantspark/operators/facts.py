"""Bitemporal company facts: dedup, derived quarters and trailing values as known at a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.operators.asof import asof
from quantspark.operators.pit import split_factor

# Day ranges of a fiscal quarter and a fiscal year.
QUARTER_DAYS, YEAR_DAYS = (80, 100), (350, 380)


def _duration(lo_hi):
    return F.datediff("end_d", "start_d").between(*lo_hi)


def quarterly_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(_duration(QUARTER_DAYS))


def annual_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(_duration(YEAR_DAYS))


def keep_one(df: DataFrame, keys: list[str], order: list, last: bool = True) -> DataFrame:
    """One whole row per key: the last (or first) by ``order``. Aggregates, so hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    rows = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return rows.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(df.columns)


def dedup_facts(facts: DataFrame) -> DataFrame:
    """The last filed row per (ticker, concept, period, form, fiscal labels); ties by tag."""
    keys = [c for c in ("ticker", "concept", "start_d", "end_d", "form", "fy", "fp") if c in facts.columns]
    return keep_one(facts, keys, [c for c in ("filed", "tag", "val") if c in facts.columns])


def first_filed(facts: DataFrame, keys: list[str]) -> DataFrame:
    return keep_one(facts, keys, ["filed", "val"], last=False)


def derived_quarters(facts: DataFrame) -> DataFrame:
    """The missing quarter of each fiscal year that reports exactly three.

    Periods use their earliest filing; a quarter belongs to the year that
    contains its dates. Rows per (ticker, concept) are bounded by its periods.
    """
    key = ["ticker", "concept"]
    quarters = first_filed(quarterly_facts(facts), [*key, "start_d", "end_d"]).select(
        *key, F.col("start_d").alias("_qs"), F.col("end_d").alias("_qe"), F.col("val").alias("_qv")
    )
    years = first_filed(annual_facts(facts), [*key, "start_d", "end_d"])
    inside = years.join(quarters, key).filter("_qs >= start_d and _qe <= end_d")
    return (
        inside.groupBy(*key, "start_d", "end_d", "val", "filed")
        .agg(F.count("*").alias("_n"), F.max("_qe").alias("_last"), F.sum("_qv").alias("_sum"))
        .filter("_n = 3")
        .select(*key, F.col("_last").alias("start_d"), "end_d", (F.col("val") - F.col("_sum")).alias("val"), "filed", F.lit("derived").alias("form"))
    )


def fact_history(facts: DataFrame) -> DataFrame:
    """Deduplicated facts plus derived quarters."""
    clean = dedup_facts(facts)
    return clean.unionByName(derived_quarters(clean), allowMissingColumns=True)


def ttm_timeline(history: DataFrame) -> DataFrame:
    """Trailing-twelve-month sum per (ticker, concept) at each filing date that may change it.

    At a filing date the four latest quarters then known count, each by its
    earliest filing. Dates in between carry the last entry.
    """
    key = ["ticker", "concept"]
    quarters = first_filed(quarterly_facts(history), [*key, "end_d"])
    dates = quarters.select(*key, F.col("filed").alias("d")).distinct()
    known = dates.join(quarters.select(*key, "end_d", "val", "filed"), key).filter("filed <= d")
    newest = F.row_number().over(Window.partitionBy(*key, "d").orderBy(F.col("end_d").desc()))
    return (
        known.withColumn("_n", newest)
        .filter("_n <= 4")
        .groupBy(*key, "d")
        .agg(F.when(F.count("*") == 4, F.sum("val")).alias("ttm"))
    )


def instant_timeline(history: DataFrame) -> DataFrame:
    """Value of the latest period known at each filing date, by that period's earliest filing."""
    key = ["ticker", "concept"]
    rows = first_filed(history, [*key, "end_d"])
    upto = Window.partitionBy(*key).orderBy("filed").rangeBetween(Window.unboundedPreceding, 0)
    newest = rows.withColumn("_best", F.max(F.struct("end_d", "val")).over(upto))
    return newest.groupBy(*key, F.col("filed").alias("d")).agg(F.max("_best.val").alias("value"))


def adjust_for_splits(history: DataFrame, splits: DataFrame, concepts: dict[str, str]) -> DataFrame:
    """Scale per-share (``divide``) or share-count (``multiply``) facts by splits after each period end."""
    out = split_factor(history, splits, on="end_d", out="_f")
    scaled = F.col("val")
    for concept, how in concepts.items():
        factor = 1 / F.col("_f") if how == "divide" else F.col("_f")
        scaled = F.when(F.col("concept") == concept, F.col("val") * factor).otherwise(scaled)
    return out.withColumn("val", scaled).drop("_f").select(history.columns)


def ttm_as_of(grid: DataFrame, history: DataFrame, out: str = "ttm") -> DataFrame:
    """TTM known at each grid date; ``grid`` is (ticker, concept, date)."""
    return asof(grid, ttm_timeline(history), ["ticker", "concept"], "date", "d", {"ttm": out})


def yoy_ttm(grid: DataFrame, history: DataFrame) -> DataFrame:
    """TTM now against the TTM known one year earlier, in percent."""
    timeline = ttm_timeline(history)
    now = asof(grid, timeline, ["ticker", "concept"], "date", "d", {"ttm": "ttm"})
    both = asof(now.withColumn("_ago", F.add_months("date", -12)), timeline, ["ticker", "concept"], "_ago", "d", {"ttm": "ttm_prior"})
    growth = (F.try_divide("ttm", "ttm_prior") - 1) * 100
    return both.drop("_ago").withColumn("yoy_pct", F.when(F.col("ttm_prior") != 0, growth))
