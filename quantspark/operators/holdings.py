"""Institutional holdings: aggregation of filings, company lookup and holder histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.operators.lookup import holding
from quantspark.session import stage


def join_filings(info: DataFrame, submissions: DataFrame) -> DataFrame:
    """Common-stock lines with the filer and period of their submission."""
    return info.filter(F.col("class") == "COM").join(submissions, "accession", "left")


def cusip_aggregate(lines: DataFrame) -> DataFrame:
    """Per (bucket, cusip, period): usual name, shares, value and distinct filings.

    Filings combine before they are counted and names before they are
    compared, so a hot issue shrinks on the map side. The usual name is the
    most frequent one, ties by spelling.
    """
    keys = ["bucket_end", "cusip", "period"]
    known = lines.filter("period is not null")
    per_filing = known.groupBy(*keys, "accession").agg(F.sum("shares").alias("shares"), F.sum("value").alias("value"))
    totals = per_filing.groupBy(*keys).agg(
        F.sum("shares").alias("total_shares"), F.sum("value").alias("total_value"), F.count("*").alias("num_filers")
    )
    names = known.filter("name is not null").groupBy(*keys, "name").agg(F.count("*").alias("n"))
    usual = names.groupBy(*keys).agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"))
    return totals.join(usual, keys, "left").withColumn("name", F.coalesce("name", F.lit("")))


def holder_aggregate(lines: DataFrame) -> DataFrame:
    return lines.filter("period is not null").groupBy("bucket_end", "cusip", "cik", "period").agg(F.sum("shares").alias("shares"), F.sum("value").alias("value"))


def vintages(buckets: DataFrame, quarters: int, buffer: int = 2) -> DataFrame:
    """For every bucket end, the ``quarters + buffer`` newest buckets known then.

    Returns (vintage, bucket_end, age); age zero is the newest. Buckets are
    one per filing quarter, so the unpartitioned window is tiny.
    """
    ends = buckets.select("bucket_end").distinct()
    recent = F.collect_list("bucket_end").over(Window.orderBy("bucket_end").rowsBetween(1 - quarters - buffer, 0))
    return ends.withColumn("_known", recent).select(
        F.col("bucket_end").alias("vintage"), F.posexplode(F.reverse("_known")).alias("age", "bucket_end")
    )


def resolve_cusip(aggregate: DataFrame, companies: dict[str, str] | DataFrame, by: list[str]) -> DataFrame:
    """Per company, the cusip with the largest value whose usual name holds the company's first word.

    A table of companies (``ticker``, ``name``; one row per ticker) may have any size: the distinct first words
    look their names up in an index, and companies join the answer of their word. A few companies from
    configuration (a dict) travel as a constant array inside the expression instead.
    """
    if isinstance(companies, DataFrame):
        first = F.regexp_extract(F.upper("name"), r"\S+", 0)
        named = companies.select("ticker", first.alias("_word"))
        names = holding(aggregate.select("name").distinct(), F.upper("name"), named.select(F.col("_word").alias("needle"), F.col("_word").alias("value")))
        found = aggregate.select(*by, "cusip", "total_value", "name").join(names.select("name", F.explode("found").alias("_word")), "name")
        totals = found.groupBy(*by, "_word", "cusip").agg(F.sum("total_value").alias("_v"))
        best = totals.groupBy(*by, "_word").agg(F.min_by("cusip", F.struct(-F.col("_v"), F.col("cusip"))).alias("cusip"))
        return best.join(named, "_word").select(*by, "ticker", "cusip")
    tokens = F.array(*[F.struct(F.lit(t).alias("ticker"), F.lit(name.upper().split()[0]).alias("token")) for t, name in sorted(companies.items())])
    hits = F.filter(tokens, lambda c: F.contains(F.upper(F.col("name")), c["token"]))
    found = aggregate.select(*by, "cusip", "total_value", F.explode(hits).alias("c"))
    totals = found.groupBy(*by, F.col("c.ticker").alias("ticker"), "cusip").agg(F.sum("total_value").alias("_v"))
    return totals.groupBy(*by, "ticker").agg(F.min_by("cusip", F.struct(-F.col("_v"), F.col("cusip"))).alias("cusip"))


def institutional_history(
    cusips: DataFrame, holders: DataFrame, companies: dict[str, str] | DataFrame, known: DataFrame, quarters: int = 5, top: int = 10
) -> DataFrame:
    """Top holders' position and mean change per quarter, for each vintage of known buckets.

    ``known`` is (vintage, bucket_end, age). Companies resolve against the
    newest bucket only; a period seen in several buckets uses the one with
    most filers; a holder without a prior position counts as +100 %.
    """
    seen = cusips.join(F.broadcast(known), "bucket_end")
    resolved = resolve_cusip(seen.filter("age = 0"), companies, ["vintage"])
    mine = seen.join(resolved, ["vintage", "cusip"])
    primary = mine.groupBy("vintage", "ticker", "cusip", "period").agg(
        F.min_by("bucket_end", F.struct(-F.col("num_filers"), F.col("age"))).alias("bucket_end")
    )
    order = Window.partitionBy("vintage", "ticker").orderBy(F.col("period").desc())
    kept = (
        primary.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= quarters + 1)
        .withColumn("prior_period", F.lead("period").over(order))
    )
    # A few rows per vintage and company, used by both sides of the comparison.
    kept = stage(kept)
    rows = holders.join(kept.select("vintage", "ticker", "cusip", "period", "prior_period", "bucket_end"), ["cusip", "period", "bucket_end"])
    largest = F.row_number().over(Window.partitionBy("vintage", "ticker", "period").orderBy(F.col("shares").desc(), "cik"))
    current = rows.filter("prior_period is not null").withColumn("_r", largest).filter(F.col("_r") <= top)
    before = rows.select("vintage", "ticker", "cik", F.col("period").alias("prior_period"), F.col("shares").alias("_before"))
    change = F.when(F.col("_before") > 0, (F.col("shares") / F.col("_before") - 1) * 100).otherwise(100.0)
    return (
        current.join(before, ["vintage", "ticker", "cik", "prior_period"], "left")
        .groupBy("vintage", "ticker", "period")
        .agg(
            F.sum("shares").alias("total_shares"), F.sum("value").alias("total_value"),
            F.count("*").alias("num_filers"), F.avg(change).alias("pct_change"),
        )
    )


def institutional_flow_timeline(cusips: DataFrame, holders: DataFrame, companies: dict[str, str]) -> DataFrame:
    """Latest quarter's mean holder change per ticker, from each bucket end onward."""
    known = vintages(cusips, quarters=1)
    history = institutional_history(cusips, holders, companies, known, quarters=1)
    latest = history.groupBy("ticker", F.col("vintage").alias("d")).agg(F.max_by("pct_change", "period").alias("institutional_flow"))
    # A vintage in which a company does not resolve hides the older value.
    every = known.select(F.col("vintage").alias("d")).distinct().select(
        "d", F.explode(F.array(*[F.lit(t) for t in sorted(companies)])).alias("ticker")
    )
    return every.join(latest, ["ticker", "d"], "left")
