"""Article intake: text, gates, ordering and what is still to be processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.functions.text import FILING_PREFIX, known_ticker, mentions, prefix_title, strip_html
from quantspark.operators.lookup import holding

# Fixed values.
MIN_FULL_TEXT_CHARS, MIN_IMPORTANCE, BACKFILL_DAYS, MAX_AGE_MONTHS = 500, 3, 90, 6


def concat_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds in one table, newest first. Filing feeds carry their ticker in the title."""
    both = feeds[0]
    for feed in feeds[1:]:
        both = both.unionByName(feed, allowMissingColumns=True)
    ticker = known_ticker(F.col("source"))
    titled = both.withColumn("title", F.when(ticker.isNotNull(), prefix_title(ticker, F.col("title"))).otherwise(F.col("title")))
    return titled.orderBy(F.col("published").desc_nulls_last())


def recent_articles(articles: DataFrame, as_of) -> DataFrame:
    """At most six months old; undated ones stay."""
    oldest = F.add_months(F.lit(as_of).cast("date"), -MAX_AGE_MONTHS)
    return articles.filter(F.col("published").isNull() | (F.col("published") >= oldest))


def article_date(as_of) -> Column:
    return F.coalesce(F.to_date("published"), F.lit(as_of).cast("date"))


def article_order(articles: DataFrame, sources: list[str]) -> DataFrame:
    """Configured source order (others, such as filings, last), newest first within a source."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source")), F.lit(0)), F.lit(len(sources) + 1))
    return articles.withColumn("source_rank", rank).orderBy("source_rank", F.col("published").desc_nulls_last())


def needs_full_text(text: Column, source: Column, flagged: list[str]) -> Column:
    return (F.length(text) < MIN_FULL_TEXT_CHARS) & source.isin(*flagged)


def article_text(articles: DataFrame, flagged: list[str] = (), pages: DataFrame | None = None) -> DataFrame:
    """Plain text of the content, else the summary; thin articles of flagged sources use the landed page text."""
    body = F.coalesce(F.nullif("content", F.lit("")), F.col("summary"), F.lit(""))
    out = articles.withColumn("text", strip_html(body))
    if pages is None:
        return out
    full = pages.select("link", F.col("text").alias("_page"))
    use = needs_full_text(F.col("text"), F.col("source"), list(flagged)) & (F.coalesce("_page", F.lit("")) != "")
    return out.join(full, "link", "left").withColumn("text", F.when(use, F.col("_page")).otherwise(F.col("text"))).drop("_page")


def mentioning(articles: DataFrame, universe: dict[str, str]) -> DataFrame:
    """Articles that name a tracked company, or come from a company's own filings.

    A native filter kept upstream of anything expensive.
    """
    text = F.concat_ws(" ", "title", "text")
    return articles.filter(F.col("source").startswith(FILING_PREFIX) | mentions(text, universe))


def event_gate(events: DataFrame) -> DataFrame:
    return events.filter((F.col("novel")) & (F.col("importance") >= MIN_IMPORTANCE) & (F.size("companies") > 0))


def missing_summary(archive: DataFrame) -> DataFrame:
    """Classified articles that have text but no stored summary."""
    blank = F.coalesce("event.summary", F.lit("")) == ""
    return archive.filter(F.col("event").isNotNull() & (F.coalesce("text", F.lit("")) != "") & blank)


def new_pairs(events: DataFrame, attempted: DataFrame) -> DataFrame:
    """One row per (article, company) not tried before."""
    pairs = events.withColumn("ticker", F.explode("companies"))
    return pairs.join(attempted.select("link", "ticker"), ["link", "ticker"], "left_anti")


def new_tickers(universe: DataFrame, known: DataFrame) -> DataFrame:
    return universe.join(known.select("ticker"), "ticker", "left_anti")


def orphan_claims(claims: DataFrame, theses: DataFrame, attempts: DataFrame, max_failures: int = 3) -> DataFrame:
    """Tickers with claims but no thesis and fewer than ``max_failures`` failed attempts in a row."""
    tired = attempts.filter(F.col("consecutive_failures") >= max_failures)
    return (
        claims.select("ticker").distinct()
        .join(theses.select("ticker"), "ticker", "left_anti")
        .join(tired.select("ticker"), "ticker", "left_anti")
    )


def backfill_candidates(archive: DataFrame, added: DataFrame, attempted: DataFrame, as_of) -> DataFrame:
    """Recent archived articles whose text holds a newly added ticker or its name, without regard to case.

    ``added`` (``ticker``, ``name``) may have any size; articles meet only companies that an index of their
    text proposes. One row per article and ticker.
    """
    recent = archive.filter(F.col("article_date") >= F.date_sub(F.lit(as_of).cast("date"), BACKFILL_DAYS))
    body = F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("title", F.lit(""))))
    needles = added.select(F.explode(F.array(F.lower("ticker"), F.lower("name"))).alias("needle"), F.col("ticker").alias("value"))
    pairs = holding(recent, body, needles).withColumn("ticker", F.explode("found")).drop("found")
    return pairs.join(attempted.select("link", "ticker"), ["link", "ticker"], "left_anti")


def transcript_index(pages: DataFrame) -> DataFrame:
    """Newest transcript link per ticker found in listing pages (``html`` column)."""
    from quantspark.functions.text import TRANSCRIPT_PATH, ticker_from_slug

    paths = pages.select(F.explode(F.regexp_extract_all("html", F.lit(TRANSCRIPT_PATH), F.lit(0))).alias("path"))
    part = lambda i: F.regexp_extract("path", TRANSCRIPT_PATH, i)
    rows = paths.select("path", F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-MM-dd")).cast("date").alias("transcript_date"), ticker_from_slug(part(4)).alias("ticker"))
    return rows.filter("ticker is not null and transcript_date is not null").groupBy("ticker").agg(
        F.max("transcript_date").alias("transcript_date"), F.max_by("path", F.struct("transcript_date", "path")).alias("path")
    )


def new_transcripts(index: DataFrame, stored: DataFrame) -> DataFrame:
    """Index entries whose link differs from the ticker's latest stored one."""
    latest = stored.groupBy("ticker").agg(F.max_by("transcript_url", F.struct("date", "seq")).alias("_url"))
    return index.join(latest, "ticker", "left").filter(~F.col("path").eqNullSafe(F.col("_url"))).drop("_url")
