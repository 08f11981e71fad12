"""Card feeds over claims, fundamentals, calls and narratives, and read / favourite marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.functions.text import stable_id

# Date and importance filters, and the display order of sectors.
DATE_FILTERS = {"1d": 1, "1w": 7, "1m": 30}
IMPORTANCE_FILTERS = {"8+": 8, "6+": 6, "4+": 4}
SECTOR_ORDER = [
    "Semiconductors", "Big Tech", "AI Infrastructure", "Futuristic",
    "Energy", "Commodities", "Crypto", "Defense & Aerospace",
]


def snapshot_cards(snapshots: DataFrame, kind: str) -> DataFrame:
    """Cards of a snapshot log (ticker, date, text); one id per ticker, kind and date."""
    return snapshots.select(
        stable_id(F.col("ticker"), F.lit(kind), F.col("date").cast("string")).alias("card_id"),
        F.lit(kind).alias("card_type"), "ticker", F.col("date"), F.col("text"),
    )


def claim_cards(claims: DataFrame) -> DataFrame:
    return claims.select(
        F.col("id").alias("card_id"), F.lit("claim").alias("card_type"), "ticker", F.col("created").alias("date"),
        F.col("claim").alias("text"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source"), "importance", "source_link",
    )


def with_summaries(cards: DataFrame, archive: DataFrame) -> DataFrame:
    """Attach the summary of the article behind each claim card."""
    side = archive.select(F.col("link").alias("source_link"), F.col("event.summary").alias("article_summary"))
    return cards.join(side, "source_link", "left")


def card_feed(*kinds: DataFrame) -> DataFrame:
    """All cards in one feed, newest first."""
    feed = kinds[0]
    for other in kinds[1:]:
        feed = feed.unionByName(other, allowMissingColumns=True)
    return feed.orderBy(F.col("date").desc(), "card_id")


def card_filter(feed: DataFrame, today, sources: list[str] | None = None, dates: str = "All", importance: str = "All", types: list[str] | None = None) -> DataFrame:
    """Type and date filters apply to every card, source and importance to claims only."""
    if types is not None:
        feed = feed.filter(F.col("card_type").isin(*types))
    if dates in DATE_FILTERS:
        feed = feed.filter(F.col("date") >= F.date_sub(F.lit(today).cast("date"), DATE_FILTERS[dates]))
    is_claim = F.col("card_type") == "claim"
    if sources is not None:
        feed = feed.filter(~is_claim | F.coalesce(F.col("source").isin(*sources), F.lit(False)))
    if importance in IMPORTANCE_FILTERS:
        feed = feed.filter(~is_claim | (F.col("importance") >= IMPORTANCE_FILTERS[importance]))
    return feed


def marked(changes: DataFrame) -> DataFrame:
    """Cards whose last change is a mark, per user. ``changes`` is (kind, user_id, card, op, ts, seq)."""
    keys = [c for c in ("kind", "user_id", "card") if c in changes.columns]
    last = changes.groupBy(*keys).agg(F.max_by("op", F.struct("ts", "seq")).alias("op"))
    return last.filter("op = 'mark'").select(*keys)


def unread(cards: DataFrame, read: DataFrame) -> DataFrame:
    return cards.join(read.select(F.col("card").alias("card_id")), "card_id", "left_anti")


def only_marked(cards: DataFrame, marks: DataFrame) -> DataFrame:
    return cards.join(marks.select(F.col("card").alias("card_id")), "card_id", "left_semi")


def sector_groups(universe: DataFrame) -> DataFrame:
    """Tickers by display name within each sector; listed sectors first, then the others as they appear.

    ``universe`` is the configured list (ticker, name, sector).
    """
    order = F.array_position(F.array(*[F.lit(s) for s in SECTOR_ORDER]), F.col("sector"))
    return (
        universe.withColumn("sector", F.coalesce("sector", F.lit("Other")))
        .groupBy("sector")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("name", "ticker"))), lambda t: t["ticker"]).alias("tickers"), F.min("name").alias("_first"))
        .withColumn("_o", F.coalesce(F.nullif(order, F.lit(0)), F.lit(len(SECTOR_ORDER) + 1)))
        .orderBy("_o", "_first")
        .drop("_o", "_first")
    )


def universe(picks: DataFrame, excluded: list[str]) -> DataFrame:
    """First name per ticker over the categories kept; ``picks`` is (category, name, ticker, ord)."""
    return picks.filter(~F.col("category").isin(*excluded)).groupBy("ticker").agg(F.min_by("name", "ord").alias("name"))


def name_pairs(universe: DataFrame) -> DataFrame:
    """(name, ticker) pairs under which a ticker may be met: its display name and itself."""
    return universe.select("name", "ticker").union(universe.select("ticker", "ticker")).distinct()


def display_names(pairs: DataFrame) -> DataFrame:
    """One name per ticker: the first real name, else the ticker itself."""
    rank = F.struct((F.col("name") == F.col("ticker")).alias("bare"), "name")
    return pairs.groupBy("ticker").agg(F.min_by("name", rank).alias("name"))
