"""Readers for event logs, trade logs, configuration and processing state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark import schemas
from quantspark.sources.market import file_key, folder_key, line_order, lines_of, numbered

_KEY = {"claims": "log_key", "theses": "ticker", "fundamentals": "ticker", "earnings_calls": "ticker", "macro": "series_key", "positions": "portfolio"}


def read_event_log(spark: SparkSession, kind: str, path: str, lines: bool = False) -> DataFrame:
    """Per-key logs (claims, theses, fundamentals, earnings_calls, macro, positions).

    A file is a JSON array, or with ``lines`` an entry per line: then a key may have many files, read in as
    many tasks as they have blocks. The key is the folder ``key=<key>``, else the file stem (the folder for
    positions); ``seq`` keeps the order in which entries were appended.
    """
    key, name, entry = folder_key() if kind == "positions" else file_key(), _KEY[kind], f"struct<{_fields(schemas.LOGS[kind])}>"
    if lines:
        rows = numbered(lines_of(spark, path, key, name), name).withColumn("e", F.from_json("line", entry))
    else:
        whole = spark.read.text(path, wholetext=True)
        rows = whole.select(key.alias(name), F.from_json("value", f"array<{entry}>").alias("items")).select(name, F.posexplode("items").alias("seq", "e"))
    out = rows.select(name, "seq", "e.*")
    if kind == "claims":
        empty = F.array().cast("array<string>")
        out = out.withColumns({
            "catalysts": F.coalesce("catalysts", empty), "invalidation": F.coalesce("invalidation", empty), "trade_worthy": F.coalesce("trade_worthy", F.lit(False)),
            "context": F.coalesce("context", F.lit("")), "source": F.coalesce("source", F.lit("")),
        })
    if kind == "macro":
        pair = F.transform("history", lambda p: F.struct(p[0].try_cast("date").alias("d"), p[1].try_cast("double").alias("value")))
        out = out.withColumn("period", F.coalesce("period", F.lit("week"))).withColumn("history", pair)
    return out


def _fields(ddl: str) -> str:
    """Top-level ``name type`` pairs as struct fields."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(ddl[start:i].strip())
            start = i + 1
    return ", ".join(p.replace(" ", ": ", 1) for p in parts)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trade logs, one or more files per portfolio folder. Old rows have six fields; missing note and rule are empty.

    ``seq`` is the row's place in the portfolio's log, from 1, the tie-break within a day.
    """
    raw = spark.read.csv(path, schema=schemas.TRADES, header=True, recursiveFileLookup=True)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = raw.select(
        folder_key().alias("portfolio"), F.col("date").alias("d"), "ticker", "action", "shares", "price", blank("note"), blank("rule"), line_order().alias("place")
    )
    return numbered(rows, "portfolio", 1).select("portfolio", "seq", "d", "ticker", "action", "shares", "price", "note", "rule")


def read_portfolios(spark: SparkSession, path: str) -> DataFrame:
    """Portfolio settings; rule settings stay a map of text."""
    meta = "name string, initial_cash double, created date, rules map<string, map<string, string>>"
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(folder_key().alias("portfolio"), F.from_json("value", meta).alias("m"))
    return rows.select("portfolio", "m.initial_cash", "m.created", "m.rules")


def _entries(spark: SparkSession, path: str, key: str, fields: str, lines: bool) -> DataFrame:
    """(key, e) of a JSON object key -> entry, or with ``lines`` of a line ``{"<key>": ..., "e": entry}`` per entry."""
    if lines:
        rows = spark.read.text(path, recursiveFileLookup=True).select(F.from_json("value", f"struct<{key}: string, e: {fields}>").alias("r"))
        return rows.select("r.*")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {fields}>")).alias(key, "e"))


def read_archive(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Article archive, link -> entry."""
    return _entries(spark, path, "link", f"struct<{_fields(schemas.ARCHIVE)}>", lines).select("link", "e.*")


def _config(spark: SparkSession, path: str) -> DataFrame:
    shape = (
        "universe map<string, struct<name: string, sector: string>>, "
        "news_sources array<struct<name: string, url: string, active: boolean, full_page_fetch: boolean>>"
    )
    return spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("c")).select("c.*")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Tracked companies (ticker, name, sector); sector defaults to "Other"."""
    rows = _config(spark, path).select(F.explode("universe").alias("ticker", "u"))
    return rows.select("ticker", "u.name", F.coalesce("u.sector", F.lit("Other")).alias("sector"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Active news sources in configured order with their full-page flag."""
    rows = _config(spark, path).select(F.posexplode("news_sources").alias("ord", "s")).filter(F.coalesce("s.active", F.lit(False)))
    return rows.select("ord", "s.name", "s.url", F.coalesce("s.full_page_fetch", F.lit(False)).alias("full_page_fetch"))


def read_attempted(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(link, ticker) pairs already processed."""
    return _entries(spark, path, "link", "array<string>", lines).select("link", F.explode("e").alias("ticker"))


def read_known_tickers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    if lines:
        return spark.read.text(path, recursiveFileLookup=True).withColumnRenamed("value", "ticker")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("ticker"))


def read_attempts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Aggregation attempts per ticker."""
    rows = _entries(spark, path, "ticker", "struct<consecutive_failures: int, last_attempt: date>", lines)
    return rows.select("ticker", "e.consecutive_failures", "e.last_attempt")


def read_earnings_checks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(ticker, earnings_date) already refreshed for."""
    return _entries(spark, path, "ticker", "string", lines).select("ticker", F.to_date("e").alias("earnings_date"))
