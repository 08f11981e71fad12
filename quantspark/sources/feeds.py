"""Readers for news feeds and headline search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.sources.market import file_key, lines_of, numbered

ARTICLE_COLUMNS = ["source", "title", "link", "published", "author", "summary", "content"]

_RSS = (
    "title string, link string, pubDate string, `dc:creator` string, description string, `content:encoded` string"
)
_ATOM = "title string, link struct<_href: string>, updated string, summary string"


def feed_time(text: Column) -> Column:
    """Mail-style or ISO time to UTC; NULL if neither."""
    plain = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    tries = [F.try_to_timestamp(plain, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z")]
    return F.coalesce(*tries, text.try_cast("timestamp"))


def _clean(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """Elements ``row`` of XML files as columns, with the file's key as ``source``.

    Files are split like lines of text at the elements' ends, so one file is read by as many tasks as it has blocks.
    """
    end = f"</{row}>"
    raw = spark.read.text(path, lineSep=end, recursiveFileLookup=True).select(file_key().alias("source"), F.regexp_extract("value", rf"(?s)<{row}[\s>].*", 0).alias("x"))
    parsed = F.from_xml(F.concat("x", F.lit(end)), schema, {"ignoreNamespace": "false"})
    return raw.filter("x <> ''").select("source", parsed.alias("r")).select("source", "r.*")


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files; the source is the file stem."""
    rows = _xml(spark, path, "item", _RSS)
    return rows.select(
        "source", _clean("title").alias("title"), _clean("link").alias("link"), feed_time(F.trim("pubDate")).alias("published"),
        _clean("`dc:creator`").alias("author"), _clean("description").alias("summary"), _clean("`content:encoded`").alias("content"),
    )


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files (regulatory filings); they carry no author and no full text."""
    rows = _xml(spark, path, "entry", _ATOM)
    return rows.select(
        "source", _clean("title").alias("title"), _clean("link._href").alias("link"), feed_time(F.trim("updated")).alias("published"),
        F.lit("").alias("author"), _clean("summary").alias("summary"), F.lit("").alias("content"),
    )


def read_feeds(spark: SparkSession, rss: str | None = None, atom: str | None = None) -> DataFrame:
    """Both kinds in one table, newest first. Articles are read once per link and source."""
    parts = [r(spark, p) for r, p in ((read_rss, rss), (read_atom, atom)) if p]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.orderBy(F.col("published").desc_nulls_last())


def read_headlines(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Search results with title, domain and date; ``ord`` keeps their relevance order.

    A file holds one answer, or with ``lines`` a result per line.
    """
    result = "struct<title: string, domain: string, seendate: string>"
    if lines:
        found = numbered(lines_of(spark, path, file_key(), "query"), "query")
        rows = found.select("query", F.col("seq").cast("int").alias("ord"), F.from_json("line", result).alias("a"))
    else:
        answers = spark.read.schema(f"articles array<{result}>").json(path, multiLine=True)
        rows = answers.select(file_key().alias("query"), F.posexplode("articles").alias("ord", "a"))
    full = rows.filter("coalesce(a.title, '') <> '' and coalesce(a.domain, '') <> '' and coalesce(a.seendate, '') <> ''")
    return full.select("query", "ord", "a.title", "a.domain", F.substring("a.seendate", 1, 8).alias("date"))
