"""Readers for landed price, earnings, ownership and analyst files.

Per-ticker files carry their ticker in the file name; missing numbers become
NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantspark import schemas


#: The folder of a key whose rows lie in several files, as Spark's writers make it.
KEYED = r"/key=([^/]*)/"


def _landed(named: Column) -> Column:
    """The value of a ``key=<value>`` folder on the row's path, else what the file or folder is named."""
    keyed = F.regexp_extract(F.col("_metadata.file_path"), KEYED, 1)
    return F.when(keyed != "", keyed).otherwise(named)


def file_key(suffix: str = "") -> Column:
    """The row's key, e.g. its ticker: a ``key=`` folder of files, or the stem of a file of its own."""
    return _landed(F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+?){suffix}\.[^./]+$", 1))


def folder_key() -> Column:
    return _landed(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def line_order() -> Column:
    """Place of a row among all lines of its key: file, block of the file, place in the block.

    Files of a key are named in order, and a file that is read in several blocks gives them ascending starts.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")
    )


def lines_of(spark: SparkSession, path: str, key: Column, name: str) -> DataFrame:
    """(key, line, place) of line-delimited files, read in as many tasks as they have blocks."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(key.alias(name), F.col("value").alias("line"), line_order().alias("place"))


def numbered(rows: DataFrame, key: str, start: int = 0) -> DataFrame:
    """``seq`` for ``place``: the row's number within its key. A hot key is numbered in chunks."""
    from quantspark.operators.ordered import in_chunks, running

    flat = rows.select("*", "place.*").drop("place")
    order = ["file", "start", "row"]
    counted = running(in_chunks(flat, [key], order), [key], order, {"seq": F.lit(1)})
    return counted.withColumn("seq", F.col("seq") - 1 + start).drop(*order, "_chunk")


def _number(c: str | Column) -> Column:
    value = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(value), value)


def _csv(spark: SparkSession, path: str, schema: str, sep: str = ",", **options) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=sep, recursiveFileLookup=True, **{"enforceSchema": False, **options})


def _wide(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Wide frame (first column the time, one column per ticker) as long rows with a value."""
    raw = spark.read.csv(path, header=True)
    time, *tickers = raw.columns
    long = raw.select(F.col(f"`{time}`").alias("t"), *[_number(F.col(f"`{c}`")).alias(c) for c in tickers])
    return long.unpivot(["t"], [F.col(f"`{c}`") for c in tickers], "ticker", value).filter(F.col(value).isNotNull())


def read_prices(spark: SparkSession, path: str, value: str = "close") -> DataFrame:
    """Wide daily CSV to (ticker, d, close)."""
    return _wide(spark, path, value).select("ticker", F.to_date("t").alias("d"), value)


def read_ohlcv(spark: SparkSession, path: str) -> DataFrame:
    """Long bars from parquet; each field is a column projection of it."""
    return spark.read.schema(schemas.BARS).parquet(path)


def read_intraday(spark: SparkSession, path: str, zone: str = "America/New_York") -> DataFrame:
    """Wide intraday CSV with mixed UTC offsets: instants in ``ts`` and wall clock in ``local``."""
    rows = _wide(spark, path, "close").withColumn("ts", F.to_timestamp("t"))
    return rows.select("ticker", "ts", F.from_utc_timestamp("ts", zone).alias("local"), "close")


def read_earnings(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Reports oldest first; the newest ``limit`` per ticker if given."""
    rows = _csv(spark, path, "earnings_date timestamp, eps_estimate double, reported_eps double, surprise_pct double")
    rows = rows.select(file_key().alias("ticker"), "earnings_date", *[_number(c).alias(c) for c in ("eps_estimate", "reported_eps", "surprise_pct")])
    if limit is not None:
        newest = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("earnings_date").desc()))
        rows = rows.withColumn("_n", newest).filter(F.col("_n") <= limit).drop("_n")
    return rows.orderBy("ticker", "earnings_date")


def read_insider(spark: SparkSession, path: str) -> DataFrame:
    """Insider filings, newest first."""
    rows = _csv(spark, path, "insider string, position string, transaction string, start_date date, shares double, value double, ownership string")
    return rows.select(
        file_key().alias("ticker"), "insider", "position", "transaction", "start_date", _number("shares").alias("shares"), _number("value").alias("value"), "ownership"
    ).orderBy("ticker", F.col("start_date").desc())


def read_holders(spark: SparkSession, institutions: str, funds: str) -> DataFrame:
    """Institutions and funds in one table, tagged by type."""
    shape = "holder string, date_reported date, pct_held double, shares double, value double, pct_change double"

    def side(path: str, kind: str) -> DataFrame:
        rows = _csv(spark, path, shape)
        numbers = [_number(c).alias(c) for c in ("pct_held", "shares", "value", "pct_change")]
        return rows.select(file_key().alias("ticker"), "holder", F.lit(kind).alias("holder_type"), "date_reported", *numbers)

    return side(institutions, "institution").unionByName(side(funds, "fund"))


MAJOR_HOLDERS = ["insidersPercentHeld", "institutionsPercentHeld", "institutionsFloatPercentHeld", "institutionsCount"]


def read_major_holders(spark: SparkSession, path: str) -> DataFrame:
    """Breakdown rows (name, value) to one row per ticker."""
    rows = _csv(spark, path, "breakdown string, value double").withColumn("ticker", file_key())
    return rows.groupBy("ticker").pivot("breakdown", MAJOR_HOLDERS).agg(F.first("value"))


def read_stock_info(spark: SparkSession, path: str) -> DataFrame:
    """Schemaless snapshot per ticker as a map of text."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)  # one small object per ticker
    return rows.select(file_key().alias("ticker"), F.from_json("value", "map<string,string>").alias("info"))


def read_rec_trend(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path, "period string, strongBuy int, buy int, hold int, sell int, strongSell int")
    return rows.select(file_key().alias("ticker"), "*")


def read_analyst_actions(spark: SparkSession, path: str) -> DataFrame:
    """Dated actions; a missing target is 0. ``seq`` is the row's place among those of its ticker, from 1."""
    shape = "grade_date timestamp, firm string, to_grade string, from_grade string, action string, current_price_target double"
    target = F.coalesce(_number("current_price_target"), F.lit(0.0))
    rows = _csv(spark, path, shape, enforceSchema=True).select(
        file_key().alias("ticker"), "grade_date", "firm", "to_grade", "from_grade", "action", target.alias("target"), line_order().alias("place")
    )
    return numbered(rows, "ticker", 1)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path, "split_d date, ratio double")
    return rows.select(file_key().alias("ticker"), "split_d", "ratio").filter("ratio is not null")


def read_fred(spark: SparkSession, path: str) -> DataFrame:
    """Two-column series; a dot marks a missing value. The key is the file stem."""
    rows = spark.read.csv(path, schema="d date, raw string", header=True, recursiveFileLookup=True)
    return rows.select(file_key().alias("key"), "d", F.col("raw").try_cast("double").alias("value")).filter("value is not null")


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Panel from CSV or parquet, ordered by date and ticker."""
    from quantspark.operators.panel import FACTOR_COLUMNS

    columns = [*FACTOR_COLUMNS, "forward_return"]
    if path.endswith(".csv"):
        raw = spark.read.csv(path, header=True)
        rows = raw.select(F.to_date("date").alias("date"), "ticker", *[_number(c).alias(c) for c in columns])
    else:
        rows = spark.read.parquet(path)
    return rows.orderBy("date", "ticker")
