"""Readers for regulatory files: holdings tables, company facts and company numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.functions.dates import bucket_end
from quantspark.sources.market import folder_key

# Tags tried for each concept.
CONCEPT_TAGS = {
    "revenue": [
        "Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax",
        "SalesRevenueNet", "SalesRevenueGoodsNet",
    ],
    "operating_income": ["OperatingIncomeLoss"],
    "net_income": ["NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic"],
    "eps_diluted": ["EarningsPerShareDiluted"],
    "shares_outstanding": ["CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"],
}

_FACT = "array<struct<start: date, end: date, val: double, filed: date, form: string, fy: int, fp: string>>"


def _bucket():
    """The bucket is the folder that holds the table."""
    return bucket_end(folder_key())


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, recursiveFileLookup=True)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """SUBMISSION.tsv files: filing, filer and period; bad periods become NULL."""
    day = F.try_to_timestamp(F.initcap("PERIODOFREPORT"), F.lit("dd-MMM-yyyy")).cast("date")
    return _tsv(spark, path).select(F.col("ACCESSION_NUMBER").alias("accession"), F.col("CIK").alias("cik"), day.alias("period"), _bucket().alias("bucket_end"))


def read_infotable(spark: SparkSession, path: str) -> DataFrame:
    """INFOTABLE.tsv files with the six columns the aggregates need."""
    return _tsv(spark, path).select(
        F.col("ACCESSION_NUMBER").alias("accession"), F.col("NAMEOFISSUER").alias("name"), F.col("TITLEOFCLASS").alias("class"),
        F.col("CUSIP").alias("cusip"), F.col("VALUE").cast("double").alias("value"), F.col("SSHPRNAMT").cast("double").alias("shares"),
    )


def list_buckets(names: DataFrame, column: str = "name") -> DataFrame:
    """Bucket names with their end dates, newest first."""
    return names.select(column, bucket_end(F.col(column)).alias("bucket_end")).orderBy(F.col("bucket_end").desc())


def eligible_buckets(buckets: DataFrame, as_of, quarters: int = 5, buffer: int = 2) -> DataFrame:
    """The newest buckets that end on or before ``as_of``."""
    known = buckets.filter(F.col("bucket_end") <= F.lit(as_of).cast("date"))
    return known.orderBy(F.col("bucket_end").desc()).limit(quarters + buffer)


def concept_tags(spark: SparkSession) -> DataFrame:
    rows = [(c, t, i) for c, tags in CONCEPT_TAGS.items() for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "concept string, tag string, tag_order int")


def read_concepts(spark: SparkSession, path: str, companies: DataFrame, lines: bool = False) -> DataFrame:
    """Company-concept JSON files to facts: dollars, else shares, else dollars per share.

    ``companies`` is (ticker, cik). Start is NULL for instant facts. A file is one object, or with ``lines`` an
    object per line with some of the facts each, so that files can be split.
    """
    schema = f"cik long, tag string, units struct<USD: {_FACT}, shares: {_FACT}, `USD/shares`: {_FACT}>"
    raw = spark.read.schema(schema).json(path, multiLine=not lines, recursiveFileLookup=True)
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    picked = raw.select(
        F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), "tag",
        F.explode(F.coalesce(some("units.USD"), some("units.shares"), some("units.`USD/shares`"))).alias("f"),
    )
    return (
        picked.join(F.broadcast(concept_tags(spark)), "tag")
        .join(companies.select("ticker", "cik"), "cik")
        .select("ticker", "concept", F.col("f.start").alias("start_d"), F.col("f.end").alias("end_d"), "f.val", "f.filed", "f.form", "f.fy", "f.fp", "tag")
    )


def read_cik_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Ticker to ten-digit company number, from one object of all companies or a line for each."""
    company = "struct<cik_str: long, ticker: string, title: string>"
    if lines:
        rows = spark.read.text(path, recursiveFileLookup=True).select(F.from_json("value", company).alias("v"))
    else:
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {company}>")).alias("k", "v"))
    return rows.select(F.upper("v.ticker").alias("ticker"), F.lpad(F.col("v.cik_str").cast("string"), 10, "0").alias("cik"))
