"""Date keys and windows as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week_key(day: Column) -> Column:
    """``2026-W34`` with the ISO year of the week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def bucket_key(day: Column, period: Column) -> Column:
    """Week key for weekly entries (also when the period is missing), month key otherwise."""
    return F.when(F.coalesce(period, F.lit("week")) == "week", iso_week_key(day)).otherwise(month_key(day))


def month_end_label(day: Column, freq: str) -> Column:
    """End of the month, quarter or year that holds the day."""
    if freq == "ME":
        return F.last_day(day)
    if freq == "QE":
        return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    return F.make_date(F.year(day), F.lit(12), F.lit(31))


def in_earnings_window(as_of: Column, report: Column, before: int = 1, after: int = 1) -> Column:
    return as_of.between(F.date_sub(report, before), F.date_add(report, after))


def is_weekly_day(day: Column) -> Column:
    """Saturday."""
    return F.dayofweek(day) == 7


def is_monthly_day(day: Column) -> Column:
    return day == F.last_day(day)


def bucket_end(name: Column) -> Column:
    """End of a filing bucket named ``2023q4`` or ``01jun2024-31aug2024`` (folder and suffix ignored)."""
    stem = F.lower(F.regexp_extract(name, r"([^/]+?)(?:_form13f)?(?:\.[a-z]+)?$", 1))
    year, quarter = F.regexp_extract(stem, r"^(\d{4})q([1-4])$", 1), F.regexp_extract(stem, r"^(\d{4})q([1-4])$", 2)
    by_quarter = F.last_day(F.make_date(year.try_cast("int"), quarter.try_cast("int") * 3, F.lit(1)))
    tail = F.regexp_extract(stem, r"(\d{2})([a-z]{3})(\d{4})$", 0)
    by_range = F.try_to_timestamp(F.initcap(F.concat_ws(" ", F.substring(tail, 1, 2), F.substring(tail, 3, 3), F.substring(tail, 6, 4))), F.lit("dd MMM yyyy")).cast("date")
    return F.when(year != "", by_quarter).otherwise(by_range)
