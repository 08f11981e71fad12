"""Query registry: each entry pairs a Spark plan with the SQL that states the same answer.

``columns`` fixes the output of both forms. Types: ``s`` string, ``d`` date
written as text, ``t`` timestamp as text, ``i`` bigint, ``b`` boolean,
``f`` double rounded to six places (``f2`` to two), ``e`` double rounded to eight
significant digits (for values of unbounded size).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.plans.derived import with_tables


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    columns: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def spec(self) -> list[tuple[str, str]]:
        return [tuple(part.split()) for part in self.columns.split(",")]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return _typed(self.build(Tables(spark, folder)), self.spec())

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return f"SELECT {', '.join(_sql_column(n, t) for n, t in self.spec())} FROM ({with_tables(self.sql)}) AS answer"


def _nudge(digits: int) -> float:
    """Moves exact halves off the rounding edge; the ``+ 0.0`` after rounding removes -0.0."""
    return float(f"3.1416e-{digits + 4}")


def _typed(df: DataFrame, spec: list[tuple[str, str]]) -> DataFrame:
    def column(name: str, kind: str):
        value = F.col(name)
        if kind == "e":
            size = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))))
            return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value / size + F.lit(_nudge(8)), 8) * size)
        if kind.startswith("f"):
            digits = int(kind[1:] or 6)
            return F.round(value.cast("double") + F.lit(_nudge(digits)), digits) + F.lit(0.0)
        return value.cast({"s": "string", "d": "date", "t": "timestamp_ntz", "i": "bigint", "b": "boolean"}[kind]).cast(
            {"d": "string", "t": "string"}.get(kind, {"s": "string", "i": "bigint", "b": "boolean"}.get(kind, "string"))
        )

    return df.select(*[column(n, t).alias(n) for n, t in spec])


def _sql_column(name: str, kind: str) -> str:
    if kind == "e":
        size = f"pow(10.0::DOUBLE, floor(log10(abs({name}))))"
        return f"CASE WHEN {name}=0 THEN 0.0::DOUBLE WHEN {name} IS NOT NULL THEN ROUND({name}/{size} + {_nudge(8)!r}, 8) * {size} END AS {name}"
    if kind.startswith("f"):
        digits = int(kind[1:] or 6)
        return f"ROUND(CAST({name} AS DOUBLE) + {_nudge(digits)!r}, {digits}) + 0.0 AS {name}"
    if kind == "d":
        return f"CAST(CAST({name} AS DATE) AS VARCHAR) AS {name}"
    if kind == "t":
        return f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {name}"
    return f"CAST({name} AS {({'s': 'VARCHAR', 'i': 'BIGINT', 'b': 'BOOLEAN'})[kind]}) AS {name}"


REGISTRY: dict[str, Query] = {}


def query(name: str, operators: str, columns: str, sql: str | None):
    """Register the decorated builder under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, operators, columns, build, sql)
        return build

    return register
