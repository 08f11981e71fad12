"""Helpers shared by the operators: tables, ids, Arrow columns over texts, durable staging."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.session import ensure_checkpoint_dir, stage  # noqa: F401  (stage is re-exported)

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of one Arrow batch between the JVM and Python; the default bounds rows only, and texts may be long.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes from now on; texts of any length then need little memory on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(n)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, _UPPER, _LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use (names are compared without case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a batch into runs of at most ``most`` bytes (at least one text), with their start."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]


def to_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string array; null becomes empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def arrow_column(function: Callable[[list[bytes]], list[dict] | list], returns: str, arrow_type: pa.DataType) -> Callable[[Column], Column]:
    """A Column function over texts: ``function`` maps a list of UTF-8 texts to a list of values.

    Only the text column goes to Python, in Arrow batches cut into steps of bounded bytes; other
    columns stay in the JVM. It is marked non-deterministic so that a filter on the result does not
    make Spark compute it twice.
    """

    def run(batches):
        for array in batches:
            out = []
            for _, part in steps(to_bytes(array)):
                out.extend(function(part))
            yield pa.array(out, type=arrow_type)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns).asNondeterministic()


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Like :func:`stage`, for larger tables: columnar, compressed, with columns that later steps may skip.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Like :func:`shared_table`, bucketed by ``keys``: joins and groups on exactly these keys do not shuffle it.

    The catalogue entry is dropped at once; the frame that is returned still knows the buckets.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    df.write.option("compression", "zstd").bucketBy(max(1, buckets), *keys).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  (resolves the table before its entry goes)
    spark.sql(f"DROP TABLE {name}")
    return table
