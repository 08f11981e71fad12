"""Texts that hold needles (company names, tickers), through an index of short character runs.

Both sides are tables of any size. Each needle is looked up by the rarest of its trigrams only, and every candidate
is verified, so a text never meets needles that share nothing rare with it and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.session import stage

#: Bytes of an index entry; shorter needles are indexed whole. A run is its bytes as a number, its length above them.
RUN = 3


def runs_of(text: bytes, lengths: list[int]) -> np.ndarray:
    """The numbers of all runs of the given lengths, in order, with repeats."""
    data = np.frombuffer(text, np.uint8).astype(np.int32)
    out = [np.zeros(0, np.int32)]
    for k in lengths:
        n = len(data) - k + 1
        if n > 0:
            code = np.full(n, k << 8 * RUN, np.int32)
            for j in range(k):
                code |= data[j : j + n] << 8 * j
            out.append(code)
    return np.concatenate(out)


def _runs(wanted: np.ndarray | None, lengths: list[int]):
    """A Column function: text -> its distinct runs, only those set in the bitmap ``wanted`` if there is one."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = []
            for text in texts.cast(pa.binary()).to_pylist():
                codes = runs_of(text or b"", lengths)
                if wanted is not None:
                    codes = codes[wanted[codes >> 3] >> (codes & 7) & 1 == 1]
                found.append(np.unique(codes))
            sizes = np.cumsum([0] + [len(x) for x in found])
            yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32()))

    return F.arrow_udf(run, "array<int>").asNondeterministic()


def holding(rows: DataFrame, text: Column, needles: DataFrame) -> DataFrame:
    """Rows whose ``text`` holds a needle, with ``found``: the distinct values of the needles it holds.

    ``needles`` has ``needle`` and ``value`` (one value may have several needles and the reverse). Null and empty
    needles find nothing; a null text holds nothing; repeated rows stay repeated. The texts are scanned three times: to
    count the runs that needles have, to look up the rarest run of each needle, and to verify.
    """
    asked = stage(needles.filter("needle <> ''").select("needle", "value").distinct())
    # At most RUN lengths, and at most 256 ** RUN runs: a bitmap of 8 MiB whatever the number of needles.
    lengths = sorted({min(RUN, r["n"]) for r in asked.select(F.least(F.octet_length("needle"), F.lit(RUN)).alias("n")).distinct().collect()})
    values = F.array().cast(f"array<{asked.schema['value'].dataType.simpleString()}>")
    if not lengths:
        return rows.withColumn("found", values).filter(F.lit(False))
    own_length = F.least(F.octet_length("needle"), F.lit(RUN))
    own = stage(asked.select("needle").distinct().select("needle", own_length.alias("_l"), F.explode(_runs(None, lengths)(F.col("needle"))).alias("run"))
                .filter(F.shiftright("run", 8 * RUN) == F.col("_l")).drop("_l"))
    wanted = np.zeros((RUN + 1) << 8 * RUN >> 3, np.uint8)
    asked_runs = own.select("run").distinct().toPandas()["run"].to_numpy(np.int64)
    np.bitwise_or.at(wanted, asked_runs >> 3, (1 << (asked_runs & 7)).astype(np.uint8))
    texts = rows.select(text.alias("_t")).filter("_t is not null").select(F.xxhash64("_t").alias("_key"), "_t")
    index = texts.select("_key", F.explode(_runs(wanted, lengths)(F.col("_t"))).alias("run"))
    counts = index.groupBy("run").agg(F.count("*").alias("_n"))
    # A needle with a run that no text has is in no text.
    rarest = own.join(counts, "run", "left").groupBy("needle").agg(
        F.min_by("run", F.struct(F.coalesce("_n", F.lit(0)), "run")).alias("run"), F.min(F.coalesce("_n", F.lit(0))).alias("_n"))
    lookup = stage(rarest.filter("_n > 0").select("run", "needle").join(asked, "needle"))
    maybe = index.join(lookup, "run").groupBy("_key").agg(F.collect_set(F.struct("needle", "value")).alias("_maybe"))
    held = F.filter("_maybe", lambda c: F.contains(F.col("_t"), c["needle"]))
    return (
        rows.withColumn("_t", text).withColumn("_key", F.xxhash64("_t")).join(maybe, "_key")
        .withColumn("found", F.array_distinct(F.transform(held, lambda c: c["value"]))).filter(F.size("found") > 0).drop("_t", "_key", "_maybe")
    )
