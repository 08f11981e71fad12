"""As-of lookups by union-and-window.

Probe rows and series rows are merged into one ordered stream per key, so the
cost is one shuffle and one sort, never a range join. A series has one row per
(key, day) and probes are dates of the same calendar, which bounds a window
partition. Probes without such a bound are reduced to their distinct times
first and joined back afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merge(probes, series, keys, at, when, values, payload):
    right = series.select(
        *keys,
        F.col(when).alias("_t"),
        F.lit(0).alias("_side"),
        F.struct(F.col(when).alias("_when"), *[F.col(c) for c in values]).alias("_v"),
        F.lit(None).alias("_row"),
    )
    left = probes.select(
        *keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema["_v"].dataType).alias("_v"), payload.alias("_row")
    )
    return left.unionByName(right.withColumn("_row", F.col("_row").cast(left.schema["_row"].dataType)))


def asof(
    probes: DataFrame,
    series: DataFrame,
    keys: list[str],
    at: str,
    when: str,
    values: dict[str, str],
    direction: str = "backward",
    strict: bool = False,
    when_as: str | None = None,
    max_age_days: int | None = None,
    bounded: bool = True,
) -> DataFrame:
    """Left as-of join. ``values`` maps series columns to output names.

    ``forward`` takes the first series row at or after ``at``; ``backward``
    the last row at or before it. ``strict`` excludes equal times. Pass
    ``bounded=False`` when many probes may share a key and time.
    """
    if not bounded:
        times = probes.select(*keys, at).distinct()
        found = asof(times, series, keys, at, when, values, direction, strict, when_as, max_age_days)
        return probes.join(found, [*keys, at], "left")
    merged = _merge(probes, series, keys, at, when, list(values), F.struct(*probes.columns))
    # Rows seen earlier in the window order are the match candidates.
    time_order = F.col("_t").desc() if direction == "forward" else F.col("_t").asc()
    tie_order = F.col("_side").desc() if strict else F.col("_side").asc()
    window = (
        Window.partitionBy(*keys)
        .orderBy(time_order, tie_order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = merged.withColumn("_hit", F.last("_v", ignorenulls=True).over(window)).filter("_side = 1")
    if max_age_days is not None:
        fresh = F.abs(F.datediff("_t", F.col("_hit._when"))) <= max_age_days
        out = out.withColumn("_hit", F.when(fresh, F.col("_hit")))
    taken = [F.col(f"_hit.{source}").alias(target) for source, target in values.items()]
    if when_as:
        taken.append(F.col("_hit._when").alias(when_as))
    return out.select("_row.*", *taken)


def benchmark_lookup(days: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every day: first benchmark row on or after it, last one on or before it.

    Both inputs hold at most one row per calendar day, so the unpartitioned
    window and the broadcast of the result are bounded by the calendar.
    """
    merged = (
        days.select("d")
        .distinct()
        .join(benchmark.filter("close is not null").select("d", F.col("close").alias("b")), "d", "full_outer")
        .withColumn("_v", F.when(F.col("b").isNotNull(), F.struct(F.col("d").alias("when"), F.col("b").alias("close"))))
    )
    up_to_here = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = Window.orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        merged.withColumn("_back", F.last("_v", ignorenulls=True).over(up_to_here))
        .withColumn("_ahead", F.last("_v", ignorenulls=True).over(from_here))
        .select(
            "d",
            F.col("_ahead.when").alias("ahead_d"),
            F.col("_ahead.close").alias("ahead_close"),
            F.col("_back.when").alias("back_d"),
            F.col("_back.close").alias("back_close"),
        )
    )


def with_benchmark_return(
    spans: DataFrame, lookup: DataFrame, start: str, end: str, out: str = "benchmark_return", min_rows: int = 1
) -> DataFrame:
    """Benchmark return from the first row on/after ``start`` to the last on/before ``end``.

    NULL when fewer than ``min_rows`` benchmark rows fall inside the span.
    """
    first = F.broadcast(lookup.select(F.col("d").alias(start), F.col("ahead_d").alias("_bench_fd"), F.col("ahead_close").alias("_bench_fc")))
    last = F.broadcast(lookup.select(F.col("d").alias(end), F.col("back_d").alias("_bench_ld"), F.col("back_close").alias("_bench_lc")))
    inside: Column = F.col("_bench_fd") <= F.col("_bench_ld") if min_rows == 1 else F.col("_bench_fd") < F.col("_bench_ld")
    return (
        spans.join(first, start, "left")
        .join(last, end, "left")
        .withColumn(out, F.when(inside, F.try_divide(F.col("_bench_lc"), F.col("_bench_fc")) - 1))
        .drop("_bench_fd", "_bench_fc", "_bench_ld", "_bench_lc")
    )
