"""Pairwise correlation, divergence of usually correlated pairs, and beta.

A correlation matrix has one output row per pair, but joining the bars to
themselves would emit every pair once per day. Instead tickers are hashed into
tiles; a row is copied once per tile pair it belongs to, and each task works
on two tiles of bounded size with dense arrays.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.operators.timeseries import cumulative_return, daily_returns
from quantspark.session import stage

TICKERS_PER_TILE = 32

_PAIR_SCHEMA = (
    "ticker_a string, ticker_b string, correlation double, n_spread long, "
    "current_spread double, mean_spread double, std_spread double"
)


def _moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paired counts and correlations of all columns of two arrays, by products of masked matrices."""
    mx, my = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
    # Shifting a column changes no correlation but keeps the sums small.
    x0 = np.where(mx > 0, x - np.nanmean(x, 0, keepdims=True), 0.0)
    y0 = np.where(my > 0, y - np.nanmean(y, 0, keepdims=True), 0.0)
    n = mx.T @ my
    sx, sy = x0.T @ my, mx.T @ y0
    cov = x0.T @ y0 - sx * sy / n
    vx, vy = (x0 * x0).T @ my - sx * sx / n, mx.T @ (y0 * y0) - sy * sy / n
    return n, np.where(n > 1, cov / np.sqrt(vx * vy), np.nan)


def _spreads(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the spread x - y of one column against many: count, last, mean and deviation."""
    spread = x[:, None] - y
    seen = np.isfinite(spread)
    m = seen.sum(0)
    mean = np.where(seen, spread, 0).sum(0) / m
    std = np.sqrt((np.where(seen, spread - mean, 0) ** 2).sum(0) / (m - 1))
    last = spread[len(spread) - 1 - seen[::-1].argmax(0), np.arange(spread.shape[1])]
    return m, last, mean, std


def _tile_pairs(min_correlation: float | None, top: int | None, by: str):
    """Statistics of the pairs of two tiles that pass the threshold, or the tiles' ``top`` pairs."""

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        if top is None or len(frame) <= top:
            return frame
        size = frame["correlation"] if by == "correlation" else ((frame["current_spread"] - frame["mean_spread"]) / frame["std_spread"]).abs()
        order = frame.assign(_size=-size).sort_values(["_size", "ticker_a", "ticker_b"])
        return order.head(top).drop(columns="_size")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        frame = frame.sort_values("d")
        ret, cum = frame.pivot(index="d", columns="ticker", values="ret"), frame.pivot(index="d", columns="ticker", values="cum")
        tile_of = frame.drop_duplicates("ticker").set_index("ticker")["tile"]
        left, right = (sorted(t for t in ret.columns if tile_of[t] == k) for k in (i, j))
        names, c_right = np.array(right, object), cum[right].to_numpy(float)
        out = pd.DataFrame(columns=["ticker_a", "ticker_b", "correlation", "n_spread", "current_spread", "mean_spread", "std_spread"])
        if not left or not right:
            return out
        with np.errstate(all="ignore"), warnings.catch_warnings():
            warnings.simplefilter("ignore")
            _, correlation = _moments(ret[left].to_numpy(float), ret[right].to_numpy(float))
            for row, name in enumerate(left):
                keep = np.isfinite(correlation[row])
                if i == j:
                    keep &= names > name
                if min_correlation is not None:
                    keep &= correlation[row] >= min_correlation
                if not keep.any():
                    continue
                m, last, mean, std = _spreads(cum[name].to_numpy(float), c_right[:, keep])
                others, sign = names[keep], np.where(names[keep] > name, 1.0, -1.0)
                found = pd.DataFrame({
                    "ticker_a": np.minimum(name, others), "ticker_b": np.maximum(name, others), "correlation": correlation[row][keep], "n_spread": m,
                    "current_spread": last * sign, "mean_spread": mean * sign, "std_spread": std,
                })
                if by == "z":
                    found = found[(found["n_spread"] >= 10) & (found["std_spread"] > 0)]
                out = best(pd.concat([out, found]) if len(out) else found)
        return out

    return run


def pair_statistics(bars: DataFrame, min_correlation: float | None = None, top: int | None = None, by: str = "correlation") -> DataFrame:
    """Return correlation and cumulative-return spread statistics of the pairs of interest.

    Either those correlated at least ``min_correlation``, or a set that holds the ``top`` pairs by
    correlation or by |z| of the spread (``by="z"``): each tile pair keeps its own best, so the number of
    rows does not grow with the square of the tickers.
    """
    if min_correlation is None and top is None:
        raise ValueError("give min_correlation or top: all pairs are never listed")
    priced = bars.filter("close is not null").select("ticker", "d", "close")
    tiles = F.greatest(F.lit(1), F.ceil(priced.agg(F.count_distinct("ticker")).scalar() / TICKERS_PER_TILE)).cast("int")
    rows = (
        cumulative_return(daily_returns(priced))
        .select("ticker", "d", "ret", "cum", F.pmod(F.xxhash64("ticker"), tiles).cast("int").alias("tile"), tiles.alias("tiles"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("i", F.least("tile", "other"))
        .withColumn("j", F.greatest("tile", "other"))
        .drop("other", "tiles")
    )
    pairs = rows.groupBy("i", "j").applyInPandas(_tile_pairs(min_correlation, top, by), _PAIR_SCHEMA)
    absent = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return pairs.select("ticker_a", "ticker_b", absent("correlation"), "n_spread", absent("current_spread"), absent("mean_spread"), absent("std_spread"))


def pairwise_correlation(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Return correlation of the pairs asked for, (ticker_a, ticker_b)."""
    rets = daily_returns(bars.filter("close is not null").select("ticker", "d", "close")).select("ticker", "d", "ret")
    a, b = rets.toDF("ticker_a", "d", "ret_a"), rets.toDF("ticker_b", "d", "ret_b")
    both = pairs.select("ticker_a", "ticker_b").distinct().join(a, "ticker_a").join(b, ["ticker_b", "d"])
    return both.groupBy("ticker_a", "ticker_b").agg(F.corr("ret_a", "ret_b").alias("correlation")).filter("correlation is not null")


def divergence(stats: DataFrame, min_correlation: float | None = None) -> DataFrame:
    """How many deviations the latest spread of each pair lies from its own mean.

    Needs ten paired days and a spread that moves.
    """
    usable = stats.filter("correlation is not null and n_spread >= 10 and std_spread <> 0")
    if min_correlation is not None:
        usable = usable.filter(F.col("correlation") >= min_correlation)
    return usable.select(
        "ticker_a", "ticker_b", "correlation", "current_spread", "mean_spread",
        ((F.col("current_spread") - F.col("mean_spread")) / F.col("std_spread")).alias("z_score"),
    )


def top_correlated(stats: DataFrame, k: int = 15) -> DataFrame:
    pairs = stats.filter("correlation is not null").select("ticker_a", "ticker_b", "correlation")
    return pairs.orderBy(F.col("correlation").desc(), "ticker_a", "ticker_b").limit(k)


def top_diverged(diverged: DataFrame, k: int = 15) -> DataFrame:
    return diverged.orderBy(F.abs("z_score").desc(), "ticker_a", "ticker_b").limit(k)


def diverged_candidates(bars: DataFrame, as_of, lookback_months: int = 6, min_correlation: float = 0.8, min_abs_z: float = 1.5) -> DataFrame:
    """The lagging leg of every diverged pair, scored by its largest |z|."""
    today = F.lit(as_of).cast("date")
    window = stage(bars.filter((F.col("d") <= today) & (F.col("d") >= F.date_sub(today, lookback_months * 31))))
    found = divergence(pair_statistics(window, min_correlation)).filter(F.abs("z_score") >= min_abs_z)
    laggard = F.when(F.col("z_score") > 0, F.col("ticker_b")).otherwise(F.col("ticker_a"))
    return found.groupBy(laggard.alias("ticker")).agg(F.max(F.abs("z_score")).alias("score"))


def beta(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Slope of ticker returns on benchmark returns over paired days (at least ten)."""
    base = daily_returns(benchmark.withColumn("ticker", F.lit("benchmark"))).select("d", F.col("ret").alias("bench_ret"))
    return (
        daily_returns(bars)
        .join(base, "d")
        .filter("ret is not null and bench_ret is not null")
        .groupBy("ticker")
        .agg(F.count("*").alias("n"), F.covar_samp("ret", "bench_ret").alias("_cov"), F.var_samp("bench_ret").alias("_var"))
        .filter("n >= 10 and _var <> 0")
        .select("ticker", "n", (F.col("_cov") / F.col("_var")).alias("beta"))
    )
