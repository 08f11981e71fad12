"""Learning to rank: relevance grades, time split, a tree model on grades and its rank correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.operators.panel import FACTOR_COLUMNS


def relevance_labels(panel: DataFrame, bins: int = 5) -> DataFrame:
    """Equal-count grades of the forward return within each date, 0 worst.

    Quantile edges over ranks 1..n in closed form; dates are cross-sections,
    so a window partition is bounded by the number of tickers.
    """
    group = Window.partitionBy("date", F.col("forward_return").isNotNull())
    r, n = F.row_number().over(group.orderBy("forward_return", "ticker")), F.count("forward_return").over(group)
    grade = F.greatest(F.lit(0), F.ceil(F.try_divide((r - 1) * bins, n - 1)).cast("int") - 1)
    return panel.withColumn("relevance", F.when(F.col("forward_return").isNotNull(), F.coalesce(grade, F.lit(0))))


def time_split(panel: DataFrame, test_fraction: float = 0.3) -> DataFrame:
    """Add ``is_test``: the last share of dates, at least one (halves round to even)."""
    dates = panel.select("date").distinct()
    newest = dates.withColumn("_r", F.row_number().over(Window.orderBy(F.col("date").desc()))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    cut = F.greatest(F.lit(1), F.bround(F.col("_n") * test_fraction).cast("int"))
    return panel.join(F.broadcast(newest.select("date", (F.col("_r") <= cut).alias("is_test"))), "date")


def train_ranker(train: DataFrame, features: list[str] = FACTOR_COLUMNS, trees: int = 20, depth: int = 4, seed: int = 7):
    """Boosted trees fitted to the relevance grades; missing features take the training median."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    # A column with no value at all cannot be imputed; the flag keeps only usable ones.
    counts = train.agg(*[F.count(c).alias(c) for c in features]).first()
    usable = [c for c in features if counts[c]]
    filled = [f"{c}_filled" for c in usable]
    stages = [
        Imputer(inputCols=usable, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="features"),
        GBTRegressor(labelCol="relevance", featuresCol="features", predictionCol="score", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed),
    ]
    return Pipeline(stages=stages).fit(train.filter("relevance is not null"))


def _average_rank(value: str):
    rank = F.rank().over(Window.partitionBy("date").orderBy(value))
    return rank + (F.count("*").over(Window.partitionBy("date", value)) - 1) / 2


def rank_ic(scored: DataFrame, score: str = "score") -> DataFrame:
    """Spearman correlation of score and forward return per date."""
    rows = scored.filter(F.col(score).isNotNull() & F.col("forward_return").isNotNull())
    ranked = rows.withColumn("_a", _average_rank(score)).withColumn("_b", _average_rank("forward_return"))
    return ranked.groupBy("date").agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("spearman"))


def feature_importance(model, spark) -> DataFrame:
    names = [c.removesuffix("_filled") for c in model.stages[1].getInputCols()]
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(names, map(float, values)), key=lambda p: -p[1])
    return spark.createDataFrame(rows, "feature string, importance double")
