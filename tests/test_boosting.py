"""Pairwise boosting against loops over all pairs and all splits."""

import math
import random

import pytest

from quantspark.operators import boosting as bo
from quantspark.operators import ltr


def plain_gradients(rows):
    """Gradient and curvature of every (date, grade, score) by visiting all pairs of a date."""
    out = []
    for date, y, s in rows:
        same = [(b, t) for d, b, t in rows if d == date and b is not None]
        pairs = sum(1 for a, _ in same for b, _ in same if a > b)
        g = h = 0.0
        for b, t in same if y is not None and pairs else []:
            if y > b:
                g, h = g - math.exp(t - s), h + math.exp(t - s)
            elif y < b:
                g, h = g + math.exp(s - t), h + math.exp(s - t)
        out.append((g / pairs if pairs else 0.0, h / pairs if pairs else 0.0))
    return out


def test_gradients_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    rows = [(f"d{rng.randrange(4)}", rng.choice([0, 1, 2, 3, 4, None]), rng.uniform(-2, 2)) for _ in range(120)]
    rows += [("alone", 2, 0.5), ("same", 1, 0.1), ("same", 1, -0.4)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, date string, relevance int, score double")
    found = {r.i: (r.gradient, r.curvature) for r in bo.pairwise_gradients(frame).collect()}
    for i, wanted in enumerate(plain_gradients(rows)):
        assert found[i] == pytest.approx(wanted, abs=1e-12)


def plain_best(rows, features, edges, ridge, least):
    """The largest gain over every feature, edge and side of the missing values."""
    gradients = plain_gradients([(d, y, 0.0) for d, y, _ in rows])
    gain = lambda part: sum(g for g, _ in part) ** 2 / (sum(h for _, h in part) + ridge)
    best = 0.0
    for k, f in enumerate(features):
        for edge in edges[f]:
            for missing_left in (True, False):
                left = [x[k] <= edge if x[k] is not None else missing_left for _, _, x in rows]
                a = [p for p, side in zip(gradients, left, strict=True) if side]
                b = [p for p, side in zip(gradients, left, strict=True) if not side]
                if len(a) >= least and len(b) >= least:
                    best = max(best, gain(a) + gain(b) - gain(a + b))
    return best


def planted(seed, dates=12, tickers=40):
    """Rows (date, relevance, features): the first feature orders a date, the second is noise; some are missing."""
    rng, rows = random.Random(seed), []
    for d in range(dates):
        for _ in range(tickers):
            signal, noise = rng.uniform(-1, 1), rng.uniform(-1, 1)
            grade = min(4, max(0, int((signal + rng.gauss(0, 0.3) + 1) * 2.5)))
            rows.append((f"2024-01-{d + 1:02d}", grade, (None if rng.random() < 0.1 else signal, noise)))
    return rows


def frame_of(spark, rows):
    flat = [(d, f"T{i:04d}", y, *x) for i, (d, y, x) in enumerate(rows)]
    return spark.createDataFrame(flat, "date string, ticker string, relevance int, signal double, noise double")


def test_first_split_has_the_largest_gain_of_all(spark):
    rows = planted(5)
    frame, features = frame_of(spark, rows), ["signal", "noise"]
    model = bo.train_pairwise(frame, features, trees=1, depth=1, bins=8)
    splits, leaves = model.trees[0]
    wanted = plain_best(rows, features, bo.bin_edges(frame, features, 8), 1e-3, 20)
    assert splits[1].feature == "signal" and splits[1].gain == pytest.approx(wanted, rel=1e-9)
    assert leaves[2] < 0 < leaves[3]


def test_order_of_new_dates_is_learned_and_shuffled_grades_teach_nothing(spark):
    rows, later = planted(7), frame_of(spark, planted(8)).withColumnRenamed("relevance", "forward_return")
    mixed = random.Random(1).sample([y for _, y, _ in rows], len(rows))
    ic = {}
    for name, frame in (("true", rows), ("shuffled", [(d, y, x) for (d, _, x), y in zip(rows, mixed, strict=True)])):
        model = bo.train_pairwise(frame_of(spark, frame), ["signal", "noise"], trees=5, depth=2, bins=16)
        scores = [r.spearman or 0.0 for r in ltr.rank_ic(model.transform(later)).collect()]
        ic[name] = sum(scores) / len(scores)
        if name == "true":
            shares = model.importances()
            assert list(shares)[0] == "signal" and sum(shares.values()) == pytest.approx(1.0)
    assert ic["true"] > 0.6 and ic["true"] > ic["shuffled"] + 0.3


def test_nothing_to_learn(spark):
    rows = frame_of(spark, planted(9))
    for frame in (rows.limit(0), rows.selectExpr("date", "ticker", "1 AS relevance", "signal", "noise"), rows.selectExpr("date", "ticker", "CAST(NULL AS INT) AS relevance", "signal", "noise")):
        model = bo.train_pairwise(frame, ["signal", "noise"], trees=2)
        assert model.trees == [] and set(model.importances().values()) == {0.0}
        assert {r.score for r in model.transform(rows).collect()} == {0.0}
