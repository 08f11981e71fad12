"""Gradient-boosted trees for ranking: a pairwise loss within each date, trees by histograms.

The loss of a date is the mean of exp(s_j - s_i) over its pairs with relevance i above j. That form
splits into sums per grade: the gradient of a row needs only the sums of exp(s) and exp(-s) of the
other grades of its date, so no pair is ever made, and a date may have any number of rows. Trees grow
level by level. Every level is one aggregate of gradients by (node, feature, bin) with map-side
combining, whose result has at most nodes x features x bins rows; only that reaches the driver, and the
splits chosen from it go back as column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.session import stage

#: Scores are kept within this size, so that no exponential overflows.
LIMIT = 20.0


@dataclass(frozen=True)
class Split:
    feature: str
    #: Values up to this go left.
    edge: float
    missing_left: bool
    gain: float


@dataclass
class Ranker:
    """Trees as nested splits (complete binary trees, node n has children 2n and 2n + 1) and leaf values."""

    features: list[str]
    rate: float
    trees: list[tuple[dict[int, Split], dict[int, float]]] = field(default_factory=list)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the column ``score``."""
        total = reduce(lambda a, b: a + b, [_leaf(splits, leaves) for splits, leaves in self.trees], F.lit(0.0))
        return rows.withColumn("score", _held(total * self.rate) if self.trees else total)

    def importances(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits, largest first; zeros if no tree splits."""
        gains = dict.fromkeys(self.features, 0.0)
        for splits, _ in self.trees:
            for split in splits.values():
                gains[split.feature] += split.gain
        total = sum(gains.values())
        return dict(sorted(((f, g / total if total else 0.0) for f, g in gains.items()), key=lambda p: (-p[1], p[0])))


def _held(score: Column) -> Column:
    return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), score))


def _goes_left(split: Split) -> Column:
    value = F.col(split.feature)
    return F.when(value.isNull() | F.isnan(value), F.lit(split.missing_left)).otherwise(value <= split.edge)


def _node(splits: dict[int, Split], at: int = 1) -> Column:
    """The node in which a row ends."""
    if at not in splits:
        return F.lit(at)
    return F.when(_goes_left(splits[at]), _node(splits, 2 * at)).otherwise(_node(splits, 2 * at + 1))


def _leaf(splits: dict[int, Split], leaves: dict[int, float], at: int = 1) -> Column:
    if at not in splits:
        return F.lit(leaves.get(at, 0.0))
    return F.when(_goes_left(splits[at]), _leaf(splits, leaves, 2 * at)).otherwise(_leaf(splits, leaves, 2 * at + 1))


def pairwise_gradients(rows: DataFrame, score: str = "score", grade: str = "relevance", group: str = "date") -> DataFrame:
    """``rows`` with ``gradient`` and ``curvature`` of the pairwise loss of their group.

    Rows without grade or score, and groups of one grade, have zeros. The sums have one row per (group, grade).
    """
    value = _held(F.col(score))
    # Names of their own, so that columns of ``rows`` may have any other.
    sums = rows.filter(F.col(grade).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(grade).alias("_y")).agg(
        F.count("*").alias("n"), F.sum(F.exp(value)).alias("up"), F.sum(F.exp(-value)).alias("down"))
    per_group = sums.groupBy("_g").agg(F.collect_list(F.struct("_y", "n", "up", "down")).alias("_grades"))
    total = lambda grades, take: F.aggregate(grades, F.lit(0.0), lambda a, x: a + take(x))
    pairs = total(F.col("_grades"), lambda x: x["n"] * total(F.filter("_grades", lambda o: o["_y"] < x["_y"]), lambda o: o["n"].cast("double")))
    per_group = per_group.select("_g", "_grades", pairs.alias("_pairs"))
    joined = rows.join(per_group, rows[group].eqNullSafe(per_group["_g"]), "left")
    own = F.col(grade)
    lower = total(F.filter("_grades", lambda x: x["_y"] < own), lambda x: x["up"]) * F.exp(-value)
    higher = total(F.filter("_grades", lambda x: x["_y"] > own), lambda x: x["down"]) * F.exp(value)
    counted = own.isNotNull() & F.col(score).isNotNull() & (F.col("_pairs") > 0)
    share = lambda amount: F.when(counted, amount / F.col("_pairs")).otherwise(0.0)
    return joined.withColumns({"gradient": share(higher - lower), "curvature": share(higher + lower)}).drop("_g", "_grades", "_pairs")


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Inner quantiles of each feature: at most ``bins`` - 1 distinct edges."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    clean = [F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), shares, 10_000).alias(f) for f in features]
    found = rows.agg(*clean).first()
    return {f: sorted(set(found[f] or [])) for f in features}


def _bin(feature: str, edges: list[float]) -> Column:
    """Number of edges below the value; -1 for a missing one."""
    value = F.col(feature)
    below = reduce(lambda a, e: a + (value > e).cast("int"), edges, F.lit(0))
    return F.when(value.isNull() | F.isnan(value), F.lit(-1)).otherwise(below)


def _gain(g: float, h: float, ridge: float) -> float:
    return g * g / (h + ridge)


def best_splits(histogram: list, edges: dict[str, list[float]], ridge: float, least: int) -> dict[int, Split]:
    """The best split of each node from rows (node, feature, bin, n, g, h); ties go to the first feature, edge and left."""
    cells: dict[tuple[int, str], dict[int, tuple[int, float, float]]] = {}
    for node, feature, place, n, g, h in histogram:
        cells.setdefault((node, feature), {})[place] = (n, g, h)
    out: dict[int, Split] = {}
    for node, feature in sorted(cells, key=lambda k: (k[0], list(edges).index(k[1]))):
        held = cells[node, feature]
        whole = [sum(c[i] for c in held.values()) for i in range(3)]
        missing = held.get(-1, (0, 0.0, 0.0))
        left = [0, 0.0, 0.0]
        for place, edge in enumerate(edges[feature]):
            left = [a + b for a, b in zip(left, held.get(place, (0, 0.0, 0.0)), strict=True)]
            for missing_left in (True, False) if missing[0] else (True,):
                n, g, h = [a + b for a, b in zip(left, missing, strict=True)] if missing_left else left
                if n < least or whole[0] - n < least:
                    continue
                gain = _gain(g, h, ridge) + _gain(whole[1] - g, whole[2] - h, ridge) - _gain(whole[1], whole[2], ridge)
                if gain > 1e-12 and (node not in out or gain > out[node].gain * (1 + 1e-9)):
                    out[node] = Split(feature, edge, missing_left, gain)
    return out


def train_pairwise(
    train: DataFrame, features: list[str], trees: int = 10, depth: int = 3, rate: float = 0.3, bins: int = 32,
    ridge: float = 1e-3, least: int = 20, grade: str = "relevance", group: str = "date",
) -> Ranker:
    """Boost ``trees`` trees on the pairwise loss of ``grade`` within ``group``.

    ``least`` is the smallest number of rows in a leaf. Missing values go to the side that gains more. A tree
    that cannot split ends the training; rows without a grade are not used, and without rows no tree is grown.
    """
    rows = stage(train.filter(F.col(grade).isNotNull()).select(
        F.col(group).alias("date"), F.col(grade).alias("relevance"), *[F.col(f).cast("double").alias(f) for f in features], F.lit(0.0).alias("score")))
    edges = bin_edges(rows, features, bins)
    usable = [f for f in features if edges[f]]
    model = Ranker(list(features), rate)
    for _ in range(trees if usable else 0):
        graded = stage(pairwise_gradients(rows).withColumn("bins", F.array(*[
            F.struct(F.lit(f).alias("feature"), _bin(f, edges[f]).alias("bin")) for f in usable])))
        splits: dict[int, Split] = {}
        for level in range(depth):
            held = graded.withColumn("node", _node(splits)).filter(F.col("node") >= 2**level)
            cells = held.select("node", "gradient", "curvature", F.explode("bins").alias("b")).groupBy("node", "b.feature", "b.bin")
            found = cells.agg(F.count("*").alias("n"), F.sum("gradient").alias("g"), F.sum("curvature").alias("h")).collect()
            new = best_splits(found, edges, ridge, least)
            if not new:
                break
            splits |= new
        if not splits:
            break
        sums = graded.groupBy(_node(splits).alias("node")).agg(F.sum("gradient").alias("g"), F.sum("curvature").alias("h")).collect()
        leaves = {r["node"]: -r["g"] / (r["h"] + ridge) for r in sums}
        model.trees.append((splits, leaves))
        rows = graded.drop("bins", "gradient", "curvature").withColumn("score", _held(F.col("score") + rate * _leaf(splits, leaves)))
    return model
