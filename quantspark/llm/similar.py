"""Near-duplicates for a corpus: of each component of similar texts one document stays.

SimHash fingerprints of five-word shingles and their covering masks bring nearly equal texts together. A fingerprint
of 64 bits cannot find them all: at a similarity of 0.8 two of them differ in about ten bits with a spread of three.
So its pairs are candidates next to those of the Jaccard join, whose tiles lose no pair, and every link rests on the
exact test: a Jaccard similarity of the sets of five-word shingles of at least 4/5.

Defined cases: null and word-free texts are copies of each other; fewer words than a shingle are one shingle; words
are those of ``simhash``; repeated rows are copies, and of rows with one id the one with the smallest hash of its text
stays; a row without an id stays only where its component has no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm import jaccard, simhash
from quantspark.llm.components import components
from quantspark.llm.rows import small_batches, stage

RULE = jaccard.Rule(over=5, under=4, size=5)


def near(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, n, fp) whose fingerprints are equal or within the radius and whose sizes fit."""
    first = stage(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")))
    equal = nodes.join(first, "fp").filter("node <> first.node").select(F.col("first").alias("a"), F.struct("node", "n").alias("b"))
    one, two = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_set")) for c in ("a", "b"))
    met = simhash.links(first.select("fp")).join(one, "a").join(two, "b")
    fits = F.greatest("a.n", "b.n") * RULE.under <= F.least("a.n", "b.n") * RULE.over
    return equal.union(met.select("a_set", "b_set")).filter(fits).select("a.node", "b.node").toDF("a", "b")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stand for their component: the smallest id, once. All columns stay."""
    small_batches(docs.sparkSession)
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())
    told = docs.select(F.col(key).alias("doc_id"), mark.alias("mark"), jaccard.named_set(RULE)(F.col(text)).alias("set"), simhash.simhash(F.col(text), RULE.size).alias("fp"))
    rows = stage(told.select("doc_id", "mark", "set.node", "set.n", "set.sketch", "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))
    nodes = stage(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("fp").alias("fp"), F.min(order).alias("kept")))
    full = nodes.filter("n > 0")
    roots = components(jaccard.links(docs.select(F.col(text).alias("text")), full, RULE, near(full), by_size=True))
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("kept").alias("kept"))
    kept = kept.select(F.col("kept.doc_id").alias("_kept_id"), F.col("kept.mark").alias("_kept_mark"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("_key"), mark.alias("_mark"))
    same = held["_key"].eqNullSafe(kept["_kept_id"]) & (held["_mark"] == kept["_kept_mark"])
    return held.join(kept, same, "left_semi").dropDuplicates(["_key", "_mark"]).select("row.*")
