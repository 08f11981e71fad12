"""The registered queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.llm import audit, decontamination, jaccard, langid, licenses, mixing, oracles, ranked, sharding, simhash, suffix_array, suffix_tree, syncmers, toxicity
from quantspark.llm.rows import remainder, stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op2_mixing": oracles.MIXING, "op5_decontamination": oracles.DECONTAMINATION, "op11_ranked_search": oracles.RANKED_SEARCH, "op13_filter_audit": oracles.FILTER_AUDIT}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score every text; labels teach only where the remainder of the id is not 2."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs.filter(~held_out), table(spark, folder, "labels"))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.toxicity(model, spark)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of every document in a mix of sources weighted 3, 1, 2."""
    docs = table(spark, folder, "documents")
    sized = stage(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    found = mixing.copies(sized, F.col("size"))
    return found.select("doc_id", "size", "mix.source_size", "mix.target", (F.col("size") * F.col("mix.copies")).cast("long").alias("taken"))


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op4_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every text, learned from rows whose id's remainder is not 0."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 10) == 0
    tree, counts = suffix_tree.train(docs.filter(~held_out).select("text"))
    found = suffix_tree.score(docs, tree, counts)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of 13 words found in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, folder, "benchmark"))
    hit = F.col("hit")
    return found.select(
        "doc_id", hit["n_words"].alias("n_words"), hit["n_hit"].alias("n_hit"), F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit["items"], ","), 256).alias("items_sha256"), decontamination.contaminated(hit).alias("contaminated"),
    )


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, learned from rows whose id's remainder is not 2."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@query
def op7_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every text that repeat 50 bytes of a document with a smaller id."""
    return suffix_array.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))[0]


@query
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards of nearly equal bytes."""
    found = sharding.sharded(table(spark, folder, "documents"))
    return found.withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and labels of every text."""
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return licenses.summary(found).drop("text")


@query
def op10_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return syncmers.compare_with_next(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked.search_all(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Size and component of every document's set of four-word shingles, linked from similarity 0.85."""
    return jaccard.join(table(spark, folder, "documents"))


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that five filters remove in all their orders, by source."""
    return audit.audit(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "labels"))
