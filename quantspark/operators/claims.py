"""Normalising model responses into events, claims, theses, reviews and snapshots.

``responses`` rows carry the model's text in ``raw``. Each normaliser keeps a
row only if its JSON parses and every required field is present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.functions.text import clamp, enum_or, json_blob, stable_id, tracked_companies

# Required fields and allowed labels.
EVENT_FIELDS = ["event", "companies", "event_type", "importance", "time_horizon", "key_facts", "type", "novel", "summary"]
KNOWN_COMPANY_FIELDS = ["event", "event_type", "importance", "time_horizon", "key_facts", "novel"]
CLAIM_FIELDS = ["trade_worthy", "claim", "confidence", "importance", "direction"]
TRADE_FIELDS = ["expected_horizon_days", "expected_return_pct"]
THESIS_FIELDS = ["thesis", "direction", "confidence", "expected_return_pct", "expected_horizon_days", "catalysts", "invalidation", "reasoning"]
CRITIC_FIELDS = ["multiplier", "concerns", "reasoning"]
FUNDAMENTAL_FIELDS = ["fundamental_direction", "fundamental_confidence", "summary", "key_changes", "risks", "reasoning"]
CALL_FIELDS = [
    "earnings_direction", "earnings_confidence", "guidance_summary", "guidance_change",
    "management_tone", "key_qa_moments", "risks", "summary",
]
EVENT_TYPES = [
    "capex", "earnings", "guidance", "product_launch", "regulatory", "m_and_a",
    "leadership_change", "supply_chain", "competitive", "macro", "other",
]
TIME_HORIZONS = ["days", "weeks", "months", "quarters"]
ARTICLE_TYPES = ["news", "analysis"]
DIRECTIONS = ["long", "short"]
TONES = ["confident", "cautious", "defensive", "evasive"]
HORIZON_DAYS = (7, 730)
CRITIC_RANGE = (0.7, 1.0)


def _parsed(responses: DataFrame) -> DataFrame:
    """Add ``_m``: the response's JSON object as field -> text, NULL if broken.

    Parsed as the only element of an array, so text after a complete object
    breaks it instead of being ignored.
    """
    return responses.withColumn("_m", _only_object("map<string,string>"))


def _only_object(kind: str) -> Column:
    wrapped = F.concat(F.lit("["), json_blob(F.col("raw")), F.lit("]"))
    items = F.from_json(wrapped, f"array<{kind}>", {"allowSingleQuotes": "false"})
    return F.when(F.size(items) == 1, F.get(items, 0))


def _has(fields: list[str], holder: str | Column = "_m") -> Column:
    keys = F.map_keys(F.col(holder) if isinstance(holder, str) else holder)
    return F.size(F.array_except(F.array(*[F.lit(f) for f in fields]), keys)) == 0


def _text(field: str) -> Column:
    return F.col("_m")[field]


def _texts(field: str) -> Column:
    return F.coalesce(F.from_json(_text(field), "array<string>"), F.array().cast("array<string>"))


def truthy(holder: Column, field: str) -> Column:
    """Truth of a JSON field by its type: null, false, zero and empty values are false.

    ``holder`` is the object as VARIANT, so the text ``"false"`` is told from the literal and is true.
    """
    value = F.try_variant_get(holder, f"$.{field}", "variant")
    kind, text = F.schema_of_variant(value), F.try_variant_get(holder, f"$.{field}", "string")
    number = F.try_variant_get(holder, f"$.{field}", "double")
    found = (
        F.when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true").when(kind == "VOID", F.lit(False))
        .when(kind.startswith("ARRAY"), text != "[]").when(kind.startswith("OBJECT"), text != "{}").otherwise(number != 0)
    )
    return F.coalesce(found, F.lit(False))


def whole(value: Column) -> Column:
    """Integer part of a number given as text, NULL if it is none."""
    return value.try_cast("double").try_cast("int")


def _event_columns() -> dict[str, Column]:
    """Importance and novelty by JSON type: text counts as a number only if it is a whole one,
    and any text but the empty one counts as true."""
    typed = _only_object("struct<importance: double, novel: boolean>")
    text = F.when(_text("importance").rlike(r"^\s*[+-]?\d+\s*$"), whole(_text("importance")))
    number = F.coalesce(typed["importance"].try_cast("int"), text)
    novel = F.coalesce(typed["novel"], F.coalesce(~F.trim(_text("novel")).isin("0", "0.0", "", "[]", "{}", "null"), F.lit(False)))
    return {"importance": F.coalesce(clamp(number, 0, 10), F.lit(0)), "novel": novel}


def normalise_event(responses: DataFrame, valid: list[str]) -> DataFrame:
    """Article classification: tracked companies only, labels within their lists, importance 0-10."""
    return _parsed(responses).filter(_has(EVENT_FIELDS)).withColumn("_c", tracked_companies(_texts("companies"), valid)).select(
        *responses.columns,
        _text("event").alias("event"),
        F.col("_c").alias("companies"),
        enum_or(_text("event_type"), EVENT_TYPES, "other").alias("event_type"),
        _event_columns()["importance"].alias("importance"),
        enum_or(_text("time_horizon"), TIME_HORIZONS, "months").alias("time_horizon"),
        _texts("key_facts").alias("key_facts"),
        enum_or(_text("type"), ARTICLE_TYPES, "news").alias("type"),
        _event_columns()["novel"].alias("novel"),
        F.coalesce(_text("summary"), F.lit("")).alias("summary"),
    )


def normalise_known_company_event(responses: DataFrame) -> DataFrame:
    """Filing classification: the company is the row's own ``ticker``."""
    return _parsed(responses).filter(_has(KNOWN_COMPANY_FIELDS)).select(
        *responses.columns,
        _text("event").alias("event"),
        F.array("ticker").alias("companies"),
        enum_or(_text("event_type"), EVENT_TYPES, "other").alias("event_type"),
        _event_columns()["importance"].alias("importance"),
        enum_or(_text("time_horizon"), TIME_HORIZONS, "months").alias("time_horizon"),
        _texts("key_facts").alias("key_facts"),
        F.lit("news").alias("type"),
        _event_columns()["novel"].alias("novel"),
    )


def _claim_items(responses: DataFrame) -> DataFrame:
    items = F.from_json(_text("claims"), "array<map<string,string>>")
    typed = F.from_json(_text("claims"), "array<variant>")
    exploded = _parsed(responses).select(*responses.columns, F.explode(F.arrays_zip(items.alias("text"), typed.alias("typed"))).alias("_both"))
    exploded = exploded.select(*responses.columns, F.col("_both.text").alias("_item"), F.col("_both.typed").alias("_typed"))
    item = lambda f: F.col("_item")[f]
    trade = truthy(F.col("_typed"), "trade_worthy")
    usable = (
        F.coalesce(_has(CLAIM_FIELDS, "_item"), F.lit(False))
        & F.coalesce(item("direction").isin(*DIRECTIONS), F.lit(False))
        & (~trade | _has(TRADE_FIELDS, "_item"))
        & item("confidence").try_cast("double").isNotNull() & whole(item("importance")).isNotNull()
        & (~trade | (whole(item("expected_horizon_days")).isNotNull() & item("expected_return_pct").try_cast("double").isNotNull()))
    )
    return exploded.withColumn("_trade", trade).withColumn("usable", F.coalesce(usable, F.lit(False))).drop("_typed")


def normalise_claims(responses: DataFrame) -> DataFrame:
    """One row per usable claim; trade-worthy ones must carry a horizon and a return."""
    item = lambda f: F.col("_item")[f]
    return _claim_items(responses).filter("usable").select(
        *responses.columns,
        item("claim").alias("claim"),
        F.col("_trade").alias("trade_worthy"),
        item("direction").alias("direction"),
        clamp(item("confidence").try_cast("double"), 0.0, 1.0).alias("confidence"),
        clamp(whole(item("importance")), 0, 10).alias("importance"),
        F.coalesce(item("context"), F.lit("")).alias("context"),
        F.when(F.col("_trade"), clamp(whole(item("expected_horizon_days")), *HORIZON_DAYS)).otherwise(0).alias("expected_horizon_days"),
        F.when(F.col("_trade"), item("expected_return_pct").try_cast("double")).otherwise(0.0).alias("expected_return_pct"),
    )


def claim_yield(responses: DataFrame) -> DataFrame:
    """Kept and dropped claims per source."""
    return _claim_items(responses).groupBy("source").agg(F.count_if("usable").alias("kept"), F.count_if(~F.col("usable")).alias("dropped"))


def build_claims(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Claim records with a stable id and the columns of their article.

    ``articles`` is (link, title, event_type, article_date, source).
    """
    side = articles.select("link", F.col("title").alias("source_title"), "event_type", F.col("article_date").alias("created"), "source")
    rows = claims.drop("source", "event_type").join(side, "link")
    return rows.select(
        stable_id(F.col("ticker"), F.col("link"), F.col("claim")).alias("id"), "ticker", F.col("link").alias("source_link"), "source_title",
        "event_type", "created", "claim", "direction", "confidence", "importance", "expected_return_pct", "expected_horizon_days",
        "trade_worthy", "context", "source",
    )


def normalise_thesis(responses: DataFrame) -> DataFrame:
    direction = _text("direction")
    return _parsed(responses).filter(_has(THESIS_FIELDS) & direction.isin(*DIRECTIONS)).select(
        *responses.columns,
        _text("thesis").alias("thesis"),
        direction.alias("direction"),
        clamp(_text("confidence").try_cast("double"), 0.0, 1.0).alias("confidence"),
        _text("expected_return_pct").try_cast("double").alias("expected_return_pct"),
        clamp(whole(_text("expected_horizon_days")), *HORIZON_DAYS).alias("expected_horizon_days"),
        _texts("catalysts").alias("catalysts"),
        _texts("invalidation").alias("invalidation"),
        _text("reasoning").alias("reasoning"),
    ).filter("confidence IS NOT NULL AND expected_return_pct IS NOT NULL AND expected_horizon_days IS NOT NULL")


def normalise_critic(responses: DataFrame) -> DataFrame:
    """Reviewer's multiplier, which may temper confidence but never gut it."""
    return _parsed(responses).filter(_has(CRITIC_FIELDS)).select(
        *responses.columns,
        clamp(_text("multiplier").try_cast("double"), *CRITIC_RANGE).alias("multiplier"),
        _texts("concerns").alias("concerns"),
        _text("reasoning").alias("reasoning"),
    ).filter("multiplier IS NOT NULL")


def normalise_fundamental(responses: DataFrame) -> DataFrame:
    return _parsed(responses).filter(_has(FUNDAMENTAL_FIELDS)).select(
        *responses.columns,
        enum_or(_text("fundamental_direction"), [*DIRECTIONS, "neutral"], "neutral").alias("fundamental_direction"),
        clamp(_text("fundamental_confidence").try_cast("double"), 0.0, 1.0).alias("fundamental_confidence"),
        _text("summary").alias("summary"),
        _texts("key_changes").alias("key_changes"),
        _texts("risks").alias("risks"),
    ).filter("fundamental_confidence IS NOT NULL")


def normalise_earnings_call(responses: DataFrame) -> DataFrame:
    return _parsed(responses).filter(_has(CALL_FIELDS)).select(
        *responses.columns,
        enum_or(_text("earnings_direction"), [*DIRECTIONS, "neutral"], "neutral").alias("earnings_direction"),
        clamp(_text("earnings_confidence").try_cast("double"), 0.0, 1.0).alias("earnings_confidence"),
        _text("guidance_summary").alias("guidance_summary"),
        _text("guidance_change").alias("guidance_change"),
        enum_or(_text("management_tone"), TONES, "cautious").alias("management_tone"),
        _texts("key_qa_moments").alias("key_qa_moments"),
        _texts("risks").alias("risks"),
        _text("summary").alias("summary"),
    ).filter("earnings_confidence IS NOT NULL")


def normalise_macro(responses: DataFrame, with_direction: bool = True) -> DataFrame:
    typed = _parsed(responses).withColumn("_v", _only_object("variant"))
    out = typed.filter(_has(["narrative"])).select(
        *responses.columns, "_m", "_v", _text("narrative").alias("narrative"), truthy(F.col("_v"), "has_clear_driver").alias("has_clear_driver")
    )
    if with_direction:
        out = (
            out.withColumn("direction", enum_or(_text("direction"), ["bullish", "bearish", "neutral"], "neutral"))
            .withColumn("confidence", enum_or(_text("confidence"), ["low", "medium", "high"], "low"))
            .withColumn("trade_worthy", truthy(F.col("_v"), "trade_worthy"))
        )
    return out.drop("_m", "_v")


def claim_counts(claims: DataFrame, *by: str) -> DataFrame:
    return claims.groupBy(*(by or ("source", "ticker"))).agg(
        F.count("*").alias("claims"),
        F.count_if(F.col("direction") == "long").alias("long_claims"),
        F.count_if(F.col("direction") == "short").alias("short_claims"),
        F.count_if("trade_worthy").alias("trade_worthy_claims"),
    )


def claim_sources(claims: DataFrame) -> DataFrame:
    """Distinct source names, ``unknown`` for missing ones."""
    return claims.select(F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source")).distinct()
