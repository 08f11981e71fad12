"""Schemas of every table and log the package reads or writes."""

BARS = "ticker string, d date, open double, close double, volume double"
INTRADAY = "ticker string, ts timestamp, close double"
EARNINGS = "ticker string, earnings_date timestamp, eps_estimate double, reported_eps double, surprise_pct double"
INSIDER = "ticker string, insider string, position string, transaction string, start_date date, shares double, value double, ownership string"
HOLDERS = "ticker string, holder string, holder_type string, date_reported date, pct_held double, shares double, value double, pct_change double"
REC_TREND = "ticker string, period string, strongBuy int, buy int, hold int, sell int, strongSell int"
ANALYST = "ticker string, grade_date timestamp, firm string, to_grade string, from_grade string, action string, current_price_target double"
SPLITS = "ticker string, split_d date, ratio double"
FACTS = "ticker string, concept string, start_d date, end_d date, val double, filed date, form string, fy int, fp string, tag string"
TRADES = "date date, ticker string, action string, shares double, price double, note string, rule string"
ARTICLES = "source string, title string, link string, published timestamp, author string, summary string, content string"
CARD_MARKS = "kind string, user_id string, card string, op string, ts timestamp"

EVENT = (
    "struct<event: string, companies: array<string>, event_type: string, importance: int, time_horizon: string, "
    "key_facts: array<string>, type: string, novel: boolean, summary: string>"
)
ARCHIVE = f"seen_date date, article_date date, title string, text string, source string, event {EVENT}"

# Elements of the per-key JSON logs.
LOGS = {
    "claims": (
        "id string, ticker string, source_link string, source_title string, event_type string, created date, claim string, direction string, "
        "confidence double, importance int, expected_return_pct double, expected_horizon_days int, catalysts array<string>, "
        "invalidation array<string>, trade_worthy boolean, context string, source string"
    ),
    "theses": (
        "event string, date date, thesis string, direction string, confidence double, news_confidence double, fundamental_direction string, "
        "fundamental_confidence double, earnings_direction string, earnings_confidence double, pre_critic_confidence double, critic_multiplier double, "
        "expected_return_pct double, expected_horizon_days int, catalysts array<string>, invalidation array<string>, reasoning string, "
        "claims_considered int, deterministic_flags array<string>, deterministic_multiplier double, llm_concerns array<string>, "
        "llm_multiplier double, llm_reasoning string, final_multiplier double, confidence_before double, confidence_after double"
    ),
    "fundamentals": (
        "date date, fundamental_direction string, fundamental_confidence double, summary string, key_changes array<string>, risks array<string>, "
        "reasoning string, fair_value_estimate double, current_price double, implied_return_pct double, "
        "factors map<string, map<string, double>>, trigger string"
    ),
    "earnings_calls": (
        "date date, transcript_date date, transcript_url string, earnings_direction string, earnings_confidence double, guidance_summary string, "
        "guidance_change string, management_tone string, key_qa_moments array<string>, risks array<string>, summary string"
    ),
    "macro": (
        "period string, week string, date date, value double, delta double, history array<array<string>>, narrative string, has_clear_driver boolean, "
        "headlines_used array<struct<title: string, domain: string, date: string>>, direction string, confidence string, trade_worthy boolean"
    ),
    "positions": (
        "event string, id string, ticker string, created date, entry_confidence double, expected_horizon_days int, rule string, status string, "
        "closed_date date, actual_return_pct double, close_reason string"
    ),
}
