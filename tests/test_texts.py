"""Text functions, response normalisers, theses, macro series and cards."""

import datetime as dt
import html
import re

import pytest
from days import day
from pyspark.sql import functions as F

from quantspark.functions import dates as fd
from quantspark.functions import formats as ff
from quantspark.functions import text as ft
from quantspark.operators import articles as ar
from quantspark.operators import cards as cd
from quantspark.operators import claims as cl
from quantspark.operators import macro as mc
from quantspark.operators import thesis as th


def test_strip_html_order(spark):
    texts = ["<p>a&amp;lt;b</p>\n\n<b>x&nbsp;y</b> &eacute;&#8212;&#x41; ", "&nbsp;plain&nbsp;", "", "1 < 2 & 3 > 2", "<br/>"]
    want = [html.unescape(re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", t))).strip() for t in texts]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ft.strip_html(F.col("t")).alias("x")).collect()]
    assert got == want
    assert spark.sql("select cast(null as string) t").select(ft.strip_html(F.col("t")).alias("x")).first().x is None


def test_mentions_respect_word_boundaries(spark):
    names = {"MU": "Micron", "BRK-B": "Berkshire Hathaway"}
    texts = {"he must music": False, "MU rose": True, "micron's plan": True, "(brk-b)": True, "Micronesia": False, "éMU": False}
    rows = spark.createDataFrame(list(texts.items()), "t string, want boolean").select("want", ft.mentions(F.col("t"), names).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_transcript_and_slug(spark):
    row = spark.sql("select 'Hi. FIRST question comes from X. open the call for questions' t, 'applied-industrial-ait-q4-2026-earnings-call' s, 'nothing' n").select(
        ft.split_transcript(F.col("t")).alias("a"), ft.ticker_from_slug(F.col("s")).alias("b"), ft.ticker_from_slug(F.col("n")).alias("c"), ft.split_transcript(F.col("n")).alias("d")).first()
    assert row.a.prepared == "Hi. " and row.a.qa.startswith("FIRST question") and row.b == "ait" and row.c is None and (row.d.prepared, row.d.qa) == ("nothing", "")


def test_date_keys_and_buckets(spark):
    d = F.to_date(F.lit("2024-12-30"))
    row = spark.range(1).select(
        fd.iso_week_key(d).alias("w"), fd.month_key(d).alias("m"), fd.month_end_label(d, "QE").alias("q"), fd.month_end_label(d, "YE").alias("y"),
        fd.bucket_end(F.lit("2023q4_form13f.zip")).alias("b1"), fd.bucket_end(F.lit("x/01jun2024-31aug2024_form13f")).alias("b2")).first()
    assert (row.w, row.m, str(row.q), str(row.y), str(row.b1), str(row.b2)) == ("2025-W01", "2024-12", "2024-12-31", "2024-12-31", "2023-12-31", "2024-08-31")


def test_formats(spark):
    values = spark.createDataFrame([(52_300_000.0,), (-1.2e9,), (900.0,), (None,)], "v double").select(ff.compact_dollars(F.col("v")).alias("x")).collect()
    assert [r.x for r in values] == ["$52.3M", "-$1.20B", "$900", "—"]
    row = spark.range(1).select(
        ff.factor_text(F.lit("revenue_growth"), F.lit(0.12)).alias("a"), ff.factor_text(F.lit("forward_pe"), F.lit(24.13)).alias("b"), ff.factor_text(F.lit("insider_flow"), F.lit(-1234.0)).alias("c"),
        ff.macro_delta_text(F.lit("bps"), F.lit(0.05)).alias("d"), ff.macro_value_text(F.lit("usd"), F.lit(1234.5)).alias("e")).first()
    assert tuple(row) == ("+12.0%", "24.1x", "$-1,234", "+5 bps", "$1,234.50")
    labels = spark.range(1).select(ff.metric_label(F.lit("price_vs_ma")).alias("a"), ff.metric_label(F.lit("trailing_pe")).alias("b")).first()
    assert tuple(labels) == ("Price vs MA", "Trailing PE")


def test_display_names_keep_a_ticker_named_after_itself(spark):
    pairs = cd.name_pairs(spark.createDataFrame([("AAPL", "Apple"), ("SPCX", "SPCX")], "ticker string, name string"))
    assert {(r.name, r.ticker) for r in pairs.collect()} == {("Apple", "AAPL"), ("AAPL", "AAPL"), ("SPCX", "SPCX")}
    assert {(r.ticker, r.name) for r in cd.display_names(pairs).collect()} == {("AAPL", "Apple"), ("SPCX", "SPCX")}


EVENT = '{"event": "e", "companies": ["B", "A", "A", "X"], "event_type": "%s", "importance": %s, "time_horizon": "weeks", "key_facts": ["f"], "type": "news", "novel": %s%s}'


def test_events(spark):
    raws = [EVENT % ("earnings", '"11"', "true", ', "summary": "s"'), "Sure!\n" + EVENT % ("gossip", '"x"', "false", ', "summary": null') + " done", EVENT % ("capex", "3", "true", ""), "no json", "{broken", '{"a": 1}', None,
            EVENT % ("earnings", "7", "true", ', "summary": "s"') + ' and {"b": 2}', (EVENT % ("earnings", "7", "true", ', "summary": "s"')).replace('"', "'"),
            EVENT % ("earnings", '"7.5"', '"false"', ', "summary": "s"'), EVENT % ("earnings", "7.5", "0", ', "summary": "s"')]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = {r.i: r for r in cl.normalise_event(rows, ["A", "B"]).collect()}
    assert set(got) == {0, 1, 9, 10}
    assert [(got[i].importance, got[i].novel) for i in (9, 10)] == [(0, True), (7, False)]
    assert (got[0].companies, got[0].event_type, got[0].importance, got[0].novel) == (["A", "B"], "earnings", 10, True)
    assert (got[1].event_type, got[1].importance, got[1].novel, got[1].summary) == ("other", 0, False, "")
    filing = cl.normalise_known_company_event(rows.withColumn("ticker", F.lit("Q"))).filter("i = 2").first()
    assert filing.companies == ["Q"] and filing.type == "news"
    assert sorted(r.i for r in ar.event_gate(cl.normalise_event(rows, ["A"])).collect()) == [0]


def test_claims(spark):
    raw = """Here: {"claims": [
      {"claim": "a", "trade_worthy": true, "direction": "long", "confidence": 1.5, "importance": 12, "expected_horizon_days": 3, "expected_return_pct": 5},
      {"claim": "b", "trade_worthy": true, "direction": "long", "confidence": 0.5, "importance": 5, "expected_return_pct": 5},
      {"claim": "c", "trade_worthy": false, "direction": "short", "confidence": 0.5, "importance": 5, "context": "why"},
      {"claim": "d", "trade_worthy": false, "direction": "flat", "confidence": 0.5, "importance": 5},
      {"claim": "e", "direction": "long", "confidence": 0.5, "importance": 5}]}"""
    rows = spark.createDataFrame([("l", "T", "src", raw), ("m", "T", "src", '{"claims": 7}'), ("n", "T", "src", '{"claims": []}')], "link string, ticker string, source string, raw string")
    got = {r.claim: r for r in cl.normalise_claims(rows).collect()}
    assert set(got) == {"a", "c"}
    assert (got["a"].confidence, got["a"].importance, got["a"].expected_horizon_days, got["a"].expected_return_pct) == (1.0, 10, 7, 5.0)
    assert (got["c"].context, got["c"].expected_horizon_days) == ("why", 0)
    y = cl.claim_yield(rows).first()
    assert (y.kept, y.dropped) == (2, 3)


def test_theses_reviews_and_snapshots(spark):
    one = lambda raw: spark.createDataFrame([("T", raw)], "ticker string, raw string")
    thesis = '{"thesis": "t", "direction": "%s", "confidence": 2, "expected_return_pct": 1, "expected_horizon_days": 9999, "catalysts": ["c"], "invalidation": [], "reasoning": "r"}'
    r = cl.normalise_thesis(one(thesis % "long")).first()
    assert (r.confidence, r.expected_horizon_days, r.catalysts) == (1.0, 730, ["c"])
    assert cl.normalise_thesis(one(thesis % "neutral")).count() == 0
    assert cl.normalise_critic(one('{"multiplier": 0.1, "concerns": [], "reasoning": "r"}')).first().multiplier == 0.7
    call = '{"earnings_direction": "up", "earnings_confidence": 0.4, "guidance_summary": "", "guidance_change": "", "management_tone": "odd", "key_qa_moments": null, "risks": ["x"], "summary": ""}'
    c = cl.normalise_earnings_call(one(call)).first()
    assert (c.earnings_direction, c.management_tone, c.key_qa_moments, c.risks) == ("neutral", "cautious", [], ["x"])
    m = cl.normalise_macro(one('{"narrative": "n", "has_clear_driver": true, "confidence": "huge"}')).first()
    assert (m.has_clear_driver, m.direction, m.confidence, m.trade_worthy) == (True, "neutral", "low", False)


def test_critic_flags_compound_and_only_temper(spark):
    claims = spark.createDataFrame([("c1", "A", "l", day("2024-01-01")), ("c2", "A", "l", day("2024-01-02")), ("c3", "B", "l", day("2024-03-01")), ("c4", "B", "m", day("2024-03-01")), ("c5", "B", "m", day("2024-03-01"))], "id string, ticker string, source_link string, created date")
    theses = spark.createDataFrame([("A", 0.8, 10), ("B", 0.8, 10)], "ticker string, confidence double, expected_horizon_days int")
    flagged = th.critic_flags(theses, claims, "2024-03-05")
    got = {r.ticker: (r.deterministic_multiplier, len(r.deterministic_flags)) for r in flagged.collect()}
    assert got == {"A": (pytest.approx(0.9 * 0.85 * 0.85), 3), "B": (1.0, 0)}
    reviews = spark.createDataFrame([("B", 0.7, ["x"])], "ticker string, multiplier double, concerns array<string>")
    final = {r.ticker: r.confidence for r in th.final_confidence(flagged, reviews).collect()}
    assert final["B"] == pytest.approx(0.56) and final["A"] == pytest.approx(0.8 * 0.9 * 0.85 * 0.85)


def test_retries_reset_on_success(spark):
    rows = [("A", 1, False), ("A", 2, True), ("A", 3, False), ("B", 1, False), ("B", 2, False), ("B", 3, False), ("C", 1, True)]
    log = spark.createDataFrame([(t, day("2024-01-01"), s, ok) for t, s, ok in rows], "ticker string, date date, seq int, ok boolean")
    assert {r.ticker: (r.consecutive_failures, r.retry) for r in th.aggregation_retry(log).collect()} == {"A": (1, True), "B": (3, False)}


def test_feeds_and_age(spark):
    rows = [("n", "t", "l1", dt.datetime(2024, 7, 1)), ("n", "t", "l2", None), ("n", "t", "l3", dt.datetime(2023, 12, 1)), ("SEC 8-K: AAPL", "8-K", "l4", dt.datetime(2024, 6, 1))]
    feed = spark.createDataFrame(rows, "source string, title string, link string, published timestamp")
    assert sorted(r.link for r in ar.recent_articles(feed, "2024-07-01").collect()) == ["l1", "l2", "l4"]
    assert ar.concat_feeds(feed).filter("link = 'l4'").first().title == "AAPL: 8-K"
    assert [r.link for r in ar.article_order(feed, ["n"]).collect()] == ["l1", "l3", "l2", "l4"]


def test_article_text_falls_back_to_the_page(spark):
    rows = [("a", "s1", "<p>body</p>", "sum"), ("b", "s2", "", "<i>sum</i>"), ("c", "s1", "", "x")]
    arts = spark.createDataFrame(rows, "link string, source string, content string, summary string")
    pages = spark.createDataFrame([("a", "long page"), ("b", "other"), ("c", "")], "link string, text string")
    assert {r.link: r.text for r in ar.article_text(arts, ["s1"], pages).collect()} == {"a": "long page", "b": "sum", "c": "x"}


def test_narratives_replace_within_a_bucket(spark):
    rows = [("g", None, "2024-12-30", 1), ("g", "week", "2025-01-01", 2), ("g", "month", "2025-01-02", 3), ("g", "week", "2025-01-06", 4), ("g", "month", "2025-01-20", 5), ("g", "week", "2025-01-01", 6)]
    log = spark.createDataFrame([(k, p, day(d), s) for k, p, d, s in rows], "series_key string, period string, date date, seq int")
    assert sorted(r.seq for r in mc.upsert_bucketed(log).collect()) == [2, 4, 5, 6]
    assert {r.period: r.seq for r in mc.latest_narrative(log).collect()} == {"week": 6, "month": 5}


def test_tiles(spark):
    start = day("2024-01-01")
    series = [("w", start + dt.timedelta(days=i), 100.0 + i) for i in (0, 1, 2, 8, 9)] + [("m", start, 2.0), ("m", start + dt.timedelta(days=31), 3.0), ("z", start, 1.0)]
    config = [("w", 1, "W", "weekly", "usd", "level", "pct_change", 7, 30), ("m", 0, "M", "monthly", "pct", "level", "pp", 365, None), ("z", 2, "Z", "monthly", "pct", "yoy_pct", "pp", 5, None)]
    tiles = mc.macro_tiles(spark.createDataFrame(series, "key string, d date, value double"), spark.createDataFrame(config, mc.SERIES_CONFIG)).collect()
    assert [t.key for t in tiles] == ["m", "w"]
    assert tiles[0].delta == 1.0 and tiles[1].delta == pytest.approx((109 / 102 - 1) * 100)
    assert [p.value for p in tiles[1].history] == [108.0, 109.0] and len(tiles[1].history_extra) == 5 and len(tiles[0].history_extra) == 0


def test_headlines_cap_domains_then_cut(spark):
    rows = [(i, "a" if i < 5 else f"d{i}", f"t{i}") for i in range(10)]
    got = mc.diverse_headlines(spark.createDataFrame(rows, "ord int, domain string, title string"), 4, 2).collect()
    assert [r.ord for r in got] == [0, 1, 5, 6]


def test_cards(spark):
    claims = spark.createDataFrame([("c1", "A", day("2024-07-01"), "x", "", 9, "l"), ("c2", "A", day("2024-07-02"), "y", "S", 3, "l")], "id string, ticker string, created date, claim string, source string, importance int, source_link string")
    snaps = spark.createDataFrame([("A", day("2024-06-30"), "f")], "ticker string, date date, text string")
    feed = cd.card_feed(cd.claim_cards(claims), cd.snapshot_cards(snaps, "fundamental"))
    assert [r.card_type for r in feed.collect()] == ["claim", "claim", "fundamental"]
    kept = cd.card_filter(feed, "2024-07-02", ["unknown"], "1w", "8+").collect()
    assert sorted(r.card_type for r in kept) == ["claim", "fundamental"]
    ts = dt.datetime(2024, 7, 1)
    marks = [("read", "u", "c1", "mark", ts, 1), ("read", "u", "c1", "mark", ts, 2), ("read", "u", "c2", "mark", ts, 3), ("read", "u", "c2", "unmark", ts, 4), ("read", "u", "none", "unmark", ts, 5)]
    read = cd.marked(spark.createDataFrame(marks, "kind string, user_id string, card string, op string, ts timestamp, seq int"))
    assert [r.card for r in read.collect()] == ["c1"]
    assert sorted(r.text for r in cd.unread(feed, read).collect()) == ["f", "y"] and cd.only_marked(feed, read).count() == 1


def test_thesis_log_rows_and_context(spark):
    claims = spark.createDataFrame([("c1", "A", "l", day("2024-01-01"))], "id string, ticker string, source_link string, created date")
    theses = spark.createDataFrame([("A", 0.5, 10, "t", "long", 1.0, ["c"], ["i"])], "ticker string, confidence double, expected_horizon_days int, thesis string, direction string, expected_return_pct double, catalysts array<string>, invalidation array<string>")
    none = spark.createDataFrame([], "ticker string, multiplier double, concerns array<string>")
    final = th.final_confidence(th.critic_flags(theses, claims, "2024-01-02"), none)
    rows = {r.event: r for r in th.thesis_events(final, "2024-01-02").collect()}
    assert rows["aggregated"].confidence == pytest.approx(0.45) and rows["aggregated"].claims_considered == 1
    assert rows["critic"].llm_multiplier is None and rows["critic"].llm_concerns == [] and len(rows["critic"].deterministic_flags) == 1
    funds = spark.createDataFrame([("A", day("2024-01-01"), 1, "long", 0.5), ("A", day("2024-01-01"), 2, "short", 0.6)], "ticker string, date date, seq int, fundamental_direction string, fundamental_confidence double")
    calls = spark.createDataFrame([], "ticker string, date date, seq int, earnings_direction string, earnings_confidence double")
    row = th.with_snapshots(theses, funds, calls).first()
    assert (row.fundamental_direction, row.earnings_direction) == ("short", None)
    due = spark.createDataFrame([("A", day("2024-01-03")), ("B", day("2024-01-04"))], "ticker string, earnings_date date")
    done = spark.createDataFrame([], "ticker string, earnings_date date")
    assert [r.ticker for r in th.earnings_refresh_due(due, done, "2024-01-02").collect()] == ["A"]
    index = spark.createDataFrame([("a", day("2024-01-01"), "p1"), ("b", day("2024-01-01"), "p2")], "ticker string, transcript_date date, path string")
    stored = spark.createDataFrame([("a", "p1", day("2024-01-01"), 1)], "ticker string, transcript_url string, date date, seq int")
    assert [r.ticker for r in ar.new_transcripts(index, stored).collect()] == ["b"]
