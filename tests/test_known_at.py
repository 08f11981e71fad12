"""Point-in-time data: filings, windows, splits, holdings and ranks."""

import datetime as dt

import pytest
from days import day
from pyspark.sql import functions as F

from quantspark.operators import facts as fa
from quantspark.operators import holdings as ho
from quantspark.operators import ltr
from quantspark.operators import panel as pn
from quantspark.operators import pit
from quantspark.operators import ranking as rk

FACT = "ticker string, concept string, start_d date, end_d date, val double, filed date, form string, fy int, fp string, tag string"


def quarter(y, q, val, filed, form="10-Q"):
    start = dt.date(y, 3 * q - 2, 1)
    end = (dt.date(y + (q == 4), (3 * q) % 12 + 1, 1)) - dt.timedelta(days=1)
    return ("A", "revenue", start, end, float(val), day(filed), form, y, f"Q{q}", "Revenues")


def history(spark):
    rows = [quarter(2022, 1, 10, "2022-05-01"), quarter(2022, 2, 11, "2022-08-01"), quarter(2022, 3, 12, "2022-11-01"),
            ("A", "revenue", day("2022-01-01"), day("2022-12-31"), 50.0, day("2023-02-15"), "10-K", 2022, "FY", "Revenues"),
            quarter(2023, 1, 20, "2023-05-01"), quarter(2022, 1, 99, "2023-05-01", "10-Q/A")]
    return spark.createDataFrame(rows, FACT)


def test_missing_quarter_and_trailing_sum(spark):
    known = fa.fact_history(history(spark))
    q4 = known.filter("form = 'derived'").collect()
    assert [(r.val, r.filed.isoformat(), r.end_d.isoformat()) for r in q4] == [(17.0, "2023-02-15", "2022-12-31")]
    # The derived quarter starts at the end of the third, so it spans 92 days and counts as one.
    dates = ["2023-02-14", "2023-02-15", "2023-05-01"]
    grid = spark.createDataFrame([("A", "revenue", day(d)) for d in dates], "ticker string, concept string, date date")
    got = {r.date.isoformat(): r.ttm for r in fa.ttm_as_of(grid, known).collect()}
    assert got == {"2023-02-14": None, "2023-02-15": 50.0, "2023-05-01": 11.0 + 12.0 + 17.0 + 20.0}


def test_later_filings_do_not_change_the_past(spark):
    known = fa.fact_history(history(spark))
    grid = spark.createDataFrame([("A", "revenue", day("2023-03-01"))], "ticker string, concept string, date date")
    cut = fa.fact_history(history(spark).filter("filed <= '2023-03-01'"))
    assert fa.ttm_as_of(grid, known).first().ttm == fa.ttm_as_of(grid, cut).first().ttm == 50.0


def test_dedup_keeps_the_last_filed_with_null_starts(spark):
    rows = [("A", "shares", None, day("2023-03-31"), v, day(f), "10-Q", 2023, "Q1", "T") for v, f in ((1.0, "2023-05-01"), (2.0, "2023-06-01"))]
    kept = fa.dedup_facts(spark.createDataFrame(rows, FACT)).collect()
    assert [r.val for r in kept] == [2.0]


def test_windows_are_open_at_the_far_end(spark):
    grid = spark.createDataFrame([("A", day("2024-07-01")), ("B", day("2024-07-01"))], "ticker string, date date")
    rows = [("A", "Purchase at x", day("2024-07-01") - dt.timedelta(days=d), 1.0, v) for d, v in ((180, 100.0), (179, 10.0), (0, 1.0), (-1, 1000.0))]
    tx = spark.createDataFrame([*rows, ("A", None, day("2024-06-30"), 1.0, 7.0)], "ticker string, transaction string, start_date date, shares double, value double")
    got = {r.ticker: r.insider_flow for r in pit.insider_flow_as_of(grid, tx).collect()}
    assert got == {"A": 11.0, "B": None}
    old = spark.createDataFrame([("A", "Sale", day("2020-01-01"), 1.0, 5.0)], tx.schema)
    assert pit.insider_flow_as_of(grid.filter("ticker = 'A'"), old).first().insider_flow == 0.0
    acts = spark.createDataFrame([("A", "f", day("2024-06-30"), "up", 0.0, 1), ("A", "f", day("2024-03-01"), "down", 0.0, 2)], "ticker string, firm string, grade_date date, action string, target double, seq int")
    up = {r.ticker: (r.net_upgrades, r.revisions_trend) for r in pit.upgrades_as_of(grid, acts).collect()}
    assert up == {"A": (1.0, 2.0), "B": (0.0, None)}


def test_insider_tags_are_case_blind_and_null_safe(spark):
    tx = spark.createDataFrame([("A", "automatic purchase"), ("A", "SALE at 3"), ("A", None)], "ticker string, transaction string")
    assert [(r.is_buy, r.is_sale) for r in pit.tag_insider(tx).collect()] == [(True, False), (False, True), (False, False)]


def test_consensus_by_firm_with_staleness_splits_and_zero_targets(spark):
    acts = [("A", "one", day("2022-01-01"), "main", 100.0, 1), ("A", "one", day("2024-01-01"), "main", 60.0, 2), ("A", "two", day("2022-01-01"), "main", 500.0, 3),
            ("A", "three", day("2024-02-01"), "main", 90.0, 4), ("A", "three", day("2024-02-01"), "main", 80.0, 5), ("A", "four", day("2024-01-05"), "main", 70.0, 6), ("A", "four", day("2024-02-05"), "down", 0.0, 7)]
    actions = spark.createDataFrame(acts, "ticker string, firm string, grade_date date, action string, target double, seq int")
    splits = spark.createDataFrame([("A", day("2024-01-15"), 2.0)], "ticker string, split_d date, ratio double")
    grid = spark.createDataFrame([("A", day("2024-03-01"), 50.0)], "ticker string, date date, price double")
    # one: 60 / 2 = 30 (before the split); two is stale; three: the day's last action, 80; four withdrew.
    assert pit.analyst_upside_as_of(grid, actions, splits).first().analyst_upside == pytest.approx(((30 + 80) / 2 / 50 - 1) * 100)


def test_split_on_the_day_itself_is_not_after_it(spark):
    rows = spark.createDataFrame([("A", day("2024-01-15")), ("A", day("2024-01-14")), ("B", day("2024-01-14"))], "ticker string, d date")
    splits = spark.createDataFrame([("A", day("2024-01-15"), 2.0), ("A", day("2024-02-15"), 3.0)], "ticker string, split_d date, ratio double")
    got = {(r.ticker, r.d.day): r.split_factor for r in pit.split_factor(rows, splits).collect()}
    assert got == {("A", 15): 3.0, ("A", 14): 6.0, ("B", 14): 1.0}


def test_institutional_history(spark):
    b1, b2, b3 = (day(d) for d in ("2024-05-31", "2024-08-31", "2024-11-30"))
    p1, p2 = day("2024-03-31"), day("2024-06-30")
    shape = "accession string, cusip string, cik int, name string, period date, bucket_end date, shares double, value double"
    lines = [("a1", "C", 1, "APPLE INC", p1, b1, 100.0, 1000.0), ("a2", "C", 2, "APPLE INC", p1, b1, 50.0, 500.0), ("a3", "C", 1, "APPLE INC", p2, b2, 110.0, 1100.0),
             ("a4", "C", 3, "APPLE", p2, b2, 40.0, 400.0), ("a5", "C", 1, "APPLE INC", p2, b3, 999.0, 9.0), ("a6", "D", 1, "APPLEBEES", p2, b3, 1.0, 1.0), ("a7", "C", 2, "APPLE INC", p1, b2, 1.0, 1.0)]
    df = spark.createDataFrame(lines, shape)
    cusips, holders = ho.cusip_aggregate(df), ho.holder_aggregate(df)
    assert {(r.bucket_end, r.period): r.name for r in cusips.filter("cusip = 'C'").collect()}[(b2, p2)] == "APPLE"  # a tie goes by spelling
    known = ho.vintages(cusips, 1)
    flow = {r.vintage: (r.period, r.total_shares, r.pct_change) for r in ho.institutional_history(cusips, holders, {"AAPL": "Apple Inc."}, known, 1).collect()}
    # In August: the later filing of p1 is the stragglers' bucket; filer 1 grew 10 %, filer 3 is new.
    assert flow[b2] == (p2, 150.0, pytest.approx((10 + 100) / 2))
    assert b1 not in flow
    line = {r.d: r.institutional_flow for r in ho.institutional_flow_timeline(cusips, holders, {"AAPL": "Apple Inc."}).collect()}
    assert line[b1] is None and line[b2] == pytest.approx(55.0)


def test_percentile_ranks_and_composite(spark):
    rows = [("a", 3.0, 1.0), ("b", 1.0, 2.0), ("c", 2.0, 3.0), ("d", 2.0, None), ("e", None, None)]
    table = spark.createDataFrame(rows, "ticker string, revenue_growth double, forward_pe double")
    ranks = {(r.ticker, r.factor): r.pct for r in rk.percentile_ranks(table).collect()}
    assert [ranks[(t, "revenue_growth")] for t in "abcde"] == [100.0, 25.0, 62.5, 62.5, None]
    assert [ranks[(t, "forward_pe")] for t in "abc"] == [pytest.approx(100.0), pytest.approx(200 / 3), pytest.approx(100 / 3)]
    scores = rk.category_scores(rk.percentile_ranks(table))
    both = {r.ticker: (r.Growth, r.Valuation, r.Quality) for r in scores.collect()}
    assert both["d"] == (62.5, None, None)
    whole = scores.select("ticker", "Growth", "Valuation", *[F.lit(50.0).alias(c) for c in ("Quality", "Momentum", "Sentiment", "Ownership")])
    got = {r.ticker: r.composite for r in rk.composite_score(whole, {"Growth": 1.0, "Valuation": 3.0}).collect()}
    assert got["e"] == pytest.approx(0.25 * 62.5 + 0.75 * 200 / 3)
    assert got["d"] == pytest.approx(0.25 * 62.5 + 0.75 * 200 / 3)
    # A category missing for everyone leaves no composite, and neither do weights of zero.
    assert all(r.composite is None for r in rk.composite_score(scores, {"Growth": 1.0}).collect())
    assert all(r.composite is None for r in rk.composite_score(whole, {}).collect())


def test_zero_counts_as_missing_in_ratios(spark):
    info = spark.createDataFrame([("A", {"operatingCashflow": "0", "totalRevenue": "5", "volume": "0", "regularMarketVolume": "4", "averageVolume": "2", "targetMeanPrice": "12", "currentPrice": "0", "regularMarketPrice": "10"})], "ticker string, info map<string,string>")
    r = rk.info_factors(info).first()
    assert r.fcf_margin is None and r.relative_volume == 2.0 and r.analyst_upside == pytest.approx(20.0) and r.low_short_interest is None


def test_factor_changes(spark):
    rows = [("A", day("2024-01-01"), 1, {"Growth": {"x": 10.0, "y": 0.0, "z": 100.0}}), ("A", day("2024-01-01"), 2, {"Growth": {"x": 11.0, "y": 5.0, "z": 104.96}, "New": {"w": 1.0}})]
    got = rk.factor_changes(spark.createDataFrame(rows, "ticker string, d date, seq int, factors map<string,map<string,double>>")).collect()
    assert [(r.factor, r.delta_pct) for r in got] == [("x", 10.0), ("z", 5.0)]


def test_relevance_split_and_rank_correlation(spark):
    rows = [(day("2024-01-01") + dt.timedelta(days=d), f"t{i:02d}", float(i if d % 2 else -i), float(i)) for d in range(10) for i in range(11)]
    frame = spark.createDataFrame(rows, "date date, ticker string, score double, forward_return double")
    labels = [r.relevance for r in ltr.relevance_labels(frame).filter("date = '2024-01-01'").orderBy("ticker").collect()]
    assert labels == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert ltr.time_split(frame).filter("is_test").select("date").distinct().count() == 3
    ic = {r.date.day: r.spearman for r in ltr.rank_ic(frame).collect()}
    assert ic[1] == pytest.approx(-1.0) and ic[2] == pytest.approx(1.0)


def test_forward_return_needs_quotes_on_the_shared_days(spark, bars):
    prices = bars({"A": {"2024-01-01": 10.0, "2024-01-03": 12.0}, "B": {"2024-01-02": 5.0, "2024-01-03": 6.0}})
    grid = spark.createDataFrame([("A", day("2024-01-01")), ("B", day("2024-01-01"))], "ticker string, date date")
    got = {r.ticker: r.forward_return for r in pn.forward_return(grid, prices, prices.select("d").distinct(), 2).collect()}
    assert got == {"A": pytest.approx(20.0), "B": None}


def test_panel_rows_are_replaced(spark):
    old = spark.createDataFrame([(day("2024-01-01"), "A", 1.0), (day("2024-01-01"), "B", 2.0)], "date date, ticker string, momentum double")
    new = spark.createDataFrame([(day("2024-01-01"), "A", 9.0), (day("2024-01-02"), "A", 3.0)], old.schema)
    got = sorted((r.date.day, r.ticker, r.momentum) for r in pn.upsert_panel(old, new).collect())
    assert got == [(1, "A", 9.0), (1, "B", 2.0), (2, "A", 3.0)]
