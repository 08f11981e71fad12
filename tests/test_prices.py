"""Calendar-aware returns, as-of lookups and event studies against hand-made cases and pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from days import day
from pyspark.sql import functions as F

from quantspark.operators import asof as ao
from quantspark.operators import calendar_effects as ce
from quantspark.operators import correlation as co
from quantspark.operators import events as ev
from quantspark.operators import timeseries as ts


def random_frame(seed=3, n=140, tickers=("A", "B", "C", "D")):
    rng = np.random.default_rng(seed)
    dates = pd.date_range("2024-01-01", periods=n, freq="D")
    frame = pd.DataFrame(100 * np.cumprod(1 + rng.normal(0, 0.03, (n, len(tickers))), axis=0), index=dates, columns=list(tickers))
    frame = frame.mask(rng.random(frame.shape) < 0.15)
    if "D" in frame:
        frame["D"] = frame["D"].where(dates >= "2024-02-10")
    return frame


def to_bars(spark, frame):
    long = frame.rename_axis("d").reset_index().melt("d", var_name="ticker", value_name="close").dropna()
    long["d"] = long["d"].dt.date
    long["open"], long["volume"] = long["close"], 100.0
    return spark.createDataFrame(long[["ticker", "d", "open", "close", "volume"]].values.tolist(), "ticker string, d date, open double, close double, volume double")


def test_return_needs_the_previous_calendar_row(bars):
    prices = bars({"STK": {"2024-03-01": 10.0, "2024-03-04": 11.0}, "CRY": {"2024-03-01": 1.0, "2024-03-02": 2.0, "2024-03-03": 3.0, "2024-03-04": 3.0}})
    got = {(r.ticker, r.d.isoformat()): r.ret for r in ts.daily_returns(prices).collect()}
    assert got[("STK", "2024-03-04")] is None
    assert got[("CRY", "2024-03-02")] == pytest.approx(1.0)
    alone = ts.daily_returns(prices.filter("ticker = 'STK'")).filter("d = '2024-03-04'").first()
    assert alone.ret == pytest.approx(0.1)


def test_returns_match_pandas(spark):
    frame = random_frame().dropna(how="all")
    want = frame.pct_change(fill_method=None).stack().dropna()
    got = ts.daily_returns(to_bars(spark, frame)).filter("ret is not null").toPandas()
    have = got.set_index([pd.to_datetime(got["d"]), "ticker"])["ret"]
    assert len(have) == len(want)
    for key, value in want.items():
        assert have[key] == pytest.approx(value)


@pytest.mark.parametrize("direction,strict,want", [("forward", False, "2024-01-05"), ("forward", True, "2024-01-09"), ("backward", False, "2024-01-05"), ("backward", True, "2024-01-03")])
def test_asof_edges(spark, direction, strict, want):
    series = spark.createDataFrame([("A", day(d), float(i)) for i, d in enumerate(["2024-01-03", "2024-01-05", "2024-01-09"])], "k string, d date, v double")
    probes = spark.createDataFrame([("A", day("2024-01-05"))], "k string, at date")
    row = ao.asof(probes, series, ["k"], "at", "d", {"v": "v"}, direction, strict, when_as="hit").first()
    assert row.hit.isoformat() == want


def test_asof_keeps_unmatched_and_duplicate_probes_and_caps_age(spark):
    series = spark.createDataFrame([("A", day("2024-01-03"), 1.0)], "k string, d date, v double")
    probes = spark.createDataFrame([("A", day("2024-01-01")), ("A", day("2024-01-12")), ("A", day("2024-01-12")), ("B", day("2024-01-12"))], "k string, at date")
    rows = ao.asof(probes, series, ["k"], "at", "d", {"v": "v"}).collect()
    assert sorted((r.k, r.at.day, r.v) for r in rows if r.v is not None) == [("A", 12, 1.0), ("A", 12, 1.0)]
    assert len(rows) == 4
    assert all(r.v is None for r in ao.asof(probes, series, ["k"], "at", "d", {"v": "v"}, max_age_days=7).collect())


def dip_loop(frame, bench, drop, hold, cost):
    out, pending = [], []
    rets = frame.pct_change(fill_method=None)
    for t in frame.columns:
        s = frame[t].dropna()
        for d in s.index:
            if not (pd.notna(rets.loc[d, t]) and rets.loc[d, t] <= -drop):
                continue
            later = s.index[s.index >= d + pd.Timedelta(days=hold)]
            if not len(later):
                pending.append((t, d.date(), (s.index[-1] - d).days))
                continue
            window = bench[(bench.index >= d) & (bench.index <= later[0])]
            if len(window):
                b = window.iloc[-1] / window.iloc[0] - 1
                out.append((t, d.date(), later[0].date(), round(s[later[0]] / s[d] - 1 - cost / 1e4, 9), round(b, 9)))
    return sorted(out), sorted(pending)


def test_dip_trades_match_a_loop(spark):
    frame = random_frame(5).dropna(how="all")
    bench = random_frame(9, 100, ("M",))["M"].dropna()
    m = spark.createDataFrame([(d.date(), float(v)) for d, v in bench.items()], "d date, close double")
    want, pending = dip_loop(frame, bench, 0.03, 9, 10)
    got = ev.dip_trades(to_bars(spark, frame), m, 0.03, 9, 10.0).collect()
    assert sorted((r.ticker, r.buy_date, r.sell_date, round(r.stock_return, 9), round(r.benchmark_return, 9)) for r in got) == want
    late = ev.pending_dips(to_bars(spark, frame), 0.03, 9).collect()
    assert sorted((r.ticker, r.buy_date, r.days_held_so_far) for r in late) == pending


def test_no_look_ahead_in_dips(spark):
    frame = random_frame(5).dropna(how="all")
    m = spark.createDataFrame([(d.date(), 100.0) for d in frame.index], "d date, close double")
    full = {(r.ticker, r.buy_date): r.stock_return for r in ev.dip_trades(to_bars(spark, frame), m, 0.03, 5).filter("sell_date <= '2024-04-01'").collect()}
    cut = {(r.ticker, r.buy_date): r.stock_return for r in ev.dip_trades(to_bars(spark, frame[:"2024-04-01"]), m, 0.03, 5).collect()}
    assert full == cut


def test_pead_enters_after_and_streak_before_the_report(spark, bars, market):
    quotes = {"A": {f"2024-01-{i:02d}": 100.0 + i for i in range(1, 29)}}
    prices, bench = bars(quotes), market({f"2024-01-{i:02d}": 50.0 for i in range(1, 29)})
    rows = [("A", day("2024-01-02"), 1.0, 1.2, 6.0), ("A", day("2024-01-05"), 1.0, 1.2, 7.0), ("A", day("2024-01-10"), 1.0, None, None)]
    reports = spark.createDataFrame(rows, "ticker string, earnings_date date, eps_estimate double, reported_eps double, surprise_pct double")
    pead = ev.pead_trades(reports, prices, bench, 6.0, 3).collect()
    assert [(r.buy_date.day, r.sell_date.day) for r in pead] == [(6, 9)]  # 6.0 is not above 6.0
    streak = ev.streak_trades(reports, prices, bench, 5.0, 3).collect()
    assert [(r.buy_date.day, r.sell_date.day) for r in streak] == [(9, 13)]
    board = ev.surprise_board(reports).first()
    assert (board.reports_ago_4, board.reports_ago_3, board.reports_ago_2, board.last_report) == (None, None, 6.0, 7.0)
    assert board.next_earnings_date.day == 10


def test_pair_statistics_match_pandas_with_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(co, "TICKERS_PER_TILE", 2)
    frame = random_frame(11, 90, ("A", "B", "C", "D", "E")).dropna(how="all")
    corr = frame.pct_change(fill_method=None).corr()
    cum = frame / frame.bfill().iloc[0] - 1
    rows = {(r.ticker_a, r.ticker_b): r for r in co.divergence(co.pair_statistics(to_bars(spark, frame), -1.0)).collect()}
    assert len(rows) == 10
    for (a, b), r in rows.items():
        spread = (cum[a] - cum[b]).dropna()
        assert r.correlation == pytest.approx(corr.loc[a, b])
        assert r.z_score == pytest.approx((spread.iloc[-1] - spread.mean()) / spread.std())
        assert r.current_spread == pytest.approx(spread.iloc[-1])


def test_overnight_times_intraday_is_the_daily_return(spark):
    frame = random_frame(2).dropna(how="all")
    prices = to_bars(spark, frame).withColumn("open", F.col("close") * 1.01)
    rows = ce.decompose_returns(prices).join(ts.daily_returns(prices).select("ticker", "d", "ret"), ["ticker", "d"]).filter("ret is not null").collect()
    assert rows and all((1 + r.overnight) * (1 + r.intraday) - 1 == pytest.approx(r.ret) for r in rows)


def test_intraday_path_uses_wall_clock_across_dst(spark):
    utc = dt.timezone.utc
    rows = [("A", dt.datetime(2024, 3, 8, 14, 30, tzinfo=utc), 100.0), ("A", dt.datetime(2024, 3, 8, 15, 30, tzinfo=utc), 110.0),
            ("A", dt.datetime(2024, 3, 11, 13, 30, tzinfo=utc), 100.0), ("A", dt.datetime(2024, 3, 11, 14, 30, tzinfo=utc), 130.0)]
    path = ce.average_intraday_path(spark.createDataFrame(rows, "ticker string, ts timestamp, close double"), "America/New_York").collect()
    assert {r.time: round(r.mean_return, 6) for r in path} == {"09:30": 0.0, "10:30": 0.2}


def test_volume_spike_excludes_the_day_itself(spark):
    start = day("2024-01-01")
    rows = [("A", start + dt.timedelta(days=i), 1.0, 1.0, 100.0 if i < 60 else 200.0) for i in range(61)]
    prices = spark.createDataFrame(rows, "ticker string, d date, open double, close double, volume double")
    hit = ts.volume_spikes(prices, "2024-01-01").collect()
    assert [(r.d, r.vs_avg_pct) for r in hit] == [(start + dt.timedelta(days=60), pytest.approx(100.0))]


def test_pick_union_and_missing(spark, bars):
    picked = spark.createDataFrame([("aapl",), ("MSFT",)], "ticker string")
    everything = ts.pick_union(picked, " msft, tsla ,", "^gspc")
    assert sorted(r.ticker for r in everything.collect()) == ["AAPL", "MSFT", "TSLA", "^GSPC"]
    assert sorted(r.ticker for r in ts.missing_tickers(everything, bars({"AAPL": {"2024-01-01": 1.0}})).collect()) == ["MSFT", "TSLA", "^GSPC"]
