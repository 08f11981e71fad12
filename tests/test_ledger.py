"""Trade replay, lot matching and fills against plain loops, including hot keys and leading sales."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantspark.operators import portfolio as pf
from quantspark.operators import positions as po
from quantspark.operators import rules as ru

SHAPE = "portfolio string, ticker string, rule string, d date, action string, shares double, price double, seq long"


def random_trades(seed, n=400, sell=0.5):
    rng = random.Random(seed)
    start = dt.date(2024, 1, 1)
    # A third of the rows share one key; many share a day.
    keys = [("p1", "HOT", "r1")] + [(f"p{i % 2 + 1}", t, r) for i, t in enumerate("ABC") for r in ("r1", "r2")]
    rows = []
    for seq in range(n):
        p, t, r = keys[0] if rng.random() < 0.34 else rng.choice(keys)
        action = "SELL" if rng.random() < sell else "BUY"
        rows.append((p, t, r, start + dt.timedelta(days=rng.randrange(30)), action, float(rng.randrange(1, 9)), float(rng.randrange(5, 50)), seq))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[3], r[7]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lots_match_a_queue(spark, seed):
    rows = random_trades(seed)
    open_lots, want = collections.defaultdict(list), []
    for p, t, r, d, action, q, price, _ in in_order(rows):
        lots = open_lots[(p, r, t)]
        if action == "BUY":
            lots.append((d, price, q))
        elif lots:
            bd, bp, bq = lots.pop(0)
            want.append((p, r, t, bd, bp, bq, d, price, "closed"))
    want += [(*k, bd, bp, bq, None, None, "open") for k, lots in open_lots.items() for bd, bp, bq in lots]
    got = pf.closed_trades(spark.createDataFrame(rows, SHAPE)).collect()
    have = [(x.portfolio, x.rule, x.ticker, x.buy_date, x.buy_price, x.shares, x.sell_date, x.sell_price, x.status) for x in got]
    assert collections.Counter(have) == collections.Counter(want)


def legal_trades(seed):
    """Sales never exceed the holding, so the average cost is well defined."""
    held, out = collections.defaultdict(float), []
    for p, t, r, d, action, q, price, seq in in_order(random_trades(seed, 500, 0.45)):
        key = (p, r, t)
        if action == "SELL":
            q = min(q, held[key])
            if q == 0:
                continue
        held[key] += q if action == "BUY" else -q
        out.append((p, t, r, d, action, q, price, seq))
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_average_cost_and_open_lot_match_a_loop(spark, seed):
    rows = legal_trades(seed)
    shares, cost, entry = collections.defaultdict(float), collections.defaultdict(float), {}
    for p, t, r, d, action, q, price, _ in in_order(rows):
        k = (p, r, t)
        if action == "BUY":
            if shares[k] <= 1e-9:
                entry[k] = d
            shares[k] += q
            cost[k] += q * price
        else:
            average = cost[k] / shares[k] if shares[k] else 0.0
            shares[k] -= q
            cost[k] -= average * q
    want = {k: (shares[k], cost[k] / shares[k], entry[k]) for k in shares if shares[k] > 1e-9}
    got = {(x.portfolio, x.rule, x.ticker): x for x in pf.positions(spark.createDataFrame(rows, SHAPE), ["portfolio", "rule", "ticker"]).collect()}
    assert set(got) == set(want)
    for k, (q, average, day) in want.items():
        assert got[k].shares == pytest.approx(q) and got[k].avg_cost == pytest.approx(average) and got[k].entry_date == day


def test_violations_and_cash(spark):
    d = dt.date(2024, 1, 1)
    rows = [("p", "A", "", d, "BUY", 2.0, 40.0, 1), ("p", "A", "", d, "BUY", 1.0, 30.0, 2), ("p", "A", "", d, "SELL", 5.0, 10.0, 3), ("p", "A", "", d, "HOLD", 1.0, 1.0, 4), ("p", "A", "", d, "BUY", 0.0, 1.0, 5)]
    folios = spark.createDataFrame([("p", 100.0, d)], "portfolio string, initial_cash double, created date")
    bad = {r.seq: r.reason for r in pf.violations(spark.createDataFrame(rows, SHAPE), folios).collect()}
    assert bad == {2: "not enough cash", 3: "not enough shares", 4: "unknown action", 5: "amounts must be positive"}


def test_undo_removes_only_the_last_trade(spark):
    rows = random_trades(6, 40)
    log = spark.createDataFrame(rows, SHAPE)
    left = [r.seq for r in pf.pop_last_trade(log, "p1").collect()]
    last = in_order([r for r in rows if r[0] == "p1"])[-1]
    assert sorted(left) == sorted(r[7] for r in rows if r[7] != last[7])


def test_valuation_carries_prices_over_weekends(spark):
    d = dt.date(2024, 3, 1)
    trades = spark.createDataFrame([("p", "A", "", d, "BUY", 2.0, 10.0, 1), ("p", "B", "", d, "BUY", 1.0, 5.0, 2)], SHAPE)
    folios = spark.createDataFrame([("p", 100.0, dt.date(2024, 2, 29)), ("idle", 7.0, d)], "portfolio string, initial_cash double, created date")
    prices = spark.createDataFrame([("A", d, 10.0), ("A", dt.date(2024, 3, 4), 12.0)], "ticker string, d date, close double")
    rows = {(r.portfolio, r.d.isoformat()): r for r in pf.valuation_history(trades, folios, prices, "2024-03-04").collect()}
    assert rows[("p", "2024-02-29")].total_value == 100.0
    assert rows[("p", "2024-03-03")].total_value == 75.0 + 20.0  # B has no price and counts as zero
    assert rows[("p", "2024-03-04")].holdings_value == 24.0
    assert rows[("idle", "2024-03-04")].total_value == 7.0


def test_greedy_fill_skips_and_goes_on(spark):
    config = spark.createDataFrame([("big", 0, 1, 9, 80.0, True), ("small", 1, 3, 9, 30.0, True)], ru.RULE_CONFIG)
    candidates = spark.createDataFrame([("big", "X", 1.0), ("small", "A", 3.0), ("small", "B", 2.0), ("small", "H", 9.0)], "rule string, ticker string, score double")
    held = spark.createDataFrame([("p", "small", "H", 1.0, 1.0, dt.date(2024, 1, 1))], "portfolio string, rule string, ticker string, shares double, avg_cost double, entry_date date")
    folios = spark.createDataFrame([("p",)], "portfolio string")
    prices = spark.createDataFrame([(t, 10.0) for t in "XABH"], "ticker string, price double")
    cash = spark.createDataFrame([("p", 70.0)], "portfolio string, cash double")
    bought = ru.rule_entries(folios, held, candidates, config, prices, cash).collect()
    assert sorted((r.rule, r.ticker, r.shares) for r in bought) == [("small", "A", 3.0), ("small", "B", 3.0)]
    exits = ru.rule_exits(held, candidates.filter("ticker <> 'H'"), config, "2024-01-05").collect()
    assert [(r.ticker, r.reason) for r in exits] == [("H", "no longer qualifies")]


def test_business_gap(spark):
    rows = spark.createDataFrame([("2024-03-01", "2024-03-04", True), ("2024-02-29", "2024-03-04", False), ("2024-03-04", "2024-03-05", True)], "a string, b string, want boolean")
    got = rows.select("want", ru.business_gap_is_empty(F.to_date("a"), F.to_date("b")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_position_states(spark):
    d = dt.date(2024, 1, 1)
    shape = "event string, id string, portfolio string, ticker string, created date, entry_confidence double, expected_horizon_days int, rule string, closed_date date, actual_return_pct double, close_reason string, seq int"
    rows = [("created", "a", "p", "A", d, 0.7, 30, "x", None, None, None, 1), ("closed", "a", None, None, None, None, None, None, d, 5.0, None, 2),
            ("closed", "orphan", None, None, None, None, None, None, d, 5.0, None, 3), ("created", "b", "p", "B", d, 0.7, 30, "x", None, None, None, 4)]
    got = {r.id: (r.status, r.close_reason) for r in po.load_positions(spark.createDataFrame(rows, shape)).collect()}
    assert got == {"a": ("closed", "horizon"), "b": ("open", None)}
