"""Queries over daily and monthly bars: event studies, returns and indicators."""

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from quantspark.operators import events as ev
from quantspark.operators import timeseries as ts
from quantspark.plans import derived as dv
from quantspark.plans.base import query
from quantspark.session import ensure_checkpoint_dir, stage
from quantspark.streaming import jobs

# Wild daily moves in the derived bars: a 50 % threshold keeps studies meaningful.
DROP, HOLD, COST = 0.5, 30, 10.0
LAST_WEEKS = "2001-06-01"

_DIPS = f"SELECT ticker, d AS buy_date, close AS buy_price, ret AS drop_that_day FROM ret_daily WHERE ret <= -{DROP}"

_TRADE_TAIL = """, ex AS (SELECT e.*, s.d AS sell_date, s.close AS sell_price
      FROM entries e ASOF JOIN px_daily s ON s.ticker=e.ticker AND s.d >= e.target),
    b1 AS (SELECT ex.*, m.d AS bd, m.close AS bc FROM ex ASOF JOIN mkt_daily m ON m.d >= ex.buy_date),
    b2 AS (SELECT b1.*, m.d AS ed, m.close AS ec FROM b1 ASOF JOIN mkt_daily m ON m.d <= b1.sell_date),
    done AS (SELECT *, sell_price/buy_price-1-{cost} AS stock_return, ec/bc-1 AS benchmark_return,
      sell_price/buy_price-1-{cost}-(ec/bc-1) AS excess_return FROM b2 WHERE bd<=ed)"""

DIP_SQL = (
    f"WITH entries AS (SELECT *, CAST(buy_date + INTERVAL {HOLD} DAY AS DATE) AS target FROM ({_DIPS}))"
    + _TRADE_TAIL.format(cost=COST / 10_000)
)


def bars_and_market(t):
    """Daily bars and the market from one staged pass over the line items."""
    sums = stage(dv.daily_sums(t))
    return dv.prices_from(sums), dv.market_from(sums)


def _dip_trades(t):
    return ev.dip_trades(*bars_and_market(t), DROP, HOLD, COST)


@query(
    "dip_trades", "H7 W1 J1 J4",
    "ticker s,buy_date d,buy_price f,sell_date d,sell_price f,drop_that_day f,stock_return f,benchmark_return f,excess_return f",
    DIP_SQL + " SELECT * FROM done",
)
def dip_trades(t):
    return _dip_trades(t)


@query(
    "dip_summary", "A10 H7", "ticker s,trades i,mean_return f,mean_excess f,compounded_return e,compounded_benchmark e",
    DIP_SQL + " SELECT ticker, COUNT(*) AS trades, AVG(stock_return) AS mean_return, AVG(excess_return) AS mean_excess, PRODUCT(1+stock_return)-1 AS compounded_return, PRODUCT(1+benchmark_return)-1 AS compounded_benchmark FROM done GROUP BY 1",
)
def dip_summary(t):
    return ev.trade_summary(_dip_trades(t), "ticker")


@query(
    "pending_dips", "H8", "ticker s,buy_date d,buy_price f,drop_that_day f,days_held_so_far i",
    f"""SELECT x.*, date_diff('day', buy_date, last_d) AS days_held_so_far FROM ({_DIPS}) x
        JOIN (SELECT ticker AS tk, MAX(d) AS last_d FROM px_daily GROUP BY 1) l ON l.tk=x.ticker
        WHERE NOT EXISTS (SELECT 1 FROM px_daily s WHERE s.ticker=x.ticker AND s.d >= x.buy_date + INTERVAL 60 DAY)""",
)
def pending_dips(t):
    return ev.pending_dips(stage(dv.px_daily(t)), DROP, 60)


@query(
    "daily_returns", "W1", "ticker s,d d,close f,ret f",
    "SELECT ticker, d, close, ret FROM ret_daily",
)
def daily_returns(t):
    return ts.daily_returns(stage(dv.px_daily(t)))


@query(
    "cumulative_return", "W2", "ticker s,d d,cum f",
    "SELECT ticker, d, close/first_value(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS cum FROM px_monthly",
)
def cumulative_return(t):
    return ts.cumulative_return(dv.px_monthly(t))


_RANGE = "SELECT ticker, MIN(d) AS first_d, MAX(d) AS last_d, arg_max(close,d)/arg_min(close,d)-1 AS total_return FROM px_monthly WHERE d BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1"


@query("range_return", "W4 F1", "ticker s,first_d d,last_d d,total_return f", _RANGE)
def range_return(t):
    return ts.range_return(dv.px_monthly(t), "1996-01-01", "2000-12-31")


@query(
    "compare_returns", "W3 W2", "ticker s,total_return f,vs_benchmark f",
    f"WITH r AS ({_RANGE}) SELECT r.ticker, r.total_return, r.total_return-b.total_return AS vs_benchmark FROM r, (SELECT total_return FROM r WHERE ticker='Brand#1') b WHERE r.ticker<>'Brand#1'",
)
def compare_returns(t):
    return ts.compare_vs_benchmark(stage(dv.px_monthly(t)), "Brand#1", "1996-01-01", "2000-12-31")


_TECH = """WITH w AS (SELECT ticker, d, close, volume,
      MIN(d) OVER k AS fd, arg_min(close,d) OVER k AS fc, COUNT(*) OVER m AS n50, AVG(close) OVER m AS ma,
      COUNT(volume) OVER l AS n60, AVG(volume) OVER l AS v60, AVG(volume) OVER s AS v10 FROM px_daily
      WINDOW k AS (PARTITION BY ticker ORDER BY d RANGE BETWEEN INTERVAL 84 DAY PRECEDING AND CURRENT ROW),
        m AS (PARTITION BY ticker ORDER BY d ROWS 49 PRECEDING), l AS (PARTITION BY ticker ORDER BY d ROWS 59 PRECEDING),
        s AS (PARTITION BY ticker ORDER BY d ROWS 9 PRECEDING)),
    b AS (SELECT w.*, m1.d AS bd, m1.close AS bc FROM w ASOF LEFT JOIN mkt_daily m1 ON m1.d >= w.fd),
    e AS (SELECT b.*, m2.d AS ed, m2.close AS ec FROM b ASOF LEFT JOIN mkt_daily m2 ON m2.d <= b.d),
    tech AS (SELECT ticker, d, close, CASE WHEN fd<d THEN (close/fc-1)*100 END AS momentum,
      CASE WHEN fd<d AND bd<ed THEN (close/fc-ec/bc)*100 END AS relative_strength,
      CASE WHEN n50=50 THEN (close/ma-1)*100 END AS price_vs_ma,
      CASE WHEN n60=60 AND v60<>0 THEN (v10/v60-1)*100 END AS relative_volume FROM e)"""


@query(
    "technicals", "W10 W11 W12", "ticker s,d d,close f,momentum f,relative_strength f,price_vs_ma f,relative_volume f",
    _TECH + " SELECT * FROM tech",
)
def technicals(t):
    return ts.technicals(*bars_and_market(t))


@query(
    "latest_technicals", "W10 W11 W12", "ticker s,d d,close f,return_7d f,momentum_2w f,relative_strength_2w f,momentum f,price_vs_ma f,relative_volume f",
    _TECH + """, z AS (SELECT p.ticker, p.d, p.close, MIN(p.d) OVER a AS fa, arg_min(p.close,p.d) OVER a AS ca, MIN(p.d) OVER b AS fb, arg_min(p.close,p.d) OVER b AS cb FROM px_daily p
      WINDOW a AS (PARTITION BY ticker ORDER BY d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW), b AS (PARTITION BY ticker ORDER BY d RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND CURRENT ROW)),
    zl AS (SELECT * FROM z QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY d DESC)=1),
    m1 AS (SELECT zl.*, m.d AS md, m.close AS mc FROM zl ASOF LEFT JOIN mkt_daily m ON m.d>=zl.fb), m2 AS (SELECT m1.*, m.d AS nd, m.close AS nc FROM m1 ASOF LEFT JOIN mkt_daily m ON m.d<=m1.d)
    SELECT m2.ticker, m2.d, m2.close, CASE WHEN fa<m2.d THEN (m2.close/ca-1)*100 END AS return_7d, CASE WHEN fb<m2.d THEN (m2.close/cb-1)*100 END AS momentum_2w,
      CASE WHEN fb<m2.d AND md<nd THEN (m2.close/cb-nc/mc)*100 END AS relative_strength_2w, t.momentum, t.price_vs_ma, t.relative_volume FROM m2 JOIN tech t ON t.ticker=m2.ticker AND t.d=m2.d""",
)
def latest_technicals(t):
    return ts.latest_technicals(*bars_and_market(t))


@query(
    "indicator_history", "F15", "ticker s,d d,value f",
    _TECH + " SELECT ticker, d, momentum AS value FROM tech WHERE d>=DATE '2000-01-01' AND momentum IS NOT NULL",
)
def indicator_history(t):
    bars, market = bars_and_market(t)
    return ts.indicator_history(ts.momentum(bars, market, 84), "momentum", "2000-01-01")


@query(
    "bars_from_ticks", "R6", "ticker s,ts t,close f,ticks i",
    "SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, arg_max(value, ts) AS close, COUNT(*) AS ticks FROM events GROUP BY 1,2",
)
def bars_from_ticks(t):
    return jobs.bars_from_ticks(_ticks(t.read("events")))


def _ticks(events):
    return events.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))


@query(
    "stream_bars", "R6", "ticker s,ts t,close f,ticks i",
    """SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, arg_max(value, ts) AS close, COUNT(*) AS ticks FROM events GROUP BY 1,2
       HAVING date_trunc('hour', MIN(ts)) + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_bars(t):
    """The same bars as a stream over the landed file: windows close behind the watermark."""
    schema = t.read("events").schema
    ticks = _ticks(t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder))
    ensure_checkpoint_dir(t.spark)
    run = f"{t.spark.sparkContext.getCheckpointDir()}/bars-{uuid.uuid4()}"
    job = jobs.bars_from_ticks(ticks).writeStream.format("parquet").option("path", f"{run}/bars").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return t.spark.read.parquet(f"{run}/bars")


@query(
    "volume_spikes", "W13", "ticker s,d d,volume f2,vs_avg_pct f",
    """WITH w AS (SELECT ticker, d, volume, COUNT(*) OVER k AS n, AVG(volume) OVER k AS a FROM px_daily
      WINDOW k AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
      SELECT ticker, d, volume, (volume/a-1)*100 AS vs_avg_pct FROM w WHERE n=60 AND a<>0 AND volume>=2*a AND d>=DATE '1999-01-01'""",
)
def volume_spikes(t):
    return ts.volume_spikes(dv.px_daily(t), "1999-01-01")


@query(
    "recent_dips", "W14", "ticker s,d d,drop_pct f",
    f"SELECT ticker, d, ret*100 AS drop_pct FROM ret_daily WHERE ret<=-{DROP} AND d>=DATE '{LAST_WEEKS}'",
)
def recent_dips(t):
    return ts.recent_dips(stage(dv.px_daily(t)), LAST_WEEKS, DROP)


@query(
    "signal_bundle", "W30", "ticker s,trailing_return_5d_pct f3,trailing_return_1m_pct f3,dip_today_pct f1,recent_earnings_surprise_pct f1,days_since_earnings i",
    """WITH r AS (SELECT ticker, close, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY d DESC) AS n FROM px_daily
        WHERE d<=DATE '2000-08-05' AND d>=DATE '2000-06-26'),
      p AS (SELECT ticker, MAX(CASE WHEN n=1 THEN close END) AS c1, MAX(CASE WHEN n=2 THEN close END) AS c2,
        MAX(CASE WHEN n=6 THEN close END) AS c6, MAX(CASE WHEN n=21 THEN close END) AS c21 FROM r GROUP BY 1),
      l AS (SELECT ticker, MAX(earnings_date) AS e, arg_max(surprise_pct, earnings_date) AS s FROM earnings
        WHERE reported_eps IS NOT NULL AND surprise_pct IS NOT NULL AND earnings_date <= DATE '2000-08-05' GROUP BY 1),
      f AS (SELECT ticker, s, date_diff('day', e, DATE '2000-08-05') AS age FROM l)
      SELECT coalesce(p.ticker,f.ticker) AS ticker, ROUND(c1/c6-1,4)*100 AS trailing_return_5d_pct,
        ROUND(c1/c21-1,4)*100 AS trailing_return_1m_pct, CASE WHEN c1/c2-1<=-0.03 THEN ROUND((c1/c2-1)*100,2) END AS dip_today_pct,
        ROUND(f.s,2) AS recent_earnings_surprise_pct, f.age AS days_since_earnings
      FROM p FULL JOIN (SELECT * FROM f WHERE age BETWEEN 0 AND 10) f ON f.ticker=p.ticker""",
)
def signal_bundle(t):
    sums = stage(dv.daily_sums(t))
    known = dv.earnings_from(sums).filter(F.col("earnings_date") <= F.lit("2000-08-05").cast("date"))
    return ts.signal_bundle(dv.prices_from(sums), known, "2000-08-05")


def _pead(direction: str, sign: str) -> str:
    return (
        f"""WITH entries AS (SELECT e.ticker, e.earnings_date, e.surprise_pct, p.d AS buy_date, p.close AS buy_price,
          CAST(p.d + INTERVAL {HOLD} DAY AS DATE) AS target FROM earnings e
          ASOF JOIN px_daily p ON p.ticker=e.ticker AND p.d > e.earnings_date WHERE e.surprise_pct {sign})"""
        + _TRADE_TAIL.format(cost=0)
        + " SELECT * FROM done"
    )


_PEAD_COLUMNS = "ticker s,earnings_date d,surprise_pct f,buy_date d,buy_price f,sell_date d,sell_price f,stock_return f,benchmark_return f,excess_return f"


def _pead_study(t, direction):
    sums = stage(dv.daily_sums(t))
    return ev.pead_trades(dv.earnings_from(sums), dv.prices_from(sums), dv.market_from(sums), 5.0, HOLD, direction)


@query("pead_beat", "H9 J2 J1 J4", _PEAD_COLUMNS, _pead("beat", "> 5"))
def pead_beat(t):
    return _pead_study(t, "beat")


@query("pead_miss", "H9 J2 J1 J4", _PEAD_COLUMNS, _pead("miss", "< -5"))
def pead_miss(t):
    return _pead_study(t, "miss")


_LOGGED = "ticker, buy_date, buy_price, sell_date, sell_price, stock_return, benchmark_return, excess_return"
_SINCE = "1996-01-01"


@query(
    "concat_trades", "U6",
    "seq i,study s,ticker s,buy_date d,buy_price f,sell_date d,sell_price f,stock_return f,benchmark_return f,excess_return f",
    f"""WITH log AS (SELECT 'beat' AS study, {_LOGGED} FROM ({_pead("beat", "> 5")}) UNION ALL SELECT 'miss', {_LOGGED} FROM ({_pead("miss", "< -5")}))
        SELECT ROW_NUMBER() OVER (ORDER BY buy_date, study, ticker, sell_date, buy_price, sell_price) AS seq, * FROM log WHERE buy_date>=DATE '{_SINCE}'""",
)
def concat_trades(t):
    sums = stage(dv.daily_sums(t))
    earnings, bars, market = dv.earnings_from(sums), dv.prices_from(sums), dv.market_from(sums)
    return ev.concat_trades(_SINCE, **{d: ev.pead_trades(earnings, bars, market, 5.0, HOLD, d) for d in ("beat", "miss")})


@query(
    "earnings_streak", "H10 W24",
    "ticker s,earnings_date d,prior_surprise_1 f,prior_surprise_2 f,buy_date d,buy_price f,sell_date d,sell_price f,stock_return f,benchmark_return f,excess_return f",
    f"""WITH l AS (SELECT ticker, earnings_date, LAG(surprise_pct,1) OVER k AS prior_surprise_1, LAG(surprise_pct,2) OVER k AS prior_surprise_2
        FROM earnings WINDOW k AS (PARTITION BY ticker ORDER BY earnings_date)),
      entries AS (SELECT l.*, p.d AS buy_date, p.close AS buy_price, CAST(l.earnings_date + INTERVAL {HOLD} DAY AS DATE) AS target
        FROM l ASOF JOIN px_daily p ON p.ticker=l.ticker AND p.d < l.earnings_date WHERE prior_surprise_1>1 AND prior_surprise_2>1)"""
    + _TRADE_TAIL.format(cost=0)
    + " SELECT * FROM done",
)
def earnings_streak(t):
    sums = stage(dv.daily_sums(t))
    return ev.streak_trades(dv.earnings_from(sums), dv.prices_from(sums), dv.market_from(sums), 1.0, HOLD)


@query(
    "surprise_board", "W25", "ticker s,reports_ago_4 f,reports_ago_3 f,reports_ago_2 f,last_report f,next_earnings_date d",
    """WITH r AS (SELECT ticker, surprise_pct, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY earnings_date DESC) AS n
        FROM earnings WHERE reported_eps IS NOT NULL AND surprise_pct IS NOT NULL),
      p AS (SELECT ticker, MAX(CASE WHEN n=4 THEN surprise_pct END) AS reports_ago_4, MAX(CASE WHEN n=3 THEN surprise_pct END) AS reports_ago_3,
        MAX(CASE WHEN n=2 THEN surprise_pct END) AS reports_ago_2, MAX(CASE WHEN n=1 THEN surprise_pct END) AS last_report FROM r GROUP BY 1),
      u AS (SELECT ticker, MIN(CASE WHEN reported_eps IS NULL THEN earnings_date END) AS next_earnings_date FROM earnings GROUP BY 1)
      SELECT u.ticker, p.* EXCLUDE (ticker), u.next_earnings_date FROM u LEFT JOIN p ON p.ticker=u.ticker""",
)
def surprise_board(t):
    return ev.surprise_board(dv.earnings(t))


@query(
    "reported_recently", "W34", "ticker s,earnings_date d,eps_estimate f,reported_eps f,surprise_pct f",
    """SELECT * FROM earnings WHERE reported_eps IS NOT NULL AND surprise_pct IS NOT NULL
        AND earnings_date BETWEEN DATE '2000-07-29' - INTERVAL 7 DAY AND DATE '2000-07-31'""",
)
def reported_recently(t):
    return ev.reported_recently(dv.earnings(t), "2000-07-31", 9)


@query(
    "upcoming_earnings", "W34 A17", "ticker s,earnings_date d,eps_estimate f",
    """SELECT ticker, MIN(earnings_date) AS earnings_date, arg_min(eps_estimate, earnings_date) AS eps_estimate FROM earnings
        WHERE reported_eps IS NULL AND earnings_date BETWEEN (SELECT MAX(earnings_date) FROM earnings) - INTERVAL 7 DAY
          AND (SELECT MAX(earnings_date) FROM earnings) GROUP BY 1""",
)
def upcoming_earnings(t):
    reports = stage(dv.earnings(t))
    last = ev.earnings_span(reports).first()["last_report"]
    return ev.upcoming_reports(reports, last - timedelta(days=7), 7)
