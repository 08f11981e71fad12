"""Queries over correlations, calendar effects and rebalancing strategies."""

from pyspark.sql import functions as F

from quantspark.functions.sampling import PRIME, ROUNDS
from quantspark.operators import backtest as bt
from quantspark.operators import calendar_effects as ce
from quantspark.operators import correlation as co
from quantspark.operators.timeseries import calendar
from quantspark.plans import derived as dv
from quantspark.plans.base import query
from quantspark.session import stage

_PAIRS = """WITH cum AS (SELECT ticker, d, ret, close/first_value(close) OVER (PARTITION BY ticker ORDER BY d)-1 AS cum FROM ret_monthly),
    stats AS (SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, corr(a.ret,b.ret) AS correlation, COUNT(*) AS n_spread,
      arg_max(a.cum-b.cum, a.d) AS current_spread, AVG(a.cum-b.cum) AS mean_spread, stddev_samp(a.cum-b.cum) AS std_spread
      FROM cum a JOIN cum b ON a.d=b.d AND a.ticker<b.ticker GROUP BY 1,2),
    z AS (SELECT ticker_a, ticker_b, correlation, current_spread, mean_spread, (current_spread-mean_spread)/std_spread AS z_score
      FROM stats WHERE n_spread>=10 AND std_spread<>0 AND correlation IS NOT NULL)"""


#: Correlations below this are not listed.
LEAST_CORRELATION = 0.05


@query("corr_pairs", "A14 J10", "ticker_a s,ticker_b s,correlation f", _PAIRS + f" SELECT * FROM stats WHERE correlation>={LEAST_CORRELATION}")
def corr_pairs(t):
    return co.pair_statistics(stage(dv.px_monthly(t)), LEAST_CORRELATION)


@query("corr_with_first", "A14", "ticker_a s,ticker_b s,correlation f",
       _PAIRS + " SELECT * FROM stats WHERE ticker_a=(SELECT MIN(ticker) FROM px_monthly) AND correlation IS NOT NULL")
def corr_with_first(t):
    """One ticker against all others: the pairs that are asked for."""
    bars = stage(dv.px_monthly(t))
    first = bars.agg(F.min("ticker")).scalar()
    asked = bars.select(first.alias("ticker_a"), F.col("ticker").alias("ticker_b")).distinct().filter("ticker_a <> ticker_b")
    return co.pairwise_correlation(bars, asked)


@query("top_correlated", "T3", "ticker_a s,ticker_b s,correlation f",
       _PAIRS + " SELECT * FROM stats WHERE correlation IS NOT NULL ORDER BY correlation DESC, ticker_a, ticker_b LIMIT 15")
def top_correlated(t):
    return co.top_correlated(co.pair_statistics(stage(dv.px_monthly(t)), top=15))


@query("divergence", "W5 H11", "ticker_a s,ticker_b s,correlation f,current_spread f,mean_spread f,z_score f",
       _PAIRS + " SELECT * FROM z WHERE correlation>=0.1")
def divergence(t):
    return co.divergence(co.pair_statistics(stage(dv.px_monthly(t)), 0.1))


@query("top_diverged", "T3 W5", "ticker_a s,ticker_b s,z_score f",
       _PAIRS + " SELECT * FROM z ORDER BY ABS(z_score) DESC, ticker_a, ticker_b LIMIT 15")
def top_diverged(t):
    return co.top_diverged(co.divergence(co.pair_statistics(stage(dv.px_monthly(t)), top=15, by="z")))


@query("diverged_candidates", "H12", "ticker s,score f",
       _PAIRS.replace("FROM ret_monthly", "FROM ret_win") .replace("WITH cum", """WITH win AS (SELECT * FROM px_monthly WHERE d<=DATE '2001-10-01' AND d>=DATE '2001-10-01' - INTERVAL 930 DAY),
        wc AS (SELECT d, LAG(d) OVER (ORDER BY d) AS prev_d FROM (SELECT DISTINCT d FROM win)),
        ret_win AS (SELECT b.ticker, b.d, b.close, b.close/p.close-1 AS ret FROM win b JOIN wc c ON c.d=b.d LEFT JOIN win p ON p.ticker=b.ticker AND p.d=c.prev_d), cum""")
       + " SELECT CASE WHEN z_score>0 THEN ticker_b ELSE ticker_a END AS ticker, MAX(ABS(z_score)) AS score FROM z WHERE correlation>=0.2 AND ABS(z_score)>=1.5 GROUP BY 1")
def diverged_candidates(t):
    return co.diverged_candidates(dv.px_monthly(t), "2001-10-01", 30, 0.2, 1.5)


@query("beta", "A13", "ticker s,n i,beta f",
       """WITH b AS (SELECT d, close/LAG(close) OVER (ORDER BY d)-1 AS br FROM mkt_monthly)
       SELECT ticker, COUNT(*) AS n, covar_samp(ret,br)/var_samp(br) AS beta FROM ret_monthly JOIN b USING (d)
       WHERE ret IS NOT NULL AND br IS NOT NULL GROUP BY 1 HAVING COUNT(*)>=10 AND var_samp(br)<>0""")
def beta(t):
    sums = stage(dv.monthly_sums(t))
    return co.beta(dv.prices_from(sums), dv.market_from(sums))


@query("overnight_intraday", "W6", "ticker s,d d,overnight f,intraday f",
       "SELECT ticker, d, open/prev_close-1 AS overnight, close/open-1 AS intraday FROM ret_daily")
def overnight_intraday(t):
    return ce.decompose_returns(stage(dv.px_daily(t)))


@query("overnight_summary", "A9", "ticker s,overnight_return f,intraday_return f,total_return f",
       """WITH p AS (SELECT ticker, open/prev_close AS o, close/open AS i FROM ret_monthly WHERE open/prev_close IS NOT NULL AND close/open IS NOT NULL),
       s AS (SELECT ticker, product(o) AS o, product(i) AS i FROM p GROUP BY 1)
       SELECT ticker, o-1 AS overnight_return, i-1 AS intraday_return, o*i-1 AS total_return FROM s""")
def overnight_summary(t):
    return ce.overnight_summary(stage(dv.px_monthly(t)))


@query("weekday_effect", "A7", "ticker s,weekday i,mean_return f,n i",
       """SELECT ticker, isodow(d) AS weekday, AVG(ret) AS mean_return, COUNT(*) AS n FROM ret_daily
       WHERE ret IS NOT NULL AND isodow(d)<=5 GROUP BY 1,2""")
def weekday_effect(t):
    return ce.weekday_effect(stage(dv.px_daily(t)))


@query("intraday_path", "A8", "ticker s,time s,mean_return f,days i",
       """WITH o AS (SELECT ticker, CAST(ts AS DATE) AS day, arg_min(close, ts) AS op FROM bars_hourly GROUP BY 1,2)
       SELECT b.ticker, strftime(b.ts,'%H:%M') AS time, AVG(b.close/o.op-1) AS mean_return, COUNT(*) AS days
       FROM bars_hourly b JOIN o ON o.ticker=b.ticker AND o.day=CAST(b.ts AS DATE) WHERE o.op<>0 GROUP BY 1,2""")
def intraday_path(t):
    bars = stage(dv.bars_hourly(t).withColumn("ts", F.col("ts").cast("timestamp")))
    return ce.average_intraday_path(bars)


LOOKBACK, N, STEP, START, TRIALS, BPS = 180, 5, 90, "1996-01-01", 50, 10.0

_DATES = f"""WITH cal AS (SELECT d, COUNT(*) OVER (ORDER BY d RANGE BETWEEN INTERVAL {LOOKBACK} DAY PRECEDING AND CURRENT ROW) AS n_rows,
      MIN(d) OVER () AS first_d FROM (SELECT DISTINCT d FROM px_monthly)),
    targets AS (SELECT CAST(unnest(generate_series(DATE '{START}', (SELECT MAX(d) FROM cal), INTERVAL {STEP} DAY)) AS DATE) AS g),
    reb AS (SELECT DISTINCT (SELECT MIN(d) FROM cal WHERE d>=g) AS date FROM targets WHERE g<=(SELECT MAX(d) FROM cal)),
    win AS (SELECT ticker, d, close, COUNT(*) OVER k AS n, arg_min(close,d) OVER k AS c0 FROM px_monthly
      WINDOW k AS (PARTITION BY ticker ORDER BY d RANGE BETWEEN INTERVAL {LOOKBACK} DAY PRECEDING AND CURRENT ROW)),
    pool AS (SELECT w.d AS date, w.ticker, w.close/w.c0-1 AS trailing_return FROM win w JOIN cal c ON c.d=w.d JOIN reb ON reb.date=w.d
      WHERE w.n=c.n_rows AND c.first_d<=w.d - INTERVAL {LOOKBACK} DAY),
    ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY trailing_return DESC, ticker) AS rank FROM pool),
    days AS (SELECT c.d, (SELECT MAX(date) FROM reb WHERE date<=c.d) AS date, c.d IN (SELECT date FROM reb) AS charged,
      c.d=(SELECT MIN(d) FROM cal WHERE d>=DATE '{START}') AS first FROM cal c WHERE c.d>=DATE '{START}')"""


def _curve(weights: str) -> str:
    return _DATES + f""", w AS ({weights}), labels AS (SELECT DISTINCT label FROM w),
    dayret AS (SELECT l.label, x.d, CASE WHEN first THEN 0 ELSE coalesce(SUM(w.w*r.ret),0) - CASE WHEN charged THEN {BPS / 10_000} ELSE 0 END END AS r
      FROM labels l CROSS JOIN days x LEFT JOIN w ON w.label=l.label AND w.date=x.date LEFT JOIN ret_monthly r ON r.ticker=w.ticker AND r.d=x.d
      GROUP BY l.label, x.d, first, charged),
    curve AS (SELECT label, d, product(1+r) OVER (PARTITION BY label ORDER BY d) AS equity FROM dayret)"""


_TOP = f"SELECT 'momentum' AS label, date, ticker, 1.0/COUNT(*) OVER (PARTITION BY date) AS w FROM ranked WHERE rank<={N}"
_ALL = "SELECT 'equal_weight' AS label, date, ticker, 1.0/COUNT(*) OVER (PARTITION BY date) AS w FROM pool"


@query("rebalance_dates", "H1 X9", "date d",
       """WITH cal AS (SELECT DISTINCT d FROM px_daily),
       q AS (SELECT CAST(unnest(generate_series(date_trunc('quarter',(SELECT MIN(d) FROM cal)), date_trunc('quarter',(SELECT MAX(d) FROM cal)), INTERVAL 3 MONTH)) AS DATE) AS s)
       SELECT DISTINCT (SELECT MIN(d) FROM cal WHERE d >= s + INTERVAL 3 MONTH - INTERVAL 1 DAY) AS date FROM q
       WHERE EXISTS (SELECT 1 FROM cal WHERE d >= s + INTERVAL 3 MONTH - INTERVAL 1 DAY)""")
def rebalance_dates(t):
    days = stage(t.read("lineitem").join(t.read("part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.to_date("l_shipdate").alias("d")).distinct())
    return bt.rebalance_dates(days, "QE")


@query("momentum_picks", "T1 T2 W9", "date d,rank i,ticker s,trailing_return f", _DATES + f" SELECT * FROM ranked WHERE rank<={N}")
def momentum_picks(t):
    bars = stage(dv.px_monthly(t))
    dates = bt.rebalance_dates(calendar(bars).select("d"), STEP, START)
    return bt.picks_by_rebalance(bars, dates, LOOKBACK, N)


@query("momentum_equity", "H2 H4 W7", "label s,d d,equity e", _curve(_TOP) + " SELECT * FROM curve")
def momentum_equity(t):
    return bt.backtest(stage(dv.px_monthly(t)), bt.top_n_strategy(LOOKBACK, N), STEP, START, BPS, "momentum")


@query("equal_weight_equity", "H2 H3", "label s,d d,equity e", _curve(_ALL) + " SELECT * FROM curve")
def equal_weight_equity(t):
    return bt.backtest(stage(dv.px_monthly(t)), bt.equal_weight_strategy(LOOKBACK), STEP, START, BPS, "equal_weight")


def inverse_volatility(date, history):
    """Weights in proportion to one over the deviation of the returns; tickers that do not move are left out."""
    deviation = history.pct_change(fill_method=None).std()
    inverse = 1 / deviation[deviation > 0]
    return (inverse / inverse.sum()).to_dict()


@query("custom_weights", "E1", "date d,ticker s,w f", _DATES + f""", s AS (SELECT reb.date, r.ticker, stddev_samp(r.ret) AS sd FROM reb JOIN ret_monthly r ON r.d<=reb.date
       JOIN cal_monthly c ON c.d=r.d AND c.prev_d>=reb.date - INTERVAL {LOOKBACK} DAY GROUP BY 1,2)
       SELECT date, ticker, (1/sd)/SUM(1/sd) OVER (PARTITION BY date) AS w FROM s WHERE sd>0""")
def custom_weights(t):
    bars = stage(dv.px_monthly(t))
    dates = stage(bt.rebalance_dates(calendar(bars).select("d"), STEP, START))
    return bt.custom_strategy(inverse_volatility, LOOKBACK)(dates, bars)


# The same permutation of the tickers' numbers, one round of all draws a step.
_RANDOM_SQL = f"""WITH RECURSIVE numbered AS (SELECT date, ticker, ROW_NUMBER() OVER (PARTITION BY date ORDER BY ticker)-1 AS place FROM pool),
    sizes AS (SELECT date, COUNT(*) AS m FROM pool GROUP BY 1),
    keys AS (SELECT date, trial, i, md5(concat(CAST(trial AS VARCHAR),'|',CAST(date AS VARCHAR),'|',CAST(i AS VARCHAR))) AS h
      FROM sizes, generate_series(0,{TRIALS - 1}) t(trial), generate_series(1,{ROUNDS}) r(i)),
    nums AS (SELECT date, trial, i, CAST(concat('0x',substr(h,1,7)) AS BIGINT) AS pivot, CAST(concat('0x',substr(h,9,7)) AS BIGINT) AS factor,
      CAST(concat('0x',substr(h,17,7)) AS BIGINT) AS shift FROM keys),
    walk AS (SELECT date, trial, m, 0::BIGINT AS i, n AS x FROM sizes, generate_series(0,{TRIALS - 1}) t(trial), generate_series(0,{N - 1}) p(n) WHERE n<m
      UNION ALL SELECT date, trial, m, i+1, CASE WHEN (factor*greatest(x,y)+shift)%{PRIME}%2=1 THEN y ELSE x END
        FROM (SELECT w.date, w.trial, w.m, w.i, w.x, ((k.pivot-w.x)%w.m+w.m)%w.m AS y, k.factor, k.shift
          FROM walk w JOIN nums k ON k.date=w.date AND k.trial=w.trial AND k.i=w.i+1))
    SELECT walk.trial AS label, walk.date, ticker, 1.0/COUNT(*) OVER (PARTITION BY walk.trial, walk.date) AS w
      FROM walk JOIN numbered ON numbered.date=walk.date AND numbered.place=walk.x WHERE walk.i={ROUNDS}"""


@query("random_control", "H5", "d d,equity e", _curve(_RANDOM_SQL) + " SELECT d, AVG(equity) AS equity FROM curve GROUP BY 1")
def random_control(t):
    return bt.random_average(stage(dv.px_monthly(t)), LOOKBACK, N, STEP, START, TRIALS, BPS)


@query("perf_summary", "A12 W8 H6", "label s,total_return e,cagr e,volatility f,sharpe f,max_drawdown f",
       _curve(f"{_TOP} UNION ALL {_ALL}") + """, m AS (SELECT *, equity/LAG(equity) OVER (PARTITION BY label ORDER BY d)-1 AS r,
         equity/MAX(equity) OVER (PARTITION BY label ORDER BY d)-1 AS dd FROM curve),
       s AS (SELECT label, arg_max(equity,d)/arg_min(equity,d) AS g, date_diff('day',MIN(d),MAX(d))/365.25 AS y, stddev_samp(r) AS sd, AVG(r) AS mu, MIN(dd) AS max_drawdown FROM m GROUP BY 1)
       SELECT label, g-1 AS total_return, CASE WHEN y>0 THEN pow(g,1/y)-1 END AS cagr, sd*sqrt(252) AS volatility,
         CASE WHEN sd<>0 THEN sqrt(252)*mu/sd END AS sharpe, max_drawdown FROM s""")
def perf_summary(t):
    bars = stage(dv.px_monthly(t))
    dates = stage(bt.rebalance_dates(calendar(bars).select("d"), STEP, START))
    pool = stage(bt.eligible(bars, dates, LOOKBACK))
    weights = stage(bt.equal_weight(bt.top_n(pool, N)).withColumn("label", F.lit("momentum")).unionByName(
        bt.equal_weight(pool).withColumn("label", F.lit("equal_weight"))))
    return bt.performance_summary(bt.equity_curves(bars, weights, dates, START, BPS))


@query("momentum_study", "H6 H5", "label s,d d,equity e",
       _curve(f"SELECT label::VARCHAR AS label, date, ticker, w FROM ({_TOP} UNION ALL {_ALL} UNION ALL SELECT CAST(label AS VARCHAR), date, ticker, w FROM ({_RANDOM_SQL}))")
       + f""" SELECT CASE WHEN label IN ('momentum','equal_weight') THEN label ELSE 'random' END AS label, d, AVG(equity) AS equity FROM curve GROUP BY 1,2
       UNION ALL SELECT 'benchmark', d, close/first_value(close) OVER (ORDER BY d) FROM mkt_monthly WHERE d>=DATE '{START}'""")
def momentum_study(t):
    sums = stage(dv.monthly_sums(t))
    return bt.momentum_study(dv.prices_from(sums), dv.market_from(sums), LOOKBACK, N, STEP, START, TRIALS, BPS)
