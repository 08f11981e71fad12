"""Queries over analyst, insider, fact and holdings data."""

from pyspark.sql import functions as F

from quantspark.operators import facts as fa
from quantspark.operators import holdings as ho
from quantspark.operators import pit
from quantspark.operators.asof import asof
from quantspark.operators.timeseries import latest_price
from quantspark.plans import derived as dv
from quantspark.plans.base import query
from quantspark.session import stage

GRID_START, GRID_END = "1996-03-31", "2001-12-31"

_GRID = f"""grid AS (SELECT b.ticker, CAST(g.date AS DATE) AS date FROM (SELECT DISTINCT p_brand AS ticker FROM part) b,
    (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '2001-10-01', INTERVAL 3 MONTH)) AS DATE) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS date) g)"""


def grid(t):
    """Every brand at each quarter end."""
    starts = F.sequence(F.lit("1996-01-01").cast("date"), F.lit("2001-10-01").cast("date"), F.make_interval(months=F.lit(3)))
    dates = F.transform(starts, lambda s: F.last_day(F.add_months(s, 2)))
    return t.read("part").select(F.col("p_brand").alias("ticker")).distinct().select("ticker", F.explode(dates).alias("date"))


@query("insider_summary", "A1 F4 F5", "ticker s,filings i,buys i,sales i,net_value f2",
       """SELECT ticker, COUNT(*) AS filings, COUNT(*) FILTER (transaction LIKE 'Purchase%') AS buys, COUNT(*) FILTER (transaction LIKE 'Sale%') AS sales,
       SUM(CASE WHEN transaction LIKE 'Purchase%' THEN value WHEN transaction LIKE 'Sale%' THEN -value ELSE 0 END) AS net_value
       FROM insider WHERE start_date >= DATE '2001-12-31' - INTERVAL 730 DAY GROUP BY 1""")
def insider_summary(t):
    return pit.insider_summary(pit.insider_lookback(dv.insider(t), "2001-12-31", 24))


@query("insider_sizable", "F5", "ticker s,n i,total f2",
       "SELECT ticker, COUNT(*) AS n, SUM(value) AS total FROM insider WHERE start_date >= DATE '2001-12-31' - INTERVAL 365 DAY AND value >= 50000 GROUP BY 1")
def insider_sizable(t):
    rows = pit.insider_lookback(dv.insider(t), "2001-12-31", 12, 50_000)
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("insider_flow_pit", "P7 J5", "ticker s,date d,insider_flow f2",
       f"""WITH {_GRID}, net AS (SELECT ticker, start_date, SUM(CASE WHEN transaction LIKE 'Purchase%' THEN value WHEN transaction LIKE 'Sale%' THEN -value ELSE 0 END) AS v FROM insider GROUP BY 1,2)
       SELECT g.ticker, g.date, coalesce(SUM(n.v),0) AS insider_flow FROM grid g LEFT JOIN net n ON n.ticker=g.ticker AND n.start_date<=g.date AND n.start_date>g.date - INTERVAL 180 DAY GROUP BY 1,2""")
def insider_flow_pit(t):
    return pit.insider_flow_as_of(grid(t), dv.insider(t))


@query("upgrades_pit", "P8", "ticker s,date d,net_upgrades f,revisions_trend f",
       f"""WITH {_GRID} SELECT g.ticker, g.date, COUNT(*) FILTER (action='up' AND grade_date>g.date - INTERVAL 90 DAY) - COUNT(*) FILTER (action='down' AND grade_date>g.date - INTERVAL 90 DAY) AS net_upgrades,
       COUNT(*) FILTER (action='up' AND grade_date>g.date - INTERVAL 90 DAY) - COUNT(*) FILTER (action='down' AND grade_date>g.date - INTERVAL 90 DAY)
       - COUNT(*) FILTER (action='up' AND grade_date<=g.date - INTERVAL 90 DAY) + COUNT(*) FILTER (action='down' AND grade_date<=g.date - INTERVAL 90 DAY) AS revisions_trend
       FROM grid g LEFT JOIN analyst a ON a.ticker=g.ticker AND a.grade_date<=g.date AND a.grade_date>g.date - INTERVAL 180 DAY GROUP BY 1,2""")
def upgrades_pit(t):
    return pit.upgrades_as_of(grid(t), dv.analyst(t))


@query("split_factors", "J7 P6", "ticker s,date d,split_factor f",
       f"""WITH {_GRID} SELECT g.ticker, g.date, coalesce(product(s.ratio),1) AS split_factor FROM grid g
       LEFT JOIN splits s ON s.ticker=g.ticker AND s.split_d>g.date GROUP BY 1,2""")
def split_factors(t):
    return pit.split_factor(grid(t), dv.splits(t), on="date")


@query("analyst_upside_pit", "P9 J5 W16", "ticker s,date d,analyst_upside f4",
       f"""WITH {_GRID}, p AS (SELECT g.*, b.close AS price FROM grid g ASOF LEFT JOIN px_daily b ON b.ticker=g.ticker AND b.d<=g.date),
       k AS (SELECT g.ticker, g.date, g.price, a.firm, arg_max(a.target, (a.grade_date, a.seq)) AS target, MAX(a.grade_date) AS gd
         FROM p g JOIN analyst a ON a.ticker=g.ticker AND a.grade_date<=g.date GROUP BY 1,2,3,4),
       f AS (SELECT k.*, coalesce((SELECT product(s.ratio) FROM splits s WHERE s.ticker=k.ticker AND s.split_d>k.gd),1) AS fac FROM k
         WHERE gd>date - INTERVAL 540 DAY AND target>0),
       u AS (SELECT ticker, date, (AVG(target/fac)/MAX(price)-1)*100 AS analyst_upside FROM f WHERE price<>0 GROUP BY 1,2)
       SELECT g.ticker, g.date, u.analyst_upside FROM grid g LEFT JOIN u ON u.ticker=g.ticker AND u.date=g.date""")
def analyst_upside_pit(t):
    priced = asof(grid(t), dv.px_daily(t), ["ticker"], "date", "d", {"close": "price"})
    return pit.analyst_upside_as_of(stage(priced), dv.analyst(t), dv.splits(t))


_SUMMARY = """WITH s AS (SELECT ticker, COUNT(*) AS actions, COUNT(*) FILTER (action='up') AS up, COUNT(*) FILTER (action='down') AS down,
      AVG(target) FILTER (target>0) AS avg_target, MAX(grade_date) AS last_action FROM analyst WHERE grade_date BETWEEN DATE '1998-06-01' AND DATE '1998-06-30' GROUP BY 1),
    p AS (SELECT ticker, arg_max(close,d) AS price FROM px_daily WHERE d<=DATE '1998-06-30' AND d>=DATE '1998-06-23' GROUP BY 1),
    j AS (SELECT s.*, actions-up-down AS maintain, p.price, (avg_target/p.price-1)*100 AS upside_pct FROM s LEFT JOIN p ON p.ticker=s.ticker)"""


@query("analyst_summary", "A2", "ticker s,actions i,up i,down i,maintain i,avg_target f4,last_action d,price f,upside_pct f4", _SUMMARY + " SELECT * FROM j")
def analyst_summary(t):
    return pit.analyst_summary(dv.analyst(t), latest_price(dv.px_daily(t), "1998-06-30"), "1998-06-01", "1998-06-30")


@query("analyst_candidates", "H15", "ticker s,score f4", _SUMMARY.replace("1998-06-23", "1998-06-20") + " SELECT ticker, upside_pct AS score FROM j WHERE up+maintain>=down AND upside_pct>=20")
def analyst_candidates(t):
    return pit.analyst_candidates(dv.analyst(t), latest_price(dv.px_daily(t), "1998-06-30", 10), "1998-06-30", "1998-06-01")


@query("net_upgrades_live", "A3", "ticker s,net_upgrades f",
       "SELECT ticker, COUNT(*) FILTER (action='up') - COUNT(*) FILTER (action='down') AS net_upgrades FROM analyst WHERE grade_date >= DATE '2000-12-31' - INTERVAL 90 DAY GROUP BY 1")
def net_upgrades_live(t):
    return pit.net_upgrades_live(dv.analyst(t), "2000-12-31")


@query("revisions_trend_live", "A19", "ticker s,revisions_trend f",
       """WITH b AS (SELECT ticker, period, (strongBuy+buy)/nullif(strongBuy+buy+hold+sell+strongSell,0) AS sh FROM rec_trend)
       SELECT t.ticker, (n.sh-o.sh)*100 AS revisions_trend FROM (SELECT DISTINCT ticker FROM b) t
       LEFT JOIN b n ON n.ticker=t.ticker AND n.period='0m' LEFT JOIN b o ON o.ticker=t.ticker AND o.period='-3m'""")
def revisions_trend_live(t):
    return pit.revisions_trend_live(dv.rec_trend(t))


@query("ownership_ranking", "A6", "ticker s,holders i,mean_pct_held f,mean_pct_change f,last_reported d",
       "SELECT ticker, COUNT(*) AS holders, AVG(pct_held) AS mean_pct_held, AVG(pct_change) AS mean_pct_change, MAX(date_reported) AS last_reported FROM holders GROUP BY 1")
def ownership_ranking(t):
    return pit.ownership_ranking(dv.holders(t))


def _facts(t):
    """Facts of one concept; their branches share one staged pass over the line items."""
    return dv.facts_from(stage(dv.quarterly_sums(t))).withColumn("concept", F.lit("revenue"))


def _history(t):
    return fa.fact_history(_facts(t))


_DEDUP = "dd AS (SELECT * FROM facts QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker,start_d,end_d,form ORDER BY filed DESC, val DESC)=1)"
_DERIVED = _DEDUP + """, fq AS (SELECT * FROM dd WHERE date_diff('day',start_d,end_d) BETWEEN 80 AND 100 QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker,start_d,end_d ORDER BY filed)=1),
    fy AS (SELECT * FROM dd WHERE date_diff('day',start_d,end_d) BETWEEN 350 AND 380 QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker,start_d,end_d ORDER BY filed)=1),
    der AS (SELECT y.ticker, MAX(q.end_d) AS start_d, y.end_d, y.val-SUM(q.val) AS val, y.filed, 'derived' AS form FROM fy y
      JOIN fq q ON q.ticker=y.ticker AND q.start_d>=y.start_d AND q.end_d<=y.end_d GROUP BY y.ticker,y.start_d,y.end_d,y.val,y.filed HAVING COUNT(*)=3)"""
_TTM = _DERIVED + """, hist AS (SELECT ticker,start_d,end_d,val,filed,form FROM dd UNION ALL SELECT * FROM der),
    known AS (SELECT g.ticker, g.date, h.end_d, h.val, h.filed FROM probe g JOIN hist h ON h.ticker=g.ticker AND h.filed<=g.date AND date_diff('day',h.start_d,h.end_d) BETWEEN 80 AND 100),
    firsts AS (SELECT * FROM known QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker,date,end_d ORDER BY filed)=1),
    last4 AS (SELECT * FROM firsts QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker,date ORDER BY end_d DESC)<=4),
    ttm AS (SELECT ticker, date, CASE WHEN COUNT(*)=4 THEN SUM(val) END AS ttm FROM last4 GROUP BY 1,2)"""


@query("facts_dedup", "U5", "ticker s,start_d d,end_d d,form s,val f2,filed d", f"WITH {_DEDUP} SELECT * FROM dd")
def facts_dedup(t):
    return fa.dedup_facts(_facts(t))


@query("derived_quarters", "P4 J6 F8", "ticker s,start_d d,end_d d,val f2,filed d,form s", f"WITH {_DERIVED} SELECT * FROM der")
def derived_quarters(t):
    return fa.derived_quarters(fa.dedup_facts(_facts(t)))


@query("ttm_asof", "P5 W17 J5 P3", "ticker s,date d,ttm f2",
       f"WITH {_GRID}, probe AS (SELECT * FROM grid), {_TTM} SELECT g.ticker, g.date, x.ttm FROM grid g LEFT JOIN ttm x ON x.ticker=g.ticker AND x.date=g.date")
def ttm_asof(t):
    probes = grid(t).withColumn("concept", F.lit("revenue"))
    return fa.ttm_as_of(probes, stage(_history(t)))


@query("yoy_ttm", "W19", "ticker s,date d,yoy_pct f4",
       f"""WITH {_GRID}, probe AS (SELECT * FROM grid UNION SELECT ticker, CAST(date - INTERVAL 1 YEAR AS DATE) FROM grid), {_TTM}
       SELECT g.ticker, g.date, (a.ttm/nullif(b.ttm,0)-1)*100 AS yoy_pct FROM grid g LEFT JOIN ttm a ON a.ticker=g.ticker AND a.date=g.date
       LEFT JOIN ttm b ON b.ticker=g.ticker AND b.date=CAST(g.date - INTERVAL 1 YEAR AS DATE)""")
def yoy_ttm(t):
    return fa.yoy_ttm(grid(t).withColumn("concept", F.lit("revenue")), stage(_history(t)))


@query("latest_instant", "W18 P5", "ticker s,date d,value f2",
       f"""WITH {_GRID}, {_DEDUP}, k AS (SELECT g.ticker, g.date, h.end_d, h.val, h.filed FROM grid g JOIN dd h ON h.ticker=g.ticker AND h.filed<=g.date ),
       one AS (SELECT * FROM k QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker,date ORDER BY end_d DESC, filed)=1)
       SELECT g.ticker, g.date, o.val AS value FROM grid g LEFT JOIN one o ON o.ticker=g.ticker AND o.date=g.date""")
def latest_instant(t):
    line = fa.instant_timeline(fa.dedup_facts(_facts(t)))
    return asof(grid(t).withColumn("concept", F.lit("revenue")), stage(line), ["ticker", "concept"], "date", "d", {"value": "value"})


#: Company names for the holdings lookup; each first word occurs in several part names.
COMPANIES = {"RING": "Ring Works", "BOLT": "Bolt Inc", "GEAR": "Gear Holdings", "SMALL": "Small Cap Trust", "BLUE": "Blue Corp"}


def holdings_lines(t):
    return ho.join_filings(dv.f13_info(t), dv.f13_sub(t))


@query("cusip_agg", "A4 J8 F6", "bucket_end d,cusip s,period d,name s,total_shares f2,total_value f2,num_filers i", "SELECT * FROM f13_cusip")
def cusip_agg(t):
    return ho.cusip_aggregate(holdings_lines(t))


@query("holder_agg", "A5", "bucket_end d,cusip s,cik i,period d,shares f2,value f2", "SELECT * FROM f13_holder")
def holder_agg(t):
    return ho.holder_aggregate(holdings_lines(t))


_COMPANY_ROWS = "co(ticker, token) AS (VALUES " + ", ".join(f"('{t}','{n.upper().split()[0]}')" for t, n in COMPANIES.items()) + ")"


# One company per part beside those above; names are looked up once per first word.
_PART_COMPANIES = (
    _COMPANY_ROWS.replace("co(", "fixed(", 1) + ", co AS (SELECT * FROM fixed UNION ALL SELECT concat('P', CAST(p_partkey AS VARCHAR)), upper(split_part(trim(p_name),' ',1)) FROM part),"
    " words AS (SELECT DISTINCT token AS ticker, token FROM co WHERE token<>'')"
)


def _inst(quarters: int, companies: str = _COMPANY_ROWS) -> str:
    universe = "words" if "words AS" in companies else "co"
    return f"""WITH {companies}, be AS (SELECT DISTINCT bucket_end FROM f13_cusip),
    known AS (SELECT v.bucket_end AS vintage, b.bucket_end, ROW_NUMBER() OVER (PARTITION BY v.bucket_end ORDER BY b.bucket_end DESC)-1 AS age
      FROM be v JOIN be b ON b.bucket_end<=v.bucket_end QUALIFY age < {quarters + 2}),
    seen AS (SELECT k.vintage, k.age, c.* FROM f13_cusip c JOIN known k ON k.bucket_end=c.bucket_end),
    res AS (SELECT vintage, ticker, cusip FROM (SELECT s.vintage, co.ticker, s.cusip, SUM(s.total_value) AS v FROM seen s JOIN {universe} AS co ON contains(upper(s.name), co.token)
      WHERE s.age=0 GROUP BY 1,2,3) QUALIFY ROW_NUMBER() OVER (PARTITION BY vintage, ticker ORDER BY v DESC, cusip)=1),
    prim AS (SELECT s.vintage, r.ticker, s.cusip, s.period, s.bucket_end FROM seen s JOIN res r ON r.vintage=s.vintage AND r.cusip=s.cusip
      QUALIFY ROW_NUMBER() OVER (PARTITION BY s.vintage, r.ticker, s.period ORDER BY s.num_filers DESC, s.age)=1),
    kept AS (SELECT *, LAG(period) OVER (PARTITION BY vintage, ticker ORDER BY period) AS pp FROM (SELECT * FROM prim QUALIFY ROW_NUMBER() OVER (PARTITION BY vintage, ticker ORDER BY period DESC)<={quarters + 1})),
    hr AS (SELECT k.vintage, k.ticker, k.period, k.pp, h.cik, h.shares, h.value FROM kept k JOIN f13_holder h ON h.cusip=k.cusip AND h.period=k.period AND h.bucket_end=k.bucket_end),
    top AS (SELECT * FROM hr WHERE pp IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY vintage, ticker, period ORDER BY shares DESC, cik)<=10),
    hist AS (SELECT t.vintage, t.ticker, t.period, SUM(t.shares) AS total_shares, SUM(t.value) AS total_value, COUNT(*) AS num_filers,
      AVG(CASE WHEN b.shares>0 THEN (t.shares/b.shares-1)*100 ELSE 100 END) AS pct_change FROM top t
      LEFT JOIN hr b ON b.vintage=t.vintage AND b.ticker=t.ticker AND b.cik=t.cik AND b.period=t.pp GROUP BY 1,2,3)"""


@query("resolve_cusip", "J11", "vintage d,ticker s,cusip s",
       _inst(1, _PART_COMPANIES) + " SELECT vintage, co.ticker, cusip FROM res JOIN co ON co.token=res.ticker")
def resolve_cusip(t):
    cusips = stage(ho.cusip_aggregate(holdings_lines(t)))
    newest = ho.vintages(cusips, 1).filter("age = 0")
    parts = t.read("part").select(F.concat(F.lit("P"), "p_partkey").alias("ticker"), F.col("p_name").alias("name"))
    companies = parts.unionByName(t.spark.createDataFrame(sorted(COMPANIES.items()), "ticker string, name string"))
    return ho.resolve_cusip(cusips.join(F.broadcast(newest), "bucket_end"), companies, ["vintage"])


@query("institutional_history", "P10 J9 J12 T4", "ticker s,period d,total_shares f2,total_value f2,num_filers i,pct_change f4",
       _inst(5) + " SELECT * FROM hist WHERE vintage=(SELECT MAX(bucket_end) FROM be)")
def institutional_history(t):
    lines = holdings_lines(t)
    cusips, holders = stage(ho.cusip_aggregate(lines)), stage(ho.holder_aggregate(lines))
    known = ho.vintages(cusips, 5)
    newest = known.join(known.agg(F.max("vintage").alias("vintage")), "vintage")
    return ho.institutional_history(cusips, holders, COMPANIES, newest, 5)


@query("institutional_flow_pit", "P11 F7", "ticker s,date d,institutional_flow f4",
       _inst(1)
       + """, dates AS (SELECT CAST(CAST(unnest(generate_series(DATE '1996-01-01', DATE '2001-10-01', INTERVAL 3 MONTH)) AS DATE) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS date),
       flow AS (SELECT vintage, ticker, arg_max(pct_change, period) AS institutional_flow FROM hist GROUP BY 1,2)
       SELECT co.ticker, d.date, f.institutional_flow FROM dates d CROSS JOIN co
       LEFT JOIN flow f ON f.ticker=co.ticker AND f.vintage=(SELECT MAX(bucket_end) FROM be WHERE bucket_end<=d.date)""")
def institutional_flow_pit(t):
    lines = holdings_lines(t)
    cusips, holders = stage(ho.cusip_aggregate(lines)), stage(ho.holder_aggregate(lines))
    flow = ho.institutional_flow_timeline(cusips, holders, COMPANIES)
    dates = grid(t).select("date").distinct()
    probes = dates.select("date", F.explode(F.array(*[F.lit(c) for c in sorted(COMPANIES)])).alias("ticker"))
    return asof(probes, flow, ["ticker"], "date", "d", {"institutional_flow": "institutional_flow"})
