"""Queries over factor tables, the point-in-time panel and the ranking model."""

from pyspark.sql import functions as F

from quantspark.operators import boosting as bo
from quantspark.operators import facts as fa
from quantspark.operators import holdings as ho
from quantspark.operators import ltr
from quantspark.operators import panel as pn
from quantspark.operators import ranking as rk
from quantspark.plans import derived as dv
from quantspark.plans import prices as px
from quantspark.plans.base import query
from quantspark.plans.filings import _GRID, _inst, grid, holdings_lines
from quantspark.session import stage

TODAY = "2000-12-31"
WEIGHTS = {"Growth": 2.0, "Valuation": 1.0, "Quality": 1.0, "Momentum": 3.0, "Sentiment": 1.0}

_TECH_TAIL = px._TECH.removeprefix("WITH ")

_TABLE = f"""WITH {_TECH_TAIL},
    lt AS (SELECT * FROM tech WHERE d<=DATE '{TODAY}' QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY d DESC)=1),
    rt AS (SELECT ticker, MAX(sh) FILTER (period='0m') - MAX(sh) FILTER (period='-3m') AS v FROM (SELECT ticker, period, (strongBuy+buy)/nullif(strongBuy+buy+hold+sell+strongSell,0) AS sh FROM rec_trend) GROUP BY 1),
    nu AS (SELECT ticker, COUNT(*) FILTER (action='up')-COUNT(*) FILTER (action='down') AS v FROM analyst WHERE grade_date>=DATE '{TODAY}' - INTERVAL 90 DAY GROUP BY 1),
    hf AS (SELECT ticker, AVG(pct_change)*100 AS v FROM holders GROUP BY 1),
    nf AS (SELECT ticker, SUM(CASE WHEN transaction LIKE 'Purchase%' THEN value WHEN transaction LIKE 'Sale%' THEN -value ELSE 0 END) AS v FROM insider GROUP BY 1),
    ft AS (SELECT s.ticker, revenueGrowth AS revenue_growth, earningsGrowth AS earnings_growth, forwardPE AS forward_pe, pegRatio AS peg_ratio,
      enterpriseToRevenue AS ev_to_revenue, operatingMargins AS operating_margin, nullif(operatingCashflow,0)/nullif(totalRevenue,0) AS fcf_margin,
      lt.momentum, lt.relative_strength, volume_/nullif(averageVolume,0) AS relative_volume, (targetMeanPrice/nullif(currentPrice,0)-1)*100 AS analyst_upside,
      rt.v*100 AS revisions_trend, CAST(coalesce(nu.v,0) AS DOUBLE) AS net_upgrades, hf.v AS institutional_flow, ROUND(nf.v,2) AS insider_flow, -shortPercentOfFloat*100 AS low_short_interest
      FROM (SELECT *, nullif(volume,0) AS volume_ FROM stock_info) s LEFT JOIN lt ON lt.ticker=s.ticker LEFT JOIN rt ON rt.ticker=s.ticker LEFT JOIN nu ON nu.ticker=s.ticker
      LEFT JOIN hf ON hf.ticker=s.ticker LEFT JOIN nf ON nf.ticker=s.ticker)"""

_RANKS = _TABLE + f""", lf AS (SELECT ticker, factor, value FROM ft UNPIVOT INCLUDE NULLS (value FOR factor IN ({", ".join(rk.FACTORS)}))),
    lo AS (SELECT *, CASE WHEN factor IN ('forward_pe','peg_ratio','ev_to_revenue') THEN -value ELSE value END AS o FROM lf),
    pr AS (SELECT a.ticker, a.factor, a.value, CASE WHEN a.o IS NOT NULL THEN ((SELECT COUNT(*) FROM lo b WHERE b.factor=a.factor AND b.o<a.o)
       + ((SELECT COUNT(*) FROM lo b WHERE b.factor=a.factor AND b.o=a.o)+1)/2.0) / (SELECT COUNT(o) FROM lo b WHERE b.factor=a.factor)*100 END AS pct FROM lo a)"""

_CATS = _RANKS + ", sc AS (SELECT ticker, " + ", ".join(
    f"AVG(pct) FILTER (factor IN ({', '.join(repr(f) for f in names)})) AS {c}" for c, names in rk.FACTOR_CATEGORIES.items()
) + " FROM pr GROUP BY 1)"


def _table(t):
    return rk.factor_table(
        dv.stock_info(t), dv.rec_trend(t), dv.analyst(t), dv.insider(t), dv.holders(t), *px.bars_and_market(t), TODAY
    ).withColumn("insider_flow", F.round("insider_flow", 2))


_FACTOR_SPEC = ",".join(f"{f} f4" for f in rk.FACTORS)


@query("factor_table", "P1 X19", f"ticker s,{_FACTOR_SPEC}", _TABLE + " SELECT * FROM ft")
def factor_table(t):
    return _table(t)


@query("factor_ranks", "W15", "ticker s,factor s,pct f", _RANKS + " SELECT * FROM pr")
def factor_ranks(t):
    return rk.percentile_ranks(_table(t))


@query("category_scores", "A21", "ticker s," + ",".join(f"{c} f" for c in rk.FACTOR_CATEGORIES), _CATS + " SELECT * FROM sc")
def category_scores(t):
    return rk.category_scores(rk.percentile_ranks(_table(t)))


@query("composite_rank", "P2", "ticker s,composite f", _CATS + " SELECT ticker, " + " + ".join(
    f"coalesce({c}, AVG({c}) OVER ())*{WEIGHTS.get(c, 0.0) / sum(WEIGHTS.values())!r}" for c in rk.FACTOR_CATEGORIES) + " AS composite FROM sc")
def composite_rank(t):
    return rk.rank_universe(_table(t), WEIGHTS)


@query("fundamental_factors", "P18 X17 X18", "ticker s,category s,factor s,value f4,implied_return_pct f", _RANKS + f""", cat(factor, category) AS (VALUES {', '.join(f"('{f}','{c}')" for c, n in rk.FACTOR_CATEGORIES.items() for f in n)})
       SELECT p.ticker, c.category, p.factor, p.value, ROUND((s.targetMeanPrice/nullif(s.currentPrice,0)-1)*100,1) AS implied_return_pct FROM pr p JOIN cat c ON c.factor=p.factor
       JOIN stock_info s ON s.ticker=p.ticker WHERE p.value IS NOT NULL AND c.category<>'Momentum'""")
def fundamental_factors(t):
    rows = rk.fundamental_factors(_table(t), dv.stock_info(t))
    flat = rows.select("ticker", "implied_return_pct", F.explode("factors").alias("category", "inner"))
    return flat.select("ticker", "implied_return_pct", "category", F.explode("inner").alias("factor", "value"))


def _flow(t, companies):
    lines = holdings_lines(t)
    cusips, holders = stage(ho.cusip_aggregate(lines)), stage(ho.holder_aggregate(lines))
    return ho.institutional_flow_timeline(cusips, holders, companies)


#: Brands matched to issuers by a word of their name.
BRAND_COMPANIES = {f"Brand#{i + 1}": w for i, w in enumerate(["Ring Works", "Bolt Inc", "Gear Co", "Small Co", "Blue Co"])}


def _panel(t):
    sums = stage(dv.daily_sums(t, full=True))
    return pn.build_panel(
        stage(grid(t)), fa.fact_history(stage(dv.facts6_from(sums))), dv.prices_from(sums), stage(dv.market_from(sums)),
        dv.analyst(t), dv.insider(t), stage(dv.splits(t)), _flow(t, BRAND_COMPANIES),
    )


_KNOWN_PRICE = f"""WITH {_TECH_TAIL}, {_GRID},
    gp AS (SELECT g.ticker, g.date, x.close AS price, x.momentum, x.relative_strength, x.price_vs_ma, x.relative_volume FROM grid g ASOF LEFT JOIN tech x ON x.ticker=g.ticker AND x.d<=g.date)"""

_COMPANY_FLOW = _inst(1).replace("WITH co(ticker, token) AS (VALUES ", "co(ticker, token) AS (VALUES ", 1)
_COMPANY_FLOW = "co(ticker, token) AS (VALUES " + ", ".join(f"('{t}','{n.upper().split()[0]}')" for t, n in BRAND_COMPANIES.items()) + ")" + _COMPANY_FLOW[_COMPANY_FLOW.index(", be AS"):]

_PANEL = _KNOWN_PRICE + f""", {_COMPANY_FLOW},
    dd AS (SELECT * FROM facts6 QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker,concept,start_d,end_d,form ORDER BY filed DESC, val DESC)=1),
    fq AS (SELECT * FROM dd WHERE date_diff('day',start_d,end_d) BETWEEN 80 AND 100 QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker,concept,start_d,end_d ORDER BY filed)=1),
    fy AS (SELECT * FROM dd WHERE date_diff('day',start_d,end_d) BETWEEN 350 AND 380 QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker,concept,start_d,end_d ORDER BY filed)=1),
    der AS (SELECT y.ticker, y.concept, MAX(q.end_d) AS start_d, y.end_d, y.val-SUM(q.val) AS val, y.filed, 'derived' AS form FROM fy y
      JOIN fq q ON q.ticker=y.ticker AND q.concept=y.concept AND q.start_d>=y.start_d AND q.end_d<=y.end_d GROUP BY y.ticker,y.concept,y.start_d,y.end_d,y.val,y.filed HAVING COUNT(*)=3),
    h0 AS (SELECT ticker,concept,start_d,end_d,val,filed FROM dd UNION ALL SELECT ticker,concept,start_d,end_d,val,filed FROM der),
    h1 AS (SELECT h.*, coalesce((SELECT product(s.ratio) FROM splits s WHERE s.ticker=h.ticker AND s.split_d>h.end_d),1) AS fac FROM h0 h),
    hist6 AS (SELECT ticker,concept,start_d,end_d,filed, CASE concept WHEN 'eps_diluted' THEN val*(1/fac) WHEN 'shares_outstanding' THEN val*fac ELSE val END AS val FROM h1),
    probe AS (SELECT * FROM grid UNION SELECT ticker, CAST(date - INTERVAL 1 YEAR AS DATE) FROM grid),
    kn AS (SELECT g.ticker, g.date, h.concept, h.end_d, h.val, h.filed FROM probe g JOIN hist6 h ON h.ticker=g.ticker AND h.filed<=g.date AND date_diff('day',h.start_d,h.end_d) BETWEEN 80 AND 100),
    ff AS (SELECT * FROM kn QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker,date,concept,end_d ORDER BY filed)=1),
    l4 AS (SELECT * FROM ff QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker,date,concept ORDER BY end_d DESC)<=4),
    tm AS (SELECT ticker, date, concept, CASE WHEN COUNT(*)=4 THEN SUM(val) END AS ttm FROM l4 GROUP BY 1,2,3),
    tw AS (SELECT ticker, date, MAX(ttm) FILTER (concept='revenue') AS rev, MAX(ttm) FILTER (concept='net_income') AS ni, MAX(ttm) FILTER (concept='eps_diluted') AS eps,
      MAX(ttm) FILTER (concept='operating_income') AS oi, MAX(ttm) FILTER (concept='operating_cash_flow') AS ocf FROM tm GROUP BY 1,2),
    sh AS (SELECT g.ticker, g.date, h.val FROM grid g JOIN hist6 h ON h.ticker=g.ticker AND h.concept='shares_outstanding' AND h.filed<=g.date QUALIFY ROW_NUMBER() OVER (PARTITION BY g.ticker,g.date ORDER BY h.end_d DESC, h.filed)=1),
    ka AS (SELECT g.ticker, g.date, g.price, a.firm, arg_max(a.target, (a.grade_date, a.seq)) AS target, MAX(a.grade_date) AS gd FROM gp g JOIN analyst a ON a.ticker=g.ticker AND a.grade_date<=g.date GROUP BY 1,2,3,4),
    fa AS (SELECT ka.*, coalesce((SELECT product(s.ratio) FROM splits s WHERE s.ticker=ka.ticker AND s.split_d>ka.gd),1) AS fac FROM ka WHERE gd>date - INTERVAL 540 DAY AND target>0),
    au AS (SELECT ticker, date, (AVG(target/fac)/MAX(price)-1)*100 AS v FROM fa WHERE price<>0 GROUP BY 1,2),
    ug AS (SELECT g.ticker, g.date, COUNT(*) FILTER (action='up' AND grade_date>g.date - INTERVAL 90 DAY) - COUNT(*) FILTER (action='down' AND grade_date>g.date - INTERVAL 90 DAY) AS nu,
      COUNT(*) FILTER (action='up' AND grade_date<=g.date - INTERVAL 90 DAY) - COUNT(*) FILTER (action='down' AND grade_date<=g.date - INTERVAL 90 DAY) AS before
      FROM grid g LEFT JOIN analyst a ON a.ticker=g.ticker AND a.grade_date<=g.date AND a.grade_date>g.date - INTERVAL 180 DAY GROUP BY 1,2),
    net AS (SELECT ticker, start_date, SUM(CASE WHEN transaction LIKE 'Purchase%' THEN value WHEN transaction LIKE 'Sale%' THEN -value ELSE 0 END) AS v FROM insider GROUP BY 1,2),
    nf AS (SELECT g.ticker, g.date, coalesce(SUM(n.v),0) AS v FROM grid g LEFT JOIN net n ON n.ticker=g.ticker AND n.start_date<=g.date AND n.start_date>g.date - INTERVAL 180 DAY GROUP BY 1,2),
    fl AS (SELECT vintage, ticker, arg_max(pct_change, period) AS v FROM hist GROUP BY 1,2),
    cd AS (SELECT DISTINCT d FROM px_daily UNION SELECT d FROM mkt_daily),
    fr AS (SELECT g.ticker, g.date, (p1.close/nullif(p0.close,0)-1)*100 AS v FROM (SELECT *, (SELECT MIN(d) FROM cd WHERE d>=date) AS din, (SELECT MIN(d) FROM cd WHERE d>=date + INTERVAL 30 DAY) AS dout FROM grid) g
      LEFT JOIN px_daily p0 ON p0.ticker=g.ticker AND p0.d=g.din LEFT JOIN px_daily p1 ON p1.ticker=g.ticker AND p1.d=g.dout),
    panel AS (SELECT g.date, g.ticker, (w.rev/nullif(o.rev,0)-1)*100 AS revenue_growth, (w.ni/nullif(o.ni,0)-1)*100 AS earnings_growth,
      CASE WHEN w.eps>0 THEN nullif(g.price,0)/w.eps END AS trailing_pe, nullif(g.price*sh.val,0)/nullif(w.rev,0) AS price_to_sales, w.oi/nullif(w.rev,0) AS operating_margin, w.ocf/nullif(w.rev,0) AS fcf_margin,
      g.momentum, g.relative_strength, g.price_vs_ma, g.relative_volume, au.v AS analyst_upside, ug.nu AS net_upgrades, ug.nu-ug.before AS revisions_trend, fl.v AS institutional_flow, nf.v AS insider_flow, fr.v AS forward_return
      FROM gp g LEFT JOIN tw w ON w.ticker=g.ticker AND w.date=g.date LEFT JOIN tw o ON o.ticker=g.ticker AND o.date=CAST(g.date - INTERVAL 1 YEAR AS DATE)
      LEFT JOIN sh ON sh.ticker=g.ticker AND sh.date=g.date LEFT JOIN au ON au.ticker=g.ticker AND au.date=g.date LEFT JOIN ug ON ug.ticker=g.ticker AND ug.date=g.date
      LEFT JOIN nf ON nf.ticker=g.ticker AND nf.date=g.date LEFT JOIN fr ON fr.ticker=g.ticker AND fr.date=g.date
      LEFT JOIN fl ON fl.ticker=g.ticker AND fl.vintage=(SELECT MAX(bucket_end) FROM be WHERE bucket_end<=g.date))"""

_PANEL_SPEC = "date d,ticker s," + ",".join(f"{c} {'f2' if c == 'insider_flow' else 'f4'}" for c in pn.FACTOR_COLUMNS) + ",forward_return f4"


@query("factor_panel", "P12", _PANEL_SPEC, _PANEL + " SELECT * FROM panel")
def factor_panel(t):
    return _panel(t)


_FORWARD = f"""WITH {_GRID}, cd AS (SELECT DISTINCT d FROM px_daily UNION SELECT d FROM mkt_daily),
    fr AS (SELECT g.ticker, g.date, (p1.close/nullif(p0.close,0)-1)*100 AS forward_return FROM (SELECT *, (SELECT MIN(d) FROM cd WHERE d>=date) AS din, (SELECT MIN(d) FROM cd WHERE d>=date + INTERVAL 30 DAY) AS dout FROM grid) g
      LEFT JOIN px_daily p0 ON p0.ticker=g.ticker AND p0.d=g.din LEFT JOIN px_daily p1 ON p1.ticker=g.ticker AND p1.d=g.dout)"""


def _forward(t):
    bars, market = px.bars_and_market(t)
    return pn.forward_return(grid(t), bars, bars.select("d").unionByName(market.select("d")).distinct())


@query("forward_return", "P13", "ticker s,date d,forward_return f4", _FORWARD + " SELECT * FROM fr")
def forward_return(t):
    return _forward(t)


@query("relevance_labels", "W26 P14", "ticker s,date d,relevance i,is_test b", _FORWARD + """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY forward_return, ticker) AS r, COUNT(*) OVER (PARTITION BY date) AS n FROM fr WHERE forward_return IS NOT NULL),
       dts AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date DESC) AS k, COUNT(*) OVER () AS m FROM (SELECT DISTINCT date FROM fr)),
       lab AS (SELECT ticker, date, CASE WHEN n=1 THEN 0 ELSE greatest(0, CAST(ceil((r-1)*5/(n-1)) AS INT)-1) END AS relevance FROM r)
       SELECT fr.ticker, fr.date, lab.relevance, k<=greatest(1, CAST(round_even(m*0.3,0) AS INT)) AS is_test FROM fr JOIN dts ON dts.date=fr.date LEFT JOIN lab ON lab.ticker=fr.ticker AND lab.date=fr.date""")
def relevance_labels(t):
    return ltr.time_split(ltr.relevance_labels(stage(_forward(t))))


@query("rank_ic", "P16", "date d,n i,spearman f", _KNOWN_PRICE + f""", {_FORWARD.removeprefix('WITH ').removeprefix(_GRID + ', ')},
       j AS (SELECT gp.date, gp.ticker, gp.momentum AS s, fr.forward_return AS r FROM gp JOIN fr ON fr.ticker=gp.ticker AND fr.date=gp.date WHERE gp.momentum IS NOT NULL AND fr.forward_return IS NOT NULL),
       k AS (SELECT date, RANK() OVER (PARTITION BY date ORDER BY s) + (COUNT(*) OVER (PARTITION BY date, s)-1)/2.0 AS a, RANK() OVER (PARTITION BY date ORDER BY r) + (COUNT(*) OVER (PARTITION BY date, r)-1)/2.0 AS b FROM j)
       SELECT date, COUNT(*) AS n, CASE WHEN isnan(corr(a,b)) THEN NULL ELSE corr(a,b) END AS spearman FROM k GROUP BY 1""")
def rank_ic(t):
    from quantspark.operators.asof import asof
    from quantspark.operators.timeseries import momentum

    bars, market = px.bars_and_market(t)
    scores = asof(grid(t), momentum(bars, market, 84), ["ticker"], "date", "d", {"momentum": "score"})
    days = bars.select("d").unionByName(market.select("d")).distinct()
    return ltr.rank_ic(scores.join(pn.forward_return(grid(t), bars, days), ["ticker", "date"]))


_GRADES = """r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY forward_return, ticker) AS r, COUNT(*) OVER (PARTITION BY date) AS n FROM fr WHERE forward_return IS NOT NULL),
       lab AS (SELECT ticker, date, CASE WHEN n=1 THEN 0 ELSE greatest(0, CAST(ceil((r-1)*5/(n-1)) AS INT)-1) END AS relevance FROM r)"""


@query("ltr_gradients", "P15", "date d,ticker s,relevance i,gradient f,curvature f", _KNOWN_PRICE + f""", {_FORWARD.removeprefix('WITH ').removeprefix(_GRID + ', ')}, {_GRADES},
       j AS (SELECT gp.date, gp.ticker, lab.relevance, tanh(gp.momentum/100) AS s FROM gp JOIN lab ON lab.ticker=gp.ticker AND lab.date=gp.date WHERE gp.momentum IS NOT NULL),
       p AS (SELECT a.date, a.ticker, a.relevance, SUM(CASE WHEN a.relevance>b.relevance THEN -exp(b.s-a.s) WHEN a.relevance<b.relevance THEN exp(a.s-b.s) ELSE 0 END) AS g,
         SUM(CASE WHEN a.relevance>b.relevance THEN exp(b.s-a.s) WHEN a.relevance<b.relevance THEN exp(a.s-b.s) ELSE 0 END) AS h,
         SUM(CASE WHEN a.relevance>b.relevance THEN 1 ELSE 0 END) AS above FROM j a JOIN j b ON b.date=a.date GROUP BY 1,2,3),
       q AS (SELECT *, SUM(above) OVER (PARTITION BY date) AS pairs FROM p)
       SELECT date, ticker, relevance, coalesce(g/nullif(pairs,0),0) AS gradient, coalesce(h/nullif(pairs,0),0) AS curvature FROM q""")
def ltr_gradients(t):
    """Gradients of the pairwise loss when squashed momentum is the score; the SQL visits every pair of a date."""
    from quantspark.operators.asof import asof
    from quantspark.operators.timeseries import momentum

    bars, market = px.bars_and_market(t)
    scores = asof(grid(t), momentum(bars, market, 84), ["ticker"], "date", "d", {"momentum": "score"})
    days = bars.select("d").unionByName(market.select("d")).distinct()
    graded = ltr.relevance_labels(pn.forward_return(grid(t), bars, days)).filter("relevance is not null")
    rows = scores.filter("score is not null").withColumn("score", F.tanh(F.col("score") / 100)).join(graded, ["ticker", "date"])
    return bo.pairwise_gradients(stage(rows))


@query("ltr_scores", "P15", "date d,ticker s,score f,forward_return f", None)
def ltr_scores(t):
    """Scores of the test dates by trees boosted on the pairwise loss of the training dates."""
    panel = stage(ltr.time_split(ltr.relevance_labels(_panel(t))))
    model = bo.train_pairwise(panel.filter("not is_test"), pn.FACTOR_COLUMNS)
    return model.transform(panel.filter("is_test")).select("date", "ticker", "score", "forward_return")


@query("ltr_checked", "P15 P17", "date d,ticker s,relevance i,has_score b,importance f",
       _FORWARD + """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY forward_return, ticker) AS r, COUNT(*) OVER (PARTITION BY date) AS n FROM fr WHERE forward_return IS NOT NULL),
       lab AS (SELECT ticker, date, CASE WHEN n=1 THEN 0 ELSE greatest(0, CAST(ceil((r-1)*5/(n-1)) AS INT)-1) END AS relevance FROM r),
       dts AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date DESC) AS k, COUNT(*) OVER () AS m FROM (SELECT DISTINCT date FROM fr)),
       x AS (SELECT fr.date, fr.ticker, lab.relevance, k<=greatest(1, CAST(round_even(m*0.3,0) AS INT)) AS is_test FROM fr JOIN dts ON dts.date=fr.date LEFT JOIN lab ON lab.ticker=fr.ticker AND lab.date=fr.date)
       SELECT date, ticker, relevance, true AS has_score, CASE WHEN (SELECT COUNT(DISTINCT relevance) FROM x WHERE NOT is_test)>1 THEN 1.0 ELSE 0.0 END AS importance FROM x WHERE is_test""")
def ltr_checked(t):
    """What is determined of the model: the grades and a score on every row of the test dates; importances sum to one, or to zero if all training grades are equal."""
    panel = stage(ltr.time_split(ltr.relevance_labels(_panel(t))))
    model = ltr.train_ranker(panel.filter("not is_test"))
    total = ltr.feature_importance(model, t.spark).agg(F.sum("importance")).scalar()
    return model.transform(panel.filter("is_test")).select("date", "ticker", "relevance", F.col("score").isNotNull().alias("has_score"), total.alias("importance"))


@query("factor_changes", "W27", "ticker s,d d,factor s,previous f,current f,delta_pct f",
       """WITH u AS (UNPIVOT (SELECT ticker, d, open AS revenue_growth, close AS earnings_growth FROM px_monthly) ON revenue_growth, earnings_growth INTO NAME factor VALUE v),
       l AS (SELECT *, LAG(v) OVER (PARTITION BY ticker, factor ORDER BY d) AS p FROM u), c AS (SELECT *, ROUND((v-p)/abs(p)*100+3e-10,1) AS delta_pct FROM l WHERE p<>0)
       SELECT ticker, d, factor, p AS previous, v AS current, delta_pct FROM c WHERE abs(delta_pct)>=5""")
def factor_changes(t):
    bars = stage(dv.px_monthly(t))
    inner = F.create_map(F.lit("revenue_growth"), F.col("open"), F.lit("earnings_growth"), F.col("close"))
    return rk.factor_changes(bars.select("ticker", "d", F.lit(0).alias("seq"), F.create_map(F.lit("Growth"), inner).alias("factors")))
