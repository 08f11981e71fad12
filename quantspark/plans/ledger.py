"""Queries over trade logs, rules and thesis positions."""

from pyspark.sql import functions as F

from quantspark.operators import portfolio as pf
from quantspark.operators import positions as po
from quantspark.operators import rules as ru
from quantspark.operators.timeseries import latest_price
from quantspark.plans import derived as dv
from quantspark.plans.base import query
from quantspark.session import stage

UNTIL, TODAY = "2002-03-31", "2001-06-29"

_FLOW = "SUM(CASE action WHEN 'BUY' THEN -shares*price ELSE shares*price END)"
_CASH = f"SELECT p.portfolio, p.initial_cash + coalesce(f.v,0) AS cash FROM portfolios p LEFT JOIN (SELECT portfolio AS pp, {_FLOW} AS v FROM trades GROUP BY 1) f ON f.pp=p.portfolio"


def _replay(keys: str) -> str:
    same = " AND ".join(f"r.{k}=s.{k}" for k in keys.split(","))
    return f"""WITH RECURSIVE r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY d, seq) AS n FROM trades),
    s AS (SELECT {keys}, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS sh, 0.0::DOUBLE AS cost, NULL::DATE AS entry FROM (SELECT DISTINCT {keys} FROM trades)
      UNION ALL SELECT {', '.join('s.' + k for k in keys.split(','))}, r.n, CASE action WHEN 'BUY' THEN sh+shares ELSE sh-shares END,
        CASE action WHEN 'BUY' THEN cost+shares*price ELSE cost - (CASE WHEN sh<>0 THEN cost/sh ELSE 0 END)*shares END,
        CASE WHEN action='BUY' AND sh<=1e-9 THEN r.d ELSE entry END FROM s JOIN r ON {same} AND r.n=s.n+1),
    fin AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY n DESC)=1)
    SELECT {keys}, sh AS shares, cost/sh AS avg_cost, entry AS entry_date FROM fin WHERE sh>1e-9"""


@query("portfolio_cash", "H18", "portfolio s,cash f2", _CASH)
def portfolio_cash(t):
    return pf.cash_balance(dv.trades(t), dv.portfolios(t))


@query("positions", "H18", "portfolio s,ticker s,shares f,avg_cost f4,entry_date d", _replay("portfolio,ticker"))
def positions(t):
    return pf.positions(dv.trades(t))


@query("rule_positions", "W31", "portfolio s,rule s,ticker s,shares f,avg_cost f4,entry_date d", _replay("portfolio,rule,ticker"))
def rule_positions(t):
    return pf.positions(dv.trades(t), ["portfolio", "rule", "ticker"])


_FIFO = """WITH b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY portfolio,rule,ticker ORDER BY d,seq) AS k FROM trades WHERE action='BUY'),
    s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY portfolio,rule,ticker ORDER BY d,seq) AS k FROM trades WHERE action='SELL'),
    pairs AS (SELECT b.portfolio, b.rule, b.ticker, b.d AS buy_date, b.price AS buy_price, b.shares, s.d AS sell_date, s.price AS sell_price,
      s.price/b.price-1 AS return_pct, (s.price-b.price)*b.shares AS pnl, date_diff('day', b.d, s.d) AS hold_days, CASE WHEN s.d IS NULL THEN 'open' ELSE 'closed' END AS status
      FROM b LEFT JOIN s ON s.portfolio=b.portfolio AND s.rule=b.rule AND s.ticker=b.ticker AND s.k=b.k)"""
_PAIR_SPEC = "portfolio s,rule s,ticker s,buy_date d,buy_price f,shares f,sell_date d,sell_price f,return_pct f,pnl f4,hold_days i,status s"


@query("closed_trades", "H19 E4", _PAIR_SPEC, _FIFO + " SELECT * FROM pairs")
def closed_trades(t):
    return pf.closed_trades(dv.trades(t))


@query("rule_pnl", "A11", "rule s,trades i,mean_return f,total_pnl f2", _FIFO + " SELECT rule, COUNT(*) AS trades, AVG(return_pct) AS mean_return, SUM(pnl) AS total_pnl FROM pairs WHERE status='closed' GROUP BY 1")
def rule_pnl(t):
    return pf.rule_pnl(pf.closed_trades(dv.trades(t)))


_MARK = "mk AS (SELECT ticker, arg_max(close,d) AS price FROM trade_px WHERE d<=DATE '2001-12-31' AND d>=DATE '2001-12-24' GROUP BY 1)"


@query("marked_trades", "H20 J17", "portfolio s,rule s,ticker s,buy_date d,buy_price f,shares f,sell_price f,return_pct f,pnl f4,status s",
       _FIFO + f", {_MARK} SELECT p.portfolio, p.rule, p.ticker, buy_date, buy_price, shares, status, CASE WHEN status='open' THEN coalesce(mk.price,buy_price) ELSE sell_price END AS sell_price,"
       " CASE WHEN status='open' THEN coalesce(mk.price,buy_price) ELSE sell_price END/buy_price-1 AS return_pct, (CASE WHEN status='open' THEN coalesce(mk.price,buy_price) ELSE sell_price END-buy_price)*shares AS pnl"
       " FROM pairs p LEFT JOIN mk ON mk.ticker=p.ticker")
def marked_trades(t):
    return pf.mark_open_trades(pf.closed_trades(dv.trades(t)), latest_price(dv.trade_px(t), "2001-12-31"))


@query("portfolio_totals", "A20 J17 J3", "portfolio s,cash f2,holdings_value f2,total_value f2,total_return f4",
       _replay("portfolio,ticker").replace("fin AS", f"cs AS ({_CASH}), {_MARK}, fin AS").replace(
           "SELECT portfolio,ticker, sh AS shares, cost/sh AS avg_cost, entry AS entry_date FROM fin WHERE sh>1e-9",
           """SELECT p.portfolio, cs.cash, coalesce(h.v,0) AS holdings_value, cs.cash+coalesce(h.v,0) AS total_value, (cs.cash+coalesce(h.v,0))/p.initial_cash-1 AS total_return
           FROM portfolios p JOIN cs ON cs.portfolio=p.portfolio LEFT JOIN (SELECT portfolio AS hp, SUM(sh*coalesce(mk.price, cost/sh)) AS v FROM fin LEFT JOIN mk ON mk.ticker=fin.ticker WHERE sh>1e-9 GROUP BY 1) h ON h.hp=p.portfolio"""))
def portfolio_totals(t):
    return pf.portfolio_totals(dv.trades(t), dv.portfolios(t), latest_price(dv.trade_px(t), "2001-12-31"))


@query("trade_violations", "H23", "portfolio s,ticker s,d d,action s,seq i,reason s",
       """WITH r AS (SELECT t.*, p.initial_cash, SUM(CASE action WHEN 'BUY' THEN -shares*price ELSE shares*price END) OVER (PARTITION BY t.portfolio ORDER BY d, seq) - (CASE action WHEN 'BUY' THEN -shares*price ELSE shares*price END) AS cash_before,
         SUM(CASE action WHEN 'BUY' THEN shares ELSE -shares END) OVER (PARTITION BY t.portfolio, t.ticker ORDER BY d, seq) - (CASE action WHEN 'BUY' THEN shares ELSE -shares END) AS held FROM trades t JOIN portfolios p ON p.portfolio=t.portfolio),
       x AS (SELECT *, CASE WHEN action='BUY' AND shares*price>initial_cash+cash_before+1e-6 THEN 'not enough cash' WHEN action='SELL' AND shares>held+1e-6 THEN 'not enough shares' END AS reason FROM r)
       SELECT * FROM x WHERE reason IS NOT NULL""")
def trade_violations(t):
    return pf.violations(dv.trades(t), dv.portfolios(t))


@query("valuation_daily", "W32 J21", "portfolio s,d d,cash f2,holdings_value f2,total_value f2",
       f"""WITH sp AS (SELECT p.portfolio, p.initial_cash, least(p.created, f.m) AS start FROM portfolios p JOIN (SELECT portfolio AS pp, MIN(d) AS m FROM trades GROUP BY 1) f ON f.pp=p.portfolio),
       g AS (SELECT portfolio, initial_cash, CAST(unnest(generate_series(start, DATE '{UNTIL}', INTERVAL 1 DAY)) AS DATE) AS d FROM sp),
       fl AS (SELECT portfolio, d, {_FLOW} AS c FROM trades GROUP BY 1,2),
       ca AS (SELECT g.portfolio, g.d, initial_cash + SUM(coalesce(c,0)) OVER (PARTITION BY g.portfolio ORDER BY g.d) AS cash FROM g LEFT JOIN fl ON fl.portfolio=g.portfolio AND fl.d=g.d),
       mv AS (SELECT portfolio, ticker, d, SUM(CASE action WHEN 'BUY' THEN shares ELSE -shares END) AS q FROM trades GROUP BY 1,2,3),
       pt AS (SELECT DISTINCT portfolio, ticker FROM trades),
       hd AS (SELECT g.portfolio, pt.ticker, g.d, SUM(coalesce(mv.q,0)) OVER (PARTITION BY g.portfolio, pt.ticker ORDER BY g.d) AS held FROM g JOIN pt ON pt.portfolio=g.portfolio LEFT JOIN mv ON mv.portfolio=g.portfolio AND mv.ticker=pt.ticker AND mv.d=g.d),
       hv AS (SELECT h.portfolio, h.d, SUM(h.held*x.close) AS v FROM hd h ASOF JOIN trade_px x ON x.ticker=h.ticker AND x.d<=h.d GROUP BY 1,2)
       SELECT ca.portfolio, ca.d, ca.cash, coalesce(hv.v,0) AS holdings_value, ca.cash+coalesce(hv.v,0) AS total_value FROM ca LEFT JOIN hv ON hv.portfolio=ca.portfolio AND hv.d=ca.d""")
def valuation_daily(t):
    return pf.valuation_history(dv.trades(t), dv.portfolios(t), dv.trade_px(t), UNTIL)


# rule, order, slots, hold days, unit size, exit on signal loss
CONFIG = [("F", 0, 12, 200, 9000.0, True), ("O", 1, 10, 400, 5000.0, False), ("P", 2, 8, 30, 2500.0, True)]
_CONFIG_SQL = "cfg(rule, rule_order, top_n, hold_days, unit_size, exit_on_signal_loss) AS (VALUES " + ", ".join(f"('{r}',{o},{n},{h},{u}::DOUBLE,{str(e).lower()})" for r, o, n, h, u, e in CONFIG) + ")"


def _config(t):
    return t.spark.createDataFrame(CONFIG, ru.RULE_CONFIG)


@query("rule_exits", "H16", "portfolio s,rule s,ticker s,shares f,reason s",
       f"""WITH {_CONFIG_SQL} SELECT h.portfolio, h.rule, h.ticker, h.shares, CASE WHEN date_diff('day',h.entry_date,DATE '{TODAY}')>=c.hold_days THEN 'max hold reached' ELSE 'no longer qualifies' END AS reason
       FROM rule_held h JOIN cfg c ON c.rule=h.rule LEFT JOIN rule_candidates k ON k.rule=h.rule AND k.ticker=h.ticker
       WHERE date_diff('day',h.entry_date,DATE '{TODAY}')>=c.hold_days OR (c.exit_on_signal_loss AND k.ticker IS NULL)""")
def rule_exits(t):
    return ru.rule_exits(dv.rule_held(t), dv.rule_candidates(t), _config(t), TODAY)


_RANKED = f"""{_CONFIG_SQL}, fresh AS (SELECT p.portfolio, c.*, k.ticker, k.score, c.top_n - coalesce(m.n,0) AS slots FROM portfolios p CROSS JOIN cfg c JOIN rule_candidates k ON k.rule=c.rule
      LEFT JOIN (SELECT portfolio, rule, COUNT(*) AS n FROM rule_held GROUP BY 1,2) m ON m.portfolio=p.portfolio AND m.rule=c.rule
      WHERE NOT EXISTS (SELECT 1 FROM rule_held h WHERE h.portfolio=p.portfolio AND h.rule=c.rule AND h.ticker=k.ticker)),
    top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY portfolio, rule ORDER BY score DESC, ticker) AS rk FROM fresh QUALIFY rk<=slots),
    ranked AS (SELECT *, CASE WHEN COUNT(*) OVER (PARTITION BY portfolio, rule)>1 THEN 1.0-(rk-1)/COUNT(*) OVER (PARTITION BY portfolio, rule) ELSE 1.0 END AS percentile FROM top)"""


@query("ranked_entries", "W33 T7", "portfolio s,rule s,ticker s,score f,percentile f", f"WITH {_RANKED} SELECT * FROM ranked")
def ranked_entries(t):
    return ru.ranked_entries(dv.portfolios(t), stage(dv.rule_held(t)), dv.rule_candidates(t), _config(t))


@query("rule_fill", "H17 T8", "portfolio s,rule s,ticker s,shares f,price f,score f",
       f"""WITH RECURSIVE {_RANKED}, px AS (SELECT ticker, arg_max(close,d) AS price FROM px_daily WHERE d<=DATE '{TODAY}' AND d>=DATE '{TODAY}' - INTERVAL 7 DAY GROUP BY 1),
       li AS (SELECT r.*, px.price, ROW_NUMBER() OVER (PARTITION BY portfolio ORDER BY percentile DESC, rule_order, rk) AS n FROM ranked r JOIN px ON px.ticker=r.ticker),
       w AS (SELECT portfolio, CAST(0 AS BIGINT) AS n, initial_cash/40 AS cash, NULL::VARCHAR AS rule, NULL::VARCHAR AS ticker, 0.0::DOUBLE AS shares, 0.0::DOUBLE AS price, 0.0::DOUBLE AS score, false AS taken FROM portfolios
         UNION ALL SELECT w.portfolio, li.n, CASE WHEN li.unit_size<=w.cash+1e-6 THEN w.cash-li.unit_size ELSE w.cash END, li.rule, li.ticker, li.unit_size/li.price, li.price, li.score, li.unit_size<=w.cash+1e-6
         FROM w JOIN li ON li.portfolio=w.portfolio AND li.n=w.n+1) SELECT * FROM w WHERE taken""")
def rule_fill(t):
    cash = dv.portfolios(t).select("portfolio", (F.col("initial_cash") / 40).alias("cash"))
    prices = latest_price(dv.px_daily(t), TODAY)
    return ru.rule_entries(dv.portfolios(t), stage(dv.rule_held(t)), dv.rule_candidates(t), _config(t), prices, cash)


_DAY_EXITS = f"""px AS (SELECT ticker, arg_max(close,d) AS price FROM px_daily WHERE d<=DATE '{TODAY}' AND d>=DATE '{TODAY}' - INTERVAL 7 DAY GROUP BY 1), {_CONFIG_SQL},
       ex AS (SELECT h.portfolio, h.rule, h.ticker, h.shares, px.price, CASE WHEN date_diff('day',h.entry_date,DATE '{TODAY}')>=c.hold_days THEN 'max hold reached' ELSE 'no longer qualifies' END AS reason
         FROM rule_held h JOIN cfg c ON c.rule=h.rule JOIN px ON px.ticker=h.ticker LEFT JOIN rule_candidates k ON k.rule=h.rule AND k.ticker=h.ticker
         WHERE date_diff('day',h.entry_date,DATE '{TODAY}')>=c.hold_days OR (c.exit_on_signal_loss AND k.ticker IS NULL)),
       hl AS (SELECT h.* FROM rule_held h WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.portfolio=h.portfolio AND ex.rule=h.rule AND ex.ticker=h.ticker))"""


@query("rule_day", "E2 H16 H17", "portfolio s,rule s,ticker s,action s,shares f,price f,reason s",
       f"""WITH RECURSIVE {_DAY_EXITS}, {_RANKED.removeprefix(_CONFIG_SQL + ", ").replace("rule_held", "hl")},
       li AS (SELECT r.*, px.price, ROW_NUMBER() OVER (PARTITION BY portfolio ORDER BY percentile DESC, rule_order, rk) AS n FROM ranked r JOIN px ON px.ticker=r.ticker),
       w AS (SELECT p.portfolio, CAST(0 AS BIGINT) AS n, p.initial_cash/40 + coalesce((SELECT SUM(ex.shares*ex.price) FROM ex WHERE ex.portfolio=p.portfolio),0) AS cash, NULL::VARCHAR AS rule, NULL::VARCHAR AS ticker, 0.0::DOUBLE AS shares, 0.0::DOUBLE AS price, false AS taken FROM portfolios p
         UNION ALL SELECT w.portfolio, li.n, CASE WHEN li.unit_size<=w.cash+1e-6 THEN w.cash-li.unit_size ELSE w.cash END, li.rule, li.ticker, li.unit_size/li.price, li.price, li.unit_size<=w.cash+1e-6
         FROM w JOIN li ON li.portfolio=w.portfolio AND li.n=w.n+1)
       SELECT portfolio, rule, ticker, 'BUY' AS action, shares, price, NULL AS reason FROM w WHERE taken UNION ALL SELECT portfolio, rule, ticker, 'SELL', shares, price, reason FROM ex""")
def rule_day(t):
    cash = dv.portfolios(t).select("portfolio", (F.col("initial_cash") / 40).alias("cash"))
    prices = stage(latest_price(dv.px_daily(t), TODAY))
    return ru.rule_day(dv.portfolios(t), stage(dv.rule_held(t)), stage(dv.rule_candidates(t)), _config(t), prices, cash, TODAY)


@query("dip_candidates", "H13", "ticker s,score f",
       """WITH w AS (SELECT * FROM px_daily WHERE d<=DATE '2000-05-12' AND d>=DATE '2000-05-02'), c AS (SELECT d, LAG(d) OVER (ORDER BY d) AS p FROM (SELECT DISTINCT d FROM w))
       SELECT a.ticker, ABS(a.close/b.close-1) AS score FROM w a JOIN c ON c.d=a.d JOIN w b ON b.ticker=a.ticker AND b.d=c.p WHERE a.d=DATE '2000-05-12' AND a.close/b.close-1<=-0.05""")
def dip_candidates(t):
    return ru.dip_candidates(dv.px_daily(t), "2000-05-12")


@query("streak_candidates", "H14 X7", "ticker s,score f",
       """WITH k AS (SELECT * FROM earnings QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY earnings_date DESC)<=8),
       nx AS (SELECT ticker, MIN(earnings_date) AS nd FROM k WHERE earnings_date>DATE '2001-07-27' GROUP BY 1),
       pr AS (SELECT k.ticker, k.surprise_pct, nx.nd, ROW_NUMBER() OVER (PARTITION BY k.ticker ORDER BY earnings_date DESC) AS r FROM k JOIN nx ON nx.ticker=k.ticker WHERE k.earnings_date<nx.nd AND k.reported_eps IS NOT NULL),
       tw AS (SELECT ticker, MAX(nd) AS nd, COUNT(surprise_pct) AS c, MIN(surprise_pct) AS lo, MAX(surprise_pct) AS hi, AVG(surprise_pct) AS av FROM pr WHERE r<=2 GROUP BY 1)
       SELECT ticker, greatest(1-ABS(av-0)/60.0, 0.01) AS score FROM tw WHERE c=2 AND lo>=-60 AND hi<=60
         AND (SELECT COUNT(*) FROM generate_series(DATE '2001-07-28', CAST(nd - INTERVAL 1 DAY AS DATE), INTERVAL 1 DAY) g(x) WHERE isodow(x)<=5)=0""")
def streak_candidates(t):
    return ru.streak_candidates(dv.earnings_from(stage(dv.quarterly_sums(t))), "2001-07-27", -60.0, 60.0)


@query("position_state", "J20", "id s,portfolio s,ticker s,created d,status s,closed_date d,actual_return_pct f",
       """WITH c AS (SELECT * FROM position_events WHERE event='created'), x AS (SELECT id, closed_date, actual_return_pct FROM position_events WHERE event='closed')
       SELECT c.id, c.portfolio, c.ticker, c.created, CASE WHEN x.id IS NULL THEN 'open' ELSE 'closed' END AS status, x.closed_date, x.actual_return_pct FROM c LEFT JOIN x ON x.id=c.id""")
def position_state(t):
    return po.load_positions(dv.position_events(t))


_PX = f"px AS (SELECT ticker, arg_max(close,d) AS price FROM px_daily WHERE d<=DATE '{TODAY}' AND d>=DATE '{TODAY}' - INTERVAL 7 DAY GROUP BY 1)"


@query("position_closes", "H22", "id s,portfolio s,ticker s,actual_return_pct f,close_reason s",
       f"""WITH {_PX}, op AS (SELECT c.* FROM position_events c WHERE event='created' AND NOT EXISTS (SELECT 1 FROM position_events x WHERE x.event='closed' AND x.id=c.id)),
       h AS (SELECT op.id, op.portfolio, op.ticker, (px.price/t.avg_cost-1)*100 AS actual_return_pct, op.expected_horizon_days, op.created FROM op JOIN thesis_held t ON t.portfolio=op.portfolio AND t.ticker=op.ticker JOIN px ON px.ticker=op.ticker)
       SELECT h.id, h.portfolio, h.ticker, h.actual_return_pct, CASE WHEN date_diff('day',created,DATE '{TODAY}')>=h.expected_horizon_days THEN 'horizon' ELSE 'invalidated' END AS close_reason
       FROM h LEFT JOIN thesis_now n ON n.ticker=h.ticker WHERE date_diff('day',created,DATE '{TODAY}')>=h.expected_horizon_days OR n.confidence<0.6 OR n.direction<>'long'""")
def position_closes(t):
    state = po.load_positions(dv.position_events(t))
    held, prices = dv.thesis_held(t), latest_price(dv.px_daily(t), TODAY)
    profiles = po.strategies(dv.portfolios(t).withColumn("risk_profile", F.lit(None).cast("string")).withColumn("concentration", F.lit(None).cast("string")).withColumn("horizon", F.lit(None).cast("string")))
    return po.position_closes(state, held, prices, dv.thesis_now(t), profiles, TODAY)


@query("position_candidates", "H21 X1", "id s,portfolio s,ticker s,shares f,price f,entry_confidence f",
       f"""WITH RECURSIVE {_PX}, pr AS (SELECT portfolio, initial_cash/100 AS cash0, CASE WHEN length(portfolio)%2=0 THEN 0.5 ELSE 0.6 END AS cmin, CASE WHEN length(portfolio)%2=0 THEN 0.65 ELSE 0.75 END AS cfull FROM portfolios),
       hw AS (SELECT h.portfolio, SUM(h.shares*px.price) AS v, COUNT(*) AS n FROM thesis_held h LEFT JOIN px ON px.ticker=h.ticker GROUP BY 1),
       li AS (SELECT pr.portfolio, t.*, px.price, h.shares AS own, ROW_NUMBER() OVER (PARTITION BY pr.portfolio ORDER BY t.ticker) AS k FROM pr CROSS JOIN thesis_now t LEFT JOIN px ON px.ticker=t.ticker LEFT JOIN thesis_held h ON h.portfolio=pr.portfolio AND h.ticker=t.ticker),
       w AS (SELECT pr.portfolio, CAST(0 AS BIGINT) AS k, pr.cash0::DOUBLE AS cash, coalesce(hw.n,0)::BIGINT AS n, pr.cash0+coalesce(hw.v,0) AS val, pr.cmin, pr.cfull, NULL::VARCHAR AS ticker, 0.0::DOUBLE AS unit, 0.0::DOUBLE AS price, 0.0::DOUBLE AS confidence, false AS buy FROM pr LEFT JOIN hw ON hw.portfolio=pr.portfolio
         UNION ALL SELECT portfolio, k, CASE WHEN sell THEN cash+own*price WHEN buy THEN cash-unit ELSE cash END, CASE WHEN sell THEN n-1 WHEN buy THEN n+1 ELSE n END, val, cmin, cfull, ticker, unit, price, confidence, buy FROM (
           SELECT *, coalesce(own,0)=0 AND direction='long' AND expected_horizon_days BETWEEN 7 AND 730 AND pct IS NOT NULL AND n<12 AND unit>=50 AND price IS NOT NULL AS buy,
             coalesce(own,0)>0 AND (confidence<cmin OR direction<>'long') AND price IS NOT NULL AS sell FROM (
             SELECT *, least(val*pct, cash) AS unit FROM (SELECT w.portfolio, li.k, w.cash, w.n, w.val, w.cmin, w.cfull, li.ticker, li.price, li.confidence, li.direction, li.expected_horizon_days, li.own,
               CASE WHEN li.confidence>=w.cfull THEN 0.03 WHEN li.confidence>=w.cmin THEN 0.015 END AS pct FROM w JOIN li ON li.portfolio=w.portfolio AND li.k=w.k+1) a) b) c)
       SELECT substr(sha1(concat(portfolio,'|',ticker,'|{TODAY}')),1,16) AS id, portfolio, ticker, unit/price AS shares, price, confidence AS entry_confidence FROM w WHERE buy""")
def position_candidates(t):
    named = dv.portfolios(t).select(
        "portfolio", F.when(F.length("portfolio") % 2 == 0, "aggressive").alias("risk_profile"), F.lit("diversified").alias("concentration"), F.lit("any").alias("horizon")
    )
    cash = dv.portfolios(t).select("portfolio", (F.col("initial_cash") / 100).alias("cash"))
    return po.open_positions_on_theses(po.strategies(named), dv.thesis_now(t), stage(dv.thesis_held(t)), stage(latest_price(dv.px_daily(t), TODAY)), cash, TODAY)
