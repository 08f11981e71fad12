"""Queries over response normalisers, thesis events, transcripts and ticker sets."""

from pyspark.sql import functions as F

from quantspark.operators import articles as ar
from quantspark.operators import cards as cd
from quantspark.operators import claims as cl
from quantspark.operators import events as ev
from quantspark.operators import panel as pn
from quantspark.operators import ranking as rk
from quantspark.operators import thesis as th
from quantspark.operators import timeseries as ts
from quantspark.plans import derived as dv
from quantspark.plans.base import query
from quantspark.plans.research import _EVENTS, _THESES, _claims, _theses
from quantspark.session import stage


@query("article_text", "L1", "link s,text s", "SELECT link, CASE WHEN source IN ('src1','src2') AND doc_id%3<>0 THEN md5(text) ELSE concat(CAST(doc_id AS VARCHAR),' ',source) END AS text FROM articles")
def article_text(t):
    rows = dv.articles(t)
    content = F.concat(F.lit("<p>"), F.col("doc_id").cast("string"), F.lit("</p>\n<b>"), "source", F.lit("</b>"))
    landed = rows.filter("doc_id % 3 <> 0").select("link", F.md5("text").alias("text"))
    plain = rows.select("link", "source", F.when(F.col("doc_id") % 2 == 0, content).otherwise("").alias("content"), content.alias("summary"))
    return ar.article_text(plain, ["src1", "src2"], landed)


@query("known_company_events", "L2", "link s,event s,companies s,event_type s,importance i,time_horizon s,type s,novel b",
       _EVENTS.replace(" WHERE json_exists(b,'$.summary') AND json_exists(b,'$.companies')", "") + " SELECT * REPLACE (ticker AS companies, 'news' AS type) FROM ev")
def known_company_events(t):
    return cl.normalise_known_company_event(dv.responses(t)).withColumn("companies", F.concat_ws(",", "companies"))


def _replies(t, body):
    """One response per document; ``body`` makes the JSON text from the id column."""
    k = F.col("doc_id")
    return t.read("documents").select("doc_id", F.concat(F.lit("reply: "), body(k)).alias("raw"))


def _case(*pairs, other):
    out = None
    for cond, value in pairs:
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(other))


@query("thesis_replies", "L5 X10", "doc_id i,direction s,confidence f,expected_return_pct f,expected_horizon_days i,n i",
       """SELECT doc_id, CASE WHEN doc_id%2=0 THEN 'short' ELSE 'long' END AS direction, CASE WHEN doc_id%5=0 THEN 1.0 ELSE 0.4 END AS confidence, 2.5 AS expected_return_pct,
       CASE WHEN doc_id%13=0 THEN 7 ELSE 90 END AS expected_horizon_days, 2 AS n FROM documents WHERE doc_id%4<>0 AND doc_id%7<>0 AND doc_id%11<>0 AND doc_id%17<>0""")
def thesis_replies(t):
    body = lambda k: F.concat(
        F.lit('{"thesis": "t", "direction": "'), _case((k % 4 == 0, "up"), (k % 2 == 0, "short"), other="long"), F.lit('", "confidence": '), _case((k % 7 == 0, '"n/a"'), (k % 5 == 0, "1.7"), other="0.4"),
        _case((k % 17 == 0, ""), other=', "expected_return_pct": 2.5'), F.lit(', "expected_horizon_days": '), _case((k % 11 == 0, '"soon"'), (k % 13 == 0, "3"), other="90"),
        F.lit(', "catalysts": ["a", "b"], "invalidation": [], "reasoning": "r"}'))
    return cl.normalise_thesis(_replies(t, body)).withColumn("n", F.size("catalysts"))


@query("critic_replies", "L6", "doc_id i,multiplier f,n i",
       "SELECT doc_id, CASE WHEN doc_id%4=0 THEN 0.7 WHEN doc_id%3=0 THEN 1.0 ELSE 0.9 END AS multiplier, 1 AS n FROM documents WHERE doc_id%6<>0 AND doc_id%5<>0")
def critic_replies(t):
    body = lambda k: F.concat(F.lit('{"multiplier": '), _case((k % 6 == 0, '"high"'), (k % 5 == 0, "null"), (k % 4 == 0, "0.2"), (k % 3 == 0, '"1.3"'), other="0.9"), F.lit(', "concerns": ["c"], "reasoning": "r"}'))
    return cl.normalise_critic(_replies(t, body)).withColumn("n", F.size("concerns"))


@query("fundamental_replies", "L6", "doc_id i,fundamental_direction s,fundamental_confidence f,summary s",
       "SELECT doc_id, CASE WHEN doc_id%4=0 THEN 'neutral' ELSE 'long' END AS fundamental_direction, CASE WHEN doc_id%3=0 THEN 0.0 ELSE 0.8 END AS fundamental_confidence, 's' AS summary FROM documents WHERE doc_id%5<>0")
def fundamental_replies(t):
    body = lambda k: F.concat(
        F.lit('{"fundamental_direction": "'), _case((k % 4 == 0, "sideways"), other="long"), F.lit('", "fundamental_confidence": '), _case((k % 5 == 0, '"?"'), (k % 3 == 0, "-2"), other="0.8"),
        F.lit(', "summary": "s", "key_changes": [], "risks": ["r"], "reasoning": "x"}'))
    return cl.normalise_fundamental(_replies(t, body))


@query("call_replies", "L6", "doc_id i,earnings_direction s,earnings_confidence f,management_tone s",
       "SELECT doc_id, CASE WHEN doc_id%4=0 THEN 'neutral' ELSE 'short' END AS earnings_direction, 0.6 AS earnings_confidence, CASE WHEN doc_id%3=0 THEN 'cautious' ELSE 'evasive' END AS management_tone FROM documents WHERE doc_id%5<>0 AND doc_id%7<>0")
def call_replies(t):
    body = lambda k: F.concat(
        F.lit('{"earnings_direction": "'), _case((k % 4 == 0, "flat"), other="short"), F.lit('", "earnings_confidence": '), _case((k % 5 == 0, "null"), other="0.6"), F.lit(', "guidance_summary": "g", "guidance_change": "raised"'),
        _case((k % 7 == 0, ""), other=', "key_qa_moments": []'), F.lit(', "management_tone": "'), _case((k % 3 == 0, "loud"), other="evasive"), F.lit('", "risks": [], "summary": "s"}'))
    return cl.normalise_earnings_call(_replies(t, body))


@query("macro_replies", "L6", "doc_id i,has_clear_driver b,direction s,confidence s,trade_worthy b",
       """SELECT doc_id, doc_id%3<>2 AS has_clear_driver, CASE WHEN doc_id%4=0 THEN 'neutral' ELSE 'bullish' END AS direction, CASE WHEN doc_id%5=0 THEN 'low' ELSE 'high' END AS confidence,
       doc_id%6 IN (2,3,5) AS trade_worthy FROM documents WHERE doc_id%7<>0""")
def macro_replies(t):
    body = lambda k: F.concat(
        _case((k % 7 == 0, '{"story": "n"'), other='{"narrative": "n"'), F.lit(', "has_clear_driver": '), _case((k % 3 == 0, "true"), (k % 3 == 1, '"false"'), other="0"), F.lit(', "direction": "'),
        _case((k % 4 == 0, "sideways"), other="bullish"), F.lit('", "confidence": "'), _case((k % 5 == 0, "sure"), other="high"), F.lit('", "trade_worthy": '),
        _case((k % 6 == 0, '""'), (k % 6 == 1, "null"), (k % 6 == 2, "[1]"), (k % 6 == 3, "2.5"), (k % 6 == 4, "{}"), other="true"), F.lit("}"))
    return cl.normalise_macro(_replies(t, body))


@query("thesis_event_rows", "L7 W16", "ticker s,event s,date d,confidence f,pre_critic_confidence f,critic_multiplier f,claims_considered i,flags s",
       _THESES + """, fin AS (SELECT ticker, claims_considered, flags, confidence AS pre, deterministic_multiplier*m AS mult, greatest(0,least(1,confidence*deterministic_multiplier*m)) AS conf
         FROM (SELECT *, CASE WHEN claims_considered%2=0 THEN 0.8 ELSE 1 END AS m FROM fl))
       SELECT ticker, 'aggregated' AS event, DATE '2024-08-01' AS date, conf AS confidence, pre AS pre_critic_confidence, mult AS critic_multiplier, claims_considered, NULL AS flags FROM fin
       UNION ALL SELECT ticker, 'critic', DATE '2024-08-01', conf, pre, mult, NULL, flags FROM fin""")
def thesis_event_rows(t):
    none = F.array().cast("array<string>")
    theses = _theses(t).withColumns({"thesis": F.lit("t"), "direction": F.lit("long"), "expected_return_pct": F.lit(1.0), "catalysts": none, "invalidation": none})
    flagged = stage(th.critic_flags(theses, _claims(t), "2024-08-01"))
    reviews = flagged.filter("claims_considered % 2 = 0").select("ticker", F.lit(0.8).alias("multiplier"), F.array(F.lit("c")).alias("concerns"))
    events = th.thesis_events(th.final_confidence(flagged, reviews), "2024-08-01")
    return events.withColumn("flags", F.when(F.col("event") == "critic", F.concat_ws(";", "deterministic_flags")))


@query("new_transcripts", "L12", "ticker s,path s", "SELECT p_brand AS ticker, MAX(p_name) AS path FROM part GROUP BY 1 HAVING p_brand NOT LIKE '%1%'")
def new_transcripts(t):
    index = stage(t.read("part").groupBy(F.col("p_brand").alias("ticker")).agg(F.max("p_name").alias("path")))
    older = index.filter("ticker NOT LIKE '%2%'").select("ticker", F.lit("x").alias("transcript_url"), F.lit("2024-01-01").cast("date").alias("date"), F.lit(0).alias("seq"))
    latest = index.filter("ticker LIKE '%1%'").select("ticker", F.col("path").alias("transcript_url"), F.lit("2024-01-01").cast("date").alias("date"), F.lit(1).alias("seq"))
    return ar.new_transcripts(index, older.union(latest))


@query("panel_grid", "J22", "ticker s,date d", "SELECT a.ticker, b.d AS date FROM (SELECT DISTINCT ticker FROM px_monthly) a, (SELECT DISTINCT d FROM px_monthly) b")
def panel_grid(t):
    bars = stage(dv.px_monthly(t).select("ticker", "d"))
    return pn.panel_grid(bars, bars.select(F.col("d").alias("date")).distinct())


@query("thesis_snapshots", "J23", "ticker s,seq i,fundamental_direction s,fundamental_confidence f,earnings_confidence f",
       """WITH l AS (SELECT * FROM thesis_log WHERE event='aggregated' QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date DESC, seq DESC)=1),
       f AS (SELECT ticker, arg_max(claims_considered, (date, seq)) AS c, arg_max(confidence, (date, seq)) AS v FROM thesis_log WHERE seq%3=0 GROUP BY 1),
       c AS (SELECT ticker, arg_max(confidence, (date, seq)) AS v FROM thesis_log WHERE event='critic' AND ticker LIKE '%1%' GROUP BY 1)
       SELECT l.ticker, l.seq, CAST(f.c AS VARCHAR) AS fundamental_direction, f.v AS fundamental_confidence, c.v AS earnings_confidence FROM l LEFT JOIN f ON f.ticker=l.ticker LEFT JOIN c ON c.ticker=l.ticker""")
def thesis_snapshots(t):
    log = dv.thesis_log(t)
    fundamentals = log.filter("seq % 3 = 0").select("ticker", "date", "seq", F.col("claims_considered").cast("string").alias("fundamental_direction"), F.col("confidence").alias("fundamental_confidence"))
    calls = log.filter("event = 'critic' AND ticker LIKE '%1%'").select("ticker", "date", "seq", F.lit("long").alias("earnings_direction"), F.col("confidence").alias("earnings_confidence"))
    return th.with_snapshots(th.latest_theses(log), fundamentals, calls)


@query("ticker_sets", "F3 U1 U2 U3", "kind s,ticker s",
       """WITH have AS (SELECT DISTINCT p_brand AS ticker FROM part JOIN lineitem ON l_partkey=p_partkey WHERE p_size>25), want AS (SELECT DISTINCT p_brand AS ticker FROM part UNION SELECT concat('Gone',CAST(n_nationkey AS VARCHAR)) FROM nation)
       SELECT 'missing' AS kind, ticker FROM want WHERE ticker NOT IN (SELECT ticker FROM have) UNION ALL SELECT 'kept', ticker FROM want WHERE ticker IN (SELECT ticker FROM have)
       UNION ALL SELECT 'panel', ticker FROM want WHERE ticker IN (SELECT ticker FROM have) UNION ALL SELECT 'picked', upper(ticker) FROM want UNION ALL SELECT 'picked', x FROM (VALUES ('SPY'),('NEW')) v(x)""")
def ticker_sets(t):
    part = t.read("part").select("p_partkey", "p_size", F.col("p_brand").alias("ticker"))
    bars = stage(part.filter("p_size > 25").join(t.read("lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey").select("ticker", F.lit(1.0).alias("close")).distinct())
    want = part.select("ticker").union(t.read("nation").select(F.concat(F.lit("Gone"), F.col("n_nationkey").cast("string"))))
    sets = {"missing": ts.missing_tickers(want, bars), "kept": ts.drop_empty_tickers(want, bars), "panel": ts.panel_intersect(want, bars), "picked": ts.pick_union(want, " new , ,spy", "SPY")}
    out = None
    for kind, df in sets.items():
        df = df.select(F.lit(kind).alias("kind"), "ticker")
        out = df if out is None else out.union(df)
    return out


@query("display_names", "U8", "ticker s,name s,n i",
       "SELECT p_brand AS ticker, CASE WHEN p_brand LIKE '%3%' THEN p_brand ELSE MIN(p_name) END AS name, CASE WHEN p_brand LIKE '%3%' THEN 1 ELSE 2 END AS n FROM part GROUP BY 1")
def display_names(t):
    name = F.when(F.col("ticker").like("%3%"), F.col("ticker")).otherwise(F.col("name"))
    universe = t.read("part").groupBy(F.col("p_brand").alias("ticker")).agg(F.min("p_name").alias("name")).select("ticker", name.alias("name"))
    pairs = stage(cd.name_pairs(universe))
    return cd.display_names(pairs).join(pairs.groupBy("ticker").agg(F.count("*").alias("n")), "ticker")


@query("headline_factors", "X13", "ticker s,d d,value f", "SELECT ticker, d, CASE WHEN month(d)%2=0 THEN close ELSE open END AS value FROM px_monthly")
def headline_factors(t):
    category, preferred = next(iter(rk.HEADLINE_FACTOR.items()))
    inner = F.when(F.month("d") % 2 == 0, F.create_map(F.lit("another"), F.col("open"), F.lit(preferred), F.col("close"))).otherwise(F.create_map(F.lit("another"), F.col("open")))
    return dv.px_monthly(t).select("ticker", "d", rk.headline_factor(category, F.create_map(F.lit(category), inner)).alias("value"))


@query("surprises", "X15", "ticker s,earnings_date d,surprise_pct f", "SELECT ticker, earnings_date, surprise_pct FROM earnings")
def surprises(t):
    return dv.earnings(t).select("ticker", "earnings_date", ev.surprise_pct(F.col("reported_eps"), F.col("eps_estimate")).alias("surprise_pct"))
