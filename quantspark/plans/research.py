"""Queries over articles, model responses, claims and theses."""

from pyspark.sql import functions as F

from quantspark.functions.dates import iso_week_key, is_monthly_day, is_weekly_day, month_end_label, month_key
from quantspark.functions.formats import compact_dollars, dollar_scale, factor_text
from quantspark.functions.text import known_ticker, split_transcript, stable_id, strip_html
from quantspark.operators import articles as ar
from quantspark.operators import claims as cl
from quantspark.operators import thesis as th
from quantspark.plans import derived as dv
from quantspark.plans.base import query
from quantspark.session import stage

AS_OF = "2024-07-01"

#: Tracked companies of the derived corpus: ticker -> display name.
UNIVERSE = {"thnt": "thnt", "OUR": "our eran", "ANEA": "anea", "ERB": "erble than", "ES": "estión", "NIC": "Nicht aulich"}
ADDED = {"THBLE": "thble thou", "ouai": "ouaiaux"}
VALID = [f"T{i}" for i in range(20)]

_WORD = r"[\p{L}\p{N}_]"
_NEEDLES = sorted({*UNIVERSE, *UNIVERSE.values()}, key=lambda n: (-len(n), n))
_MENTION = f"regexp_matches(lower(concat_ws(' ', title, text)), '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(n.lower() for n in _NEEDLES)})($|[^\\p{{L}}\\p{{N}}_])')"


@query("recent_articles", "F9 X21", "link s,source s,article_date d",
       f"SELECT link, source, coalesce(published, DATE '{AS_OF}') AS article_date FROM articles WHERE published IS NULL OR published >= CAST(DATE '{AS_OF}' - INTERVAL 6 MONTH AS DATE)")
def recent_articles(t):
    return ar.recent_articles(dv.articles(t), AS_OF).withColumn("article_date", ar.article_date(AS_OF))


@query("mentions", "F10", "link s", f"SELECT link FROM articles WHERE {_MENTION}")
def mentions(t):
    return ar.mentioning(dv.articles(t), UNIVERSE).select("link")


@query("article_order", "T6 U4", "link s,source_rank i",
       "SELECT link, CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END AS source_rank FROM articles")
def article_order(t):
    return ar.article_order(ar.concat_feeds(dv.articles(t)), ["src3", "src1"])


@query("thin_articles", "F13", "source s,n i", "SELECT source, COUNT(*) AS n FROM articles WHERE length(text)<500 AND source IN ('src1','src2','src3') GROUP BY 1")
def thin_articles(t):
    return dv.articles(t).filter(ar.needs_full_text(F.col("text"), F.col("source"), ["src1", "src2", "src3"])).groupBy("source").agg(F.count("*").alias("n"))


@query("html_text", "X2 E5", "page_id i,text s",
       r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(html,'<[^>]+>',' ','g'),'\s+',' ','g'),'&quot;','"'),'&copy;','©'),'&middot;','·'),'&amp;?','&','g')) AS text FROM pages""")
def html_text(t):
    return t.read("pages").select("page_id", strip_html(F.col("html")).alias("text"))


@query("backfill", "J15 J13 L10", "link s,ticker s",
       f"""WITH nt(ticker, name) AS (VALUES {', '.join(f"('{k}','{v}')" for k, v in ADDED.items())}
         UNION ALL SELECT upper(word), MAX(p_name) FROM (SELECT p_name, unnest(string_split(p_name,' ')) AS word FROM part) WHERE word<>'' GROUP BY 1), done AS (SELECT link FROM articles WHERE doc_id%9=0)
       SELECT a.link, nt.ticker FROM articles a, nt WHERE a.published >= DATE '{AS_OF}' - INTERVAL 90 DAY
         AND (contains(lower(concat(a.text,' ',a.title)), lower(nt.ticker)) OR contains(lower(concat(a.text,' ',a.title)), lower(nt.name)))
         AND NOT (nt.ticker='THBLE' AND a.link IN (SELECT link FROM done))""")
def backfill(t):
    rows = dv.articles(t).withColumnRenamed("published", "article_date")
    attempted = rows.filter("doc_id % 9 = 0").select("link", F.lit("THBLE").alias("ticker"))
    words = t.read("part").select("p_name", F.explode(F.split("p_name", " ")).alias("word")).filter("word <> ''")
    added = words.groupBy(F.upper("word").alias("ticker")).agg(F.max("p_name").alias("name"))
    added = added.unionByName(t.spark.createDataFrame(sorted(ADDED.items()), "ticker string, name string"))
    return ar.backfill_candidates(rows, added, attempted, AS_OF)


_VALID_SQL = ", ".join(f"'{v}'" for v in VALID)
_BLOB = r"v AS (SELECT * FROM (SELECT *, regexp_extract(raw,'(?s)\{.*\}') AS b FROM responses) WHERE b<>'' AND json_valid(b))"
_EVENTS = f"""WITH {_BLOB}, ev AS (SELECT link, ticker, source, as_of, doc_id, b, json_extract_string(b,'$.event') AS event,
      list_sort(list_distinct(list_filter(CAST(json_extract(b,'$.companies') AS VARCHAR[]), lambda x: list_contains([{_VALID_SQL}], x)))) AS companies,
      CASE WHEN json_extract_string(b,'$.event_type') IN ({', '.join(repr(e) for e in cl.EVENT_TYPES)}) THEN json_extract_string(b,'$.event_type') ELSE 'other' END AS event_type,
      coalesce(least(10,greatest(0,CAST(trunc(TRY_CAST(json_extract_string(b,'$.importance') AS DOUBLE)) AS INT))),0) AS importance,
      CASE WHEN json_extract_string(b,'$.time_horizon') IN ('days','weeks','months','quarters') THEN json_extract_string(b,'$.time_horizon') ELSE 'months' END AS time_horizon,
      CASE WHEN json_extract_string(b,'$.type') IN ('news','analysis') THEN json_extract_string(b,'$.type') ELSE 'news' END AS type,
      json_extract_string(b,'$.novel')='true' AS novel FROM v WHERE json_exists(b,'$.summary') AND json_exists(b,'$.companies'))"""


def _events(t):
    return cl.normalise_event(dv.responses(t), VALID)


@query("event_norm", "L2 X3 X10 X11 X16", "link s,event s,companies s,event_type s,importance i,time_horizon s,type s,novel b",
       _EVENTS + " SELECT *  REPLACE (array_to_string(companies,',') AS companies) FROM ev")
def event_norm(t):
    return _events(t).withColumn("companies", F.concat_ws(",", "companies"))


@query("article_gate", "F11", "link s,importance i", _EVENTS + " SELECT * FROM ev WHERE novel AND importance>=3 AND len(companies)>0")
def article_gate(t):
    return ar.event_gate(_events(t))


@query("new_pairs", "J13", "link s,ticker s",
       _EVENTS + " SELECT link, c AS ticker FROM (SELECT link, doc_id, unnest(companies) AS c FROM ev WHERE novel AND importance>=3) WHERE NOT (doc_id%3=0 AND c='T1')")
def new_pairs(t):
    attempted = dv.responses(t).filter("doc_id % 3 = 0").select("link", F.lit("T1").alias("ticker"))
    return ar.new_pairs(ar.event_gate(_events(t)).drop("ticker"), attempted)


@query("missing_summary", "F14", "source s,n i", _EVENTS + " SELECT source, COUNT(*) AS n FROM ev WHERE doc_id%2=0 GROUP BY 1")
def missing_summary(t):
    kept = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("summary"))
    archive = _events(t).withColumn("text", F.col("raw")).withColumn("event", F.struct(F.col("event").alias("event"), kept.alias("summary")))
    return ar.missing_summary(archive).groupBy("source").agg(F.count("*").alias("n"))


_ITEMS = f"""WITH {_BLOB}, it AS (SELECT link, ticker, source, as_of, doc_id, unnest(CAST(json_extract(b,'$.claims') AS JSON[])) AS j FROM v),
    ok AS (SELECT *, json_extract_string(j,'$.direction') IN ('long','short') AND (json_extract_string(j,'$.trade_worthy')<>'true' OR (json_exists(j,'$.expected_horizon_days') AND json_exists(j,'$.expected_return_pct'))) AS usable FROM it),
    cn AS (SELECT link, ticker, source, as_of, json_extract_string(j,'$.claim') AS claim, json_extract_string(j,'$.trade_worthy')='true' AS trade_worthy, json_extract_string(j,'$.direction') AS direction,
      least(1.0,greatest(0.0,CAST(json_extract_string(j,'$.confidence') AS DOUBLE))) AS confidence, least(10,greatest(0,CAST(json_extract_string(j,'$.importance') AS INT))) AS importance,
      coalesce(json_extract_string(j,'$.context'),'') AS context,
      CASE WHEN json_extract_string(j,'$.trade_worthy')='true' THEN least(730,greatest(7,CAST(json_extract_string(j,'$.expected_horizon_days') AS INT))) ELSE 0 END AS expected_horizon_days,
      CASE WHEN json_extract_string(j,'$.trade_worthy')='true' THEN CAST(json_extract_string(j,'$.expected_return_pct') AS DOUBLE) ELSE 0 END AS expected_return_pct FROM ok WHERE usable),
    bc AS (SELECT substr(sha1(concat(ticker,'|',link,'|',claim)),1,16) AS id, link AS source_link, as_of AS created, * FROM cn)"""


@query("claims_norm", "L3", "link s,ticker s,claim s,trade_worthy b,direction s,confidence f,importance i,context s,expected_horizon_days i,expected_return_pct f", _ITEMS + " SELECT * FROM cn")
def claims_norm(t):
    return cl.normalise_claims(dv.responses(t))


@query("claim_yield", "L3 A15", "source s,kept i,dropped i", _ITEMS + " SELECT source, COUNT(*) FILTER (usable) AS kept, COUNT(*) FILTER (NOT usable) AS dropped FROM ok GROUP BY 1")
def claim_yield(t):
    return cl.claim_yield(dv.responses(t))


def _claims(t):
    responses = dv.responses(t)
    side = dv.articles(t).select("link", "title", F.lit("earnings").alias("event_type"), "source").join(
        responses.select("link", F.col("as_of").alias("article_date")), "link")
    return cl.build_claims(cl.normalise_claims(responses), side)


@query("claim_records", "L4 X1 J16", "id s,ticker s,source_link s,created d,claim s,source s", _ITEMS + " SELECT * FROM bc")
def claim_records(t):
    return _claims(t)


@query("claim_counts", "A15", "source s,ticker s,claims i,long_claims i,short_claims i,trade_worthy_claims i",
       _ITEMS + " SELECT source, ticker, COUNT(*) AS claims, COUNT(*) FILTER (direction='long') AS long_claims, COUNT(*) FILTER (direction='short') AS short_claims, COUNT(*) FILTER (trade_worthy) AS trade_worthy_claims FROM bc GROUP BY 1,2")
def claim_counts(t):
    return cl.claim_counts(_claims(t))


_THESES = _ITEMS + """, te AS (SELECT ticker, 0.5+(COUNT(*)%5)/10.0 AS confidence, CAST(7+COUNT(*)%50 AS INT) AS expected_horizon_days FROM responses GROUP BY 1),
    e AS (SELECT ticker, COUNT(DISTINCT source_link) AS sources, COUNT(*) AS claims_considered, MAX(created) AS newest FROM bc GROUP BY 1),
    f AS (SELECT te.*, e.sources, e.claims_considered, date_diff('day', e.newest, DATE '2024-08-01') AS age_days FROM te JOIN e ON e.ticker=te.ticker),
    fl AS (SELECT *, (CASE WHEN sources=1 THEN 0.9 ELSE 1 END)*(CASE WHEN confidence>=0.75 AND claims_considered<3 THEN 0.85 ELSE 1 END)*(CASE WHEN age_days>expected_horizon_days THEN 0.85 ELSE 1 END) AS deterministic_multiplier,
      concat_ws(';', CASE WHEN sources=1 THEN 'one article is the only evidence' END,
        CASE WHEN confidence>=0.75 AND claims_considered<3 THEN concat(CAST(claims_considered AS VARCHAR),' claims are thin evidence for ',printf('%.0f',confidence*100),'% confidence') END,
        CASE WHEN age_days>expected_horizon_days THEN concat('no claim in ',CAST(age_days AS VARCHAR),' days, horizon is ',CAST(expected_horizon_days AS VARCHAR),' days') END) AS flags FROM f)"""


def _theses(t):
    n = F.count("*")
    return dv.responses(t).groupBy("ticker").agg((0.5 + (n % 5) / 10.0).alias("confidence"), (7 + n % 50).cast("int").alias("expected_horizon_days"))


@query("critic_flags", "A16 T5", "ticker s,sources i,claims_considered i,age_days i,deterministic_multiplier f,flags s", _THESES + " SELECT * FROM fl")
def critic_flags(t):
    return th.critic_flags(_theses(t), _claims(t), "2024-08-01").withColumn("flags", F.concat_ws(";", "deterministic_flags"))


@query("final_confidence", "L7", "ticker s,pre_critic_confidence f,critic_multiplier f,confidence f",
       _THESES + """ SELECT ticker, confidence AS pre_critic_confidence, deterministic_multiplier*m AS critic_multiplier, greatest(0,least(1,confidence*deterministic_multiplier*m)) AS confidence
       FROM (SELECT *, CASE WHEN claims_considered%2=0 THEN 0.8 ELSE 1 END AS m FROM fl)""")
def final_confidence(t):
    flagged = stage(th.critic_flags(_theses(t), _claims(t), "2024-08-01"))
    reviews = flagged.filter("claims_considered % 2 = 0").select("ticker", F.lit(0.8).alias("multiplier"), F.array(F.lit("c")).alias("concerns"))
    return th.final_confidence(flagged, reviews)


@query("claim_inputs", "L11", "ticker s,position i,id s,created d,claim s,importance i",
       _ITEMS + " SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY created, id) AS position FROM bc")
def claim_inputs(t):
    return th.claim_inputs(_claims(t))


@query("newest_claims", "T5", "ticker s,id s,created d", _ITEMS + " SELECT * FROM bc QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY created DESC, id)<=10")
def newest_claims(t):
    return th.latest_claims(_claims(t), 10)


_LOG2 = "WITH l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date DESC, seq DESC) AS n FROM thesis_log WHERE event='aggregated')"


@query("new_claims_delta", "W28", "ticker s,new_claims i", _LOG2 + " SELECT a.ticker, a.claims_considered-coalesce(b.claims_considered,0) AS new_claims FROM l a LEFT JOIN l b ON b.ticker=a.ticker AND b.n=2 WHERE a.n=1")
def new_claims_delta(t):
    return th.new_claims_delta(dv.thesis_log(t))


@query("thesis_changes", "W28 T9", "ticker s,before_confidence f,after_confidence f", _LOG2 + " SELECT a.ticker, b.confidence AS before_confidence, a.confidence AS after_confidence FROM l a LEFT JOIN l b ON b.ticker=a.ticker AND b.n=2 WHERE a.n=1")
def thesis_changes(t):
    return th.thesis_changes(dv.thesis_log(t))


@query("latest_theses", "W16 T9", "ticker s,date d,seq i,confidence f", _LOG2 + " SELECT * FROM l WHERE n=1")
def latest_theses(t):
    return th.latest_theses(dv.thesis_log(t))


@query("currently_holding", "J18", "ticker s,holding b,created d",
       _LOG2 + """, op AS (SELECT ticker, MAX(created) AS created FROM position_events c WHERE event='created' AND portfolio='BUILDING' AND NOT EXISTS (SELECT 1 FROM position_events x WHERE x.event='closed' AND x.id=c.id) GROUP BY 1)
       SELECT l.ticker, op.created IS NOT NULL AS holding, op.created FROM l LEFT JOIN op ON op.ticker=l.ticker WHERE n=1""")
def currently_holding(t):
    from quantspark.operators.positions import load_positions

    held = load_positions(dv.position_events(t)).filter("status = 'open'")
    newest = th.latest_per_key(held, ["portfolio", "ticker"], ["created", "id"])
    return th.currently_holding(th.latest_theses(dv.thesis_log(t)), newest, "BUILDING")


@query("aggregation_retry", "L8", "ticker s,consecutive_failures i,last_attempt d,retry b",
       """WITH a AS (SELECT ticker, date, seq, confidence>0.7 AS ok FROM thesis_log), s AS (SELECT ticker, MAX((date, seq)) AS k FROM a WHERE ok GROUP BY 1)
       SELECT a.ticker, COUNT(*) AS consecutive_failures, MAX(a.date) AS last_attempt, COUNT(*)<3 AS retry FROM a LEFT JOIN s ON s.ticker=a.ticker WHERE NOT a.ok AND (s.k IS NULL OR (a.date, a.seq)>s.k) GROUP BY 1""")
def aggregation_retry(t):
    return th.aggregation_retry(dv.thesis_log(t).select("ticker", "date", "seq", (F.col("confidence") > 0.7).alias("ok")))


@query("orphan_claims", "J14", "ticker s", _ITEMS + " SELECT DISTINCT ticker FROM bc WHERE ticker NOT IN (SELECT ticker FROM responses WHERE doc_id%31=0) AND ticker NOT IN ('T3','T4')")
def orphan_claims(t):
    from quantspark.operators.articles import orphan_claims as orphans

    theses = dv.responses(t).filter("doc_id % 31 = 0").select("ticker")
    attempts = t.spark.createDataFrame([("T3", 3), ("T4", 5), ("T5", 2)], "ticker string, consecutive_failures int")
    return orphans(_claims(t), theses, attempts)


@query("earnings_refresh_due", "L9 X8", "ticker s,earnings_date d",
       "SELECT ticker, MIN(earnings_date) AS earnings_date FROM earnings WHERE DATE '1998-07-31' BETWEEN earnings_date - INTERVAL 1 DAY AND earnings_date + INTERVAL 1 DAY AND NOT (ticker LIKE 'Brand#1%' AND earnings_date=DATE '1998-07-31') GROUP BY 1")
def earnings_refresh_due(t):
    reports = dv.earnings(t)
    on_day = F.to_date("earnings_date") == F.lit("1998-07-31").cast("date")
    done = reports.filter(F.col("ticker").like("Brand#1%") & on_day).select("ticker", F.to_date("earnings_date").alias("earnings_date"))
    return th.earnings_refresh_due(reports, done, "1998-07-31")


_SLUG = "concat('<a href=\"/earnings/call-transcripts/2024/', lpad(CAST(1+length(html)%12 AS VARCHAR),2,'0'), '/', lpad(CAST(1+length(url)%28 AS VARCHAR),2,'0'), '/acme-corp-t', CAST(length(html)%40 AS VARCHAR), '-q', CAST(1+length(html)%4 AS VARCHAR), '-2024-earnings-call-', CAST(page_id AS VARCHAR), '/\">x</a>')"


@query("transcript_index", "S25 X5", "ticker s,transcript_date d,path s",
       f"""WITH p AS (SELECT length(html) AS h, length(url) AS u, {_SLUG} AS link FROM pages),
       r AS (SELECT concat('t',CAST(h%40 AS VARCHAR)) AS ticker, make_date(2024, CAST(1+h%12 AS INT), CAST(1+u%28 AS INT)) AS transcript_date, regexp_extract(link,'href="([^"]+)"',1) AS path FROM p)
       SELECT ticker, MAX(transcript_date) AS transcript_date, arg_max(path, (transcript_date, path)) AS path FROM r GROUP BY 1""")
def transcript_index(t):
    k, h, u = F.col("page_id"), F.length("html"), F.length("url")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    link = F.concat(
        F.lit('<a href="/earnings/call-transcripts/2024/'), two(1 + h % 12), F.lit("/"), two(1 + u % 28), F.lit("/acme-corp-t"), (h % 40).cast("string"),
        F.lit("-q"), (1 + h % 4).cast("string"), F.lit("-2024-earnings-call-"), k.cast("string"), F.lit('/">x</a>'),
    )
    return ar.transcript_index(t.read("pages").select(F.concat("html", link).alias("html")))


@query("split_transcript", "X4", "conv_id i,turn i,prepared i,qa i",
       """WITH c AS (SELECT conv_id, turn, CASE turn%3 WHEN 0 THEN concat(text,' We Open the call for Questions now. ',text,' first question comes from x') WHEN 1 THEN concat(text,' our FIRST question comes from y') ELSE text END AS x FROM conversations),
       p AS (SELECT *, list_min(list_filter([instr(lower(x),'open the call for questions'), instr(lower(x),'open the call up for questions'), instr(lower(x),'open the call to questions'), instr(lower(x),'opens the call for questions'), instr(lower(x),'first question comes from')], lambda v: v>0)) AS cut FROM c)
       SELECT conv_id, turn, CASE WHEN cut IS NULL THEN length(x) ELSE cut-1 END AS prepared, CASE WHEN cut IS NULL THEN 0 ELSE length(x)-cut+1 END AS qa FROM p""")
def split_transcript_lengths(t):
    text = (
        F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" We Open the call for Questions now. "), "text", F.lit(" first question comes from x")))
        .when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" our FIRST question comes from y")))
        .otherwise(F.col("text"))
    )
    rows = t.read("conversations").withColumn("_s", split_transcript(text))
    return rows.select("conv_id", "turn", F.length("_s.prepared").alias("prepared"), F.length("_s.qa").alias("qa"))


@query("date_keys", "X6 X9 F16", "d d,iso_week s,month_key s,quarter_end d,weekly b,monthly b",
       """SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, concat(CAST(isoyear(o_orderdate) AS VARCHAR),'-W',lpad(CAST(week(o_orderdate) AS VARCHAR),2,'0')) AS iso_week, strftime(o_orderdate,'%Y-%m') AS month_key,
       last_day(CAST(date_trunc('quarter',o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS quarter_end, isodow(o_orderdate)=6 AS weekly, CAST(o_orderdate AS DATE)=last_day(CAST(o_orderdate AS DATE)) AS monthly FROM orders""")
def date_keys(t):
    d = F.col("d")
    return t.read("orders").select(F.to_date("o_orderdate").alias("d")).distinct().select(
        "d", iso_week_key(d).alias("iso_week"), month_key(d).alias("month_key"), month_end_label(d, "QE").alias("quarter_end"),
        is_weekly_day(d).alias("weekly"), is_monthly_day(d).alias("monthly"))


@query("dollar_texts", "X12 A22", "ticker s,amount s,scale s",
       """WITH n AS (SELECT ticker, SUM(CASE WHEN transaction LIKE 'Purchase%' THEN value WHEN transaction LIKE 'Sale%' THEN -value END) AS v FROM insider GROUP BY 1)
       SELECT ticker, concat(CASE WHEN v<0 THEN '-' ELSE '' END, CASE WHEN abs(v)>=1e9 THEN printf('$%.2fB',abs(v)/1e9) WHEN abs(v)>=1e6 THEN printf('$%.1fM',abs(v)/1e6) WHEN abs(v)>=1e3 THEN printf('$%.1fK',abs(v)/1e3) ELSE printf('$%.0f',abs(v)) END) AS amount,
       CASE WHEN abs(v)>=1e9 THEN '$ billions' WHEN abs(v)>=1e6 THEN '$ millions' WHEN abs(v)>=1e3 THEN '$ thousands' ELSE '$' END AS scale FROM n""")
def dollar_texts(t):
    from quantspark.operators.pit import insider_summary

    rows = insider_summary(dv.insider(t))
    return rows.select("ticker", compact_dollars(F.col("net_value")).alias("amount"), dollar_scale(F.abs("net_value"))["label"].alias("scale"))


@query("factor_texts", "X12", "ticker s,growth s,pe s,margin s",
       "SELECT ticker, printf('%+.1f%%', revenueGrowth*100) AS growth, printf('%.1fx', forwardPE) AS pe, printf('%+.1f%%', operatingMargins*100) AS margin FROM stock_info")
def factor_texts(t):
    from quantspark.operators.ranking import info_factors

    rows = info_factors(dv.stock_info(t))
    return rows.select("ticker", *[factor_text(F.lit(f), F.col(f)).alias(a) for f, a in (("revenue_growth", "growth"), ("forward_pe", "pe"), ("operating_margin", "margin"))])


@query("filing_tickers", "X20", "ticker s,n i", "SELECT CASE WHEN doc_id%2=0 THEN substr(source,4) END AS ticker, COUNT(*) AS n FROM documents GROUP BY 1")
def filing_tickers(t):
    tagged = t.read("documents").select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("SEC 8-K: "), F.substr("source", F.lit(4)))).otherwise(F.col("source")).alias("source"))
    return tagged.select(known_ticker(F.col("source")).alias("ticker")).groupBy("ticker").agg(F.count("*").alias("n"))


@query("card_ids", "X1", "c_custkey i,id s", "SELECT c_custkey, substr(sha1(concat(c_name,'|',c_mktsegment,'|',CAST(c_nationkey AS VARCHAR))),1,16) AS id FROM customer")
def card_ids(t):
    return t.read("customer").select("c_custkey", stable_id(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("id"))
