"""Queries over macro series, narratives, card feeds and marks."""

from pyspark.sql import functions as F

from quantspark.operators import cards as cd
from quantspark.operators import macro as mc
from quantspark.plans import derived as dv
from quantspark.plans.base import query
from quantspark.plans.research import _ITEMS, _claims
from quantspark.session import stage

# key, order, label, cadence, unit, transform, delta format, chart days, longer chart days
SERIES = [
    ("click", 0, "Clicks", "weekly", "num", "level", "points", 7, 30), ("view", 1, "Views", "weekly", "usd", "level", "pct_change", 7, 30),
    ("purchase", 2, "Purchases", "monthly", "pct", "yoy_pct", "pp", 365, None), ("error", 3, "Errors", "monthly", "pct", "level", "pp", 10, None),
    ("signup", 4, "Signups", "weekly", "usd", "level", "bps", 14, 20),
]
_CFG = "cfg(key, ord, label, cadence, unit, transform, delta_format, chart_days, extra_days) AS (VALUES " + ", ".join(
    f"('{a}',{b},'{c}','{d}','{e}','{f}','{g}',{h},{'NULL::INT' if i is None else i})" for a, b, c, d, e, f, g, h, i in SERIES) + ")"
_TILES = f"""WITH {_CFG}, raw AS (SELECT m.*, c.* EXCLUDE (key) FROM macro m JOIN cfg c ON c.key=m.key),
    yy AS (SELECT * REPLACE (CASE WHEN transform='yoy_pct' THEN (value/LAG(value,12) OVER (PARTITION BY key ORDER BY d)-1)*100 ELSE value END AS value) FROM raw),
    lv AS (SELECT *, MAX(d) OVER (PARTITION BY key) AS last_d, ROW_NUMBER() OVER (PARTITION BY key ORDER BY d DESC) AS n FROM yy WHERE value IS NOT NULL),
    ag AS (SELECT key, label, ord, cadence, delta_format, MAX(last_d) AS as_of, MAX(value) FILTER (n=1) AS value,
      CASE WHEN cadence='weekly' THEN arg_max(value,d) FILTER (d<=last_d - INTERVAL 7 DAY) ELSE MAX(value) FILTER (n=2) END AS prior,
      COUNT(*) FILTER (d>last_d - chart_days) AS n_history, COUNT(*) FILTER (d>last_d - extra_days) AS n_extra,
      arg_min(value,d) FILTER (d>last_d - extra_days) AS w0 FROM lv GROUP BY 1,2,3,4,5),
    ti AS (SELECT *, CASE WHEN delta_format='pct_change' AND prior<>0 THEN (value/prior-1)*100 ELSE value-prior END AS delta FROM ag)"""


def _tiles(t):
    return mc.macro_tiles(dv.macro(t), t.spark.createDataFrame(SERIES, mc.SERIES_CONFIG))


@query("macro_tiles", "W21 W20 W22 W23", "key s,label s,as_of d,value f,delta f,n_history i,n_extra i,section i",
       _TILES + " SELECT *, CASE WHEN cadence='weekly' THEN 1 ELSE 2 END AS section FROM ti")
def macro_tiles(t):
    return mc.macro_sections(_tiles(t)).withColumn("n_history", F.size("history")).withColumn("n_extra", F.size("history_extra"))


@query("macro_window", "W22", "key s,window_value f,window_delta f",
       _TILES + " SELECT key, CASE WHEN n_extra>0 THEN value END AS window_value, CASE WHEN n_extra>1 THEN CASE WHEN delta_format='pct_change' AND w0<>0 THEN (value/w0-1)*100 ELSE value-w0 END END AS window_delta FROM ti")
def macro_window(t):
    return mc.delta_over_window(_tiles(t))


@query("diverse_headlines", "W29", "ord i,domain s",
       "SELECT ord, domain FROM (SELECT * FROM headlines QUALIFY ROW_NUMBER() OVER (PARTITION BY domain ORDER BY ord)<=2) ORDER BY ord LIMIT 25")
def diverse_headlines(t):
    return mc.diverse_headlines(dv.headlines(t))


_BUCKET = "CASE WHEN p='week' THEN concat(CAST(isoyear(date) AS VARCHAR),'-W',lpad(CAST(week(date) AS VARCHAR),2,'0')) ELSE strftime(date,'%Y-%m') END"


@query("narrative_upsert", "K3 X6", "series_key s,period s,bucket s,date d,seq i,value f",
       f"""WITH n AS (SELECT *, coalesce(period,'week') AS p FROM narratives), b AS (SELECT *, {_BUCKET} AS bucket FROM n),
       l AS (SELECT *, LEAD(bucket) OVER (PARTITION BY series_key, p ORDER BY seq) AS nx FROM b) SELECT series_key, p AS period, bucket, date, seq, value FROM l WHERE nx IS DISTINCT FROM bucket""")
def narrative_upsert(t):
    return mc.upsert_bucketed(dv.narratives(t))


@query("latest_narrative", "W16", "series_key s,period s,date d,seq i,value f",
       "SELECT series_key, coalesce(period,'week') AS period, date, seq, value FROM narratives QUALIFY ROW_NUMBER() OVER (PARTITION BY series_key, coalesce(period,'week') ORDER BY seq DESC)=1")
def latest_narrative(t):
    return mc.latest_narrative(dv.narratives(t))


_FEED = _ITEMS + """, fd AS (SELECT id AS card_id, 'claim' AS card_type, ticker, created AS date, claim AS text, source, importance FROM bc
    UNION ALL SELECT substr(sha1(concat(ticker,'|fundamental|',CAST(date AS VARCHAR))),1,16), 'fundamental', ticker, date, CAST(n AS VARCHAR), NULL, NULL FROM (SELECT ticker, CAST(as_of + INTERVAL 3 DAY AS DATE) AS date, COUNT(*) AS n FROM responses GROUP BY 1,2)
    UNION ALL SELECT substr(sha1(concat(series_key,'|macro_week|',CAST(date AS VARCHAR))),1,16), 'macro_week', series_key, date, CAST(n AS VARCHAR), NULL, NULL FROM (SELECT series_key, date, COUNT(*) AS n FROM narratives GROUP BY 1,2))"""


def _feed(t):
    snapshots = dv.responses(t).groupBy("ticker", F.date_add("as_of", 3).alias("date")).agg(F.count("*").cast("string").alias("text"))
    macro = dv.narratives(t).groupBy(F.col("series_key").alias("ticker"), "date").agg(F.count("*").cast("string").alias("text"))
    return cd.card_feed(cd.claim_cards(_claims(t)), cd.snapshot_cards(snapshots, "fundamental"), cd.snapshot_cards(macro, "macro_week"))


@query("card_feed", "U7", "card_id s,card_type s,ticker s,date d,text s,source s,importance i", _FEED + " SELECT * FROM fd")
def card_feed(t):
    return _feed(t)


@query("card_filter", "F12", "card_id s,card_type s,date d",
       _FEED + " SELECT * FROM fd WHERE card_type IN ('claim','fundamental') AND date>=DATE '2024-07-10' - INTERVAL 30 DAY AND (card_type<>'claim' OR (source IN ('src1','src2','src3') AND importance>=4))")
def card_filter(t):
    return cd.card_filter(_feed(t), "2024-07-10", ["src1", "src2", "src3"], "1m", "4+", ["claim", "fundamental"])


_MARKED = "SELECT user_id, card FROM marks QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, card ORDER BY ts DESC, seq DESC)=1 AND op='mark'"


@query("card_marks", "J19", "user_id i,card s", f"SELECT user_id, card FROM (SELECT user_id, card, arg_max(op, (ts, seq)) AS op FROM marks GROUP BY 1,2) WHERE op='mark'")
def card_marks(t):
    return cd.marked(dv.marks(t))


@query("unread_cards", "J19", "card_id s", _FEED + " SELECT card_id FROM (SELECT card_id, bool_or(coalesce(importance>=5,false)) OVER (PARTITION BY card_id) AS seen FROM fd) WHERE NOT seen")
def unread_cards(t):
    feed = stage(_feed(t))
    return cd.unread(feed, feed.filter("importance >= 5").select(F.col("card_id").alias("card")))


@query("article_summaries", "J16", "card_id s,article_summary s",
       _ITEMS + " SELECT bc.id AS card_id, CASE WHEN json_valid(v.b) THEN json_extract_string(v.b,'$.summary') END AS article_summary FROM bc LEFT JOIN v ON v.link=bc.source_link")
def article_summaries(t):
    from quantspark.operators.claims import _parsed

    archive = _parsed(dv.responses(t)).select("link", F.struct(F.col("_m")["summary"].alias("summary")).alias("event"))
    return cd.with_summaries(cd.claim_cards(_claims(t)), archive)


@query("sector_groups", "A18", "sector s,tickers s",
       """WITH u AS (SELECT DISTINCT p_brand AS ticker, lower(p_brand) AS name, CASE WHEN p_brand LIKE '%1%' THEN 'Energy' WHEN p_brand LIKE '%2%' THEN 'Big Tech' ELSE 'Other' END AS sector FROM part)
       SELECT sector, string_agg(ticker, ',' ORDER BY name) AS tickers FROM u GROUP BY 1""")
def sector_groups(t):
    sector = F.when(F.col("ticker").contains("1"), "Energy").when(F.col("ticker").contains("2"), "Big Tech")
    rows = t.read("part").select(F.col("p_brand").alias("ticker")).distinct().select("ticker", F.lower("ticker").alias("name"), sector.alias("sector"))
    return cd.sector_groups(rows).withColumn("tickers", F.concat_ws(",", "tickers"))


@query("universe_names", "F2", "ticker s,name s",
       "SELECT p_brand AS ticker, arg_min(p_name, p_partkey) AS name FROM part WHERE p_type NOT IN ('ECONOMY','PROMO') GROUP BY 1")
def universe_names(t):
    picks = t.read("part").select(F.col("p_type").alias("category"), F.col("p_name").alias("name"), F.col("p_brand").alias("ticker"), F.col("p_partkey").alias("ord"))
    return cd.universe(picks, ["ECONOMY", "PROMO"])
