"""Readers, sinks and streams over landed files.

Each query writes a derived table in the landed format into the staging folder, reads it back with the
reader (or passes it through the sink or stream) and is compared with SQL on the given tables.
"""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.plans import derived as dv
from quantspark.plans.base import query
from quantspark.session import stage, staging_folder
from quantspark.sources import feeds, filings, logs, market, sinks
from quantspark.streaming import jobs

_KEYED = "replace(ticker,'#','')"


def _place(t, name: str) -> str:
    return f"{staging_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _plain(c: str = "ticker"):
    """Tickers as file names: no ``#``, which file URLs escape."""
    return F.replace(F.col(c), F.lit("#"), F.lit(""))


#: Rows of one landed file; a key with more has several files.
FILE_ROWS = 100_000


def land(t, df: DataFrame, key: str, kind: str, order: tuple[str, ...] = (), **options) -> str:
    """Write the rows of each key into files of a folder ``key=<value>``, in ``order``. Returns the folder above.

    Keys and orders are range partitioned, so a hot key is written by many tasks, into files whose names ascend.
    """
    out = _place(t, "landed")
    rows = df.withColumnRenamed(key, "key").repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    writer = rows.drop("_order").write.partitionBy("key").option("maxRecordsPerFile", FILE_ROWS)
    if kind == "csv":
        writer.csv(out, header=True, **options)
    elif kind == "json":
        writer.json(out)
    else:
        writer.text(out)
    return out


def wide(t, df: DataFrame, time: str, value: str) -> str:
    """CSV files with a column per ticker."""
    tickers = sorted(r[0] for r in df.select("ticker").distinct().collect())  # columns of a wide file
    out = _place(t, "wide")
    df.groupBy(time).pivot("ticker", tickers).agg(F.first(value)).write.csv(out, header=True)
    return out


@query("landed_prices", "S1", "ticker s,d d,close f", "SELECT ticker, d, close FROM px_monthly")
def landed_prices(t):
    return market.read_prices(t.spark, wide(t, dv.px_monthly(t), "d", "close"))


@query("landed_ohlcv", "S2", "ticker s,d d,open f,close f,volume f2", "SELECT ticker, d, open, close, volume FROM px_daily")
def landed_ohlcv(t):
    out = _place(t, "bars")
    dv.px_daily(t).select("ticker", "d", "open", "close", F.col("volume").cast("double").alias("volume")).write.parquet(out)
    return market.read_ohlcv(t.spark, out)


@query("landed_intraday", "S3", "ticker s,ts t,close f", "SELECT ticker, ts, close FROM bars_hourly")
def landed_intraday(t):
    bars = dv.bars_hourly(t).select("ticker", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ssXXX").alias("t"), "close")
    return market.read_intraday(t.spark, wide(t, bars, "t", "close"))


@query("landed_earnings", "S4", "ticker s,earnings_date d,eps_estimate f,reported_eps f,surprise_pct f", f"SELECT {_KEYED} AS ticker, earnings_date, eps_estimate, reported_eps, surprise_pct FROM earnings")
def landed_earnings(t):
    rows = dv.earnings(t).select(_plain().alias("ticker"), F.col("earnings_date").cast("timestamp").alias("earnings_date"), "eps_estimate", "reported_eps", "surprise_pct")
    return market.read_earnings(t.spark, land(t, rows, "ticker", "csv")).withColumn("earnings_date", F.to_date("earnings_date"))


@query("landed_insider", "S5", "ticker s,transaction s,start_date d,n i,shares f2,value f2", f"SELECT {_KEYED} AS ticker, transaction, start_date, COUNT(*) AS n, SUM(shares) AS shares, SUM(value) AS value FROM insider GROUP BY 1,2,3")
def landed_insider(t):
    blank = F.lit("x")
    rows = dv.insider(t).select(_plain().alias("ticker"), blank.alias("insider"), blank.alias("position"), "transaction", "start_date", "shares", "value", F.lit("D").alias("ownership"))
    back = market.read_insider(t.spark, land(t, rows, "ticker", "csv"))
    return back.groupBy("ticker", "transaction", "start_date").agg(F.count("*").alias("n"), F.sum("shares").alias("shares"), F.sum("value").alias("value"))


@query("landed_holders", "S6", "ticker s,holder s,holder_type s,date_reported d,pct_held f,pct_change f", f"SELECT {_KEYED} AS ticker, holder, holder_type, date_reported, pct_held, pct_change FROM holders")
def landed_holders(t):
    rows = dv.holders(t).select(_plain().alias("ticker"), "holder", "date_reported", "pct_held", F.lit(1.0).alias("shares"), F.lit(1.0).alias("value"), "pct_change", "holder_type")
    side = lambda kind: land(t, rows.filter(F.col("holder_type") == kind).drop("holder_type"), "ticker", "csv")
    return market.read_holders(t.spark, side("institution"), side("fund"))


@query("landed_major_holders", "S7", "ticker s,insidersPercentHeld f,institutionsCount f", "SELECT replace(p_brand,'#','') AS ticker, AVG(p_size)/100 AS insidersPercentHeld, CAST(COUNT(*) AS DOUBLE) AS institutionsCount FROM part GROUP BY 1")
def landed_major_holders(t):
    sums = t.read("part").groupBy(_plain("p_brand").alias("ticker")).agg((F.avg("p_size") / 100).alias("insidersPercentHeld"), F.count("*").cast("double").alias("institutionsCount"))
    rows = sums.unpivot(["ticker"], ["insidersPercentHeld", "institutionsCount"], "breakdown", "value")
    return market.read_major_holders(t.spark, land(t, rows, "ticker", "csv"))


@query("landed_stock_info", "S8", "ticker s,forwardPE f,volume f,pegRatio f", f"SELECT {_KEYED} AS ticker, forwardPE, volume, pegRatio FROM stock_info")
def landed_stock_info(t):
    info = dv.stock_info(t)
    fields = F.col("info") if "info" in info.columns else F.struct(*[c for c in info.columns if c != "ticker"])
    rows = info.select(_plain().alias("ticker"), F.to_json(fields).alias("value"))
    back = market.read_stock_info(t.spark, land(t, rows, "ticker", "text"))
    return back.select("ticker", *[F.col("info")[c].try_cast("double").alias(c) for c in ("forwardPE", "volume", "pegRatio")])


@query("landed_rec_trend", "S9", "ticker s,period s,strongBuy i,buy i,hold i,sell i,strongSell i", f"SELECT {_KEYED} AS ticker, period, strongBuy, buy, hold, sell, strongSell FROM rec_trend")
def landed_rec_trend(t):
    rows = dv.rec_trend(t).select(_plain().alias("ticker"), "period", "strongBuy", "buy", "hold", "sell", "strongSell")
    return market.read_rec_trend(t.spark, land(t, rows, "ticker", "csv"))


@query("landed_analyst", "S10", "ticker s,grade_date d,firm s,action s,n i,target f4", f"SELECT {_KEYED} AS ticker, grade_date, firm, action, COUNT(*) AS n, SUM(target) AS target FROM analyst GROUP BY 1,2,3,4")
def landed_analyst(t):
    rows = dv.analyst(t).select(
        _plain().alias("ticker"), F.col("grade_date").cast("timestamp").alias("grade_date"), "firm", F.lit("Buy").alias("to_grade"), F.lit("Hold").alias("from_grade"), "action",
        F.when(F.col("target") != 0, F.col("target")).alias("current_price_target"),
    )
    back = market.read_analyst_actions(t.spark, land(t, rows, "ticker", "csv"))
    return back.groupBy("ticker", F.to_date("grade_date").alias("grade_date"), "firm", "action").agg(F.count("*").alias("n"), F.sum("target").alias("target"))


@query("landed_splits", "S11", "ticker s,split_d d,ratio f", f"SELECT {_KEYED} AS ticker, split_d, ratio FROM splits")
def landed_splits(t):
    return market.read_splits(t.spark, land(t, dv.splits(t).select(_plain().alias("ticker"), "split_d", "ratio"), "ticker", "csv"))


@query("landed_filings", "S12 S13", "bucket_end d,cik i,period d,n i,shares f2,value f2",
       "SELECT bucket_end, cik, period, COUNT(*) AS n, SUM(shares) AS shares, SUM(value) AS value FROM f13_sub s JOIN f13_info i ON i.accession=s.accession GROUP BY 1,2,3")
def landed_filings(t):
    start = F.trunc(F.add_months("bucket_end", -2), "month")
    stamp = lambda c: F.lower(F.date_format(c, "ddMMMyyyy"))
    bucket = F.concat(stamp(start), F.lit("-"), stamp(F.col("bucket_end")), F.lit("_form13f"))
    subs = dv.f13_sub(t).select(
        bucket.alias("bucket"), F.col("accession").alias("ACCESSION_NUMBER"), F.col("cik").alias("CIK"), F.upper(F.date_format("period", "dd-MMM-yyyy")).alias("PERIODOFREPORT"))
    info = dv.f13_info(t).select(
        F.lit("all").alias("bucket"), F.col("accession").alias("ACCESSION_NUMBER"), F.col("name").alias("NAMEOFISSUER"), F.col("class").alias("TITLEOFCLASS"),
        F.col("cusip").alias("CUSIP"), F.col("value").alias("VALUE"), F.col("shares").alias("SSHPRNAMT"))
    read = filings.read_submissions(t.spark, land(t, subs, "bucket", "csv", sep="\t"))
    lines = filings.read_infotable(t.spark, land(t, info, "bucket", "csv", ("ACCESSION_NUMBER",), sep="\t"))
    return read.join(lines, "accession").groupBy("bucket_end", "cik", "period").agg(F.count("*").alias("n"), F.sum("shares").alias("shares"), F.sum("value").alias("value"))


@query("landed_concepts", "S14 S15", "ticker s,concept s,start_d d,end_d d,val f2,filed d,form s", f"SELECT upper({_KEYED}) AS ticker, 'revenue' AS concept, start_d, end_d, val, filed, form FROM facts")
def landed_concepts(t):
    from quantspark.plans.filings import _facts

    number = F.regexp_extract("ticker", r"(\d+)$", 1).cast("long")
    facts = _facts(t).select("ticker", F.struct(F.col("start_d").alias("start"), F.col("end_d").alias("end"), "val", "filed", "form", F.lit(2000).alias("fy"), F.lit("Q1").alias("fp")).alias("fact"), number.alias("cik"))
    files = facts.select(_plain().alias("key"), "cik", F.lit("Revenues").alias("tag"), F.struct(F.array("fact").alias("USD")).alias("units"))
    names = facts.select("ticker", "cik").distinct()
    listing = names.select(F.lit("listing").alias("key"), F.col("cik").alias("cik_str"), F.lower(_plain()).alias("ticker"), F.lit("x").alias("title"))
    companies = filings.read_cik_map(t.spark, land(t, listing, "key", "json", ("ticker",)), lines=True)
    return filings.read_concepts(t.spark, land(t, files, "key", "json"), companies, lines=True)


@query("landed_fred", "S16", "key s,d d,value f", "SELECT key, d, value FROM macro WHERE day(d)<>1")
def landed_fred(t):
    rows = dv.macro(t).select("key", "d", F.when(F.dayofmonth("d") == 1, ".").otherwise(F.col("value").cast("string")).alias("value"))
    return market.read_fred(t.spark, land(t, rows, "key", "csv"))


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query("landed_feeds", "S17", "source s,link s,published t,title s",
       "SELECT source, link, CAST(published AS TIMESTAMP) AS published, trim(title) AS title FROM articles")
def landed_feeds(t):
    when = F.date_format(F.col("published").cast("timestamp"), "d MMM yyyy HH:mm:ss")
    item = F.concat(F.lit("<item><title>"), _escaped(F.col("title")), F.lit("</title><link>"), F.col("link"), F.lit("</link><pubDate>"), F.coalesce(F.concat(when, F.lit(" +0000")), F.lit("soon")), F.lit("</pubDate></item>"))
    # Feed files of a source hold some of its items each.
    rows = dv.articles(t).select("source", item.alias("value"), F.col("doc_id").alias("_order"))
    return feeds.read_feeds(t.spark, land(t, rows, "source", "xml", ("_order",)))


@query("landed_headlines", "S18", "query s,ord i,title s,domain s", "SELECT domain AS query, ROW_NUMBER() OVER (PARTITION BY domain ORDER BY ord)-1 AS ord, title, domain FROM headlines QUALIFY title<>'' AND domain<>''")
def landed_headlines(t):
    rows = dv.headlines(t).select(F.col("domain").alias("key"), F.col("ord").alias("_order"), "title", "domain", F.lit("20240305T000000Z").alias("seendate"))
    return feeds.read_headlines(t.spark, land(t, rows, "key", "json", ("_order",)), lines=True)


@query("landed_thesis_log", "S19", "ticker s,seq i,event s,date d,confidence f,claims_considered i",
       f"SELECT {_KEYED} AS ticker, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY seq)-1 AS seq, event, date, confidence, claims_considered FROM thesis_log")
def landed_thesis_log(t):
    rows = dv.thesis_log(t).withColumn("ticker", _plain())
    return logs.read_event_log(t.spark, "theses", land(t, rows.withColumnRenamed("seq", "_order"), "ticker", "json", ("_order",)), lines=True)


@query("landed_positions", "S22", "portfolio s,event s,id s,ticker s,created d,closed_date d",
       "SELECT coalesce(portfolio,'none') AS portfolio, event, id, ticker, created, closed_date FROM (SELECT CASE WHEN event='created' THEN portfolio END AS portfolio, event, id, ticker, created, closed_date FROM position_events)")
def landed_positions(t):
    rows = dv.position_events(t).withColumn("portfolio", F.coalesce("portfolio", F.lit("none")))
    rows = rows.withColumn("portfolio", F.when(F.col("event") == "created", F.col("portfolio")).otherwise("none"))
    return logs.read_event_log(t.spark, "positions", land(t, rows.withColumnRenamed("seq", "_order"), "portfolio", "json", ("_order",)), lines=True)


@query("landed_trades", "S20", "portfolio s,d d,ticker s,action s,n i,shares f2", "SELECT portfolio, d, ticker, action, COUNT(*) AS n, SUM(shares) AS shares FROM trades GROUP BY 1,2,3,4")
def landed_trades(t):
    rows = dv.trades(t).select("portfolio", F.col("d").alias("date"), "ticker", "action", "shares", "price", F.lit("a, b").alias("note"), "rule", F.col("seq").alias("_order"))
    back = logs.read_trades(t.spark, land(t, rows, "portfolio", "csv", ("date", "_order")))
    return back.filter("note = 'a, b'").groupBy("portfolio", "d", "ticker", "action").agg(F.count("*").alias("n"), F.sum("shares").alias("shares"))


@query("landed_portfolios", "S21", "portfolio s,initial_cash f2,created d", "SELECT portfolio, initial_cash, created FROM portfolios")
def landed_portfolios(t):
    body = F.to_json(F.struct(F.col("portfolio").alias("name"), F.col("initial_cash").cast("double").alias("initial_cash"), "created"))
    return logs.read_portfolios(t.spark, land(t, dv.portfolios(t).select("portfolio", body.alias("value")), "portfolio", "text"))


@query("landed_archive", "S23", "link s,source s,article_date d,event_type s", "SELECT link, source, coalesce(published, DATE '2024-07-01') AS article_date, CASE WHEN doc_id%2=0 THEN 'earnings' END AS event_type FROM articles")
def landed_archive(t):
    event = F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("earnings").alias("event_type"), F.lit(3).alias("importance")))
    entry = F.struct(F.coalesce("published", F.lit("2024-07-01").cast("date")).alias("article_date"), "title", "source", event.alias("event"))
    rows = dv.articles(t).select(F.col("source").alias("key"), "link", entry.alias("e"))
    return logs.read_archive(t.spark, land(t, rows, "key", "json", ("link",)), lines=True).select("link", "source", "article_date", F.col("event.event_type").alias("event_type"))


@query("landed_state", "S26", "kind s,name s,n i",
       """SELECT 'attempted' AS kind, link AS name, 2 AS n FROM articles UNION ALL SELECT 'known', source, 1 FROM (SELECT DISTINCT source FROM articles)
       UNION ALL SELECT 'attempt', ticker, CAST(COUNT(*) AS INT) FROM thesis_log GROUP BY 2 UNION ALL SELECT 'check', ticker, CAST(day(MAX(date)) AS INT) FROM thesis_log GROUP BY 2""")
def landed_state(t):
    entries = lambda df, key, e: land(t, df.select(F.lit("state").alias("key"), key, e.alias("e")), "key", "json", (key,))
    articles, log = dv.articles(t), dv.thesis_log(t).groupBy("ticker").agg(F.count("*").cast("int").alias("n"), F.max("date").alias("date"))
    attempted = logs.read_attempted(t.spark, entries(articles, "link", F.array(F.lit("A"), F.lit("B"))), lines=True).groupBy(F.col("link").alias("name")).agg(F.count("*").alias("n"))
    known = logs.read_known_tickers(t.spark, land(t, articles.select(F.lit("state").alias("key"), F.col("source").alias("value")).distinct(), "key", "text", ("value",)), lines=True).select(F.col("ticker").alias("name"), F.lit(1).alias("n"))
    entry = F.struct(F.col("n").alias("consecutive_failures"), F.col("date").alias("last_attempt"))
    attempts = logs.read_attempts(t.spark, entries(log, "ticker", entry), lines=True).select(F.col("ticker").alias("name"), F.col("consecutive_failures").alias("n"))
    checks = logs.read_earnings_checks(t.spark, entries(log, "ticker", F.col("date").cast("string")), lines=True).select(F.col("ticker").alias("name"), F.dayofmonth("earnings_date").alias("n"))
    parts = [df.select(F.lit(kind).alias("kind"), "name", F.col("n").cast("long").alias("n")) for kind, df in (("attempted", attempted), ("known", known), ("attempt", attempts), ("check", checks))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("sink_append", "K1", "ticker s,n i", f"SELECT {_KEYED} AS ticker, 2*COUNT(*) AS n FROM thesis_log GROUP BY 1")
def sink_append(t):
    rows, out = dv.thesis_log(t).withColumn("ticker", _plain()), _place(t, "log")
    for batch in (rows, rows.limit(0), rows):
        sinks.append_log(batch, out)
    return sinks.read_log(t.spark, out).groupBy("ticker").agg(F.count("*").alias("n"))


@query("sink_panel", "K2 S24", "date d,ticker s,momentum f",
       "SELECT d AS date, ticker, CASE WHEN month(d)%2=0 THEN -close ELSE close END AS momentum FROM px_monthly")
def sink_panel(t):
    from quantspark.operators.panel import FACTOR_COLUMNS

    out, bars = _place(t, "panel"), dv.px_monthly(t).select(F.col("d").alias("date"), "ticker", F.col("close").alias("momentum"))
    empty = {c: F.lit(None).cast("double") for c in [*FACTOR_COLUMNS, "forward_return"] if c != "momentum"}
    sinks.write_panel(bars.withColumns(empty), out)
    sinks.write_panel(bars.filter(F.month("date") % 2 == 0).withColumn("momentum", -F.col("momentum")).withColumns(empty), out)
    return market.read_panel(t.spark, out)


@query("sink_narratives", "K3 R3", "series_key s,period s,bucket s,date d,seq i,value f",
       """WITH n AS (SELECT *, coalesce(period,'week') AS p FROM narratives), b AS (SELECT *, CASE WHEN p='week' THEN concat(CAST(isoyear(date) AS VARCHAR),'-W',lpad(CAST(week(date) AS VARCHAR),2,'0')) ELSE strftime(date,'%Y-%m') END AS bucket FROM n),
       l AS (SELECT *, LEAD(bucket) OVER (PARTITION BY series_key, p ORDER BY seq) AS nx FROM b) SELECT series_key, p AS period, bucket, date, seq, value FROM l WHERE nx IS DISTINCT FROM bucket""")
def sink_narratives(t):
    landed, out, state = _place(t, "refreshes"), _place(t, "narratives"), _place(t, "state")
    rows = dv.narratives(t)
    rows.write.parquet(landed)
    jobs.upsert_narratives(t.spark.readStream.schema(rows.schema).parquet(landed), out, state).awaitTermination()
    return t.spark.read.parquet(out)


@query("sink_aggregates", "K4", "kind s,bucket_end d,n i,value f2",
       "SELECT 'cusip' AS kind, bucket_end, COUNT(*) AS n, SUM(total_value) AS value FROM f13_cusip GROUP BY 2 UNION ALL SELECT 'holder', bucket_end, COUNT(*), SUM(value) FROM f13_holder GROUP BY 2")
def sink_aggregates(t):
    from quantspark.operators import holdings as ho
    from quantspark.plans.filings import holdings_lines

    out, lines = _place(t, "aggregates"), holdings_lines(t)
    sinks.write_aggregates(ho.cusip_aggregate(lines), ho.holder_aggregate(lines), out)
    side = lambda name, value: t.spark.read.parquet(f"{out}/{name}").groupBy("bucket_end").agg(F.count("*").alias("n"), F.sum(value).alias("value"))
    return side("cusip_agg", "total_value").withColumn("kind", F.lit("cusip")).unionByName(side("holder_agg", "value").withColumn("kind", F.lit("holder")))


@query("sink_undo", "K5", "portfolio s,n i,last i",
       """WITH newest AS (SELECT arg_max((portfolio, d, seq), (d, seq, portfolio)) AS x FROM trades)
       SELECT portfolio, COUNT(*) AS n, MAX(seq) AS last FROM trades, newest WHERE (portfolio, d, seq)<>x GROUP BY 1""")
def sink_undo(t):
    """Undo for the portfolio that traded last."""
    trades, out = stage(dv.trades(t)), _place(t, "trades")
    sinks.append_log(trades, out, "portfolio", None)
    newest = trades.agg(F.max_by("portfolio", F.struct("d", "seq", "portfolio")).alias("portfolio")).first()
    sinks.undo_last_trade(t.spark, out, newest.portfolio)
    return t.spark.read.parquet(out).groupBy("portfolio").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def _stream(t, rows: DataFrame) -> DataFrame:
    landed = _place(t, "landed")
    rows.write.parquet(landed)
    return t.spark.readStream.schema(rows.schema).parquet(landed)


@query("stream_intake", "R1", "link s,article_date d", "SELECT link, coalesce(published, DATE '2024-07-01') AS article_date FROM articles WHERE published IS NULL OR published >= DATE '2024-01-01'")
def stream_intake(t):
    out = _place(t, "archive")
    rows = dv.articles(t).drop("doc_id").withColumn("published", F.col("published").cast("timestamp"))
    for _ in range(2):  # the second run meets what the first has archived
        jobs.ingest_articles(_stream(t, rows), out, _place(t, "state"), "2024-07-01").awaitTermination()
    return t.spark.read.parquet(out).select("link", F.coalesce(F.to_date("published"), F.to_date("seen_date")).alias("article_date"))


@query("stream_counts", "R2", "source s,ticker s,n i", "SELECT source, ticker, COUNT(*) AS n FROM responses GROUP BY 1,2")
def stream_counts(t):
    """Each batch stores the counts that it changed with its number; the newest of a key is its count."""
    out = _place(t, "counts")

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    counts = jobs.claim_counts(_stream(t, dv.responses(t).select("source", "ticker")))
    job = counts.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", _place(t, "state")).trigger(availableNow=True).start()
    job.awaitTermination()
    return t.spark.read.parquet(out).groupBy("source", "ticker").agg(F.max_by("count", "batch").alias("n"))
