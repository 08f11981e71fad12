"""Readers over landed files, writers and streaming jobs."""

import datetime as dt
import json

from days import day
from pyspark.sql import functions as F

from quantspark.sources import feeds, filings, logs, market, sinks
from quantspark.streaming import jobs


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_wide_prices(spark, tmp_path):
    path = write(tmp_path / "p.csv", "Date,AAPL,BRK.B\n2024-01-02,1.5,\n2024-01-03,nan,2.5\n")
    got = sorted((r.ticker, r.d.isoformat(), r.close) for r in market.read_prices(spark, path).collect())
    assert got == [("AAPL", "2024-01-02", 1.5), ("BRK.B", "2024-01-03", 2.5)]


def test_intraday_with_mixed_offsets(spark, tmp_path):
    path = write(tmp_path / "i.csv", "Datetime,A\n2024-03-08 09:30:00-05:00,1\n2024-03-11 09:30:00-04:00,2\n")
    assert [r.local.strftime("%H:%M") for r in market.read_intraday(spark, path).collect()] == ["09:30", "09:30"]


def test_per_ticker_files(spark, tmp_path):
    write(tmp_path / "e/AAPL.csv", "earnings_date,eps_estimate,reported_eps,surprise_pct\n2024-05-01 16:00:00,1.0,,\n2024-02-01 16:00:00,1.0,1.1,10.0\n2023-11-01 16:00:00,1.0,1.0,0.0\n")
    rows = market.read_earnings(spark, str(tmp_path / "e"), limit=2).collect()
    assert [(r.ticker, r.earnings_date.month, r.surprise_pct) for r in rows] == [("AAPL", 2, 10.0), ("AAPL", 5, None)]
    write(tmp_path / "a/MSFT.csv", "grade_date,firm,to_grade,from_grade,action,current_price_target\n2024-01-01 00:00:00,F,Buy,Hold,up,\n2024-01-01 00:00:00,F,Buy,Hold,main,400\n")
    assert [(r.ticker, r.action, r.target, r.seq) for r in market.read_analyst_actions(spark, str(tmp_path / "a")).orderBy("seq").collect()] == [("MSFT", "up", 0.0, 1), ("MSFT", "main", 400.0, 2)]
    write(tmp_path / "n/A.csv", "insider,position,transaction,start_date,shares,value,ownership\nX,CEO,Stock Gift,2024-01-01,5,,D\nX,CEO,Sale,2024-02-01,5,50,D\n")
    assert [r.value for r in market.read_insider(spark, str(tmp_path / "n")).collect()] == [50.0, None]
    head = "holder,date_reported,pct_held,shares,value,pct_change\n"
    write(tmp_path / "hi/A.csv", head + "I,2024-03-31,0.1,1,1,0.2\n")
    write(tmp_path / "hf/A.csv", head + "F,2024-03-31,0.1,1,1,\n")
    assert sorted((r.holder_type, r.pct_change) for r in market.read_holders(spark, str(tmp_path / "hi"), str(tmp_path / "hf")).collect() if r.pct_change) == [("institution", 0.2)]
    write(tmp_path / "m/A.csv", "breakdown,value\ninsidersPercentHeld,0.1\ninstitutionsCount,7\n")
    row = market.read_major_holders(spark, str(tmp_path / "m")).first()
    assert (row.insidersPercentHeld, row.institutionsPercentHeld, row.institutionsCount) == (0.1, None, 7.0)
    write(tmp_path / "s/A.json", '{"volume": 5, "sector": "x", "beta": null}')
    assert market.read_stock_info(spark, str(tmp_path / "s")).first().info["volume"] == "5"
    write(tmp_path / "r/A.csv", "period,strongBuy,buy,hold,sell,strongSell\n0m,1,2,3,4,5\n")
    assert market.read_rec_trend(spark, str(tmp_path / "r")).first().strongSell == 5
    write(tmp_path / "sp/A.csv", "split_d,ratio\n2024-06-10,10.0\n")
    assert market.read_splits(spark, str(tmp_path / "sp")).first().ratio == 10.0
    write(tmp_path / "f/DGS10.csv", "date,value\n2024-01-01,.\n2024-01-02,4.1\n")
    assert [(r.key, r.value) for r in market.read_fred(spark, str(tmp_path / "f")).collect()] == [("DGS10", 4.1)]


def test_filings(spark, tmp_path):
    folder = tmp_path / "13f/01jun2024-31aug2024_form13f"
    write(folder / "SUBMISSION.tsv", "ACCESSION_NUMBER\tX\tCIK\tPERIODOFREPORT\nA1\t-\t7\t30-JUN-2024\nA2\t-\t8\tbad\n")
    write(folder / "INFOTABLE.tsv", "ACCESSION_NUMBER\tNAMEOFISSUER\tTITLEOFCLASS\tCUSIP\tVALUE\tSSHPRNAMT\tZ\nA1\tAPPLE\tCOM\tC\t10\t2\t-\n")
    sub = filings.read_submissions(spark, str(folder / "SUBMISSION.tsv")).orderBy("accession").collect()
    assert [(r.period and r.period.isoformat(), r.bucket_end.isoformat()) for r in sub] == [("2024-06-30", "2024-08-31"), (None, "2024-08-31")]
    assert filings.read_infotable(spark, str(folder / "INFOTABLE.tsv")).first().asDict() == {"accession": "A1", "name": "APPLE", "class": "COM", "cusip": "C", "value": 10.0, "shares": 2.0}
    names = spark.createDataFrame([("2023q4_form13f.zip",), ("2024q1_form13f.zip",), ("01jun2024-31aug2024_form13f.zip",)], "name string")
    assert [r.bucket_end.isoformat() for r in filings.eligible_buckets(filings.list_buckets(names), "2024-08-30").collect()] == ["2024-03-31", "2023-12-31"]
    fact = {"start": "2024-01-01", "end": "2024-03-31", "val": 5, "filed": "2024-05-01", "form": "10-Q", "fy": 2024, "fp": "Q1"}
    write(tmp_path / "x/a.json", json.dumps({"cik": 320193, "tag": "Revenues", "units": {"USD": [fact]}}))
    write(tmp_path / "x/b.json", json.dumps({"cik": 320193, "tag": "CommonStockSharesOutstanding", "units": {"shares": [{k: v for k, v in fact.items() if k != "start"}]}}))
    write(tmp_path / "cik.json", json.dumps({"0": {"cik_str": 320193, "ticker": "aapl", "title": "Apple"}}))
    companies = filings.read_cik_map(spark, str(tmp_path / "cik.json"))
    assert companies.first().cik == "0000320193"
    got = sorted((r.ticker, r.concept, r.start_d is None, r.val) for r in filings.read_concepts(spark, str(tmp_path / "x"), companies).collect())
    assert got == [("AAPL", "revenue", False, 5.0), ("AAPL", "shares_outstanding", True, 5.0)]


def test_feeds(spark, tmp_path):
    rss = """<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>c</title>
    <item><title> A &amp; B </title><link>http://x/1</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0100</pubDate><dc:creator>Jo</dc:creator><description>d</description><content:encoded><![CDATA[<p>t</p>]]></content:encoded></item>
    <item><title>Q</title><link>http://x/2</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate><description></description></item>
    <item><title>R</title><link>http://x/3</link><pubDate>soon</pubDate></item></channel></rss>"""
    atom = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>8-K</title><link href="http://s/1"/><updated>2024-03-06T08:00:00-05:00</updated><summary>Item</summary></entry></feed>"""
    write(tmp_path / "rss/News.xml", rss)
    write(tmp_path / "atom/SEC 8-K AAPL.xml", atom)
    rows = {r.link: r for r in feeds.read_feeds(spark, str(tmp_path / "rss"), str(tmp_path / "atom")).collect()}
    assert rows["http://x/1"].title == "A & B" and rows["http://x/1"].author == "Jo" and rows["http://x/1"].content == "<p>t</p>"
    stamp = {k: r.published and r.published.isoformat() for k, r in rows.items()}
    assert stamp == {"http://x/1": "2024-03-05T09:00:00", "http://x/2": "2024-03-05T10:00:00", "http://x/3": None, "http://s/1": "2024-03-06T13:00:00"}
    write(tmp_path / "g/gold.json", json.dumps({"articles": [{"title": "t", "domain": "d", "seendate": "20240305T000000Z"}, {"title": "", "domain": "d", "seendate": "20240305"}]}))
    assert [(r.query, r.ord, r.date) for r in feeds.read_headlines(spark, str(tmp_path / "g")).collect()] == [("gold", 0, "20240305")]


def test_logs(spark, tmp_path):
    write(tmp_path / "claims/AAPL.json", json.dumps([{"id": "1", "ticker": "AAPL", "created": "2024-01-01", "confidence": 0.5, "trade_worthy": True}, {"id": "2", "ticker": "AAPL", "created": "2024-01-02", "source": "S"}]))
    got = logs.read_event_log(spark, "claims", str(tmp_path / "claims")).orderBy("seq").collect()
    assert [(r.log_key, r.id, r.source, r.catalysts) for r in got] == [("AAPL", "1", "", []), ("AAPL", "2", "S", [])]
    write(tmp_path / "macro/gold.json", json.dumps([{"date": "2024-01-01", "value": 1.0, "history": [["2023-12-31", 2.5]], "headlines_used": [{"title": "t", "domain": "d", "date": "x"}]}]))
    m = logs.read_event_log(spark, "macro", str(tmp_path / "macro")).first()
    assert (m.series_key, m.period, m.history[0].value, m.headlines_used[0].domain) == ("gold", "week", 2.5, "d")
    write(tmp_path / "fund/A.json", json.dumps([{"date": "2024-01-01", "factors": {"Growth": {"revenue_growth": 0.1}}}]))
    assert logs.read_event_log(spark, "fundamentals", str(tmp_path / "fund")).first().factors["Growth"]["revenue_growth"] == 0.1
    write(tmp_path / "pf/p1/trades.csv", 'date,ticker,action,shares,price,note\n2024-01-02,A,BUY,1,2.5,"a, b"\n2024-01-01,A,BUY,1,2,x,r1\n')
    write(tmp_path / "pf/p1/meta.json", '{"name": "p1", "initial_cash": 100.0, "created": "2024-01-01", "rules": {"theses": {"horizon": "any"}}}')
    write(tmp_path / "pf/p1/positions.json", '[{"event": "created", "id": "i", "ticker": "A", "created": "2024-01-01"}]')
    rows = logs.read_trades(spark, str(tmp_path / "pf/*/trades.csv")).orderBy("seq").collect()
    assert [(r.portfolio, r.seq, r.note, r.rule, r.price) for r in rows] == [("p1", 1, "a, b", "", 2.5), ("p1", 2, "x", "r1", 2.0)]
    p = logs.read_portfolios(spark, str(tmp_path / "pf/*/meta.json")).first()
    assert (p.portfolio, p.initial_cash, p.rules["theses"]["horizon"]) == ("p1", 100.0, "any")
    assert logs.read_event_log(spark, "positions", str(tmp_path / "pf/*/positions.json")).first().portfolio == "p1"
    cfg = write(tmp_path / "config.json", json.dumps({"universe": {"A": {"name": "Apple", "sector": "Big Tech"}, "B": {"name": "Bee"}}, "news_sources": [{"name": "N", "url": "u", "active": True}, {"name": "O", "url": "v"}]}))
    assert sorted((r.ticker, r.sector) for r in logs.read_universe(spark, cfg).collect()) == [("A", "Big Tech"), ("B", "Other")]
    assert [(r.name, r.full_page_fetch) for r in logs.read_sources(spark, cfg).collect()] == [("N", False)]
    assert logs.read_attempted(spark, write(tmp_path / "t1.json", '{"l": ["A", "B"]}')).count() == 2
    assert logs.read_attempted(spark, write(tmp_path / "t2.json", "{}")).count() == 0
    assert [r.ticker for r in logs.read_known_tickers(spark, write(tmp_path / "t3.json", '["A"]')).collect()] == ["A"]
    assert logs.read_attempts(spark, write(tmp_path / "t4.json", '{"A": {"consecutive_failures": 2, "last_attempt": "2024-01-01"}}')).first().consecutive_failures == 2
    assert logs.read_earnings_checks(spark, write(tmp_path / "t5.json", '{"A": "2024-01-01"}')).first().earnings_date == day("2024-01-01")
    entry = {"l": {"seen_date": "2024-01-01", "article_date": "2024-01-01", "title": "t", "text": "x", "event": None, "source": "s"}}
    assert logs.read_archive(spark, write(tmp_path / "t6.json", json.dumps(entry))).first().event is None


def test_sinks(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, v int")
    sinks.append_log(rows, log)
    sinks.append_log(rows.limit(0), log)
    sinks.append_log(rows, log)
    assert sorted(tuple(r) for r in sinks.read_log(spark, log).collect()) == [("A", 1), ("A", 1), ("B", 2), ("B", 2)]
    assert sinks.read_log(spark, log).columns == rows.columns
    assert [tuple(r) for r in sinks.read_log(spark, log, value="B").collect()] == [("B", 2), ("B", 2)]
    many = str(tmp_path / "many")
    sinks.append_log(spark.range(3000).selectExpr("concat('T', id) AS ticker", "id"), many)
    assert sinks.read_log(spark, many).count() == 3000 and sum(1 for _ in (tmp_path / "many").glob("_bucket=*")) <= sinks.BUCKETS
    panel = str(tmp_path / "panel")
    sinks.write_panel(spark.createDataFrame([(day("2024-01-01"), "A", 1.0), (day("2024-01-02"), "A", 1.0)], "date date, ticker string, momentum double"), panel)
    sinks.write_panel(spark.createDataFrame([(day("2024-01-01"), "A", 9.0), (day("2024-01-01"), "B", 2.0)], "date date, ticker string, momentum double"), panel)
    assert sorted((r.date.day, r.ticker, r.momentum) for r in spark.read.parquet(panel).collect()) == [(1, "A", 9.0), (1, "B", 2.0), (2, "A", 1.0)]
    table = str(tmp_path / "narratives")
    shape = "series_key string, period string, date date, seq int, narrative string"
    sinks.write_narratives(spark.createDataFrame([("g", "week", day("2024-01-01"), 1, "old"), ("o", "week", day("2024-01-01"), 1, "oil")], shape), table)
    sinks.write_narratives(spark.createDataFrame([("g", "week", day("2024-01-03"), 2, "new")], shape), table)
    assert sorted(r.narrative for r in spark.read.parquet(table).collect()) == ["new", "oil"]
    trades = str(tmp_path / "trades")
    sinks.append_log(spark.createDataFrame([("p", day("2024-01-01"), 1), ("p", day("2024-01-01"), 2), ("q", day("2024-01-01"), 1)], "portfolio string, d date, seq int"), trades, "portfolio", None)
    sinks.undo_last_trade(spark, trades, "p")
    sinks.undo_last_trade(spark, trades, "q")
    assert [(r.portfolio, r.seq) for r in spark.read.parquet(trades).collect()] == [("p", 1)]


def run(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return q


def test_bars_and_counts_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, 10)
    ticks = [("A", base + dt.timedelta(minutes=m), float(m)) for m in (0, 30, 59, 60)] + [("A", base + dt.timedelta(hours=9), 1.0)]
    spark.createDataFrame(ticks, "ticker string, ts timestamp, price double").write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema("ticker string, ts timestamp, price double").parquet(str(tmp_path / "ticks"))
    run(jobs.bars_from_ticks(stream), tmp_path, "bars", "append")
    assert sorted((r.ts.hour, r.close, r.ticks) for r in spark.table("bars").collect()) == [(10, 59.0, 3), (11, 60.0, 1)]
    spark.createDataFrame([("s", "A"), ("s", "A"), ("t", "B")], "source string, ticker string").write.parquet(str(tmp_path / "claims"))
    counts = jobs.claim_counts(spark.readStream.schema("source string, ticker string").parquet(str(tmp_path / "claims")))
    run(counts, tmp_path, "counts", "update")
    assert sorted(tuple(r) for r in spark.table("counts").collect()) == [("s", "A", 2), ("t", "B", 1)]


def test_articles_are_archived_once(spark, tmp_path):
    shape = "link string, title string, published timestamp"
    folder, archive = str(tmp_path / "in"), str(tmp_path / "archive")
    first = [("a", "x", dt.datetime(2024, 6, 1)), ("a", "again", dt.datetime(2024, 6, 1)), ("b", "undated", None), ("old", "x", dt.datetime(2020, 1, 1))]
    spark.createDataFrame(first, shape).write.parquet(folder)
    for _ in range(2):
        jobs.ingest_articles(spark.readStream.schema(shape).parquet(folder), archive, str(tmp_path / "ck"), "2024-07-01").awaitTermination(180)
        assert sorted(r.link for r in spark.read.parquet(archive).collect()) == ["a", "b"]
    spark.createDataFrame([("a", "x", dt.datetime(2024, 6, 1)), ("c", "new", dt.datetime(2024, 6, 30))], shape).write.mode("append").parquet(folder)
    # A fresh checkpoint forgets its watermark state; the archive itself still holds back known links.
    jobs.ingest_articles(spark.readStream.schema(shape).parquet(folder), archive, str(tmp_path / "ck2"), "2024-07-01").awaitTermination(180)
    assert sorted(r.link for r in spark.read.parquet(archive).collect()) == ["a", "b", "c"]


def test_narrative_stream(spark, tmp_path):
    shape = "series_key string, period string, date date, seq int, narrative string"
    spark.createDataFrame([("g", "week", day("2024-01-01"), 1, "old"), ("g", "week", day("2024-01-03"), 2, "new")], shape).write.parquet(str(tmp_path / "in"))
    jobs.upsert_narratives(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(180)
    assert [r.narrative for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["new"]
