"""Market tables derived from the driver's tables, in SQL and as DataFrames.

``SQL`` holds one SELECT per derived table; ``with_tables`` prefixes a query
with those it names. The functions below build the same tables in Spark.
Prices and surprises are rounded to six places so both forms carry equal
values into comparisons; a tiny offset before rounding keeps exact halves from
falling on different sides in the two engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SQL: dict[str, str] = {
    "px_daily": """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS d,
        ROUND(SUM(l_extendedprice*(1-l_discount))/SUM(l_quantity)+3e-10,6) AS open,
        ROUND(SUM(l_extendedprice)/SUM(l_quantity)+3e-10,6) AS close, SUM(l_quantity) AS volume
        FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1,2""",
    "px_monthly": """SELECT p_brand AS ticker, CAST(date_trunc('month',l_shipdate) AS DATE) AS d,
        ROUND(SUM(l_extendedprice*(1-l_discount))/SUM(l_quantity)+3e-10,6) AS open,
        ROUND(SUM(l_extendedprice)/SUM(l_quantity)+3e-10,6) AS close, SUM(l_quantity) AS volume
        FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1,2""",
    "mkt_daily": """SELECT CAST(l_shipdate AS DATE) AS d, ROUND(SUM(l_extendedprice)/SUM(l_quantity)+3e-10,6) AS close
        FROM lineitem GROUP BY 1""",
    "mkt_monthly": """SELECT CAST(date_trunc('month',l_shipdate) AS DATE) AS d,
        ROUND(SUM(l_extendedprice)/SUM(l_quantity)+3e-10,6) AS close FROM lineitem GROUP BY 1""",
    "cal_daily": "SELECT d, LAG(d) OVER (ORDER BY d) AS prev_d FROM (SELECT DISTINCT d FROM px_daily)",
    "cal_monthly": "SELECT d, LAG(d) OVER (ORDER BY d) AS prev_d FROM (SELECT DISTINCT d FROM px_monthly)",
    "ret_daily": """SELECT b.ticker, b.d, b.open, b.close, b.volume, p.close AS prev_close, b.close/p.close-1 AS ret
        FROM px_daily b JOIN cal_daily c ON c.d=b.d LEFT JOIN px_daily p ON p.ticker=b.ticker AND p.d=c.prev_d""",
    "ret_monthly": """SELECT b.ticker, b.d, b.open, b.close, p.close AS prev_close, b.close/p.close-1 AS ret
        FROM px_monthly b JOIN cal_monthly c ON c.d=b.d LEFT JOIN px_monthly p ON p.ticker=b.ticker AND p.d=c.prev_d""",
    "bars_hourly": """SELECT event_type AS ticker, date_trunc('hour',ts) AS ts, ROUND(AVG(value)+3e-10,6) AS close
        FROM events GROUP BY 1,2""",
    "earnings": """WITH q AS (SELECT p_brand AS ticker, CAST(date_trunc('quarter',l_shipdate) AS DATE) AS qs,
          ROUND(SUM(l_extendedprice)/SUM(l_quantity)/100+3e-10,6) AS v
          FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1,2),
        r AS (SELECT *, LAG(v) OVER (PARTITION BY ticker ORDER BY qs) AS est, MAX(qs) OVER (PARTITION BY ticker) AS mq FROM q)
        SELECT ticker, CAST(qs + INTERVAL '120' DAY AS DATE) AS earnings_date, est AS eps_estimate,
          CASE WHEN qs<mq THEN v END AS reported_eps,
          CASE WHEN qs<mq THEN ROUND((v-est)/ABS(est)*100+3e-10,6) END AS surprise_pct FROM r""",
    "analyst": """SELECT concat('Brand#',CAST(1+o_custkey%25 AS VARCHAR)) AS ticker, concat('F',CAST(o_custkey%20 AS VARCHAR)) AS firm,
        CAST(o_orderdate AS DATE) AS grade_date,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'up' WHEN '5-LOW' THEN 'down' WHEN '2-HIGH' THEN 'init' ELSE 'main' END AS action,
        CASE WHEN o_orderstatus='P' THEN 0.0::DOUBLE ELSE o_totalprice/50 END AS target, o_orderkey AS seq FROM orders""",
    "splits": """SELECT p_brand AS ticker, CAST(DATE '1996-01-01' + CAST((length(p_type)*113)%1800 AS INT) AS DATE) AS split_d,
        CAST(2+COUNT(*)%2 AS DOUBLE) AS ratio FROM part GROUP BY 1,2""",
    "insider": """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS start_date,
        CASE l_returnflag WHEN 'R' THEN 'Sale at price per share' WHEN 'A' THEN 'Purchase at price' ELSE 'Stock Gift' END AS transaction,
        l_quantity AS shares, CASE WHEN l_returnflag<>'N' THEN l_extendedprice END AS value
        FROM lineitem JOIN part ON p_partkey=l_partkey""",
    "f13_sub": """SELECT o_orderkey AS accession, o_custkey%40 AS cik,
        last_day(CAST(CAST(date_trunc('quarter',o_orderdate) AS DATE) + INTERVAL '70' DAY AS DATE)) AS period,
        last_day(CAST(CAST(date_trunc('quarter',o_orderdate) AS DATE) + (CASE WHEN o_orderkey%11=0 THEN 252 ELSE 160 END) * INTERVAL '1' DAY AS DATE)) AS bucket_end
        FROM orders""",
    "f13": """SELECT i.*, s.cik, s.period, s.bucket_end FROM f13_info i LEFT JOIN f13_sub s ON s.accession=i.accession WHERE i.class='COM'""",
    "f13_cusip": """WITH n AS (SELECT bucket_end, cusip, period, name, COUNT(*) AS n FROM f13 GROUP BY 1,2,3,4),
          m AS (SELECT * FROM n QUALIFY ROW_NUMBER() OVER (PARTITION BY bucket_end, cusip, period ORDER BY n DESC, name)=1),
          a AS (SELECT bucket_end, cusip, period, SUM(shares) AS total_shares, SUM(value) AS total_value, COUNT(DISTINCT accession) AS num_filers
            FROM f13 WHERE period IS NOT NULL GROUP BY 1,2,3)
        SELECT a.*, m.name FROM a JOIN m USING (bucket_end, cusip, period)""",
    "f13_holder": """SELECT bucket_end, cusip, cik, period, SUM(shares) AS shares, SUM(value) AS value FROM f13 WHERE period IS NOT NULL GROUP BY 1,2,3,4""",
    "holders": """SELECT concat('Brand#',CAST(1+s_suppkey%25 AS VARCHAR)) AS ticker, s_name AS holder,
        CASE WHEN s_suppkey%2=0 THEN 'institution' ELSE 'fund' END AS holder_type, CAST(DATE '1998-01-01' + s_nationkey AS DATE) AS date_reported,
        s_acctbal/1e6 AS pct_held, (s_acctbal-5000)/1e4 AS pct_change FROM supplier""",
    "rec_trend": """SELECT concat('Brand#',CAST(1+o_custkey%25 AS VARCHAR)) AS ticker,
        CASE o_orderstatus WHEN 'F' THEN '0m' WHEN 'O' THEN '-3m' ELSE '-1m' END AS period,
        COUNT(*) FILTER (o_orderpriority='1-URGENT') AS strongBuy, COUNT(*) FILTER (o_orderpriority='2-HIGH') AS buy,
        COUNT(*) FILTER (o_orderpriority='3-MEDIUM') AS hold, COUNT(*) FILTER (o_orderpriority='4-NOT SPECIFIED') AS sell,
        COUNT(*) FILTER (o_orderpriority='5-LOW') AS strongSell FROM orders GROUP BY 1,2""",
    "f13_info": """SELECT l_orderkey AS accession, concat('C',CAST(l_partkey%50 AS VARCHAR)) AS cusip, upper(p_name) AS name,
        CASE WHEN l_linestatus='O' THEN 'COM' ELSE 'PUT' END AS class, l_extendedprice AS value, l_quantity AS shares
        FROM lineitem JOIN part ON p_partkey=l_partkey""",
    "facts": """WITH q AS (SELECT p_brand AS ticker, CAST(date_trunc('quarter',l_shipdate) AS DATE) AS s,
          ROUND(SUM(l_extendedprice),2) AS v FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1,2),
        p AS (SELECT ticker, s, last_day(CAST(s + INTERVAL '70' DAY AS DATE)) AS e, v FROM q),
        y AS (SELECT ticker, CAST(date_trunc('year',s) AS DATE) AS s, ROUND(SUM(v),2) AS v, COUNT(*) AS n FROM q GROUP BY 1,2)
        SELECT ticker, s AS start_d, e AS end_d, v AS val, CAST(e + INTERVAL '45' DAY AS DATE) AS filed, '10-Q' AS form
          FROM p WHERE EXTRACT(month FROM s)<10
        UNION ALL SELECT ticker, s, e, ROUND(v*1.01+3e-6,2), CAST(e + INTERVAL '410' DAY AS DATE), '10-Q' FROM p WHERE EXTRACT(month FROM s)<10
        UNION ALL SELECT ticker, s, last_day(CAST(s + INTERVAL '340' DAY AS DATE)), v, CAST(s + INTERVAL '425' DAY AS DATE), '10-K'
          FROM y WHERE n=4""",
    "facts6": """WITH q AS (SELECT p_brand AS ticker, CAST(date_trunc('quarter',l_shipdate) AS DATE) AS s,
          ROUND(SUM(l_extendedprice),2) AS revenue, ROUND(SUM(l_extendedprice*l_discount)+3e-6,2) AS net_income,
          ROUND(SUM(l_tax*l_quantity)/1000+3e-10,6) AS eps_diluted, ROUND(SUM(l_quantity),2) AS shares_outstanding,
          ROUND(SUM(l_extendedprice*l_tax)+3e-6,2) AS operating_income, ROUND(SUM(l_extendedprice*(l_discount+l_tax))+3e-6,2) AS operating_cash_flow
          FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1,2),
        u AS (UNPIVOT q ON revenue, net_income, eps_diluted, shares_outstanding, operating_income, operating_cash_flow INTO NAME concept VALUE v),
        p AS (SELECT ticker, concept, s, last_day(CAST(s + INTERVAL '70' DAY AS DATE)) AS e, v FROM u),
        y AS (SELECT ticker, concept, CAST(date_trunc('year',s) AS DATE) AS s, ROUND(SUM(v)+3e-10,6) AS v, COUNT(*) AS n FROM u GROUP BY 1,2,3)
        SELECT ticker, concept, CASE WHEN concept<>'shares_outstanding' THEN s END AS start_d, e AS end_d, v AS val, CAST(e + INTERVAL '45' DAY AS DATE) AS filed, '10-Q' AS form
          FROM p WHERE EXTRACT(month FROM s)<10 OR concept='shares_outstanding'
        UNION ALL SELECT ticker, concept, s, last_day(CAST(s + INTERVAL '340' DAY AS DATE)), v, CAST(s + INTERVAL '425' DAY AS DATE), '10-K'
          FROM y WHERE n=4 AND concept<>'shares_outstanding'""",
    "stock_info": """SELECT p_brand AS ticker, ROUND(AVG(p_size)/50-0.5+3e-10,6) AS revenueGrowth, ROUND(AVG(p_retailprice)/2000+3e-10,6) AS earningsGrowth,
        ROUND(AVG(p_retailprice)/100+3e-10,6) AS forwardPE, CASE WHEN COUNT(*)%3<>0 THEN ROUND(AVG(p_size)/10+3e-10,6) END AS pegRatio,
        ROUND(MAX(p_retailprice)/300+3e-10,6) AS enterpriseToRevenue, ROUND(AVG(p_size)/100+3e-10,6) AS operatingMargins,
        CASE WHEN COUNT(*)%5=0 THEN 0.0 ELSE CAST(SUM(p_size) AS DOUBLE) END AS operatingCashflow, ROUND(SUM(p_retailprice)/10+3e-10,6) AS totalRevenue,
        CAST(COUNT(*) AS DOUBLE) AS averageVolume, CAST(MAX(p_size)*2 AS DOUBLE) AS volume, ROUND(AVG(p_retailprice)*1.1+3e-10,6) AS targetMeanPrice,
        ROUND(MIN(p_retailprice)+3e-10,6) AS currentPrice, ROUND(AVG(p_size)/1000+3e-10,6) AS shortPercentOfFloat FROM part GROUP BY 1""",
    "trades": """WITH b AS (SELECT c_mktsegment AS portfolio, o_orderpriority AS ticker, o_orderstatus AS rule,
          CAST(o_orderdate AS DATE) AS d, o_orderkey AS k, CAST(1+o_orderkey%10 AS DOUBLE) AS shares, o_totalprice/1000 AS price
          FROM orders JOIN customer ON c_custkey=o_custkey)
        SELECT portfolio, ticker, rule, d, 'BUY' AS action, shares, price, k*2 AS seq FROM b
        UNION ALL SELECT portfolio, ticker, rule, CAST(d + INTERVAL '30' DAY AS DATE), 'SELL', shares, price*1.02, k*2+1 FROM b WHERE k%3=0""",
    "trade_px": """SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS d, ROUND(SUM(o_totalprice)/COUNT(*)/1000+3e-10,6) AS close
        FROM orders WHERE isodow(o_orderdate)<=4 GROUP BY 1,2""",
    "portfolios": """SELECT c_mktsegment AS portfolio, ROUND(SUM(c_acctbal),2) AS initial_cash, DATE '1996-01-01' AS created FROM customer GROUP BY 1""",
    "rule_held": """SELECT c_mktsegment AS portfolio, o_orderstatus AS rule, concat('Brand#',CAST(1+8*(o_orderkey%3)+SUM(o_custkey)%8 AS VARCHAR)) AS ticker,
        CAST(COUNT(*) AS DOUBLE) AS shares, ROUND(AVG(o_totalprice)/1000+3e-10,6) AS avg_cost, CAST(MAX(o_orderdate) AS DATE) AS entry_date
        FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1,2,o_orderkey%3""",
    "rule_candidates": """SELECT o_orderstatus AS rule, concat(CASE WHEN COUNT(*)%3=0 THEN 'Gone#' ELSE 'Brand#' END,CAST(1+o_custkey%25 AS VARCHAR)) AS ticker, ROUND(AVG(o_totalprice)/1000+3e-10,6) AS score
        FROM orders GROUP BY 1,o_custkey%25""",
    "thesis_now": """SELECT p_brand AS ticker, CASE WHEN COUNT(*)%4=0 THEN 'short' ELSE 'long' END AS direction,
        ROUND(AVG(p_retailprice)/2000+(COUNT(*)%7)/14.0+3e-10,6) AS confidence, CAST(7+(COUNT(*)*13)%700 AS INT) AS expected_horizon_days FROM part GROUP BY 1""",
    "thesis_held": """SELECT c_mktsegment AS portfolio, concat('Brand#',CAST(1+4*(o_custkey%6)+SUM(o_custkey)%4 AS VARCHAR)) AS ticker, CAST(COUNT(*) AS DOUBLE) AS shares,
        ROUND(AVG(o_totalprice)/1000+3e-10,6) AS avg_cost FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1,o_custkey%6""",
    "position_events": """SELECT 'created' AS event, CAST(o_orderkey AS VARCHAR) AS id, c_mktsegment AS portfolio, concat('Brand#',CAST(1+o_custkey%25 AS VARCHAR)) AS ticker,
          CAST(o_orderdate AS DATE) AS created, CAST(30+o_orderkey%300 AS INT) AS expected_horizon_days, NULL::DATE AS closed_date, NULL::DOUBLE AS actual_return_pct, o_orderkey*2 AS seq
          FROM orders JOIN customer ON c_custkey=o_custkey
        UNION ALL SELECT 'closed', CAST(CASE WHEN o_orderkey%15=0 THEN -o_orderkey-1 ELSE o_orderkey END AS VARCHAR), NULL, NULL, NULL, NULL, CAST(o_orderdate + INTERVAL '40' DAY AS DATE), o_totalprice/1e5, o_orderkey*2+1
          FROM orders WHERE o_orderkey%3=0""",
    "thesis_log": """SELECT concat('Brand#',CAST(1+o_custkey%25 AS VARCHAR)) AS ticker, CASE WHEN o_orderkey%4=0 THEN 'critic' ELSE 'aggregated' END AS event,
        CAST(o_orderdate AS DATE) AS date, o_orderkey AS seq, ROUND(o_totalprice/600000+3e-10,6) AS confidence, CAST(o_custkey%50 AS INT) AS claims_considered FROM orders""",
    "narratives": """SELECT event_type AS series_key, CASE WHEN event_id%10=0 THEN 'month' WHEN event_id%3=0 THEN NULL ELSE 'week' END AS period,
        CAST(ts AS DATE) AS date, event_id AS seq, value FROM events""",
    "articles": """SELECT concat('http://a/',CAST(doc_id AS VARCHAR)) AS link, source, split_part(text, chr(10), 1) AS title, text,
        CASE WHEN doc_id%50<>0 THEN CAST(DATE '2024-01-01' + CAST(doc_id%200 AS INT) AS DATE) END AS published, doc_id FROM documents""",
    "headlines": r"""SELECT page_id AS ord, regexp_extract(url,'https?://([^/]+)',1) AS domain,
        regexp_extract(html,'<title>([^<]*)</title>',1) AS title FROM pages""",
    "macro": """SELECT event_type AS key, CAST(ts AS DATE) AS d, ROUND(AVG(value)+3e-10,6) AS value FROM events GROUP BY 1,2""",
    "marks": """SELECT user_id, event_type AS card, CASE WHEN event_id%4=0 THEN 'unmark' ELSE 'mark' END AS op, ts, event_id AS seq FROM events""",
    # Model responses: valid JSON, broken JSON (every 7th) and JSON inside prose (every 11th).
    "responses": r"""SELECT concat('http://a/',CAST(d.doc_id AS VARCHAR)) AS link, concat('T',CAST(d.doc_id%30 AS VARCHAR)) AS ticker,
        d.source AS source, CAST(DATE '2024-01-01' + CAST(d.doc_id%200 AS INT) AS DATE) AS as_of, d.doc_id AS doc_id,
        CASE WHEN d.doc_id%7=0 THEN concat('{"claims": [', md5(d.text))
        ELSE concat(CASE WHEN d.doc_id%11=0 THEN 'Here is the answer: ' ELSE '' END,
          '{"event": "', md5(d.text),
          '", "companies": ["T', CAST(d.doc_id%30 AS VARCHAR), '", "ZZ", "T', CAST(d.doc_id%13 AS VARCHAR),
          '"], "event_type": "', CASE WHEN d.doc_id%5=0 THEN 'rumour' ELSE 'earnings' END,
          '", "importance": ', CASE WHEN d.doc_id%17=0 THEN '"many"' ELSE CAST(2*coalesce(l.quality,0) + d.doc_id%12 AS VARCHAR) END,
          ', "time_horizon": "', CASE WHEN d.doc_id%4=0 THEN 'weeks' ELSE 'years' END,
          '", "key_facts": ["f1", "f2"], "type": "', CASE WHEN d.doc_id%3=0 THEN 'analysis' ELSE 'blog' END,
          '", "novel": ', CASE WHEN coalesce(l.toxic,0)=0 THEN 'true' ELSE 'false' END,
          CASE WHEN d.doc_id%19=0 THEN '' ELSE ', "summary": "s"' END,
          ', "claims": [{"claim": "c', CAST(d.doc_id AS VARCHAR), 'a", "trade_worthy": true, "direction": "',
          CASE WHEN d.doc_id%6=0 THEN 'up' ELSE 'long' END, '", "confidence": ', CASE WHEN d.doc_id%8=0 THEN '1.4' ELSE '0.6' END,
          ', "importance": ', CAST(d.doc_id%15 AS VARCHAR), ', "expected_return_pct": 4.5',
          CASE WHEN d.doc_id%9=0 THEN '' ELSE concat(', "expected_horizon_days": ', CAST(d.doc_id%900 AS VARCHAR)) END,
          '}, {"claim": "c', CAST(d.doc_id AS VARCHAR), 'b", "trade_worthy": false, "direction": "short", "confidence": 0.3, "importance": 4, "context": "x"}]}')
        END AS raw FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id""",
}


def with_tables(body: str) -> str:
    """Prefix ``body`` with the derived tables it uses, dependencies first."""
    order: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in SQL:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                need(SQL[name])
                order.append(name)

    need(body)
    ctes = ", ".join(f"{name} AS MATERIALIZED ({SQL[name]})" for name in order)
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {stripped[15:]}"
    if stripped.upper().startswith("WITH "):
        return f"WITH {ctes}, {stripped[5:]}"
    return f"WITH {ctes} {body}"


def _lines(t) -> DataFrame:
    """Line items with their brand; AQE picks the join and splits hot part keys."""
    part = t.read("part").select("p_partkey", "p_brand")
    return t.read("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def _six(value):
    return F.round(value + F.lit(3e-10), 6)


def _sums(t, unit: str, full: bool = False) -> DataFrame:
    """Partial sums per brand and day (or month): the one pass over line items that
    prices, the market and earnings are all derived from; ``full`` adds those of company facts."""
    ext, disc, tax, qty = (F.col(f"l_{c}") for c in ("extendedprice", "discount", "tax", "quantity"))
    day = F.to_date("l_shipdate") if unit == "day" else F.to_date(F.date_trunc(unit, "l_shipdate"))
    sums = [F.sum(ext).alias("s_ext"), F.sum(ext * (1 - disc)).alias("s_net"), F.sum(qty).alias("s_qty")]
    if full:
        sums += [F.sum(ext * disc).alias("s_disc"), F.sum(tax * qty).alias("s_tax_qty"), F.sum(ext * tax).alias("s_tax")]
    return _lines(t).groupBy(F.col("p_brand").alias("ticker"), day.alias("d")).agg(*sums)


def daily_sums(t, full: bool = False) -> DataFrame:
    return _sums(t, "day", full)


def monthly_sums(t) -> DataFrame:
    return _sums(t, "month")


def quarterly_sums(t) -> DataFrame:
    return _sums(t, "quarter")


def prices_from(sums: DataFrame) -> DataFrame:
    return sums.select(
        "ticker", "d", _six(F.col("s_net") / F.col("s_qty")).alias("open"), _six(F.col("s_ext") / F.col("s_qty")).alias("close"), F.col("s_qty").alias("volume")
    )


def market_from(sums: DataFrame) -> DataFrame:
    return sums.groupBy("d").agg(_six(F.sum("s_ext") / F.sum("s_qty")).alias("close"))


def px_daily(t) -> DataFrame:
    return prices_from(daily_sums(t))


def px_monthly(t) -> DataFrame:
    return prices_from(monthly_sums(t))


def bars_hourly(t) -> DataFrame:
    return (
        t.read("events")
        .groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(_six(F.avg("value")).alias("close"))
    )


def earnings_from(sums: DataFrame) -> DataFrame:
    quarters = sums.groupBy("ticker", F.to_date(F.date_trunc("quarter", "d")).alias("qs")).agg(
        _six(F.sum("s_ext") / F.sum("s_qty") / 100).alias("v")
    )
    by_quarter = Window.partitionBy("ticker").orderBy("qs")
    done = F.col("qs") < F.col("mq")
    return (
        quarters.withColumn("est", F.lag("v").over(by_quarter))
        .withColumn("mq", F.max("qs").over(Window.partitionBy("ticker")))
        .select(
            "ticker",
            F.date_add("qs", 120).alias("earnings_date"),
            F.col("est").alias("eps_estimate"),
            F.when(done, F.col("v")).alias("reported_eps"),
            F.when(done, _six((F.col("v") - F.col("est")) / F.abs("est") * 100)).alias("surprise_pct"),
        )
    )


def earnings(t) -> DataFrame:
    return earnings_from(quarterly_sums(t))


def analyst(t) -> DataFrame:
    action = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "up")
        .when(F.col("o_orderpriority") == "5-LOW", "down")
        .when(F.col("o_orderpriority") == "2-HIGH", "init")
        .otherwise("main")
    )
    return t.read("orders").select(
        F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string")).alias("ticker"),
        F.concat(F.lit("F"), (F.col("o_custkey") % 20).cast("string")).alias("firm"),
        F.to_date("o_orderdate").alias("grade_date"),
        action.alias("action"),
        F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice") / 50).alias("target"),
        F.col("o_orderkey").alias("seq"),
    )


def splits(t) -> DataFrame:
    day = F.date_add(F.lit("1996-01-01").cast("date"), ((F.length("p_type") * 113) % 1800).cast("int"))
    return (
        t.read("part")
        .groupBy(F.col("p_brand").alias("ticker"), day.alias("split_d"))
        .agg((2 + F.count("*") % 2).cast("double").alias("ratio"))
    )


def insider(t) -> DataFrame:
    text = (
        F.when(F.col("l_returnflag") == "R", "Sale at price per share")
        .when(F.col("l_returnflag") == "A", "Purchase at price")
        .otherwise("Stock Gift")
    )
    return _lines(t).select(
        F.col("p_brand").alias("ticker"),
        F.to_date("l_shipdate").alias("start_date"),
        text.alias("transaction"),
        F.col("l_quantity").alias("shares"),
        F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("value"),
    )


def f13_sub(t) -> DataFrame:
    quarter = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    return t.read("orders").select(
        F.col("o_orderkey").alias("accession"),
        (F.col("o_custkey") % 40).alias("cik"),
        F.last_day(F.date_add(quarter, 70)).alias("period"),
        # Every 11th filing arrives one bucket late.
        F.last_day(F.date_add(quarter, F.when(F.col("o_orderkey") % 11 == 0, 252).otherwise(160))).alias("bucket_end"),
    )


def f13_info(t) -> DataFrame:
    part = t.read("part").select("p_partkey", "p_name")
    return (
        t.read("lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("accession"),
            F.concat(F.lit("C"), (F.col("l_partkey") % 50).cast("string")).alias("cusip"),
            F.upper("p_name").alias("name"),
            F.when(F.col("l_linestatus") == "O", "COM").otherwise("PUT").alias("class"),
            F.col("l_extendedprice").alias("value"),
            F.col("l_quantity").alias("shares"),
        )
    )


def holders(t) -> DataFrame:
    return t.read("supplier").select(
        F.concat(F.lit("Brand#"), (1 + F.col("s_suppkey") % 25).cast("string")).alias("ticker"),
        F.col("s_name").alias("holder"),
        F.when(F.col("s_suppkey") % 2 == 0, "institution").otherwise("fund").alias("holder_type"),
        F.date_add(F.lit("1998-01-01").cast("date"), F.col("s_nationkey")).alias("date_reported"),
        (F.col("s_acctbal") / 1e6).alias("pct_held"),
        ((F.col("s_acctbal") - 5000) / 1e4).alias("pct_change"),
    )


def rec_trend(t) -> DataFrame:
    named = {"strongBuy": "1-URGENT", "buy": "2-HIGH", "hold": "3-MEDIUM", "sell": "4-NOT SPECIFIED", "strongSell": "5-LOW"}
    period = F.when(F.col("o_orderstatus") == "F", "0m").when(F.col("o_orderstatus") == "O", "-3m").otherwise("-1m")
    ticker = F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string"))
    return (
        t.read("orders").groupBy(ticker.alias("ticker"), period.alias("period"))
        .agg(*[F.count_if(F.col("o_orderpriority") == p).alias(c) for c, p in named.items()])
    )


def facts_from(sums: DataFrame) -> DataFrame:
    quarters = sums.select("ticker", F.col("d").alias("s"), F.round("s_ext", 2).alias("v"))
    periods = quarters.withColumn("e", F.last_day(F.date_add("s", 70))).filter(F.month("s") < 10)
    years = (
        quarters.groupBy("ticker", F.to_date(F.date_trunc("year", "s")).alias("s"))
        .agg(F.round(F.sum("v"), 2).alias("v"), F.count("*").alias("n"))
        .filter("n = 4")
    )
    shape = ["ticker", "start_d", "end_d", "val", "filed", "form"]
    first = periods.select("ticker", F.col("s").alias("start_d"), F.col("e").alias("end_d"), F.col("v").alias("val"), F.date_add("e", 45).alias("filed"), F.lit("10-Q").alias("form"))
    again = periods.select("ticker", F.col("s").alias("start_d"), F.col("e").alias("end_d"), F.round(F.col("v") * 1.01 + F.lit(3e-6), 2).alias("val"), F.date_add("e", 410).alias("filed"), F.lit("10-Q").alias("form"))
    annual = years.select("ticker", F.col("s").alias("start_d"), F.last_day(F.date_add("s", 340)).alias("end_d"), F.col("v").alias("val"), F.date_add("s", 425).alias("filed"), F.lit("10-K").alias("form"))
    return first.select(shape).unionByName(again.select(shape)).unionByName(annual.select(shape))


def facts6_from(sums: DataFrame) -> DataFrame:
    """Six concepts per brand: three quarters and a year filed for flows, every quarter for share counts."""
    cents = lambda v: F.round(v + F.lit(3e-6), 2)
    total = {c: F.sum(c) for c in ("s_ext", "s_disc", "s_tax_qty", "s_qty", "s_tax")}
    quarters = sums.groupBy("ticker", F.to_date(F.date_trunc("quarter", "d")).alias("s")).agg(
        F.round(total["s_ext"], 2).alias("revenue"),
        cents(total["s_disc"]).alias("net_income"),
        _six(total["s_tax_qty"] / 1000).alias("eps_diluted"),
        F.round(total["s_qty"], 2).alias("shares_outstanding"),
        cents(total["s_tax"]).alias("operating_income"),
        cents(total["s_disc"] + total["s_tax"]).alias("operating_cash_flow"),
    )
    concepts = [c for c in quarters.columns if c not in ("ticker", "s")]
    long = quarters.unpivot(["ticker", "s"], concepts, "concept", "v")
    instant = F.col("concept") == "shares_outstanding"
    periods = long.filter((F.month("s") < 10) | instant).withColumn("e", F.last_day(F.date_add("s", 70)))
    years = (
        long.filter(~instant)
        .groupBy("ticker", "concept", F.to_date(F.date_trunc("year", "s")).alias("s"))
        .agg(_six(F.sum("v")).alias("v"), F.count("*").alias("n"))
        .filter("n = 4")
    )
    filed = periods.select("ticker", "concept", F.when(~instant, F.col("s")).alias("start_d"), F.col("e").alias("end_d"), F.col("v").alias("val"), F.date_add("e", 45).alias("filed"), F.lit("10-Q").alias("form"))
    annual = years.select("ticker", "concept", F.col("s").alias("start_d"), F.last_day(F.date_add("s", 340)).alias("end_d"), F.col("v").alias("val"), F.date_add("s", 425).alias("filed"), F.lit("10-K").alias("form"))
    return filed.unionByName(annual)


def stock_info(t) -> DataFrame:
    """One map of text fields per brand, with zero and missing fields."""
    n, size, price = F.count("*"), F.col("p_size"), F.col("p_retailprice")
    fields = {
        "revenueGrowth": _six(F.avg(size) / 50 - 0.5), "earningsGrowth": _six(F.avg(price) / 2000), "forwardPE": _six(F.avg(price) / 100),
        "pegRatio": F.when(n % 3 != 0, _six(F.avg(size) / 10)), "enterpriseToRevenue": _six(F.max(price) / 300),
        "operatingMargins": _six(F.avg(size) / 100), "operatingCashflow": F.when(n % 5 == 0, 0.0).otherwise(F.sum(size).cast("double")),
        "totalRevenue": _six(F.sum(price) / 10), "averageVolume": n.cast("double"), "volume": (F.max(size) * 2).cast("double"),
        "targetMeanPrice": _six(F.avg(price) * 1.1), "currentPrice": _six(F.min(price)), "shortPercentOfFloat": _six(F.avg(size) / 1000),
    }
    rows = t.read("part").groupBy(F.col("p_brand").alias("ticker")).agg(*[v.alias(k) for k, v in fields.items()])
    pairs = [x for k in fields for x in (F.lit(k), F.col(k).cast("string"))]
    return rows.select("ticker", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("info"))


def trades(t) -> DataFrame:
    customer = t.read("customer").select("c_custkey", "c_mktsegment")
    buys = (
        t.read("orders")
        .join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .select(
            F.col("c_mktsegment").alias("portfolio"),
            F.col("o_orderpriority").alias("ticker"),
            F.col("o_orderstatus").alias("rule"),
            F.to_date("o_orderdate").alias("d"),
            F.col("o_orderkey").alias("k"),
            (1 + F.col("o_orderkey") % 10).cast("double").alias("shares"),
            (F.col("o_totalprice") / 1000).alias("price"),
        )
    )
    # Each order makes one buy and, for every third key, a later sale.
    legs = F.array(
        F.struct(F.lit("BUY").alias("action"), F.col("d").alias("on"), F.col("price").alias("at"), (F.col("k") * 2).alias("seq")),
        F.struct(F.lit("SELL").alias("action"), F.date_add("d", 30).alias("on"), (F.col("price") * 1.02).alias("at"), (F.col("k") * 2 + 1).alias("seq")),
    )
    return (
        buys.withColumn("leg", F.explode(F.when(F.col("k") % 3 == 0, legs).otherwise(F.slice(legs, 1, 1))))
        .select("portfolio", "ticker", "rule", F.col("leg.on").alias("d"), "leg.action", "shares", F.col("leg.at").alias("price"), "leg.seq")
    )


def trade_px(t) -> DataFrame:
    """Quotes on Monday to Thursday only, so prices must carry forward."""
    return (
        t.read("orders").filter(F.weekday("o_orderdate") < 4)
        .groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("d"))
        .agg(_six(F.sum("o_totalprice") / F.count("*") / 1000).alias("close"))
    )


def portfolios(t) -> DataFrame:
    return t.read("customer").groupBy(F.col("c_mktsegment").alias("portfolio")).agg(F.round(F.sum("c_acctbal"), 2).alias("initial_cash")).withColumn(
        "created", F.lit("1996-01-01").cast("date")
    )


def _brand_of_customer():
    return F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string"))


def _customer_orders(t) -> DataFrame:
    customer = t.read("customer").select("c_custkey", F.col("c_mktsegment").alias("portfolio"))
    return t.read("orders").join(customer, F.col("c_custkey") == F.col("o_custkey")).withColumn("ticker", _brand_of_customer())


def rule_held(t) -> DataFrame:
    """Three positions per portfolio and rule; every order counts in one of them."""
    third = (F.col("o_orderkey") % 3).alias("third")
    return (
        _customer_orders(t).groupBy("portfolio", F.col("o_orderstatus").alias("rule"), third)
        .agg(F.count("*").cast("double").alias("shares"), _six(F.avg("o_totalprice") / 1000).alias("avg_cost"), F.to_date(F.max("o_orderdate")).alias("entry_date"), F.sum("o_custkey").alias("_s"))
        .withColumn("ticker", F.concat(F.lit("Brand#"), (1 + 8 * F.col("third") + F.col("_s") % 8).cast("string")))
        .select("portfolio", "rule", "ticker", "shares", "avg_cost", "entry_date")
    )


def rule_candidates(t) -> DataFrame:
    return (
        t.read("orders").groupBy(F.col("o_orderstatus").alias("rule"), (F.col("o_custkey") % 25).alias("_b"))
        .agg(_six(F.avg("o_totalprice") / 1000).alias("score"), F.count("*").alias("_n"))
        .withColumn("ticker", F.concat(F.when(F.col("_n") % 3 == 0, "Gone#").otherwise("Brand#"), (1 + F.col("_b")).cast("string")))
        .select("rule", "ticker", "score")
    )


def thesis_now(t) -> DataFrame:
    n = F.count("*")
    return t.read("part").groupBy(F.col("p_brand").alias("ticker")).agg(
        F.when(n % 4 == 0, "short").otherwise("long").alias("direction"),
        _six(F.avg("p_retailprice") / 2000 + (n % 7) / 14.0).alias("confidence"),
        (7 + (n * 13) % 700).cast("int").alias("expected_horizon_days"),
    )


def thesis_held(t) -> DataFrame:
    return (
        _customer_orders(t).groupBy("portfolio", (F.col("o_custkey") % 6).alias("_b"))
        .agg(F.count("*").cast("double").alias("shares"), _six(F.avg("o_totalprice") / 1000).alias("avg_cost"), F.sum("o_custkey").alias("_s"))
        .withColumn("ticker", F.concat(F.lit("Brand#"), (1 + 4 * F.col("_b") + F.col("_s") % 4).cast("string")))
        .select("portfolio", "ticker", "shares", "avg_cost")
    )


def position_events(t) -> DataFrame:
    """A creation per order, a close for every third key; some closes have no creation."""
    rows, k = _customer_orders(t), F.col("o_orderkey")
    created = rows.select(
        F.lit("created").alias("event"), k.cast("string").alias("id"), "portfolio", "ticker", F.to_date("o_orderdate").alias("created"),
        F.lit(0.7).alias("entry_confidence"), (30 + k % 300).cast("int").alias("expected_horizon_days"), F.lit("loop").alias("rule"), (k * 2).alias("seq"),
    )
    closed = rows.filter(k % 3 == 0).select(
        F.lit("closed").alias("event"), F.when(k % 15 == 0, -k - 1).otherwise(k).cast("string").alias("id"),
        F.to_date(F.date_add("o_orderdate", 40)).alias("closed_date"), (F.col("o_totalprice") / 1e5).alias("actual_return_pct"),
        F.lit("horizon").alias("close_reason"), (k * 2 + 1).alias("seq"),
    )
    return created.unionByName(closed, allowMissingColumns=True)


def thesis_log(t) -> DataFrame:
    k = F.col("o_orderkey")
    return t.read("orders").select(
        _brand_of_customer().alias("ticker"), F.when(k % 4 == 0, "critic").otherwise("aggregated").alias("event"),
        F.to_date("o_orderdate").alias("date"), k.alias("seq"), _six(F.col("o_totalprice") / 600000).alias("confidence"),
        (F.col("o_custkey") % 50).cast("int").alias("claims_considered"),
    )


def narratives(t) -> DataFrame:
    """A log of refreshes; entries without a period count as weekly."""
    k = F.col("event_id")
    return t.read("events").select(
        F.col("event_type").alias("series_key"), F.when(k % 10 == 0, "month").when(k % 3 == 0, None).otherwise("week").alias("period"),
        F.to_date("ts").alias("date"), k.alias("seq"), "value",
    )


def articles(t) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 200).cast("int"))
    return t.read("documents").select(
        F.concat(F.lit("http://a/"), F.col("doc_id").cast("string")).alias("link"),
        "source",
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        F.when(F.col("doc_id") % 50 != 0, day).alias("published"),
        "doc_id",
    )


def headlines(t) -> DataFrame:
    return t.read("pages").select(
        F.col("page_id").alias("ord"),
        F.regexp_extract("url", "https?://([^/]+)", 1).alias("domain"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
    )


def macro(t) -> DataFrame:
    return (
        t.read("events").groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("d")).agg(_six(F.avg("value")).alias("value"))
    )


def marks(t) -> DataFrame:
    return t.read("events").select(
        "user_id",
        F.col("event_type").alias("card"),
        F.when(F.col("event_id") % 4 == 0, "unmark").otherwise("mark").alias("op"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def responses(t) -> DataFrame:
    docs = t.read("documents").select("doc_id", "text", "source")
    labels = t.read("labels").select("doc_id", "quality", "toxic")
    k = F.col("doc_id")
    num = lambda c: c.cast("string")
    pick = lambda cond, a, b: F.when(cond, F.lit(a)).otherwise(F.lit(b))
    raw = F.concat(
        pick(k % 11 == 0, "Here is the answer: ", ""),
        F.lit('{"event": "'), F.md5("text"),
        F.lit('", "companies": ["T'), num(k % 30), F.lit('", "ZZ", "T'), num(k % 13),
        F.lit('"], "event_type": "'), pick(k % 5 == 0, "rumour", "earnings"),
        F.lit('", "importance": '), F.when(k % 17 == 0, F.lit('"many"')).otherwise(num(2 * F.col("quality") + k % 12)),
        F.lit(', "time_horizon": "'), pick(k % 4 == 0, "weeks", "years"),
        F.lit('", "key_facts": ["f1", "f2"], "type": "'), pick(k % 3 == 0, "analysis", "blog"),
        F.lit('", "novel": '), pick(F.col("toxic") == 0, "true", "false"),
        pick(k % 19 == 0, "", ', "summary": "s"'),
        F.lit(', "claims": [{"claim": "c'), num(k), F.lit('a", "trade_worthy": true, "direction": "'),
        pick(k % 6 == 0, "up", "long"), F.lit('", "confidence": '), pick(k % 8 == 0, "1.4", "0.6"),
        F.lit(', "importance": '), num(k % 15), F.lit(', "expected_return_pct": 4.5'),
        F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.lit(', "expected_horizon_days": '), num(k % 900))),
        F.lit('}, {"claim": "c'), num(k),
        F.lit('b", "trade_worthy": false, "direction": "short", "confidence": 0.3, "importance": 4, "context": "x"}]}'),
    )
    known = docs.join(labels, "doc_id", "left").fillna(0, ["quality", "toxic"])
    return known.select(
        F.concat(F.lit("http://a/"), num(k)).alias("link"),
        F.concat(F.lit("T"), num(k % 30)).alias("ticker"),
        "source",
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 200).cast("int")).alias("as_of"),
        "doc_id",
        F.when(k % 7 == 0, F.concat(F.lit('{"claims": ['), F.md5("text"))).otherwise(raw).alias("raw"),
    )
