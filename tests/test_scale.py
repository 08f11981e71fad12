"""Landed files and ranks with one hot key: split work, the same answers."""

import datetime as dt
import json

import pytest
from days import day
from pyspark.sql import functions as F

from quantspark.operators import backtest, ranking
from quantspark.sources import feeds, logs


def test_hot_log_is_read_in_many_tasks_and_keeps_its_order(spark, tmp_path):
    n = 3000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "HOT").otherwise(F.concat(F.lit("T"), (F.col("id") % 7).cast("string"))).alias("key"),
        F.col("id").alias("_order"), F.lit("aggregated").alias("event"), F.lit("2024-01-01").cast("date").alias("date"), (F.col("id") / n).alias("confidence"),
    )
    out = str(tmp_path / "log")
    dealt = rows.repartitionByRange(4, "key", "_order").sortWithinPartitions("key", "_order")
    dealt.drop("_order").write.partitionBy("key").option("maxRecordsPerFile", 500).json(out)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(out).filter(F.col("_metadata.file_path").contains("key=HOT"))
        assert lines.select(F.spark_partition_id().alias("p")).distinct().count() >= 16
        got = logs.read_event_log(spark, "theses", out, lines=True).select("ticker", "seq", "confidence").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == n
    for ticker in ("HOT", "T0"):
        mine = sorted((r.seq, r.confidence) for r in got if r.ticker == ticker)
        assert [s for s, _ in mine] == list(range(len(mine)))
        assert [c for _, c in mine] == sorted(c for _, c in mine)


def test_feed_files_are_split_at_items(spark, tmp_path):
    items = "".join(f"<item><title>t{i} &amp; <![CDATA[<b>]]></title>\n<link>l{i}</link></item>\n" for i in range(400))
    (tmp_path / "key=News").mkdir()
    (tmp_path / "key=News/part.xml").write_text(f"<rss><channel><title>c</title>{items}</channel></rss>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        rows = feeds.read_rss(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= 8
        got = sorted((r.source, r.title, r.link) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(("News", f"t{i} & <b>", f"l{i}") for i in range(400))


def test_logs_of_lines_and_of_arrays_agree(spark, tmp_path):
    entries = [{"event": "created", "id": str(i), "ticker": "A", "created": "2024-01-01"} for i in range(5)]
    (tmp_path / "a/p1").mkdir(parents=True)
    (tmp_path / "a/p1/positions.json").write_text(json.dumps(entries))
    (tmp_path / "b/key=p1").mkdir(parents=True)
    (tmp_path / "b/key=p1/part-0.json").write_text("\n".join(map(json.dumps, entries[:3])))
    (tmp_path / "b/key=p1/part-1.json").write_text("\n".join(map(json.dumps, entries[3:])))
    read = lambda path, lines: sorted((r.portfolio, r.seq, r.id) for r in logs.read_event_log(spark, "positions", str(tmp_path / path), lines).collect())
    assert read("a/*/positions.json", False) == read("b", True) == [("p1", i, str(i)) for i in range(5)]


def test_ranks_of_a_hot_factor(spark):
    values = [(i * 37) % 50 if i % 9 else None for i in range(500)]
    table = spark.createDataFrame([(f"t{i}", None if v is None else float(v), 1.0) for i, v in enumerate(values)], "ticker string, momentum double, forward_pe double")
    got = {(r.ticker, r.factor): r.pct for r in ranking.percentile_ranks(table).collect()}
    known = sorted(v for v in values if v is not None)
    for i, v in enumerate(values):
        want = None if v is None else (known.index(v) + 1 + (known.count(v) - 1) / 2) / len(known) * 100
        assert got[f"t{i}", "momentum"] == (None if want is None else pytest.approx(want))
        assert got[f"t{i}", "forward_pe"] == pytest.approx(250.5 / 5)


def test_custom_weights_see_only_their_window(spark, bars):
    quotes = bars({"A": {"2024-01-01": 1.0, "2024-01-05": 2.0, "2024-01-09": 3.0}, "B": {"2024-01-05": 5.0, "2024-01-09": 7.0}})
    seen = backtest.custom_strategy(lambda date, history: {t: history[t].sum() + len(history) / 10 for t in history}, 4)
    dates = spark.createDataFrame([(day("2024-01-05"),), (day("2024-01-09"),)], "date date")
    got = sorted((r.date, r.ticker, round(r.w, 6)) for r in seen(dates, quotes).collect())
    assert got == [(dt.date(2024, 1, 5), "A", 3.2), (dt.date(2024, 1, 5), "B", 5.2), (dt.date(2024, 1, 9), "A", 5.2), (dt.date(2024, 1, 9), "B", 12.2)]
    none = backtest.custom_strategy(lambda date, history: {}, 4)
    assert none(dates, quotes).count() == 0
