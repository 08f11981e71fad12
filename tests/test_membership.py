"""Monthly filters of an archive: no held link is missed, and only hit months are read."""

import datetime as dt

from quantspark.streaming import jobs, membership


def frame(spark, rows):
    return spark.createDataFrame(rows, "link string, seen_date date")


def test_every_held_link_is_found_also_with_crowded_filters(spark, tmp_path):
    rows = [(f"l{i}", dt.date(2024, 1 + i % 5, 1 + i % 28)) for i in range(600)]
    asked = spark.createDataFrame([(f"l{i}",) for i in range(300, 900)] + [(None,)], "link string")
    for bits in (128, 1 << 14):
        archive, filters = str(tmp_path / f"a{bits}"), str(tmp_path / f"f{bits}")
        frame(spark, rows).write.partitionBy("seen_date").parquet(archive)
        found = {r.link for r in membership.held(asked, archive, filters, bits).collect()}
        assert found == {f"l{i}" for i in range(300, 600)}


def test_hits_name_the_month_and_repeated_filters_change_nothing(spark, tmp_path):
    filters = str(tmp_path / "f")
    seen = frame(spark, [("a", dt.date(2024, 1, 3)), ("b", dt.date(2024, 2, 3)), ("a", dt.date(2024, 3, 9)), (None, dt.date(2024, 3, 9))])
    for _ in range(2):
        membership.add(seen, filters, 1 << 16)
    index = spark.read.schema("word long, bits long, month string").parquet(filters)
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "link string")
    hits = sorted((r.link, r.month) for r in membership.maybe_held(asked, index, 1 << 16).collect())
    assert hits == [("a", "2024-01"), ("a", "2024-03"), ("b", "2024-02")]


def test_only_hit_months_of_the_archive_are_read(spark, tmp_path):
    archive, filters = str(tmp_path / "a"), str(tmp_path / "f")
    frame(spark, [("a", dt.date(2024, 1, 3)), ("b", dt.date(2024, 2, 3)), ("c", dt.date(2024, 3, 3))]).write.partitionBy("seen_date").parquet(archive)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    found = membership.held(spark.createDataFrame([("b",), ("z",)], "link string"), archive, filters)
    assert [r.link for r in found.collect()] == ["b"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pruned = plan.split("PartitionFilters: [", 1)[1].split("PushedFilters", 1)[0]
    assert "seen_date" in pruned and "2024-02" in pruned and "2024-01" not in pruned


def test_a_link_of_years_ago_is_held_back(spark, tmp_path):
    shape = "link string, title string, published timestamp"
    folder, archive = str(tmp_path / "in"), str(tmp_path / "archive")
    spark.createDataFrame([("u", "undated", None)], shape).write.parquet(folder)
    jobs.ingest_articles(spark.readStream.schema(shape).parquet(folder), archive, str(tmp_path / "c1"), "2020-07-01").awaitTermination(180)
    jobs.ingest_articles(spark.readStream.schema(shape).parquet(folder), archive, str(tmp_path / "c2"), "2024-07-01").awaitTermination(180)
    rows = spark.read.parquet(archive).collect()
    assert [(r.link, str(r.seen_date)) for r in rows] == [("u", "2020-07-01")]
