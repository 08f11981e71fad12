"""Keyed permutations and the index of names against plain loops."""

import hashlib
import itertools
import random
from collections import Counter

import pytest
from days import day
from pyspark.sql import functions as F

from quantspark.functions.sampling import PRIME, permuted, round_keys
from quantspark.operators import articles, backtest, holdings
from quantspark.operators.lookup import holding


def plain_permuted(place, size, key, rounds=48):
    for i in range(1, rounds + 1):
        h = hashlib.md5(f"{key}|{i}".encode()).hexdigest()
        pivot, factor, offset = (int(h[at : at + 7], 16) for at in (0, 8, 16))
        other = (pivot - place) % size
        if (factor * max(place, other) + offset) % PRIME % 2:
            place = other
    return place


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100, 1001])
def test_permutation_is_a_bijection_and_equals_the_loop(spark, size):
    keys = spark.range(3).select(F.concat(F.lit("k"), "id").alias("key")).withColumn("keys", round_keys(F.col("key")))
    got = keys.select("key", F.posexplode(permuted(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(size), F.col("keys"))).alias("id", "to")).collect()
    for key in ("k0", "k1", "k2"):
        mine = {r.id: r.to for r in got if r.key == key}
        assert sorted(mine.values()) == list(range(size))
        assert mine == {i: plain_permuted(i, size, key) for i in range(size)}


def test_pairs_of_draws_are_even():
    trials, size = 6000, 6
    seen = Counter((plain_permuted(0, size, f"t{k}"), plain_permuted(1, size, f"t{k}")) for k in range(trials))
    expected = trials / (size * (size - 1))
    assert set(seen) == set(itertools.permutations(range(size), 2))
    # 29 degrees of freedom: 59 is passed by one fair draw in a thousand.
    assert sum((n - expected) ** 2 / expected for n in seen.values()) < 59


def test_random_picks_have_no_repeats_and_take_all_of_a_small_pool(spark):
    pool = spark.createDataFrame([(day("2020-01-01"), f"T{i}") for i in range(40)] + [(day("2020-02-01"), f"T{i}") for i in range(2)], "date date, ticker string")
    picks = Counter((r.trial, r.date, r.ticker) for r in backtest.random_picks(pool, 5, 30).collect())
    assert set(picks.values()) == {1}
    sizes = Counter((t, d) for t, d, _ in picks)
    assert all(n == (5 if d == day("2020-01-01") else 2) for (_, d), n in sizes.items()) and len(sizes) == 60
    assert len({t for _, d, t in picks if d == day("2020-01-01")}) > 30
    assert backtest.random_picks(pool.limit(0), 5, 3).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_holding_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    letters = "abcé😀 _%"
    word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    texts = [word(60) for _ in range(80)] + [None, "", "abc", "abc"]
    needles = [(word(6), f"v{rng.randint(0, 20)}") for _ in range(60)] + [("", "empty"), (None, "null"), ("abc", "x"), ("abc", "y")]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: set(r.found) for r in holding(rows, F.col("text"), spark.createDataFrame(needles, "needle string, value string")).collect()}
    want = {i: {v for n, v in needles if n and n in t} for i, t in enumerate(texts) if t is not None}
    assert got == {i: found for i, found in want.items() if found}


def test_holding_of_nothing(spark):
    rows = spark.createDataFrame([(1, "abc")], "id int, text string")
    none = spark.createDataFrame([("", "a")], "needle string, value string")
    assert holding(rows, F.col("text"), none).columns == ["id", "text", "found"]
    assert holding(rows, F.col("text"), none).count() == 0
    assert holding(rows.limit(0), F.col("text"), none.withColumn("needle", F.lit("b"))).count() == 0


def test_a_table_of_companies_resolves_like_the_dict(spark):
    names = [("C1", "ring works inc", 5.0), ("C2", "Ringer", 5.0), ("C3", "blue bolt", 7.0), ("C1", "ring works inc", 1.0), ("C4", None, 9.0)]
    table = spark.createDataFrame([(1, c, n, v) for c, n, v in names], "vintage int, cusip string, name string, total_value double")
    companies = {"A": "Ring Works", "B": "Bolt Inc", "C": "  Blue   Corp", "D": "Absent Ltd", "E": "O"}
    as_table = spark.createDataFrame(sorted(companies.items()), "ticker string, name string")
    want = {(r.ticker, r.cusip) for r in holdings.resolve_cusip(table, companies, ["vintage"]).collect()}
    assert want == {("A", "C1"), ("B", "C3"), ("C", "C3"), ("E", "C3")} or ("E", "C1") in want
    assert {(r.ticker, r.cusip) for r in holdings.resolve_cusip(table, as_table, ["vintage"]).collect()} == want


def test_backfill_reads_a_large_universe(spark):
    rng = random.Random(5)
    added = [(f"ZQ{i}", f"Company {rng.randint(0, 10**9)} plc") for i in range(3000)] + [("ZQ1", "Second Name")]
    rows = [(f"l{i}", f"News on {added[i][1].upper()} and zq{i + 100}.", None, day("2024-06-01")) for i in range(50)] + [("old", "zq5", "zq5", day("2020-01-01"))]
    archive = spark.createDataFrame(rows, "link string, text string, title string, article_date date")
    attempted = spark.createDataFrame([("l0", "ZQ0")], "link string, ticker string")
    got = {(r.link, r.ticker) for r in articles.backfill_candidates(archive, spark.createDataFrame(added, "ticker string, name string"), attempted, "2024-07-01").collect()}
    want = {(link, t) for link, text, _, _ in rows[:-1] for t, n in added if t.lower() in text.lower() or n.lower() in text.lower()}
    assert got == want - {("l0", "ZQ0")}
