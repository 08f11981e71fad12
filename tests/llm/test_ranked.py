"""Ranked search: range maxima, best-first intervals and whole results against plain loops."""

import math
import random
import re

import numpy as np
import pytest

from quantspark.llm import ranked

ITEMS = "item_id long, text string"


def plain_terms(text):
    return [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, k=10):
    """docs: (id, text); items: (id, text). Rows (item, rank, score, id), ids of equal scores sorted."""
    split = [(i, plain_terms(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    out = []
    for item, text in set(items):
        scores = []
        for i, terms in split:
            score = 0
            for term in plain_terms(text):
                tf = terms.count(term)
                if tf:
                    df = sum(term in t for _, t in split)
                    m = 100 - 75 + (75 * len(terms) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_range_maxima():
    rng = np.random.default_rng(1)
    term = np.sort(rng.integers(0, 6, 300))
    doc = np.concatenate([np.sort(rng.choice(400, n, replace=False)) for n in np.bincount(term, minlength=6)])
    value = rng.integers(1, 20, 300)
    lists = ranked.Postings(term, doc, value, 6, 400)
    for t in range(6):
        b, e = lists.bounds[t], lists.bounds[t + 1]
        for i in range(b, e):
            for j in range(i + 1, e + 1):
                assert lists.largest(np.array([i]), np.array([j]))[0] == i + value[i:j].argmax()
    assert lists.place(np.array([0, 5]), np.array([0, 400])).tolist() == [0, 300]


@pytest.mark.parametrize("splits", [1, 3, 64])
def test_best_first_equals_full_scores(monkeypatch, splits):
    monkeypatch.setattr(ranked, "SPLITS", splits)
    rng = np.random.default_rng(2)
    docs, terms = 500, 12
    impact = rng.integers(0, 4, (terms, docs)) * rng.integers(0, 30, (terms, 1)) * (rng.random((terms, docs)) < 0.3)
    term, doc = np.nonzero(impact)
    lists = ranked.Postings(term, doc, impact[term, doc], terms, docs)
    for q in range(20):
        chosen = np.sort(rng.choice(terms, rng.integers(1, 6), replace=False))
        times = rng.integers(1, 3, len(chosen))
        best = ranked.Best(1, 7)
        scored = ranked.search(lists, 0, chosen, times, 1000, best)
        full = (impact[chosen] * times[:, None]).sum(0)
        assert best.found[0] == sorted((-int(s), 1000 + d) for d, s in enumerate(full) if s > 0)[:7]
        assert scored <= docs
    # Selective queries leave most documents unscored.
    one = ranked.Best(1, 3)
    lists = ranked.Postings(np.zeros(docs, int), np.arange(docs), np.arange(docs) + 1, 1, docs)
    assert ranked.search(lists, 0, np.array([0]), np.array([1]), 0, one) < docs / 5
    assert [r for _, r in one.found[0]] == [499, 498, 497]


@pytest.mark.parametrize("postings", [500_000, 40])
def test_search_equals_plain_loops(spark, docs_of, corpus, monkeypatch, postings):
    monkeypatch.setattr(ranked, "POSTINGS", postings)
    rows = [(i if i % 19 else None, t, "en", "a") for i, t in enumerate(corpus)] + [(7, corpus[7], "en", "a"), (7, corpus[7], "en", "a")]
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices((corpus[i] or "x").split(" "), k=12))) for i in range(12)]
    items += [(1, items[1][1]), (1, "Other WORDS " + corpus[3]), (None, corpus[2]), (20, None), (21, ""), (22, "nothingofthekind"), (23, "a a a b")]
    found = ranked.search_all(docs_of(rows), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_search([(i, t) for i, t, _, _ in rows], items)


def test_blocks_of_queries_and_empty_tables(spark, docs_of, corpus, monkeypatch):
    docs, items = docs_of(corpus[:30]), spark.createDataFrame([(i, corpus[i]) for i in range(9)], ITEMS)
    whole = sorted(map(tuple, ranked.search_all(docs, items).collect()))
    monkeypatch.setattr(ranked, "QUERY_TERMS", 100)
    assert sorted(map(tuple, ranked.search_all(docs, items).collect())) == whole
    assert ranked.search_all(docs_of([]), items).count() == 0
    assert ranked.search_all(docs, items.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "doc_id string, text string")
    assert [tuple(r) for r in ranked.search_all(named, spark.createDataFrame([(1, "two")], ITEMS)).orderBy("rank").collect()][0][:3] == (1, 1, "a")
