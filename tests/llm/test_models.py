"""Toxicity, language, suffix tree: held-out accuracy, probability laws and plain-loop forms."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.llm import langid, suffix_tree, toxicity
from quantspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_language_query_is_right_on_held_out_rows(spark):
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op6_language"](spark, FOLDER).join(truth, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98


def test_language_odd_texts_and_spans(spark, docs_of):
    training = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.train(training)
    english, german = (training.filter(F.col("lang") == x).orderBy("doc_id").first()["text"][:600] for x in ("en", "de"))
    docs = docs_of([None, "", "1234 ... !!", english, english + " " + german, "Привет мир"])
    found = langid.identify(docs, model)
    assert found.columns[:-1] == docs.columns and found.columns[-1] == "language_"
    rows = [r["language_"] for r in found.orderBy("doc_id").collect()]
    assert [r["lang"] for r in rows[:4]] == ["und", "und", "und", "en"] and rows[0]["score"] == 0
    assert {s["lang"] for s in rows[4]["spans"]} >= {"en", "de"} and len(rows[4]["spans"]) <= 6
    assert rows[5]["lang"] in model.languages
    empty = langid.train(docs_of([]))
    assert [r["language_"]["lang"] for r in langid.identify(docs, empty).collect()] == ["und"] * 6


def plain_viterbi(emit, switch):
    n, k = emit.shape
    score, back = emit[0].astype(float).copy(), []
    for t in range(1, n):
        best = score.max() - switch
        back.append([j if score[j] >= best else int(score.argmax()) for j in range(k)])
        score = np.maximum(score, best) + emit[t]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def value(emit, path, switch):
    return sum(emit[t, p] for t, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))


def test_block_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    sizes = [1, 2, 63, 64, 65, 200, 7]
    emit = rng.normal(0, 3, (sum(sizes), 4)).astype(np.float32)
    starts = np.cumsum([0] + sizes[:-1])
    labels = langid.viterbi(emit, starts, 5.0)
    for s, n in zip(starts, sizes, strict=True):
        own, part = labels[s : s + n], emit[s : s + n].astype(float)
        assert math.isclose(value(part, own, 5.0), value(part, plain_viterbi(part, 5.0), 5.0), abs_tol=1e-2)


def test_viterbi_of_many_labels():
    rng = np.random.default_rng(1)
    sizes, k = [1, 1300, 30], 300
    emit = rng.normal(0, 3, (sum(sizes), k)).astype(np.float32)
    starts = np.cumsum([0] + sizes[:-1])
    labels = langid.viterbi(emit, starts, 2.0)
    assert labels.max() > 127
    for s, n in zip(starts, sizes, strict=True):
        own, part = labels[s : s + n], emit[s : s + n].astype(float)
        assert math.isclose(value(part, own, 2.0), value(part, plain_viterbi(part, 2.0), 2.0), rel_tol=1e-4)


def test_every_language_is_learned_and_too_many_are_refused(docs_of, monkeypatch):
    names = [f"l{i:03d}" for i in range(150)]
    texts = {name: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}" for x in ("ko", "mu", "ra", "zi") * 3) for i, name in enumerate(names)}
    # The last name has the fewest rows.
    rows = [(i * 3 + j, texts[n], n, "s") for i, n in enumerate(names) for j in range(1 if n == "l149" else 2)]
    model = langid.train(docs_of(rows))
    assert model.languages == names
    found = langid.identify(docs_of(rows), model).select("lang", F.col("language_.lang").alias("got")).collect()
    assert np.mean([r["lang"] == r["got"] for r in found]) > 0.98 and ("l149", "l149") in {(r["lang"], r["got"]) for r in found}
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 149)
    with pytest.raises(ValueError, match="149"):
        langid.train(docs_of(rows))


def test_toxicity_query_separates_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    recall = np.mean([s >= 0.3 for s, y in held if y == 1])
    false = np.mean([s >= 0.3 for s, y in held if y == 0])
    assert recall > 0.8 and false < 0.05


def test_toxicity_knows_unseen_misspellings_and_odd_input(spark, docs_of):
    rng = random.Random(1)
    words = ["river", "stone", "cloud", "window", "paper", "garden", "letter", "summer"]
    texts, marks = [], []
    for i in range(400):
        text = rng.choices(words, k=30)
        if i % 4 == 0:
            text[rng.randrange(30)] = rng.choice(["grumblefoot", "grumblefoots", "grumblefooty", "grumblefooting"])
        texts.append(" ".join(text))
        marks.append(int(i % 4 == 0))
    labels = spark.createDataFrame(list(enumerate(marks)) + [(0, 0), (None, 1), (9999, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(texts), labels)
    docs = docs_of(["river stone grumblefootish cloud paper", "river stone window cloud paper", None, "", "?!"])
    got = [r["s"] for r in docs.select("doc_id", toxicity.toxicity(model, spark)(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert got[0] > 0.3 > max(got[1:]) and min(got) >= 0
    nothing = toxicity.train(docs_of(texts), labels.filter("toxic = 0 AND doc_id > 0"))
    assert [r["s"] for r in docs.select(toxicity.toxicity(nothing, spark)(F.col("text")).alias("s")).collect()] == [0.0] * 5


def plain_base(texts, train):
    split = [(t or "").encode().lower().split() + [b""] for t in texts]
    c = Counter(w for w, k in zip(split, train, strict=True) if k for w in w)
    n = sum(c.values())
    d = n + 0.1 * (len(c) + 1)
    return n, [(len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.1) / d) for x in w)) for w in split]


def test_suffix_tree_counts_and_base(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HOT_RATE", 0.2)  # most words are outside the vocabulary
    docs = docs_of(corpus)
    tree, counts = suffix_tree.train(docs.filter("doc_id % 3 <> 0").select("text"))
    rows = {r["doc_id"]: r for r in suffix_tree.score(docs, tree, counts).collect()}
    n, want = plain_base(corpus, [i % 3 != 0 for i in range(len(corpus))])
    assert tree.tokens == n and len(rows) == len(corpus)
    for i, (tokens, known, base) in enumerate(want):
        assert (rows[i]["n_tokens"], rows[i]["n_known"]) == (tokens, known)
        assert math.isclose(rows[i]["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)


def test_suffix_tree_learns_contexts_and_sums_to_one(docs_of):
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        w = []
        while len(w) < 30:
            w += rng.choice([["red", "wine"], ["red", "wine", "glass"], ["blue", "sky"], [rng.choice(["tree", "house", "road"])]])
        texts.append(" ".join(w))
    docs = docs_of(texts)
    tree, counts = suffix_tree.train(docs.select("text"))
    assert any(level.state.any() for level in tree.levels)
    got = suffix_tree.score(docs, tree, counts).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"] * 0.8
    # After any history the next-word probabilities, with one unknown word, sum to one.
    for history in (["red"], ["red", "wine"], ["road", "blue"], ["unknown"], []):
        ids = tree.sequence([w.encode() for w in history])[:-1]
        last = [np.full(len(tree.vocabulary), c[-1]) for c in tree.contexts(ids)]
        p, weight = tree.probabilities(last, np.arange(len(tree.vocabulary)))
        _, rest = tree.probabilities([x[:1] for x in last], np.array([-1]))
        assert math.isclose(p.sum() + 10 ** rest[0] * 0.1 / tree.divisor(), 1.0, rel_tol=1e-9)


def test_suffix_tree_odd_tables(docs_of):
    tree, counts = suffix_tree.train(docs_of([]).select("text"))
    rows = suffix_tree.score(docs_of(["a b", None, ""]), tree, counts).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    assert suffix_tree.score(docs_of([]), tree, counts).count() == 0
    docs = docs_of([(1, "a b", "en", "s")] * 3 + [(None, "a c", None, None), (1, "c c c", "en", "s")])
    tree, counts = suffix_tree.train(docs.select("text"))
    assert sorted(r["n_tokens"] for r in suffix_tree.score(docs, tree, counts).collect()) == [3, 3, 3, 3, 4]


def plain_tree_scores(texts, train):
    """The tree from dictionaries of word tuples, the score of each text word by word."""
    start = None
    split = [[start, *(t or "").encode().lower().split(), b""] for t in texts]
    c = Counter(w for s, k in zip(split, train, strict=True) if k for w in s[1:])
    n = sum(c.values())
    root = lambda w: (c[w] + 0.1) / (n + 0.1 * (len(c) + 1))
    context, entry = (max(2.0, r * n**0.5) for r in (suffix_tree.CONTEXT_RATE, suffix_tree.ENTRY_RATE))
    states = {}

    def probability(history, word, most):
        p = root(word)
        for size in range(1, most + 1):
            held = states.get(tuple(history[-size:])) if len(history) >= size else None
            if held:
                many, kept = held
                p = (kept.get(word, 0) + (many - sum(kept.values()) + suffix_tree.SMOOTH) * p) / (many + suffix_tree.SMOOTH)
        return p

    level = {(w,): m for w, m in [*c.items(), (start, sum(train))] if w != b"" and m >= context}
    for size in range(1, suffix_tree.DEPTH + 1):
        follow = {h: Counter() for h in level}
        for s, k in zip(split, train, strict=True):
            for i in range(size, len(s)) if k else ():
                if tuple(s[i - size : i]) in follow:
                    follow[tuple(s[i - size : i])][s[i]] += 1
        onward, new = {}, {}
        for h, m in level.items():
            kept = {w: x for w, x in follow[h].items() if x >= entry}
            parent = {w: probability(h, w, size - 1) for w in kept}
            gain = sum(x * math.log(x / m / parent[w]) for w, x in kept.items())
            rest = m - sum(kept.values())
            gain += rest * math.log(rest / m / max(1 - sum(parent.values()), 1e-9)) if rest > 0 else 0.0
            if gain > len(kept) + 10:
                new[h] = (m, kept)
            onward.update({(*h, w): x for w, x in kept.items() if w != b"" and x >= context})
        states.update(new)
        level = onward
    return states, [sum(math.log10(probability(s[max(0, i - suffix_tree.DEPTH) : i], s[i], suffix_tree.DEPTH)) for i in range(1, len(s))) for s in split]


def test_suffix_tree_equals_the_plain_tree(docs_of, corpus):
    rng = random.Random(8)
    texts = corpus + [" ".join(rng.choices(["red wine", "red wine glass", "blue sky", "tree", "a house"], k=25)) for _ in range(150)]
    train = [i % 5 != 0 for i in range(len(texts))]
    docs = docs_of(texts).withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))  # ids may be text
    tree, counts = suffix_tree.train(docs_of(texts).filter("doc_id % 5 <> 0").select("text"))
    states, want = plain_tree_scores(texts, train)
    assert {len(h) for h in states} == {1, 2, 3} and sum(int(x.state.sum()) for x in tree.levels) == len(states)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, tree, counts).collect()}
    for i, score in enumerate(want):
        assert math.isclose(got[f"id{i}"], score, rel_tol=1e-9, abs_tol=1e-9)


def test_suffix_tree_knows_a_phrase_of_143_in_a_million(docs_of):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    stream = rng.choices(words, k=1_000_000)
    for at in rng.sample(range(0, 999_000, 10), 143):
        stream[at : at + 4] = ["w1", "w2", "w3", "w4"]
    texts = [" ".join(stream[i : i + 2000]) for i in range(0, 1_000_000, 2000)]
    tree, counts = suffix_tree.train(docs_of(texts).select("text"))
    got = suffix_tree.score(docs_of(["w1 w2 w3 w4"]), tree, counts).first()
    assert got["score"] > got["base_score"] + 4
