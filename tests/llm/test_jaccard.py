"""Jaccard join: tile keys, signatures and components against all pairs."""

import random

import numpy as np
import pytest

from quantspark.llm import jaccard
from quantspark.llm.jaccard import Rule

RULE = Rule()


def plain_set(text, size=4):
    words = [w for w in (text or "").encode().lower().split()]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_components(rows, size=4, over=100, under=85):
    """rows: (id, text). Per row id, set size, component."""
    sets = [plain_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and over * common >= under * (len(a) + len(sets[j]) - common):
                root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return sorted(((key, len(sets[i]), least.get(top(i), key)) for i, (key, _) in enumerate(rows)), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[at] = "new%d" % rng.randrange(10**6)
        elif kind == 1:
            words.insert(at, "more%d" % rng.randrange(10**6))
        elif len(words) > 1:
            del words[at]
    return words


def test_linking_sets_share_a_tile_key():
    rng = random.Random(1)
    linked = apart = 0
    for _ in range(4000):
        n = rng.choice([3, 5, 7, 8, 9, 12, 20, 33, 60, 150, 400])
        words = ["w%d" % rng.randrange(5000) for _ in range(n)]
        a, b = (jaccard.shingles(" ".join(x).encode()) for x in (words, edited(rng, words, rng.randrange(1, 2 + n // 25))))
        common = len(np.intersect1d(a, b))
        if RULE.enough(common, len(a) + len(b)):
            linked += not np.array_equal(a, b)
            if not np.array_equal(a, b):
                (x, least_a), (y, least_b) = jaccard.keys(a, RULE), jaccard.keys(b, RULE)
                assert len(np.intersect1d(x, y)) >= max(least_a, least_b) >= 1
        else:
            apart += 1
    assert linked > 500 and apart > 500


def test_sets_in_few_segments_are_not_lost():
    # Shingles of one narrow range of hashes leave nearly all segments empty.
    base = np.arange(1, 101, dtype=np.uint64)
    for drop in (1, 5, 10):
        a, b = base, np.concatenate((base[drop:], np.arange(1000, 1000 + drop // 2, dtype=np.uint64)))
        assert RULE.enough(len(np.intersect1d(a, b)), len(a) + len(b))
        assert len(np.intersect1d(jaccard.keys(a, RULE)[0], jaccard.keys(b, RULE)[0]))


def test_every_linking_pair_of_sizes_has_a_band_with_room():
    starts, most, cuts = jaccard.bands(RULE)
    for a in range(1, 3000):
        band = int(np.searchsorted(starts, a, side="right")) - 1
        assert RULE.apart(a + RULE.largest(a)) <= most[band] < cuts[band]


def test_bit_counts_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 5, 64, 700):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 1 << 63, n).astype(np.uint64))))
        bits = jaccard.bits_for(n)
        differ = np.bitwise_count(jaccard.signature(a, bits) ^ jaccard.signature(b, bits)).sum()
        assert differ <= len(np.setxor1d(a, b))


def test_met_tiles_over_any_batches():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows = np.array(sorted(map(tuple, rng.integers(0, 60, (300, 2)) // [1, 20])))
    want = sorted({(t, n) for t, n in map(tuple, rows.tolist()) if len({m for u, m in rows.tolist() if u == t}) > 1})
    for step in (1, 2, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + step, k]) for k in (0, 1)], ["tile", "node"]) for i in range(0, 300, step)]
        got = [tuple(r.values()) for b in jaccard._met(iter(batches)) for r in b.to_pylist()]
        assert got == want
    assert list(jaccard._met(iter([]))) == []


@pytest.mark.parametrize(("pivots", "block"), [(16, 2048), (1, 3), (2, 5)])
def test_join_equals_all_pairs(spark, docs_of, corpus, monkeypatch, pivots, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    rng = random.Random(12)
    texts = list(corpus)
    for n in (9, 30, 90, 250):  # groups of near copies that are alike in chains
        words = ["v%d" % rng.randrange(3000) for _ in range(n)]
        for _ in range(12):
            texts.append(" ".join(words))
            words = edited(rng, words, max(1, n // 60))
    rng.shuffle(texts)
    rows = [(i if i % 23 else None, t, "en", "a") for i, t in enumerate(texts)] + [(7, texts[7], "en", "a")] * 2
    if block == 3:
        cut = jaccard.links
        monkeypatch.setattr(jaccard, "links", lambda docs, nodes, rule: cut(docs, nodes, rule, by_size=True))
    found = jaccard.join(docs_of(rows))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_components([(i, t) for i, t, _, _ in rows])


def test_five_words_and_four_fifths(spark, docs_of):
    rng = random.Random(13)
    words = ["v%d" % rng.randrange(900) for _ in range(120)]
    texts = [" ".join(edited(rng, words, e % 6)) for e in range(40)]
    found = jaccard.join(docs_of(texts), rule=Rule(5, 4, 5))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_components(list(enumerate(texts)), 5, 5, 4)


def test_empty_tables_and_string_ids(spark, docs_of):
    assert jaccard.join(docs_of([])).count() == 0
    assert sorted(map(tuple, jaccard.join(docs_of([None, "", " "])).collect())) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]
    named = spark.createDataFrame([("b", "t u"), ("a", "t U")], "doc_id string, text string")
    assert sorted(map(tuple, jaccard.join(named).collect())) == [("a", 1, "a"), ("b", 1, "a")]


def test_sketches_leave_every_link_possible():
    rng = random.Random(21)
    sets = []
    for _ in range(60):
        words = ["w%d" % rng.randrange(4000) for _ in range(rng.choice([4, 12, 60, 63, 64, 66, 120, 130, 500]))]
        sets += [jaccard.shingles(" ".join(edited(rng, words, e)).encode()) for e in (0, 1, 2, 5)]
    sets = [s for s in sets if len(s)]
    sketches = [jaccard.sketch(s) for s in sets]
    for found, made in zip(sets, sketches, strict=True):
        assert made[0] == len(found) and 64 * (len(made) - 1) >= len(found)
        for bits in (64, 128, 256):
            if bits <= 64 * (len(made) - 1):
                assert jaccard.folded(made[None, 1:], bits // 64)[0].tolist() == jaccard.signature(found, bits).tolist()
    node = np.array(rng.sample(range(10**6), len(sets)), np.int64)
    both, odd = np.arange(len(sets)), np.arange(len(sets)) % 3 == 0
    place = {v: i for i, v in enumerate(node.tolist())}
    for sides in ([(both, both)], [(both[odd], both[~odd]), (both[~odd], both[odd])]):
        root = list(range(len(sets)))

        def top(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        edges = 0
        for left, right in sides:
            a, b = jaccard.alike(node, node, sketches, RULE, left, right)
            edges += len(a)
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                root[top(place[x])] = top(place[y])
        assert edges <= len(sides) * (len(sets) - 1)
        for i in range(len(sets)):
            for j in range(i):
                if (len(sides) == 1 or odd[i] != odd[j]) and RULE.enough(len(np.intersect1d(sets[i], sets[j])), len(sets[i]) + len(sets[j])):
                    assert top(i) == top(j)


def test_sets_that_only_meet_are_not_shipped(spark, docs_of, monkeypatch):
    """Long texts of one stock of passages meet in tiles; only those that may link send their shingles."""
    rng = random.Random(22)
    stock = [" ".join("s%d" % rng.randrange(5000) for _ in range(8)) for _ in range(60)]
    texts = [" ".join(p for _ in range(50) for p in (rng.choice(stock), "own%d" % rng.randrange(10**6))) for _ in range(40)]
    texts.append(texts[7] + " end")
    shipped = []
    plain = jaccard._needed
    monkeypatch.setattr(jaccard, "_needed", lambda docs, nodes, rule: shipped.append(nodes.select("node").distinct().count()) or plain(docs, nodes, rule))
    found = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs_of(texts)).collect()}
    assert found == {i: 7 if i == 40 else i for i in range(41)}
    assert shipped == [2]
