"""SimHash components, suffix-array removal and syncmer fingerprints against plain loops."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quantspark.llm import similar, simhash, suffix_array, syncmers
from quantspark.llm.components import components


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=3):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash_matches_plain_loops(docs_of, corpus):
    texts = corpus[:110]
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(texts)).collect()}
    prints = [plain_print(t) for t in texts]
    assert [rows[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == prints
    assert [rows[i]["component_id"] for i in range(len(texts))] == plain_groups(prints)


def test_covering_masks_miss_no_pair():
    rng = np.random.default_rng(3)
    for level in range(simhash.LEVELS):
        masks = simhash.masks(level)
        for _ in range(300):
            bits = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(bits & (m & (2**64 - 1)) == 0 for m in masks)


@pytest.mark.parametrize("bound", [4096, 3])
def test_links_also_beyond_the_bucket_bound(spark, bound):
    rng = np.random.default_rng(1)
    prints = []
    for _ in range(12):
        centre = int(rng.integers(0, 2**63)) << 1
        for _ in range(25):
            prints.append(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)))
    prints = sorted(set(prints))
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), bound=bound)
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    label = plain_groups(prints)
    by_root, by_label = {}, {}
    for (s,), group in zip(signed, label, strict=True):
        by_root.setdefault(roots.get(s, s), set()).add(s)
        by_label.setdefault(group, set()).add(s)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_label.values()))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(41)) and all(roots[100 + i] == 100 for i in range(30))


def test_one_row_of_each_group_stays(docs_of, corpus):
    texts = corpus[:110]
    docs = docs_of(texts).union(docs_of(texts[:3]))  # repeated rows
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(plain_groups([plain_print(t) for t in texts])))


def plain_similar(texts):
    """Components of the texts whose five-word shingles have a Jaccard similarity of at least 0.8."""
    sets = []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    pairs = {(i, j): len(a & sets[j]) / len(a | sets[j]) for i, a in enumerate(sets) for j in range(i)}
    label = list(range(len(texts)))
    for (i, j), value in pairs.items():
        if value >= 0.8:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return label, [v for v in pairs.values() if v > 0]


def edited(rng, text, edits):
    words = text.split(" ")
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def test_pipeline_stage_finds_every_pair_of_similarity_four_fifths(spark, docs_of, corpus):
    rng = random.Random(8)
    texts = list(corpus)
    for i in range(40):  # one to four edits in texts of about 130 words: similarities on both sides of 0.8
        words = " ".join(f"{rng.choice('bcdfg')}{rng.randrange(400)}" for _ in range(rng.randrange(90, 170)))
        texts += [words, edited(rng, words, 1 + i % 4), edited(rng, words, 1 + i % 3)]
    hub = " ".join(f"h{rng.randrange(500)}" for _ in range(150))
    texts += [edited(rng, hub, 2) for _ in range(40)]  # a large group of near copies
    chain = [f"c{k}" for k in range(60)]
    texts += [" ".join(chain[4 * i : 4 * i + 44]) for i in range(5)]  # each similar to the next only
    rng.shuffle(texts)
    label, values = plain_similar(texts)
    assert sum(0.8 <= v <= 0.95 for v in values) > 100 and sum(0.7 <= v < 0.8 for v in values) > 10
    docs = docs_of(texts)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r["doc_id"] for r in stage(spark, docs.union(docs.limit(3)), "").collect()) == sorted(set(label))
    assert stage(spark, docs_of([]), "").count() == 0


def test_near_fingerprints_are_candidates(spark):
    rows = [(1, 0), (2, 0), (3, 7), (4, 1 << 40), (5, -1), (6, 15), (7, -1)]
    found = similar.near(spark.createDataFrame([(n, 10, fp) for n, fp in rows] + [(8, 99, 0)], "node long, n long, fp long")).collect()
    parent = {n: n for n, _ in rows}
    for a, b in found:
        old, new = parent[a], parent[b]
        parent = {n: new if r == old else r for n, r in parent.items()}
    groups = {}
    for n, r in parent.items():
        groups.setdefault(r, set()).add(n)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4, 6], [5, 7]]  # 0-7 three bits, 0-2**40 one, 7-15 one


def plain_removed(texts, length=50):
    data = [(t or "").encode() for t in texts]
    first = {}
    for i, x in enumerate(data):
        for p in range(len(x) - length + 1):
            first.setdefault(x[p : p + length], i)
    out = []
    for i, x in enumerate(data):
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if first[x[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("local", [48, 1])
def test_suffix_array_matches_plain_loops(docs_of, corpus, local, monkeypatch):
    monkeypatch.setattr(suffix_array, "LOCAL", local)  # with 1 nearly every anchor is hot
    monkeypatch.setattr(suffix_array, "BUCKET_BYTES", 4096)
    result, kept = suffix_array.without_repeats(docs_of(corpus))
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result.collect()}
    assert [rows[i] for i in range(len(corpus))] == plain_removed(corpus)
    for r in kept.collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == rows[r["doc_id"]][3]


def test_two_stage_order_is_the_suffix_order():
    rng = np.random.default_rng(2)
    for text in (b"banana" * 3, b"aaaa", bytes(rng.integers(0, 3, 200, np.uint8)), bytes(rng.integers(0, 256, 300, np.uint8))):
        u = np.frombuffer(text + bytes([255]) + bytes(suffix_array.PAD), np.uint8)
        n = len(text)
        smaller = np.array([bytes(u[i:]) < bytes(u[i + 1 :]) for i in range(len(u))])
        need = np.arange(len(u)) < n  # the last of them is smaller than its successor
        order = suffix_array.two_stage(u, need, smaller)
        got = [bytes(u[i : i + suffix_array.PAD]) for i in order]
        assert got == sorted(got) and sorted(order) == list(range(n))


def test_syncmers_match_plain_loops(docs_of, corpus):
    texts = [t or "" for t in corpus]
    rows = {r["doc_id"]: r for r in syncmers.compare_with_next(docs_of(corpus)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == t:
            assert r["fingerprint"] == r["edited_fingerprint"] and r["near_edited"] == 1
        assert r["fingerprint"] == rows[texts.index(t)]["fingerprint"]
    long = [rows[i] for i, t in enumerate(texts) if len(t) > 400 and len(set(t)) > 3]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.3


def test_anchors_move_with_their_passage_and_leave_no_gap():
    text = b"the quick brown fox jumps over the lazy dog and runs through the quiet forest at night"
    _, here, hashes = syncmers.anchors_of([text])
    _, there, moved = syncmers.anchors_of([b"some other beginning " + text])
    found = dict(zip(moved.tolist(), there.tolist(), strict=True))
    assert all(found[h] - p == 21 for h, p in zip(hashes.tolist(), here.tolist(), strict=True))
    assert max(np.diff(here)) <= syncmers.K - syncmers.S


def test_blocks_find_every_follower(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(syncmers, "BLOCK_BYTES", 500)
    texts = [t or "" for t in corpus]
    rows = {r["doc_id"]: r["edited_sha256"] for r in syncmers.compare_with_next(docs_of(corpus)).collect()}
    for i, t in enumerate(texts):
        edited = syncmers.edited(t, texts[(i + 1) % len(texts)])
        assert rows[i] == hashlib.sha256(edited.encode()).hexdigest()


def test_empty_tables(docs_of):
    none = docs_of([])
    assert simhash.near_duplicates(none).count() == 0
    assert suffix_array.without_repeats(none)[0].count() == 0
    assert syncmers.compare_with_next(none).count() == 0
    assert simhash.one_of_each(none).count() == 0


def test_null_ids_and_repeated_rows(docs_of):
    long = "one two three four five six seven eight nine ten eleven twelve"
    docs = docs_of([(None, long, "en", "s"), (None, long, "en", "s"), (4, long, "en", "s"), (4, long, "en", "s"), (5, None, None, None)])
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()) == [(-1, 4), (-1, 4), (4, 4), (4, 4), (5, 5)]
    removed = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffix_array.without_repeats(docs)[0].collect())
    assert removed == [(-1, len(long)), (-1, len(long)), (4, 0), (4, 0), (5, 0)]
    assert syncmers.compare_with_next(docs).count() == 5


def test_suffix_array_looks_up_many_texts_and_segments_at_once():
    rng = np.random.default_rng(5)
    flags = [rng.random(n) < 0.6 for n in (0, 1, 7, 0, 40, 3)]
    number, begin, end = suffix_array._runs(flags)
    plain = [(i, m.start(), m.end()) for i, f in enumerate(flags) for m in re.finditer("1+", "".join("01"[int(x)] for x in f))]
    assert list(zip(number.tolist(), begin.tolist(), end.tolist(), strict=True)) == plain
    assert [len(x) for x in suffix_array._runs([])] == [0, 0, 0]

    owner = np.repeat(np.arange(6), [3, 0, 5, 40, 1, 9])
    hashes = rng.integers(0, 12, len(owner)).astype(np.uint64)
    told = {k: [rng.integers(0, 12, n).astype(np.uint64).tobytes() for n in rng.integers(0, 5, 6)] for k in (suffix_array.COMPARE, suffix_array.HOT, suffix_array.REPEATED)}
    want = []
    for t, h in zip(owner.tolist(), hashes, strict=True):
        want.append(next((k for k in reversed(told) if h.tobytes() in [told[k][t][i : i + 8] for i in range(0, len(told[k][t]), 8)]), -1))
    assert suffix_array._status(owner, hashes, told).tolist() == want
    assert suffix_array._status(owner[:0], hashes[:0], {k: [] for k in told}).tolist() == []


def test_suffix_array_replies_are_blocks_not_rows_per_text(docs_of, monkeypatch):
    """What buckets answer comes in a row per pair of buckets, whatever the number of texts."""
    made = []
    plain = suffix_array._answer
    monkeypatch.setattr(suffix_array, "_answer", lambda replies: made.append(replies) or plain(replies))
    rng = random.Random(3)
    shared = ["".join(rng.choices("abcdefgh ", k=80)) for _ in range(12)]
    docs = docs_of([" ".join(rng.sample(shared, 6)) + str(i) for i in range(60)])
    suffix_array.without_repeats(docs)
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    sent = rows.mapInArrow(suffix_array._send_runs(5), suffix_array.BLOCK_SCHEMA)
    replies = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(plain(2), suffix_array.REPLY_SCHEMA)
    assert made == [1] and 0 < replies.count() <= 5 * 2
    found = replies.repartition("reply").sortWithinPartitions("reply").mapInArrow(suffix_array._learned, suffix_array.LEARNED_SCHEMA).collect()
    assert len(found) == len({(r["doc_id"], r["mark"]) for r in found}) >= 50
    assert all(len(r[k]) % 8 == 0 for r in found for k in ("repeated", "compare", "hot"))


def test_suffix_array_blocks_do_not_carry_long_marks_and_ids():
    """What a block tells of a text takes few bytes once compressed: at size each text is in many blocks."""
    rng = np.random.default_rng(6)
    for values in (np.zeros(0, np.int64), np.array([5, -3, suffix_array.NO_ID, -suffix_array.NO_ID - 1, 7]), np.sort(rng.integers(0, 1 << 40, 99)), rng.integers(0, 1 << 32, 50).astype(np.uint32)):
        assert suffix_array._of_steps(suffix_array._steps(values), values.dtype.type).tolist() == values.tolist()
        assert suffix_array._of_planes(suffix_array._planes(values), values.dtype.type).tolist() == values.tolist()
    texts = [("".join(map(chr, rng.integers(97, 123, 60)))).encode() for _ in range(400)]
    marks = rng.integers(-(1 << 63), 1 << 63, 400)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(400) + 10**9), pa.array(marks), pa.array(texts, pa.binary())], ["doc_id", "mark", "text"])
    for sent in suffix_array._send_runs(1)(iter([batch])):
        row = next(r for r in sent.to_pylist() if r["kind"] == suffix_array.ENTRY)
        assert len(pa.compress(row["ids"] + row["marks"], "lz4", asbytes=True)) < 5 * 400


def test_suffix_array_tells_rows_of_one_id_apart(docs_of, monkeypatch):
    monkeypatch.setattr(suffix_array, "SHORT", 0)  # rows of one id learn together
    rng = random.Random(9)
    part = lambda: "".join(rng.choices("abcdefgh ", k=70))
    shared = [part() for _ in range(4)]
    rows = [(1, shared[0] + part()), (2, shared[0] + shared[1]), (2, part() + shared[1] + shared[2]), (3, shared[2] + part()), (None, shared[3] + part()), (None, shared[3] + shared[1]), (4, shared[3]), (3, shared[0] + shared[1])]
    found = suffix_array.without_repeats(docs_of([(*r, "en", "s") for r in rows]))[0].collect()
    data, windows = [(r[0] if r[0] is not None else 99, r[1]) for r in rows], {}
    for key, x in data:
        for p in range(len(x) - 49):
            windows[x[p : p + 50]] = min(windows.get(x[p : p + 50], 99), key)
    want = []
    for key, x in data:
        gone = {q for p in range(len(x) - 49) if windows[x[p : p + 50]] < key for q in range(p, p + 50)}
        want.append((key, len(x), len(gone), hashlib.sha256("".join(c for p, c in enumerate(x) if p not in gone).encode()).hexdigest()))
    assert sorted((99 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in found) == sorted(want)
