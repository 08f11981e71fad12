"""Mixing, decontamination, sharding, licenses and the pipeline against plain loops."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantspark.llm import decontamination, licenses, mixing, sharding

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def plain_hits(words, items, window=13):
    hit, found = set(), set()
    for name, item in items:
        k = min(window, len(item))
        wins = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if wins and tuple(words[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(name)
    return len(hit), sorted(found)


def test_decontamination_matches_plain_loops(spark, docs_of, corpus):
    source = [t for t in corpus if t and len(t.split()) > 20]
    items = [(1, " ".join(source[0].split()[3:20])), (2, " ".join(source[1].split()[:13])), (3, "changed"), (10, " ".join(source[0].split()[:5])), (11, "a a a a"),
             (12, None), (13, "?!"), (None, " ".join(source[2].split()[1:15])), (1, " ".join(source[3].split()[2:18])), (4, " ".join(source[0].split()[3:20]))]
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = docs_of(corpus)
    found = decontamination.decontaminate(docs, bench)
    assert found.columns == [*docs.columns, "hit_"]
    coded = [("" if i is None else str(i), words_of(t)) for i, t in items]
    for r in found.collect():
        words = words_of(r["text"])
        assert (r["hit_"]["n_words"], (r["hit_"]["n_hit"], r["hit_"]["items"])) == (len(words), plain_hits(words, coded))
    assert decontamination.decontaminate(docs, bench.limit(0)).filter("hit_.n_hit > 0").count() == 0
    assert decontamination.decontaminate(docs_of([]), bench).count() == 0


def test_decontamination_in_several_blocks(spark, docs_of, corpus, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 5)
    source = [t for t in corpus if t and len(t.split()) > 20]
    items = [(i, " ".join(t.split()[:16])) for i, t in enumerate(source[:6])]
    bench = spark.createDataFrame(items, "item_id int, text string")
    coded = [(str(i), words_of(t)) for i, t in items]
    for r in decontamination.decontaminate(docs_of(corpus[:40]), bench).collect():
        assert (r["hit_"]["n_hit"], r["hit_"]["items"]) == plain_hits(words_of(r["text"]), coded)


def test_cleaned_text_and_coverage_rule(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    docs = docs_of(["Start, one Two three end", "nothing here", None, " ".join(["word"] * 57) + " one two three", " ".join(["word"] * 58) + " one two three"])
    found = decontamination.decontaminate(docs, bench)
    rows = found.select("doc_id", decontamination.cleaned(F.col("text"), F.col("hit_")).alias("c"), decontamination.contaminated(F.col("hit_")).alias("x")).orderBy("doc_id").collect()
    assert [r["c"] for r in rows[:3]] == ["Start end", "nothing here", None]
    assert [r["x"] for r in rows] == [True, False, False, True, False]


def plain_targets(sizes):
    """Share again and again what is above the limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / free for s in names}
        above = {s for s in names if target[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return target
        full |= above


def test_mixing_targets_and_copies(docs_of):
    rows = [(i, " ".join(["w"] * (i % 37)), "en", [None, "b", "a", "é", "Z", "hot", "hot", "hot"][i % 8]) for i in range(2000)]
    rows += [(9000, None, None, "empty"), (9001, "", None, "empty")]
    docs = docs_of(rows)
    found = mixing.copies(docs, mixing.n_words(F.col("text"))).collect()
    sizes, taken = {}, {}
    for r in found:
        m = r["mix_"]
        assert m["size"] == len((r["text"] or "").split())
        assert m["copies"] * m["size"] <= 2 * m["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + m["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + m["copies"] * m["size"]
    want = plain_targets(sizes)
    for r in found:
        assert r["mix_"]["target"] == pytest.approx(want[r["source"]], abs=1e-6) and r["mix_"]["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 0.12 * max(want[s], 1) for s in want)
    again = mixing.copies(docs.repartition(7), mixing.n_words(F.col("text"))).collect()
    assert {r["doc_id"]: r["mix_"]["copies"] for r in again} == {r["doc_id"]: r["mix_"]["copies"] for r in found}
    emitted = mixing.mixed(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r["mix_"]["copies"] for r in found)
    assert mixing.mixed(docs_of([])).count() == 0


def test_sharding_law_groups_and_slots(docs_of, corpus):
    rows = [(i, t, "en", "s") for i, t in enumerate(corpus * 6)] + [(None, "no id", None, None)] * 2 + [(3, corpus[3], "en", "s")] * 5
    got = sharding.sharded(docs_of(rows)).collect()
    assert len(got) == len(rows)
    load, slots = {}, {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(load) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == sorted(
        (i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows
    )
    largest = max(r["size"] for r in got)
    assert max(load.values()) - min(load.values()) <= 2 * largest


def test_sharding_splits_one_huge_group_and_takes_empty_tables(docs_of):
    got = sharding.sharded(docs_of(["same text"] * 800 + ["other"] * 10)).collect()
    load = {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert len(load) == 8 and max(load.values()) < 1.1 * min(load.values())
    assert sharding.sharded(docs_of([])).count() == 0
    assert [r["size"] for r in sharding.sharded(docs_of([None])).collect()] == [1]


def plain_scan(text):
    words = [w.decode() for w in words_of(text)]
    norm = f" {' '.join(words)} "
    places, base = [], set()
    for phrase, label in licenses.BASE:
        q = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(q)] == q]
        places += here
        base |= {label} if here else set()
    found = []
    for r in licenses.rules():
        also = r["also"] in words or r["also"] == licenses.STEM and any(w.startswith(licenses.STEM) for w in words)
        if r["keyword"] in words and also:
            for m in re.finditer(r["regex"], norm):
                begin = norm[: m.start()].count(" ") - 1
                found.append((begin, -(begin + m.group().count(" ") + 1), r["priority"], r["label"], r["confidence"]))
    kept = []
    for d in sorted(found):
        if not any(k[2] <= d[2] and -k[1] >= -d[1] for k in kept):
            kept.append(d)
    score = max([k[4] for k in kept] + [0.8 if places else 0.0])
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {k[3] for k in kept})), score)


def test_license_scan_matches_plain_loops(docs_of, corpus):
    notices = [
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the \"License\")", "mit license mit license MIT LICENSE",
        "This is free software under the GNU General Public License, version 3, or the Mozilla Public License 2.0", "SPDX-License-Identifier: GPL-3.0-or-later OR MIT",
        "Licensed under CC BY-NC 4.0.", "Creative Commons Attribution ShareAlike 3.0", "Copyright (c) 2019 Someone. All rights reserved.", "mit dem Auto", "the apache helicopter",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "Apache license 2.0 apache license", "see the LICENSE file for details", "general public license " * 50,
    ]
    texts = corpus + notices
    scanned = licenses.summary(licenses.scan(docs_of(texts).select("doc_id", "text")))
    rows = {r["doc_id"]: r for r in scanned.collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == plain_scan(t), t
    assert len(licenses.rules()) > 300
    assert licenses.summary(licenses.scan(docs_of([]).select("doc_id", "text"))).count() == 0


def test_license_words_are_a_plain_class_and_rules_see_keywords_only(docs_of, monkeypatch):
    assert not licenses.WORD.startswith("[^")  # Java tests a negated class of ranges an order of magnitude slower
    seen = []
    plain = licenses.detections
    monkeypatch.setattr(licenses, "detections", lambda norm, words: seen.append(words) or plain(norm, words))
    texts = ["\x00a\x7fb_c\x80\U0001f600 \U0010ffff,9", "the MIT license of licen and é words under gpl", None, "..."]
    docs = docs_of(texts).select("doc_id", "text")
    found = {r["doc_id"]: r for r in licenses.summary(licenses.scan(docs)).collect()}
    assert [found[i]["n_words"] for i in range(4)] == [len(words_of(t or "")) for t in texts]
    norm = licenses.normalised(F.lit(texts[1]))
    name = seen[0]._jc.toString()
    assert docs.limit(1).select(norm.alias("n")).first()["n"] == " the mit license of licen and é words under gpl "
    assert name == "found_keywords" and set(licenses.keywords()) >= {"mit", "license", "under", "gpl"} and "of" not in licenses.keywords()


def test_license_scan_loses_no_match_to_its_keywords(docs_of, corpus):
    texts = corpus + [
        "GPL_V2", "GPL_2", "CC_BY_SA_4_0", "ALL_RIGHTS_RESERVED", "copyright_2020", "__Apache_2_0__", "SPDX_0BSD", "SPDX-License-Identifier: 0BSD", "released under the FreeBSD license",
        "0bsd license", "freebsd licence", "see COPYING", "see the licence", "see the copying file for details", "see_the_LICENSE", "écopyright 2020", "copyright 2020é", "mycopyright 2020", "xgpl 2",
    ]
    rows = {r["doc_id"]: r for r in licenses.summary(licenses.scan(docs_of(texts).select("doc_id", "text"))).collect()}
    for i, t in enumerate(texts):
        norm = f" {' '.join(w.decode() for w in words_of(t))} "
        found = []
        for r in licenses.rules():  # every regex, whatever its keywords
            for m in re.finditer(r["regex"], norm):
                begin = norm[: m.start()].count(" ") - 1
                found.append((begin, -(begin + m.group().count(" ") + 1), r["priority"], r["label"], r["confidence"]))
        kept = []
        for d in sorted(found):
            if not any(k[2] <= d[2] and -k[1] >= -d[1] for k in kept):
                kept.append(d)
        base = set(filter(None, rows[i]["base_labels"].split(",")))
        score = max([k[4] for k in kept] + [0.8 if base else 0.0])
        assert (rows[i]["labels"], rows[i]["score"]) == (",".join(sorted(base | {k[3] for k in kept})), score), t
    by_text = {t: rows[i]["labels"] for i, t in enumerate(texts)}
    assert by_text["GPL_2"] == "gpl-2.0" and by_text["CC_BY_SA_4_0"] == "cc-by-sa-4.0" and by_text["copyright_2020"] == "copyright" and by_text["see COPYING"] == "reference"
    assert by_text["0bsd license"] == "bsd-0-clause" and by_text["freebsd licence"] == "bsd-2-clause" and by_text["xgpl 2"] == ""


def test_license_scan_runs_no_python(docs_of):
    plan = licenses.summary(licenses.scan(docs_of(["x"])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_pipeline_stages_keep_their_columns_and_clean_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("language", F.lit("clash")).withColumn("hit", F.lit(1))
    bench = [(str(r["item_id"]), words_of(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        before, after = {r["doc_id"] for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        assert after <= before
        if name == "decontamination":
            for r in docs.collect():
                words = words_of(r["text"])
                hit, _ = plain_hits(words, bench)
                assert (r["doc_id"] in after) == (not (hit and 20 * hit >= len(words)))
        if name == "language":
            assert after == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
        docs = spark.createDataFrame(out.collect(), out.schema)
    shards = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert shards.count() == docs.count()
