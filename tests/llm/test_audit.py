"""Filter audit: the transducer and its hash table, failure bits and all orders against plain loops."""

import random
from itertools import permutations

import numpy as np
import pytest

from quantspark.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def plain_profile(text):
    words = (text or "").encode().split()
    t = text or ""
    return {"words": len(words), "different": len(set(words)), "capitals": sum("A" <= c <= "Z" for c in t), "points": len(t), "symbols": sum(c in "#$%&*|" for c in t)}


@pytest.mark.parametrize("most", [1 << 20, 64, 7, 1])
def test_profile_equals_plain_counts(corpus, most):
    texts = [*corpus, "x" * 700 + " " + "x" * 700 + " " + "x" * 699 + "y", "A B A B", "\x1c \x85 \v\f", "ab" * 4 + " " + "ab" * 4 + "c"]
    assert audit.profile([(t or "").encode() for t in texts], most) == [plain_profile(t) for t in texts]


def test_no_texts():
    assert audit.profile([]) == []


def test_spans_with_equal_slots_are_told_apart_by_their_bytes():
    rng = random.Random(3)
    words = [bytes(rng.choices(b"ab", k=rng.randrange(1, 30))) for _ in range(3000)]
    buffer = b" ".join(words) + b" " * 8
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = ends - [len(w) for w in words]
    group = np.array([i % 3 for i in range(len(words))])
    first = audit.first_spans(buffer, begins, ends, group)
    seen, want = set(), []
    for i, w in enumerate(words):
        want.append((i % 3, w) not in seen)
        seen.add((i % 3, w))
    assert first.tolist() == want


def plain_audit(rows, labels):
    """rows: (id, part, text); labels: (id, quality, toxic)."""
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[k] == 1} for k in (1, 2))
    failing = []
    for i, part, text in rows:
        p = plain_profile(text)
        fails = "A" * (p["words"] < 50) + "B" * (100 * p["different"] < 65 * p["words"]) + "C" * (100 * p["capitals"] > 5 * p["points"]) + "D" * (p["symbols"] > 0)
        if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, _, t in rows):
            fails += "E"
        failing.append((i, part or "", fails))
    out = {}
    for part in {p for _, p, _ in failing}:
        mine = [(i, f) for i, p, f in failing if p == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                removed = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                share[letter] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(letter in f for _, f in mine) - len(removed), sum(f == letter for _, f in mine),
                    sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_plain_loops(spark, docs_of, corpus):
    rows = [(i if i % 17 else None, t, "en", [None, "", "a", "b"][i % 4]) for i, t in enumerate(corpus)]
    rows += [(5, corpus[5], "en", "a"), (5, corpus[5], "en", "a"), (900, "Big WORDS # here", None, None)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None)]
    found = audit.audit(docs_of(rows), spark.createDataFrame([(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels], LABELS)).collect()
    want = plain_audit([(i, s, t) for i, t, _, s in rows], labels)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found} == want
    assert len(found) == 3 * 120 * 5
    for r in found:  # what all filters remove does not depend on their order
        assert r.kept + r.removed + r.redundant <= sum(1 for _, _, _, s in rows if (s or "") == r.part)


def test_no_rows_and_string_ids(spark, docs_of):
    labels = spark.createDataFrame([], LABELS)
    assert audit.audit(docs_of([]), labels).count() == 0
    named = spark.createDataFrame([("b", "t", "s"), ("a", "t", "s")], "doc_id string, text string, source string")
    found = audit.audit(named, spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int"))
    first = found.filter("filter_order = 'EABCD' AND step = 1").first()
    assert (first.removed, first.good_lost, first.kept) == (1, 1, 1)
