import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hit string, mix string, language string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts (ids 0, 1, ...) or (id, text, lang, source) rows, with extra columns of clashing names."""

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r, "en", f"s{i % 3}")
            full.append((*r, None if r[1] is None else len(r[1]), "x", "y", "z"))
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empty, odd and long texts."""
    rng = random.Random(5)
    words = [rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice(["", "a", "ing", "é"]) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 5, 40, 120]))) for _ in range(60)]
    passage = " ".join(rng.choices(words, k=30))
    for i in range(0, 60, 4):
        at = rng.randrange(len(texts[i]) + 1)
        texts[i] = texts[i][:at] + passage + texts[i][at:]
    texts += texts[:5] * 3
    for i in range(20, 30):
        parts = texts[i].split(" ")
        parts[len(parts) // 2] = "changed"
        texts.append(" ".join(parts))
    texts += [None, "", "", "   \t\n", "a", "a" * 300, "a" * 300 + "b", "ab" * 100, "Ünï cödé ümläut " * 12, "x\x00y\x1cz  w", "!!! ??? ...", "12 34", passage, passage + "!", None]
    texts.append(" ".join(rng.choices(words, k=6000)))
    return texts
