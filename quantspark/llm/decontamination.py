"""Benchmark decontamination with a generalised suffix automaton.

All items go into one suffix automaton over word ids. A document streams through it while the length
of the longest match that ends at each word is tracked. Wherever that length reaches the window (13
words; an item with fewer words is one window of its own length) the window's words are hit. Hit spans
are removed from a document whose hits exceed the length limit, and a document whose hits reach the
coverage limit is contaminated.

Defined cases: a null or word-free text has no words, no hits and is clean; an item without words is
ignored; a null item id counts as an empty id; repeated items and ids count once; an empty benchmark
leaves every document clean. Rows of documents are never merged, so repeated ids keep their rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.rows import arrow_column

WINDOW = 13
#: A document is contaminated when hits * COVERAGE >= words.
COVERAGE = 20
#: Words of benchmark text in one broadcast block; more words make more blocks, all of them used.
BLOCK_WORDS = 1_000_000

#: A-Z fold to a-z, 0-9 and all bytes of non-ASCII characters stay, everything else separates.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


class Automaton:
    """Suffix automaton of word sequences with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((name, ids))
            last = 0
            for word in ids:
                last = self._extend(last, word)
        self.whole: dict[int, set[str]] = {}  # items whose full-length window ends in the state
        short: dict[int, dict[int, set[str]]] = {}
        self.least = window
        for name, ids in coded:
            state = 0
            for i, word in enumerate(ids):
                state = self.next[state][word]
                if i + 1 >= window:
                    state_of = self._cut(state)
                    self.whole.setdefault(state_of, set()).add(name)
            if 0 < len(ids) < window:
                short.setdefault(state, {}).setdefault(len(ids), set()).add(name)
                self.least = min(self.least, len(ids))
        # The nearest state at or above each state (over suffix links) that ends a short window.
        self.short = short
        self.short_link = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short_link[state] = state if state in short else self.short_link[self.link[state]] if self.link[state] > 0 else -1
        self._pairs(coded)

    def _cut(self, state: int) -> int:
        """The state of the suffix with exactly ``window`` words."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _clone(self, parent: int, child: int, word: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[child]))
        self.length.append(self.length[parent] + 1)
        self.link.append(self.link[child])
        self.link[child] = copy
        while parent != -1 and self.next[parent].get(word) == child:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, known, word)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        state = last
        while state != -1 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state != -1:
            child = self.next[state][word]
            self.link[new] = child if self.length[child] == self.length[state] + 1 else self._clone(state, child, word)
        return new

    def _pairs(self, coded) -> None:
        """A hashed set of the neighbouring words of items: a walk can only go on through these."""
        size = max(1, len(self.vocabulary))
        pairs = {a * size + b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)}
        bits = max(16, (len(pairs) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.pair_seen = np.zeros(1 << bits, bool)
        if pairs:
            self.pair_seen[self._hash(np.fromiter(pairs, np.int64, len(pairs)))] = True

    def _hash(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def _runs(self, ids: np.ndarray):
        """Stretches of words, at least as long as the shortest window, in which a match is possible."""
        known = ids >= 0
        if self.least == 1:
            edges = np.diff(np.concatenate(([False], known, [False])).astype(np.int8))
            yield from zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)
            return
        if len(ids) < self.least:
            return
        good = known[:-1] & known[1:]
        good &= self.pair_seen[self._hash(np.where(good, ids[:-1] * len(self.vocabulary) + ids[1:], 0))]
        edges = np.diff(np.concatenate(([False], good, [False])).astype(np.int8))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1
        keep = end - begin >= self.least
        yield from zip(begin[keep], end[keep], strict=True)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans (in order, may overlap), items found and the longest match of a document."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        spans, found, longest = [], set(), 0
        follow, link, length, window = self.next, self.link, self.length, self.window
        for begin, end in self._runs(ids):
            state = matched = 0
            for i, word in enumerate(ids[begin:end].tolist(), int(begin)):
                while state and word not in follow[state]:
                    state = link[state]
                    matched = length[state]
                if word in follow[state]:
                    state, matched = follow[state][word], matched + 1
                if matched > longest:
                    longest = matched
                if matched >= window:
                    spans.append((i + 1 - window, i + 1))
                    found |= self.whole[self._cut(state)]
                at = self.short_link[state]
                while at != -1:
                    for k, names in self.short[at].items():
                        if k <= matched:
                            spans.append((i + 1 - k, i + 1))
                            found |= names
                    at = self.short_link[link[at]] if link[at] > 0 else -1
        return spans, found, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _blocks(benchmark: DataFrame, item: str, text: str) -> list:
    """Broadcast the items in blocks of about BLOCK_WORDS words each; usually one block."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-size // (6 * BLOCK_WORDS)))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    return [
        spark.sparkContext.broadcast(sorted({(r["item"], r["text"].encode()) for r in items.filter(part == b).collect()}))
        for b in range(count)
    ]


def hits(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", item_text: str = "text"):
    """A Column function: text -> struct(n_words, n_hit, longest, items, spans).

    ``items`` are the ids of items with an occurring window, sorted as strings; ``spans`` are the hit
    word ranges (begin, end), merged and in order.
    """
    blocks = _blocks(benchmark, item, item_text)
    built: dict[int, Automaton] = {}  # of this task; one automaton is in memory at a time

    def automaton_of(number: int) -> Automaton:
        if number not in built:
            built.clear()
            built[number] = Automaton([(name, item.translate(FOLD).split()) for name, item in blocks[number].value], window)
        return built[number]

    def scan(texts: list[bytes]) -> list[dict]:
        split = [t.translate(FOLD).split() for t in texts]
        results = [([], set(), 0)] * len(texts)
        for number in range(len(blocks)):
            automaton = automaton_of(number)
            for i, words in enumerate(split):
                spans, found, longest = automaton.scan(words)
                before = results[i]
                results[i] = (before[0] + spans, before[1] | found, max(before[2], longest)) if spans or longest > before[2] else before
        out = []
        for words, (spans, found, longest) in zip(split, results, strict=True):
            spans = merged(spans)
            out.append({
                "n_words": len(words), "n_hit": sum(e - b for b, e in spans), "longest": longest, "items": sorted(found),
                "spans": [{"begin": int(b), "end": int(e)} for b, e in spans],
            })
        return out

    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(span))])
    return arrow_column(
        scan, "n_words long, n_hit long, longest long, items array<string>, spans array<struct<begin:long,end:long>>", kind
    )


def contaminated(hit: Column, coverage: int = COVERAGE) -> Column:
    """The coverage rule on the struct that :func:`hits` makes."""
    return (hit["n_hit"] > 0) & (hit["n_hit"] * coverage >= hit["n_words"])


def cleaned(text: Column, hit: Column, most: int = 0) -> Column:
    """The text without hit spans of more than ``most`` words, its other words joined by spaces.

    A text without such spans is returned as it is.
    """
    spans = F.filter(hit["spans"], lambda s: s["end"] - s["begin"] > most)
    words = F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    kept = F.filter(words, lambda w, i: ~F.exists(spans, lambda s: (s["begin"] <= i) & (i < s["end"])))
    return F.when(F.size(spans) > 0, F.array_join(kept, " ")).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with one more column ``hit``; its name gets underscores if ``docs`` has that column."""
    from quantspark.llm.rows import fresh

    return docs.withColumn(fresh(docs, "hit"), hits(benchmark, window)(F.col(text)))
