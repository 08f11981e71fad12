"""Ranked lexical search: the best documents of every query by summed term impacts, found without scoring them all.

A task indexes its documents in blocks. A block has one posting list per query term, in ascending order of
documents, with the impact of the term in each document, and over every list a sparse table that answers "where
is the largest impact between these two postings?" in two look-ups. A search starts with the interval of all
documents of the block. The bound of an interval is the sum over the query's terms of their largest impact in it;
the interval with the highest bound goes next. It is split at the document that holds the largest single impact:
that document is scored exactly, and what lies left and right of it become two intervals with bounds of their
own. A search ends when no interval can beat the worst of the best documents found. Several intervals of all
queries of a block are split in one numpy step.

Documents are read twice: once for the statistics (documents with a term, their length, documents of every query
term), which are sums over tasks, and once to index and search. A task keeps the best documents of each query from
block to block, so later blocks are cut off sooner; the lists of tasks meet in a top-k per query, cut before the
shuffle. Queries are taken in blocks of at most QUERY_TERMS terms; a block of queries is what is broadcast.

Defined cases: a null or term-free document has no terms, counts in no statistic and is never found; a query
without terms finds nothing; equal scores go by ascending id, null ids last, equal ids in any order; repeated rows
of documents are documents of their own; repeated (id, text) rows of queries are one query, equal ids with other
texts are queries of their own; no documents, no results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.rows import steps, to_bytes

BEST = 10
#: Terms of queries that one pass over the documents takes; more make more passes, all of them made.
QUERY_TERMS = 1_000_000
#: Postings of one block of documents; a sparse table has about twenty numbers for each.
POSTINGS = 500_000
#: Intervals of one query that are split at once.
SPLITS = 64

#: A-Z fold to a-z, 0-9 and all bytes of non-ASCII characters stay, everything else separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def impact(weights: np.ndarray, tf: np.ndarray, size: np.ndarray, docs: int, words: int) -> np.ndarray:
    """Weight times saturated frequency, all in 64-bit whole numbers."""
    norm = 100 - 75 + (75 * size * docs) // words
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm))


class Postings:
    """Posting lists of a block, one after the other, with a range-maximum table over each.

    ``term`` and ``doc`` are sorted by (term, doc); ``value`` is the impact. Places are positions in these arrays.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, terms: int, docs: int):
        self.value, self.doc, self.docs = value, doc, docs
        self.bounds = np.searchsorted(term, np.arange(terms + 1))
        self.order = term * (docs + 1) + doc
        longest = int(np.diff(self.bounds).max(initial=1))
        n = len(doc)
        self.table = np.empty((max(1, longest.bit_length()), n), np.int32)
        self.table[0] = np.arange(n)
        for level in range(1, len(self.table)):
            # A window that runs over the end of its list holds garbage and is never asked for.
            left = self.table[level - 1]
            right = left[np.minimum(np.arange(n) + (1 << (level - 1)), n - 1)]
            self.table[level] = np.where(value[right] > value[left], right, left)

    def place(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The first posting of a term at or after a document."""
        return np.searchsorted(self.order, term * (self.docs + 1) + doc)

    def largest(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The posting of the largest impact in begin:end (the first of several); begin < end."""
        level = np.frexp((end - begin).astype(np.float64))[1] - 1
        a, b = self.table[level, begin], self.table[level, end - (1 << level)]
        return np.where(self.value[b] > self.value[a], b, a)


class Best:
    """The best documents of every query so far: score descending, then rank of the id ascending."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(queries)]  # (-score, id rank)

    def worst(self, query: int) -> tuple[int, int]:
        """What a document has to precede; any score above 0 does at first."""
        held = self.found[query]
        return held[-1] if len(held) == self.k else (0, -1)

    def add(self, query: int, new: list[tuple[int, int]]) -> None:
        self.found[query] = sorted(self.found[query] + new)[: self.k]


def search(postings: Postings, query: int, terms: np.ndarray, times: np.ndarray, base: int, best: Best) -> int:
    """Best-first over document intervals of one block; documents rank as ``base`` plus their number.

    Returns how many documents were scored.
    """
    def bounded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the intervals first:last (documents): bound, document of the largest impact."""
        n, t = len(first), len(terms)
        begin = postings.place(np.tile(terms, n), np.repeat(first, t))
        end = postings.place(np.tile(terms, n), np.repeat(last, t))
        some = begin < end
        at = postings.largest(begin[some], end[some])
        most = np.zeros(n * t, np.int64)
        most[some] = postings.value[at] * np.tile(times, n)[some]
        doc = np.zeros(n * t, np.int64)
        doc[some] = postings.doc[at]
        most, doc = most.reshape(n, t), doc.reshape(n, t)
        return most.sum(1), doc[np.arange(n), most.argmax(1)]

    def exact(docs: np.ndarray) -> np.ndarray:
        n, t = len(docs), len(terms)
        key, doc = np.tile(terms, n), np.repeat(docs, t)
        at = np.minimum(postings.place(key, doc), len(postings.doc) - 1)
        there = postings.order[at] == key * (postings.docs + 1) + doc
        return np.where(there, postings.value[at] * np.tile(times, n), 0).reshape(n, t).sum(1)

    if not len(terms):
        return 0
    first, last = np.zeros(1, np.int64), np.full(1, postings.docs, np.int64)
    bound, split = bounded(first, last)
    scored = 0
    while True:
        least, rank = best.worst(query)
        # An interval of the bound that the worst has can only hold equals; those count with a smaller id.
        keep = (bound > 0) & ((bound > -least) | ((bound == -least) & (base + first < rank)))
        first, last, bound, split = first[keep], last[keep], bound[keep], split[keep]
        if not len(bound):
            return scored
        go = np.lexsort((first, -bound))[:SPLITS]
        score = exact(split[go])
        scored += len(go)
        best.add(query, [(-int(s), base + int(d)) for s, d in zip(score, split[go], strict=True) if s > 0])
        new_first = np.concatenate((first[go], split[go] + 1))
        new_last = np.concatenate((split[go], last[go]))
        some = new_first < new_last
        new_first, new_last = new_first[some], new_last[some]
        new_bound, new_split = bounded(new_first, new_last) if some.any() else (bound[:0], split[:0])
        rest = np.ones(len(bound), bool)
        rest[go] = False
        first, last = np.concatenate((first[rest], new_first)), np.concatenate((last[rest], new_last))
        bound, split = np.concatenate((bound[rest], new_bound)), np.concatenate((split[rest], new_split))


def _counted(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Terms of a text, and the query terms among them with their counts."""
    words = terms_of(text)
    ids = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
    term, tf = np.unique(ids[ids >= 0], return_counts=True)
    return len(words), term, tf


def _blocks(queries: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The distinct queries (id, terms) in blocks of bounded size, one at a time."""
    asked = queries.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-size // (6 * QUERY_TERMS)))
    for block in range(count):
        part = asked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == block)
        yield [(r["id"], terms_of(r["text"].encode())) for r in part.collect()]


def _statistics(docs: DataFrame, vocabulary) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, documents of every query term (by number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(vocabulary.value), np.int64)
        with_terms = words = 0
        for batch in batches:
            for _, part in steps(to_bytes(batch.column(0))):
                for text in part:
                    n, term, _ = _counted(text, vocabulary.value)
                    held[term] += 1
                    words += n
                    with_terms += n > 0
        some = np.flatnonzero(held)
        numbers = np.concatenate((some, [-1, -2]))
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.concatenate((held[some], [with_terms, words])))], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row per query term
    counts = {r["term"]: r["n"] for r in found}
    return counts.pop(-1, 0), counts.pop(-2, 0), counts


def _searched(vocabulary, asked, docs_total: int, words_total: int, k: int):
    """mapInArrow over (text, id), ids ascending: rows (query, id, score), the best of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = asked.value
        best = Best(len(queries), k)
        ids: list[pa.Array] = []  # of the found documents only, after each block
        base = 0

        def block(terms, tfs, sizes, names) -> None:
            nonlocal base, ids
            if not sizes:
                return
            per = np.fromiter(map(len, terms), np.int64, len(terms))
            term, tf = np.concatenate(terms), np.concatenate(tfs)
            doc = np.repeat(np.arange(len(sizes)), per)
            value = impact(weights[term], tf, np.repeat(np.array(sizes, np.int64), per), docs_total, words_total)
            some = value > 0
            term, doc, value = term[some], doc[some], value[some]
            if len(term):
                order = np.lexsort((doc, term))
                postings = Postings(term[order], doc[order], value[order], len(weights), len(sizes))
                for q, (numbers, times) in enumerate(queries):
                    search(postings, q, numbers, times, base, best)
            # Only the ids of documents that are among the best stay.
            held = sorted({rank for found in best.found for _, rank in found})
            known = pa.concat_arrays([*ids, *names])
            have = np.concatenate([np.array(kept, np.int64), np.arange(base, base + len(sizes))])
            at = np.searchsorted(have, held)
            ids, base = [known.take(pa.array(at))], base + len(sizes)
            kept[:] = held

        kept: list[int] = []
        terms, tfs, sizes, names, total = [], [], [], [], 0
        for batch in batches:
            for start, part in steps(to_bytes(batch.column(0))):
                for text in part:
                    n, term, tf = _counted(text, vocabulary.value)
                    terms.append(term)
                    tfs.append(tf)
                    sizes.append(n)
                    total += len(term)
                names.append(batch.column(1).slice(start, len(part)))
                if total >= POSTINGS:
                    block(terms, tfs, sizes, names)
                    terms, tfs, sizes, names, total = [], [], [], [], 0
        block(terms, tfs, sizes, names)
        rows = [(q, rank, -low) for q, found in enumerate(best.found) for low, rank in found]
        if rows:
            q, rank, score = zip(*rows, strict=True)
            at = np.searchsorted(np.array(kept, np.int64), rank)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), ids[0].take(pa.array(at)), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    return run


def search_all(docs: DataFrame, queries: DataFrame, k: int = BEST, text: str = "text", key: str = "doc_id", query_text: str = "text", query_key: str = "item_id") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` best documents of every query."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(key).alias("doc_id"))
    id_type = dict(rows.dtypes)["doc_id"]
    name_type = queries.schema[query_key].dataType
    answers = None
    for asked in _blocks(queries, query_key, query_text):
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in asked for t in terms))}
        shared = spark.sparkContext.broadcast(vocabulary)
        docs_total, words_total, holding = _statistics(rows, shared)
        weights = np.array([weight(docs_total, holding[i]) if i in holding else 0 for i in range(len(vocabulary))], np.int64)
        counted = []
        for _, terms in asked:
            numbers, times = np.unique(np.array([vocabulary[t] for t in terms], np.int64), return_counts=True)
            counted.append((numbers[weights[numbers] > 0], times[weights[numbers] > 0]))
        sent = spark.sparkContext.broadcast((weights, counted))
        ordered = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_last())
        found = ordered.mapInArrow(_searched(shared, sent, docs_total, max(1, words_total), k), f"query long, doc_id {id_type}, score long")
        top = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(asked)], f"query long, item_id {name_type.simpleString()}")
        part = found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # a block of queries at most
        answers = part if answers is None else answers.unionByName(part)
    return answers
