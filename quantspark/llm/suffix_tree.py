"""Language-model scores from a probabilistic suffix tree over words.

Contexts are sequences of up to DEPTH preceding words. With N training tokens, a context is a candidate if it occurs at
least CONTEXT_RATE * sqrt(N) times (140 times in a million tokens, 9,900 times in five thousand million), and it becomes
a state if its next words diverge from those of its longest suffix state: the gain in log likelihood must exceed what as
many free parameters gain by chance. A state keeps the next words that follow at least ENTRY_RATE * sqrt(N) times; the
rest of its mass, and a constant, goes to its suffix state, whose probabilities it smooths with, down to the root. The
root has (c + 0.1) / (N + 0.1 (V + 1)). A token is scored in the longest state that ends before it.

So the model grows with the corpus, with the square root of its tokens: at most sqrt(N) / HOT_RATE words,
sqrt(N) / CONTEXT_RATE contexts and sqrt(N) / ENTRY_RATE next words a level are broadcast. The table of all words
grows with the corpus itself; it is shuffled, never collected. Words outside the broadcast vocabulary get their
counts by a join, and each of them is a small share of all training tokens, so that join has no hot key.

Defined cases: null is empty; an empty text has one token, its end; without training rows every
probability is that of an empty count (log 0); rows with equal id and text share one score each; ids may be of any type that casts to text and back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.rows import shared_table, steps, to_bytes

DEPTH = 3
HOT_RATE = 0.02
CONTEXT_RATE = 0.14
ENTRY_RATE = 0.02
SMOOTH = 2.0
#: Entries of a task's local counts before they are sent on.
FLUSH = 400_000
END = b""  # no word is empty


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z only; separators are space and \t to \r


def least(rate: float, tokens: int) -> float:
    """Occurrences that ``rate`` asks for among ``tokens`` tokens; once is never enough."""
    return max(2.0, rate * float(tokens) ** 0.5)


def _counted(pairs: dict | Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.binary()), pa.array(list(pairs.values()), pa.int64())], ["word", "n"])


def count_words(texts: DataFrame) -> DataFrame:
    """word -> count over all texts (one column, ``text``), the end of each text included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in to_bytes(batch.column(0)):
                held.update(words_of(text))
                held[END] += 1
                if len(held) > FLUSH:
                    yield _counted(held)
                    held = Counter()
        if held:
            yield _counted(held)

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Level:
    """Contexts of one length. ``codes`` name them: shorter context's number * width + word, in order."""

    codes: np.ndarray
    count: np.ndarray = field(default_factory=lambda: np.zeros(0))
    state: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0))
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    entry_count: np.ndarray = field(default_factory=lambda: np.zeros(0))


def find(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in a sorted array, -1 where it is not."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


class Tree:
    """Vocabulary 0..hot-1 (the end among them), start = hot, everything else -1."""

    def __init__(self, vocabulary: list[bytes], counts: np.ndarray, tokens: int, distinct: int, texts: int):
        self.vocabulary, self.counts, self.tokens, self.distinct, self.texts = vocabulary, counts, tokens, distinct, texts
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.start, self.end = len(vocabulary), self.number.get(END, -2)
        self.width = len(vocabulary) + 2
        self.levels: list[Level] = []

    def plain(self) -> tuple:
        """Built-in values and arrays only, for a broadcast."""
        own = [(x.codes, x.count, x.state, x.kept, x.entries, x.entry_count) for x in self.levels]
        return self.vocabulary, self.counts, self.tokens, self.distinct, self.texts, own

    def divisor(self) -> float:
        return self.tokens + 0.1 * (self.distinct + 1)

    def root(self, ids: np.ndarray) -> np.ndarray:
        return (np.where(ids >= 0, self.counts[np.clip(ids, 0, max(len(self.counts) - 1, 0))] if len(self.counts) else 0.0, 0.0) + 0.1) / self.divisor()

    def sequence(self, words: list[bytes]) -> np.ndarray:
        """Start, words, end; the end is -2 if training had no text."""
        ids = np.empty(len(words) + 2, np.int64)
        ids[0], ids[-1] = self.start, self.end
        ids[1:-1] = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        return ids

    def contexts(self, ids: np.ndarray) -> list[np.ndarray]:
        """Per level: the number of the context that ends at each place, or -1."""
        out: list[np.ndarray] = []
        for level in self.levels:
            if not out:
                codes = ids
            else:
                before = np.concatenate(([-1], out[-1][:-1]))
                codes = np.where((before >= 0) & (ids >= 0) & (ids != self.start), before * self.width + ids, -1)
            out.append(find(level.codes, codes))
        return out

    def probabilities(self, before: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word after its contexts: the probability (vocabulary), the log weight of the root (others)."""
        p, weight = self.root(words), np.zeros(len(words))
        for level, context in zip(self.levels, before, strict=True):
            at = np.flatnonzero(context >= 0)
            at = at[level.state[context[at]]] if len(at) else at
            if not len(at):
                continue
            c = context[at]
            entry = find(level.entries, np.where(words[at] >= 0, c * self.width + words[at], -1))
            seen = np.where(entry >= 0, level.entry_count[np.maximum(entry, 0)] if len(level.entries) else 0.0, 0.0)
            rest = level.count[c] - level.kept[c] + SMOOTH
            total = level.count[c] + SMOOTH
            p[at] = (seen + rest * p[at]) / total
            weight[at] += np.log10(rest / total)
        return p, weight


def tree_of(plain: tuple) -> Tree:
    tree = Tree(*plain[:5])
    tree.levels = [Level(*x) for x in plain[5]]
    return tree


def _joined(tree: Tree, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    split = [words_of(t) for t in texts]
    parts = [tree.sequence(w) for w in split]
    return np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts]), split


def _follow_counts(texts: DataFrame, tree: Tree) -> DataFrame:
    """code -> count of (context of the last level, next vocabulary word) over all texts."""
    sent = texts.sparkSession.sparkContext.broadcast(tree.plain())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree_of(sent.value)
        held: list[np.ndarray] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

        for batch in batches:
            for _, part in steps(to_bytes(batch.column(0))):
                ids, _, _ = _joined(own, part)
                last = own.contexts(ids)[-1][:-1]
                word = ids[1:]
                ok = (last >= 0) & (word >= 0) & (word != own.start)
                held.append(last[ok] * own.width + word[ok])
                size += int(ok.sum())
                if size > 8 * FLUSH:
                    yield flushed()
                    held, size = [], 0
        if size:
            yield flushed()

    return texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _states(tree: Tree, level: Level, codes: np.ndarray, counts: np.ndarray) -> None:
    """Fill the level from its entries and test every context's divergence from its longest suffix state."""
    order = np.argsort(codes)
    level.entries, level.entry_count = codes[order], counts[order].astype(float)
    context, word = level.entries // tree.width, level.entries % tree.width
    level.kept = np.bincount(context, level.entry_count, len(level.codes))
    level.state = np.zeros(len(level.codes), bool)
    if not len(context):
        return
    # The suffix of a context, without its first word, one context number per shorter level.
    history = [_decode(tree, len(tree.levels), c) for c in range(len(level.codes))]
    shorter = []
    for size in range(1, len(tree.levels)):
        suffix = np.array([_encode(tree, h[len(h) - size :]) for h in history])
        shorter.append(suffix[context])
    tree.levels, full = tree.levels[:-1], tree.levels
    parent, _ = tree.probabilities(shorter, word)
    tree.levels = full
    n = level.count
    share = level.entry_count / n[context]
    gain = np.bincount(context, level.entry_count * np.log(share / parent), len(n))
    rest, rest_parent = n - level.kept, 1 - np.bincount(context, parent, len(n))
    gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-9) / n / np.maximum(rest_parent, 1e-9)), 0.0)
    free = np.bincount(context, minlength=len(n))
    level.state = gain > free + 10


def _decode(tree: Tree, length: int, number: int) -> list[int]:
    out: list[int] = []
    for level in reversed(tree.levels[:length]):
        code = int(level.codes[number])
        if level is tree.levels[0]:
            out.append(code)
            break
        number, word = divmod(code, tree.width)
        out.append(word)
    return out[::-1]


def _encode(tree: Tree, words: list[int]) -> int:
    number = -1
    for i, word in enumerate(words):
        code = word if i == 0 else number * tree.width + word
        at = int(np.searchsorted(tree.levels[i].codes, code))
        if at == len(tree.levels[i].codes) or tree.levels[i].codes[at] != code:
            return -1
        number = at
    return number


def train(texts: DataFrame, depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """The tree and the table of all word counts (word, c), from ``texts`` (one column, ``text``)."""
    table = shared_table(count_words(texts))
    tokens, distinct, ends = table.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("c")))).first()
    tokens, distinct, ends = tokens or 0, distinct or 0, ends or 0
    hot = table.filter((F.col("c") >= HOT_RATE * float(tokens) ** 0.5) | (F.length("word") == 0)).collect()  # at most sqrt(tokens) / HOT_RATE rows
    hot.sort(key=lambda r: bytes(r["word"]))
    tree = Tree([bytes(r["word"]) for r in hot], np.array([r["c"] for r in hot], float), tokens, distinct, ends)
    # Level one: frequent words and the start of a text (never the end).
    counts = np.append(tree.counts, float(ends))
    codes = np.array([i for i in range(len(counts)) if i != tree.end and counts[i] >= least(CONTEXT_RATE, tokens)], np.int64)
    n = counts[codes] if len(codes) else np.zeros(0)
    for _ in range(depth if tokens else 0):
        if not len(codes):
            break
        level = Level(codes, n)
        tree.levels.append(level)
        rows = _follow_counts(texts, tree).filter(F.col("n") >= least(ENTRY_RATE, tokens)).toPandas()  # at most sqrt(tokens) / ENTRY_RATE rows
        found, many = rows["code"].to_numpy(np.int64), rows["n"].to_numpy(float)
        level.state, level.kept = np.zeros(len(codes), bool), np.zeros(len(codes))
        _states(tree, level, found, many)
        onward = (many >= least(CONTEXT_RATE, tokens)) & (found % tree.width != tree.end)
        order = np.argsort(found[onward])
        codes, n = found[onward][order], many[onward][order]
    return tree, table


def score(docs: DataFrame, tree: Tree, table: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(tree.plain())
    schema = "doc_id string, mark long, word binary, n long, n_tokens long, n_known long, base double, score double, rows long"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree_of(sent.value)
        for batch in batches:
            ids_of, marks = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist()
            for start, part in steps(to_bytes(batch.column("text"))):
                yield rows(own, ids_of[start : start + len(part)], marks[start : start + len(part)], part)

    def rows(own: Tree, ids_of, marks, part) -> pa.RecordBatch:
        ids, bounds, split = _joined(own, part)
        before = [np.concatenate(([-1], c[:-1])) for c in own.contexts(ids)]
        p, weight = own.probabilities(before, ids)
        known = ids >= 0
        own_log = np.log10(own.root(ids))
        base = np.where(known | (ids == -2), own_log, 0.0)
        full = np.where(known, np.log10(p), np.where(ids == -2, own_log + weight, weight))
        first = bounds[:-1]
        for a in (base, full):
            a[first] = 0.0  # the start is no token
        known[first] = False
        head = [
            ids_of, marks, [b" %d" % m for m in marks], [0] * len(part), (np.diff(bounds) - 1).tolist(),
            np.add.reduceat(known, first, dtype=np.int64).tolist(), np.add.reduceat(base, first).tolist(), np.add.reduceat(full, first).tolist(), [1] * len(part),
        ]
        columns = head
        for i, words in enumerate(split):
            places = np.flatnonzero(ids[bounds[i] : bounds[i + 1]] == -1)
            if not len(places):
                continue
            rare = Counter([words[j - 1] for j in places.tolist()])
            m = len(rare)
            for column, values in zip(columns, ([ids_of[i]] * m, [marks[i]] * m, list(rare), list(rare.values()), [0] * m, [0] * m, [0.0] * m, [0.0] * m, [0] * m), strict=True):
                column.extend(values)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    # Header rows carry a word with a space in it, which no text has: they meet no count and spread evenly.
    source = docs.select(F.col(key).cast("string").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = source.mapInArrow(run, schema).join(table, "word", "left")
    rare = F.col("n") * F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.1) / F.lit(tree.divisor()))
    sums = parts.groupBy("doc_id", "mark").agg(
        F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + rare).alias("base_score"), F.sum(F.col("score") + rare).alias("score"),
    )
    per_row = sums.select(
        "doc_id", (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"), (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"),
        (F.col("base_score") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"),
        F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("one"),
    ).drop("one")
    return per_row.withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))
