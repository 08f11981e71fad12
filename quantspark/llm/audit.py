"""Filter interaction audit: how many rows each quality filter removes in every order of the filters.

A table-driven byte transducer reads each text once. One table gives the class of a byte (separator, capital,
symbol, first byte of a code point); the two states, inside and outside a word, follow from it. The pass counts
code points, capitals and symbols and marks word spans, which go into an open-addressing hash table. A span is a
repeat only after its bytes have been compared with those of the span that owns the slot, so the count of distinct
words is exact whatever the hash does.

The counts become five failure bits a row. Only counts by (part, bits) go on, at most 32 a part, and every order
and step is read from those.

Defined cases: a null text is empty and has no words; a row without an id is never a repeat of another, and its
text makes no other row one; rows of equal id and equal text are not repeats of each other; several labels of one
id count if any of them says 1; a null part is the empty string and shares that string's rows; no rows, no parts.
A text longer than STEP_BYTES is read in pieces that end between words, so memory follows its distinct words.
"""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.rows import STEP_BYTES, arrow_column, stage

MIN_WORDS = 50
MIN_DISTINCT_PCT = 65
MAX_CAPITALS_PCT = 5
SYMBOLS = b"#$%&*|"
SEPARATORS = b" \t\n\v\f\r"
#: Words of more bytes than this are compared by Python's own hash table.
LONG_WORD = 256
#: The filters by letter; filter i sets bit 1 << i.
FILTERS = "ABCDE"

_SEPARATOR, _CAPITAL, _SYMBOL, _POINT = 1, 2, 4, 8
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_PAD = b" " * 8


def _classes() -> np.ndarray:
    """The transducer's table: what reading a byte adds."""
    table = np.zeros(256, np.uint8)
    table[list(SEPARATORS)] |= _SEPARATOR
    table[ord("A") : ord("Z") + 1] |= _CAPITAL
    table[list(SYMBOLS)] |= _SYMBOL
    table[[b for b in range(256) if b & 0xC0 != 0x80]] |= _POINT
    return table


CLASSES = _classes()


def _chunk(eights: np.ndarray, begin: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of spans, zero beyond their ends."""
    return eights[begin + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)]


def first_spans(buffer: bytes, begin: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True for the first span of its bytes within its group. ``buffer`` ends with eight spare bytes."""
    size = end - begin
    first = np.zeros(len(begin), bool)
    held = set()
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        word = (int(group[i]), buffer[begin[i] : end[i]])
        first[i] = word not in held
        held.add(word)
    at = np.flatnonzero(size <= LONG_WORD)
    if not len(at):
        return first
    begin, size, group = begin[at], size[at], group[at]
    eights = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    chunks = -(-int(size.max()) // 8)
    h = (group.astype(np.uint64) << np.uint64(32)) + size.astype(np.uint64)
    for k in range(chunks):
        more = slice(None) if k == 0 else np.flatnonzero(size > 8 * k)
        x = (h[more] ^ _chunk(eights, begin[more], size[more], k)) * np.uint64(0x9E3779B97F4A7C15)
        h[more] = x ^ (x >> np.uint64(29))
    bits = max(4, (2 * len(at)).bit_length())
    slot = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)
    owner = np.full(1 << bits, -1, np.int64)
    pending = np.arange(len(at))
    while len(pending):
        free = pending[owner[slot[pending]] < 0]
        owner[slot[free[::-1]]] = free[::-1]  # of several spans the first one stays
        held_by = owner[slot[pending]]
        new = held_by == pending
        first[at[pending[new]]] = True
        same = ~new & (h[held_by] == h[pending]) & (size[held_by] == size[pending]) & (group[held_by] == group[pending])
        for k in range(chunks):
            i = np.flatnonzero(same & (size[pending] > 8 * k))
            if not len(i):
                break
            a, b = held_by[i], pending[i]
            same[i] = _chunk(eights, begin[a], size[a], k) == _chunk(eights, begin[b], size[b], k)
        pending = pending[~new & ~same]
        slot[pending] = (slot[pending] + 1) & ((1 << bits) - 1)
    return first


def _read(texts: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """One pass over texts: counts (words, capitals, code points, symbols) each, and the word spans with their text."""
    buffer = b" ".join(texts) + _PAD
    seen = CLASSES[np.frombuffer(buffer, np.uint8)]
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(length + 1) - length - 1
    inside = np.concatenate(([0], (seen & _SEPARATOR) ^ _SEPARATOR)).astype(np.int8)  # state before each byte and at the end
    change = np.diff(inside)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    text_of = np.searchsorted(start, begin, side="right") - 1
    counts = np.zeros((4, len(texts)), np.int64)
    counts[0] = np.bincount(text_of, minlength=len(texts))
    for row, bit in enumerate((_CAPITAL, _POINT, _SYMBOL), 1):
        total = np.concatenate(([0], np.cumsum((seen & bit) != 0)))
        counts[row] = total[start + length] - total[start]
    return counts, buffer, begin, end, text_of


def _pieces(text: bytes, most: int):
    """A long text in pieces that end before a separator."""
    start = 0
    while start < len(text):
        cut = len(text)
        if cut - start > most:
            found = re.compile(rb"[ \t-\r]").search(text, start + most)
            cut = found.start() if found else cut
        yield text[start:cut]
        start = cut


def profile(texts: list[bytes], most: int = STEP_BYTES) -> list[dict]:
    """Words, distinct words, capitals, code points and symbols of every text."""
    out: list[dict] = []
    short = [t if len(t) <= most else b"" for t in texts]
    counts, buffer, begin, end, text_of = _read(short)
    distinct = np.bincount(text_of[first_spans(buffer, begin, end, text_of)], minlength=len(texts))
    for i, text in enumerate(texts):
        n, different = counts[:, i], int(distinct[i])
        if len(text) > most:
            held: set[bytes] = set()
            n = np.zeros(4, np.int64)
            for piece in _pieces(text, most):
                more, part, b, e, of = _read([piece])
                new = first_spans(part, b, e, of)
                held.update(part[i:j] for i, j in zip(b[new].tolist(), e[new].tolist(), strict=True))
                n = n + more[:, 0]
            different = len(held)
        out.append({"words": int(n[0]), "different": different, "capitals": int(n[1]), "points": int(n[2]), "symbols": int(n[3])})
    return out


def profiled(text: Column) -> Column:
    names = ["words", "different", "capitals", "points", "symbols"]
    return arrow_column(profile, ", ".join(f"{n} long" for n in names), pa.struct([(n, pa.int64()) for n in names]))(text)


def failures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row its columns ``part`` and ``key`` as they are, and the bits of the filters that it fails."""
    p, fold = F.col("p"), F.coalesce(F.col(text), F.lit(""))
    rows = stage(docs.select(F.col(key).alias("doc_id"), F.col("part"), profiled(F.col(text)).alias("p"), F.sha2(fold, 256).alias("sha")))
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    fails = [
        p["words"] < MIN_WORDS,
        p["different"] * 100 < p["words"] * MIN_DISTINCT_PCT,
        p["capitals"] * 100 > p["points"] * MAX_CAPITALS_PCT,
        p["symbols"] > 0,
        F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
    ]
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))
    return rows.join(first, "sha", "left").select("doc_id", "part", bits.cast("int").alias("bits"))


def tallies(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part the rows, good rows and toxic rows of every combination of failure bits that occurs."""
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = failed.join(marked, "doc_id", "left").groupBy("part", "bits").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    return counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("tally"))  # at most 2 ** 5 entries


def _total(rule, value) -> Column:
    """Sum of a value over the entries of the tally that a rule takes."""
    return F.aggregate(F.filter("tally", rule), F.lit(0).cast("long"), lambda total, e: total + value(e))


def interactions(tally: DataFrame) -> DataFrame:
    """All orders and steps of every part."""
    orders = ["".join(x) for x in permutations(FILTERS)]
    steps = tally.select("part", "tally", F.explode(F.array(*[F.lit(o) for o in orders])).alias("filter_order"))
    steps = steps.select("*", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))])).alias("step"))
    bits_of = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(FILTERS)), F.lit(0))
    order, step = F.col("filter_order"), F.col("step")
    steps = steps.withColumn("own", bits_of(order.substr(step, F.lit(1)))).withColumn("before", bits_of(F.substring(order, F.lit(1), step - 1)))
    meets = lambda e, mask: e["bits"].bitwiseAND(F.col(mask)) != 0
    removed = lambda e: meets(e, "own") & ~meets(e, "before")
    share = lambda e: e["n"] * F.expr(f"{len(orders)}L").cast("long") / F.bit_count(e["bits"])
    return steps.select(
        "part", "filter_order", "step",
        _total(lambda e: ~meets(e, "own") & ~meets(e, "before"), lambda e: e["n"]).alias("kept"),
        _total(removed, lambda e: e["n"]).alias("removed"),
        _total(lambda e: meets(e, "own") & meets(e, "before"), lambda e: e["n"]).alias("redundant"),
        _total(lambda e: e["bits"] == F.col("own"), lambda e: e["n"]).alias("unique_fails"),
        _total(removed, lambda e: e["good"]).alias("good_lost"),
        _total(removed, lambda e: e["toxic"]).alias("toxic_lost"),
        # A row that fails s filters is removed by each of them in 120 / s of the orders.
        _total(lambda e: meets(e, "own"), lambda e: share(e).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, ...) for all orders of the five filters."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return interactions(tallies(failures(rows), labels.select("doc_id", "quality", "toxic")))
