"""SimHash near-duplicates found with covering locality-sensitive hashing.

A fingerprint bit is one if more than half of a text's shingle hashes set it. Fingerprints at most
``RADIUS`` bits apart are linked. Each bit position gets a non-zero vector of RADIUS + 1 bits; for each of
the 2**(RADIUS + 1) - 1 non-zero vectors a mask keeps the positions whose vector has an odd product
with it. Any RADIUS positions leave some vector orthogonal to all of theirs, so every pair within the
radius agrees on the kept bits of some mask: the pair meets in that table, whatever the data.

Work is done on distinct fingerprints. Tables are shuffled by masked value and read in sorted order, so a
task holds one bucket at a time. A bucket of more than ``BUCKET`` fingerprints is not compared as it is:
its rows go through the masks of the next level (other positions), which again miss no pair. A bucket
gives the edges of a spanning forest, not its pairs.

Defined cases: a null or word-free text has fingerprint zero and is linked like any other; fewer words
than a shingle are one shingle; a null id is never a component's name unless the component has no
other; repeated rows keep their count and share everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.components import components
from quantspark.llm.rows import arrow_column, stage

SHINGLE = 3
SEED = 42
RADIUS = 3
BUCKET = 4096
LEVELS = 4


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint."""
    words = text.lower().split()  # bytes: A-Z only, separators are space and \t to \r
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.concatenate(([0], ends[:-size]))
        hashes = [digest(joined[b:e], SEED) for b, e in zip(begins.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
    array = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(array), 1 << 15):
        part = array[start : start + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(array), bitorder="little").view("<u8")
    return int(bits.view("<i8")[0])


def simhash(text: Column, size: int = SHINGLE) -> Column:
    return arrow_column(lambda texts: [fingerprint(t, size) for t in texts], "long", pa.int64())(text)


def hex_of(value: Column) -> Column:
    """Sixteen lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def masks(level: int, radius: int = RADIUS) -> list[int]:
    """Covering masks as signed numbers; each level deals the vectors to other positions."""
    count = (1 << (radius + 1)) - 1
    vectors = [1 + int(p) % count for p in np.random.default_rng(level).permutation(64)]
    out = []
    for v in range(1, count + 1):
        kept = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1)
        out.append(kept - (1 << 64) if kept >= 1 << 63 else kept)
    return out


def forest(bucket: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside each bucket; rows of a bucket lie together."""
    n, bits = len(prints), prints.view(np.uint64)
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if n else np.zeros(0, int)
    size = np.diff(np.append(begin, n))
    rest = np.repeat(begin + size, size) - np.arange(n)  # rows of the bucket from here on
    label = np.arange(n)
    active = np.flatnonzero(rest > 1)
    step = 1
    while len(active):
        close = active[np.bitwise_count(bits[active] ^ bits[active + step]) <= radius]
        a, b = close, close + step
        while len(a):
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                jumped = label[label]
                if np.array_equal(jumped, label):
                    break
                label = jumped
        step += 1
        active = active[rest[active] > step]
    child = np.flatnonzero(label != np.arange(n))
    return prints[label[child]], prints[child]


def _compare(masks_of_level: list[int], radius: int, bound: int | None):
    """mapInArrow over rows sorted by bucket: edges (pending false) and rows of too large buckets (pending true)."""
    names = ["pending", "path", "v", "a", "b"]
    mask_array = np.array(masks_of_level, np.int64)

    def out(pending: bool, path, v, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), pending)), pa.array(path, pa.int64()), pa.array(v, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        large = None  # identity of the bucket that already went over the bound
        for batch in _with_end(batches):
            if batch is not None:
                rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if held is None or not len(held[0]):
                continue
            path, v, prints = held
            key = prints & mask_array[v]
            new = np.concatenate(([True], (path[1:] != path[:-1]) | (v[1:] != v[:-1]) | (key[1:] != key[:-1])))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(path)))
            first = (int(path[0]), int(v[0]), int(key[0]))
            too_large = np.zeros(len(starts), bool) if bound is None else sizes > bound
            if large is not None and first == large:
                too_large[0] = True
            done = len(path) if batch is None else int(starts[-1])
            if batch is not None and too_large[-1]:
                done = len(path)
            large = (int(path[-1]), int(v[-1]), int(key[-1])) if too_large[-1] else None
            number = np.cumsum(new) - 1
            flagged = too_large[number[:done]]
            if flagged.any():
                yield out(True, path[:done][flagged], v[:done][flagged], prints[:done][flagged], key[:done][flagged])
            plain = ~flagged & (sizes[number[:done]] > 1)
            a, b = forest(number[:done][plain], prints[:done][plain], radius)
            if len(a):
                yield out(False, np.zeros(len(a), np.int64), np.zeros(len(a), np.int32), a, b)
            held = [x[done:] for x in held]

    return run


def _with_end(batches):
    yield from batches
    yield None


def links(prints: DataFrame, radius: int = RADIUS, bound: int = BUCKET) -> DataFrame:
    """``prints`` (fp), distinct: edges (a, b) that connect all fingerprints within the radius.

    The number of edges is at most that of (fingerprint, mask) rows.
    """
    edges = None
    rows = prints.select(F.lit(0).cast("long").alias("path"), "fp")
    for level in range(LEVELS):
        chosen = masks(level, radius)
        kept = F.array(*[F.lit(m) for m in chosen])
        tables = rows.select("path", F.posexplode(kept).alias("v", "mask"), "fp")
        key = F.col("fp").bitwiseAND(F.col("mask"))
        dealt = tables.repartition(F.col("path"), F.col("v"), key).sortWithinPartitions("path", "v", key, "fp").select("path", "v", "fp")
        found = dealt.mapInArrow(_compare(chosen, radius, bound if level + 1 < LEVELS else None), "pending boolean, path long, v int, a long, b long")
        found = stage(found)
        more = found.filter("NOT pending").select("a", "b")
        edges = more if edges is None else edges.union(more)
        rows = found.filter("pending").select(F.xxhash64("path", "v", "b").alias("path"), F.col("a").alias("fp"))
        if rows.isEmpty():
            break
    return edges


def grouped(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` (doc_id, mark, fp): fp -> component_id, kept (the id and mark of the row that stands for it).

    ``mark`` tells rows of one id apart.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min(order).alias("kept")))
    roots = components(links(prints.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = prints.join(roots, "fp")
    of_root = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("kept").alias("component_kept"))
    whole = roots.join(of_root, "root").select("fp", "component_id", "component_kept", F.lit(True).alias("linked"))
    return prints.join(whole, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("linked"), F.col("component_kept")).otherwise(F.col("kept")).alias("kept"),
    )


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fp, component_id."""
    rows = stage(docs.select(F.col(key).alias("doc_id"), F.lit(0).alias("mark"), simhash(F.col(text), size).alias("fp")))
    return rows.select("doc_id", "fp").join(grouped(rows, radius).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the smallest id, once. All columns stay."""
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())
    rows = stage(docs.select(F.col(key).alias("doc_id"), mark.alias("mark"), simhash(F.col(text), size).alias("fp")))
    kept = grouped(rows, radius).select(F.col("kept.doc_id").alias("_kept_id"), F.col("kept.mark").alias("_kept_mark")).distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("_key"), mark.alias("_mark"))
    same = held["_key"].eqNullSafe(kept["_kept_id"]) & (held["_mark"] == kept["_kept_mark"])
    return held.join(kept, same, "left_semi").dropDuplicates(["_key", "_mark"]).select("row.*")
