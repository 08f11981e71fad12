"""Document fingerprints from closed syncmers.

A k-mer (K bytes of UTF-8) is a closed syncmer if the smallest hash of its inner S-byte substrings lies at
its first or last place. That depends on the k-mer alone, so the same passage gives the same anchors in
any text, at shifted positions, and no stretch of K - S neighbouring k-mers is without one. Anchors carry
position and hash for positional matching; the fingerprint keeps the least anchor hash of each of BINS
classes (eight bits, two hex digits each, 00 where a class is empty). The likeness of two
fingerprints estimates the Jaccard similarity of their anchor sets.

Defined cases: a text without an anchor (short or empty) has itself as its only one; null is empty;
equal texts have equal fingerprints. The following document in id order ends a text's edit; rows of one
id are ordered by text, null ids come first, after the last row comes the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.rows import arrow_column, steps, to_bytes

K, S, BINS = 16, 5, 128
#: Bytes of text in one block of neighbouring ids, and the most blocks (larger blocks beyond: rows are streamed).
BLOCK_BYTES, MOST_BLOCKS = 8 << 20, 20_000


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, byte position and 64-bit hash of every closed syncmer."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    a = np.frombuffer(b"".join(texts), np.uint8)
    n = len(a) - K + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    m = len(a) - S + 1
    v = np.zeros(m, np.uint64)
    for j in range(S):
        v |= a[j : j + m].astype(np.uint64) << np.uint64(8 * j)
    h = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    two = np.minimum(h[:-1], h[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    least = np.minimum(eight[:n], four[8:][:n])  # of K - S + 1 = 12 neighbours
    at = np.flatnonzero((h[:n] == least) | (h[K - S :][:n] == least))
    text = np.searchsorted(ends, at, "right")
    inside = at + K <= ends[text]
    at, text = at[inside], text[inside]
    pair = np.lib.stride_tricks.sliding_window_view(a, K)[at].view("<u8").reshape(-1, 2)
    x = (pair[:, 0] ^ (pair[:, 0] >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ pair[:, 1] ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return text, at - (ends - sizes)[text], x ^ (x >> np.uint64(33))


def sketches(texts: list[bytes]) -> np.ndarray:
    """Texts x BINS bytes."""
    out = np.zeros((len(texts), BINS), np.uint8)
    for start, part in steps(texts):
        text, _, hashes = anchors_of(part)
        bare = np.flatnonzero(np.bincount(text, minlength=len(part)) == 0)
        if len(bare):
            own = [int.from_bytes(hashlib.blake2b(part[i], digest_size=8).digest(), "little") for i in bare]
            text, hashes = np.concatenate([text, bare]), np.concatenate([hashes, np.array(own, np.uint64)])
        least = np.full(len(part) * BINS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, text * BINS + (hashes % np.uint64(BINS)).astype(np.int64), hashes)
        seen = least != np.iinfo(np.uint64).max
        out[start : start + len(part)] = np.where(seen, 1 + (least >> np.uint64(7)) % np.uint64(255), 0).reshape(len(part), BINS)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints, row by row, without the share of chance agreements."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    return np.clip((same / used - 1 / 255) / (1 - 1 / 255), 0.0, 1.0)


def fingerprint(text: Column) -> Column:
    """Two hex digits per bin."""
    return arrow_column(lambda texts: [row.tobytes().hex() for row in sketches(texts)], "string", pa.string())(text)


def anchors(text: Column) -> Column:
    """array<struct<position, hash>> in order of position (bytes)."""

    def find(texts: list[bytes]) -> list[list[dict]]:
        number, position, hashes = anchors_of(texts)
        out: list[list[dict]] = [[] for _ in texts]
        for i, p, h in zip(number.tolist(), position.tolist(), hashes.view(np.int64).tolist(), strict=True):
            out[i].append({"position": p, "hash": h})
        return out

    return arrow_column(find, "array<struct<position:long,hash:long>>", pa.list_(pa.struct([("position", pa.int64()), ("hash", pa.int64())])))(text)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def neighbours(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Deal whole texts once into blocks of neighbouring ids, in order: block, ahead, doc_id, text.

    The first rows of a block also appear at the end of the block before it (``ahead`` 1), so every row finds
    its follower inside its block. Block bounds are approximate quantiles of the ids; only they and the
    least id of each block, at most MOST_BLOCKS numbers, are known to the driver.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("rank", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    size = docs.select(F.sum(F.octet_length(F.col(text))), F.count("*")).first()
    many = max(1, min(MOST_BLOCKS, (size[0] or 0) // BLOCK_BYTES, size[1]))
    found = rows.select("rank").agg(F.percentile_approx("rank", [(i + 1) / many for i in range(many)], 50_000), F.max("rank")).first()
    bounds = sorted(b for b in set(found[0] or []) if b < found[1])
    edges = np.array(bounds, np.int64)

    def number(ranks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for r in ranks:
            yield pa.array(np.searchsorted(edges, r.to_numpy(zero_copy_only=False), "left"), pa.int32())

    number.__annotations__ = {"ranks": Iterator[pa.Array], "return": Iterator[pa.Array]}
    block_of = F.arrow_udf(number, "int")
    firsts = [r[0] for r in rows.select("rank", block_of("rank").alias("block")).groupBy("block").agg(F.min("rank").alias("least")).select("least").collect()]
    starts = np.array(sorted(firsts), np.int64)
    count = len(bounds) + 1

    def roles(ranks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Number of the block, negative (minus one) if the row begins it."""
        for r in ranks:
            values = r.to_numpy(zero_copy_only=False)
            block = np.searchsorted(edges, values, "left")
            yield pa.array(np.where(starts[block] == values, -1 - block, block), pa.int32())

    roles.__annotations__ = {"ranks": Iterator[pa.Array], "return": Iterator[pa.Array]}
    placed = rows.withColumn("role", F.arrow_udf(roles, "int")("rank"))
    block = F.when(F.col("role") < 0, -1 - F.col("role")).otherwise(F.col("role"))
    own = F.struct(block.alias("block"), F.lit(0).alias("ahead"))
    before = F.struct(F.pmod(block - 1, F.lit(count)).alias("block"), F.lit(1).alias("ahead"))
    twice = F.when(F.col("role") < 0, F.array(own, before)).otherwise(F.array(own))
    dealt = placed.select(F.explode(twice).alias("at"), "doc_id", "rank", "text").select("at.block", "at.ahead", "doc_id", "rank", "text")
    return dealt.repartition("block").sortWithinPartitions("block", "ahead", "rank", "text").select("block", "ahead", "doc_id", "text")


def compare_with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness to each other and to the next text's."""
    id_type = docs.schema[key].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last row: (block, id, text) whose follower is not yet known
        for batch in batches:
            blocks, ahead, ids, texts = batch.column("block").to_pylist(), batch.column("ahead").to_pylist(), batch.column("doc_id").to_pylist(), to_bytes(batch.column("text"))
            for start, part in steps(texts):
                kept = [] if waiting is None else [waiting]
                follows = []  # pairs of places in ``kept``
                for i in range(start, start + len(part)):
                    if ahead[i] and (waiting is None or waiting[0] != blocks[i]):
                        continue  # the block has its follower
                    kept.append((blocks[i], ids[i], texts[i]))
                    if waiting is not None and waiting[0] == blocks[i]:
                        follows.append((len(kept) - 2, len(kept) - 1))
                    waiting = None if ahead[i] else kept[-1]
                if follows:
                    yield rows(kept, follows)

    def rows(kept, follows) -> pa.RecordBatch:
        own = sketches([k[2] for k in kept])
        strings = [k[2].decode() for k in kept]
        edits = [edited(strings[a], strings[b]).encode() for a, b in follows]
        changed = sketches(edits)
        first, second = own[[a for a, _ in follows]], own[[b for _, b in follows]]
        values = [
            [kept[a][1] for a, _ in follows], [len(strings[a]) for a, _ in follows], [hashlib.sha256(e).hexdigest() for e in edits],
            [r.tobytes().hex() for r in first], [r.tobytes().hex() for r in changed], likeness(first, changed), likeness(first, second),
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    ordered = neighbours(docs, text, key).withColumn("doc_id", F.col("doc_id").cast("long"))
    return ordered.mapInArrow(build, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumn("doc_id", F.col("doc_id").cast(id_type))
