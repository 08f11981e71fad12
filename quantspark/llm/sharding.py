"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

Every node is cut at the weighted median (weight: bytes) of its widest dimension, until each leaf is one
shard's share of all bytes; nodes of several shards are cut in proportion to the shards on each side. The
dimensions are functions of the text (bytes, bytes beyond one per character, crc32), so documents with
equal texts are one point. Medians come from histograms: a grouped sum over at most BINS intervals per
node, narrowed until an interval is one value. Only histograms reach the driver: BINS rows per node.

Ties at the median go on to crc32, so a cut passes between texts. Only where the texts at the cut weigh
more than TOLERANCE of a shard are documents of one text cut apart, by hash of their id, because the law is
``bytes``. Slots number the rows of a shard through hash buckets: rank in the bucket plus the rows of the
buckets before, so a shard is not one task's work.

Defined cases: a null text weighs 1 and has crc32 0; null ids count as one id; repeated rows are rows of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.rows import stage

SHARDS = 8
BINS = 2048
TOLERANCE = 0.002
SLOT_ROWS = 5_000
DIMENSIONS = ("size", "beyond", "text_crc32")


def points(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"),
        (F.octet_length(whole) - F.char_length(whole)).cast("long").alias("beyond"), F.crc32(whole).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(1 << 40)).alias("spread"),
    )


def _by_node(values: dict[int, Column], default: Column | None = None) -> Column:
    """A column that depends on the node."""
    out = default
    for node, value in values.items():
        out = F.when(F.col("node") == node, value) if out is None else F.when(F.col("node") == node, value).otherwise(out)
    return out


def _median(rows: DataFrame, column: dict[int, str], aim: dict[int, float]) -> dict[int, tuple[int, int, int]]:
    """Per node: the value at which the running weight passes ``aim``, the weight below it and its own."""
    value = _by_node({k: F.col(c) for k, c in column.items()})
    rows = rows.filter(F.col("node").isin(list(column))).select("node", value.alias("value"), "size")
    ranges = {r[0]: [r[1], r[2], 0] for r in rows.groupBy("node").agg(F.min("value"), F.max("value")).collect()}
    done: dict[int, tuple[int, int, int]] = {}
    while len(done) < len(ranges):
        open_nodes = {k: r for k, r in ranges.items() if k not in done}
        width = {k: -(-(hi - lo + 1) // BINS) for k, (lo, hi, _) in open_nodes.items()}
        low = _by_node({k: F.lit(r[0]) for k, r in open_nodes.items()})
        high = _by_node({k: F.lit(r[1]) for k, r in open_nodes.items()})
        wide = _by_node({k: F.lit(w) for k, w in width.items()})
        inside = rows.filter(F.col("node").isin(list(open_nodes)) & F.col("value").between(low, high))
        counted = inside.groupBy("node", F.floor((F.col("value") - low) / wide).cast("long").alias("bin")).agg(F.sum("size").alias("weight")).collect()
        by_node: dict[int, list] = {k: [] for k in open_nodes}
        for r in counted:
            by_node[r["node"]].append((r["bin"], r["weight"]))
        for k, bins in by_node.items():
            lo, hi, below = open_nodes[k]
            for b, weight in sorted(bins):
                if below + weight >= aim[k] or b == max(bins)[0]:
                    first = lo + b * width[k]
                    if width[k] == 1:
                        done[k] = (first, below, weight)
                    else:
                        ranges[k] = [first, min(hi, first + width[k] - 1), below]
                    break
                below += weight
    return done


def _cuts(rows: DataFrame, shards: dict[int, tuple[int, int]], total: dict[int, int], spans: dict[str, int], limits: dict[int, dict[str, int]], share: float):
    """Per node the lexicographic upper bound of its left half: (dimension, value, crc32, spread)."""
    left = {k: (first + last) // 2 for k, (first, last) in shards.items()}
    aim = {k: total[k] * (left[k] - shards[k][0]) / (shards[k][1] - shards[k][0]) for k in shards}
    widest = {k: max(DIMENSIONS, key=lambda d: (limits[k][d] / max(spans[d], 1), -DIMENSIONS.index(d))) for k in shards}
    cut: dict[int, list] = {k: [widest[k]] for k in shards}
    below = dict.fromkeys(shards, 0)
    pending, ties = dict(widest), rows
    for step, follow in enumerate(("text_crc32", "spread", None)):
        found = _median(ties, pending, {k: aim[k] - below[k] for k in pending})
        nearer = {}
        for k, (value, before, own) in found.items():
            short, over = aim[k] - below[k] - before, below[k] + before + own - aim[k]
            below[k] += before
            cut[k].append(value)
            if follow is None or min(abs(short), abs(over)) <= (TOLERANCE * share if step else 0):
                # End here: all ties to one side, whichever is nearer to the aim.
                cut[k].append(abs(over) <= abs(short))
            else:
                nearer[k] = follow
        if not nearer:
            break
        same = {k: F.col(pending[k]) == found[k][0] for k in nearer}
        ties = ties.filter(_by_node(same, F.lit(False)))
        pending = nearer
    return left, cut


def _is_left(cut: list) -> Column:
    """Compare (dimension, crc32, spread) with the bound; the last entry says where its ties go."""
    columns = [F.col(cut[0]), F.col("text_crc32"), F.col("spread")]
    values, inclusive = cut[1:-1], cut[-1]
    out = F.lit(bool(inclusive))
    for column, value in reversed(list(zip(columns, values, strict=False))):
        out = (column < value) | ((column == value) & out)
    return out


def tree(rows: DataFrame, count: int = SHARDS) -> DataFrame:
    """``rows`` of :func:`points` with a column shard, 0 to count - 1."""
    rows = stage(rows.withColumn("node", F.lit(0)))
    shards = {0: (0, count)}
    span: dict[str, int] = {}
    while any(last - first > 1 for first, last in shards.values()):
        measured = rows.groupBy("node").agg(F.sum("size").alias("weight"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()
        span = span or {d: max((r[d] for r in measured), default=0) for d in DIMENSIONS}
        divided = {r["node"]: r for r in measured if r["node"] in shards and shards[r["node"]][1] - shards[r["node"]][0] > 1}
        if not divided:
            break
        share = sum(r["weight"] for r in measured) / count
        left, cut = _cuts(
            rows, {k: shards[k] for k in divided}, {k: r["weight"] for k, r in divided.items()}, span,
            {k: {d: r[d] for d in DIMENSIONS} for k, r in divided.items()}, share,
        )
        # A node is named by its first shard: the left half keeps the name.
        moved = _by_node({k: F.when(_is_left(cut[k]), F.lit(k)).otherwise(F.lit(left[k])) for k in divided}, F.col("node"))
        rows = stage(rows.withColumn("node", moved))
        for k in divided:
            first, last = shards[k]
            shards[k], shards[left[k]] = (first, left[k]), (left[k], last)
    return rows.withColumnRenamed("node", "shard")


def with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of every shard from 0 without a gap."""
    total = rows.count()
    buckets = max(1, total // SLOT_ROWS)
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets))
    dealt = rows.withColumn("bucket", bucket)
    counts = dealt.groupBy("shard", "bucket").count()
    earlier = Window.partitionBy("shard").orderBy("bucket")
    offsets = counts.select("shard", "bucket", (F.sum("count").over(earlier) - F.col("count")).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return dealt.withColumn("place", inside).join(offsets, ["shard", "bucket"]).withColumn("slot", (F.col("offset") + F.col("place")).cast("long")).drop("bucket", "place", "offset")


def sharded(docs: DataFrame, count: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every row."""
    found = with_slots(tree(points(docs, text, key), count))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot")
