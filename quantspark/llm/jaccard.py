"""N-gram Jaccard join: all pairs of texts whose shingle sets are similar enough, as links and components.

Sets that link have sizes within a fixed ratio and a bounded difference. Sizes fall into geometric bands; for the
smaller set's band the difference of a linking pair is at most ``d``. The hash range is cut into ``k > d`` equal
segments, and a set has one tile key per segment that is not empty: band, segment and a hash of its shingles there.
``d`` shingles spoil at most ``d`` segments, so of ``m`` keys a linking partner has all but ``d``; and of the first
``d + SHARED`` keys in the order of the segments the two share SHARED, or ``m - d`` if that is less. Only those keys
are shipped. A set with no more than ``d`` keys also goes to a tile of its band for such sets, so no pair is lost. A
tile holds sets that share whole segments: a passage or word that many texts share does not bring them together.

Sets that meet in enough tiles form families, the components of meeting. In one task, pairs of fitting sizes are
tested on hashed bitmap signatures: each shingle flips one bit, and the bits in which two signatures differ are at most
the shingles in which the sets differ, so a bit count bounds the overlap from above. This is done twice. First on
sketches of one to two bits per shingle, for long texts that meet by common shingles form families that grow with the
corpus: the components of what passes are smaller families, and most sets leave. Then the sorted shingle arrays
of the rest go to one task a family, once; what passes four bits per shingle is intersected exactly, nearest pairs
first, unless it is connected already; a spanning forest of the links leaves the task.

Equal sets are one node from the start. A family of more than BLOCK sets is cut into blocks. Each block is compared
with a few pivots of the family, which joins a large group of near copies in linear work; only sets outside the
family's largest component are then compared with all its blocks.

Defined cases: a text without words (null too) has an empty set and is linked with nothing, not even its copies;
fewer words than a shingle are one shingle; a null id is never a component's name unless the component has no
other; repeated rows keep their count and share everything; shingles and sets are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.components import components
from quantspark.llm.rows import arrow_column, shared_table, small_batches, stage, steps, to_bytes

SHINGLE = 4
SEED = 42
#: Ratio of the sizes that a band spans.
BAND = 1.6
#: Log probability that a set has too many empty segments for its band.
LOG_EMPTY = -20.0
#: Keys that a linking pair shares, where it has so many; the two lowest bits of a set's name hold one less.
SHARED = 4
#: Sets, and shingles of them, that one task holds of each side of a comparison.
BLOCK = 8192
BLOCK_SHINGLES = 8_000_000
#: Shingles of sets whose sketches one task holds of each side; they take at most two bits each.
SKETCH_SHINGLES = 128_000_000
#: Sets of a large family with which all its others are compared first.
PIVOTS = 16
#: The filter that tells which texts are needed again has 2 ** FILTER_BITS bits.
FILTER_BITS = 24


@dataclass(frozen=True)
class Rule:
    """Two sets link when over * common >= under * all, as in 100 * common >= 85 * all; words per shingle."""

    over: int = 100
    under: int = 85
    size: int = SHINGLE

    def enough(self, common, both):
        """``both`` is the sum of the two sizes."""
        return (self.over + self.under) * common >= self.under * both

    def apart(self, both):
        """Most shingles that only one set of a linking pair has."""
        return ((self.over - self.under) * both) // (self.over + self.under)

    def largest(self, n: int) -> int:
        """The largest size that links with size ``n``."""
        return self.over * n // self.under


@lru_cache(maxsize=None)
def bands(rule: Rule) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
    """Per band its first size, the largest difference of a pair whose smaller set is in it, and its segments."""
    starts, apart, cuts = [], [], []
    start = 1
    while start < 1 << 40:
        end = max(start + 1, math.ceil(start * BAND))
        d = rule.apart(end - 1 + rule.largest(end - 1))
        k = d + 1
        # All shingles in at most d segments: at most C(k, d) choices, each with probability (d / k) ** start.
        while d and math.lgamma(k + 1) - math.lgamma(d + 1) - math.lgamma(k - d + 1) + start * math.log(d / k) > LOG_EMPTY:
            k += max(1, d // 50)
        starts.append(start)
        apart.append(d)
        cuts.append(k)
        start = end
    return tuple(starts), tuple(apart), tuple(cuts)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes (uint64) of all runs of ``size`` words."""
    words = text.lower().split()  # bytes: A-Z only, separators are space and \t to \r
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    runs = max(1, len(words) - size + 1)
    x = np.full(runs, min(len(words), size), np.uint64)
    for i in range(min(size, len(words))):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + runs]
        x ^= x >> np.uint64(29)
    return np.unique(_mixed(x))


def keys(found: np.ndarray, rule: Rule) -> tuple[np.ndarray, int]:
    """Tile keys of a set for the bands of its smaller and larger partners, and how many a partner shares at least."""
    starts, apart, cuts = bands(rule)
    n, least, out = len(found), SHARED, []
    own = int(np.searchsorted(starts, n, side="right")) - 1
    for band in range(own, -1, -1):
        if band < own and rule.largest(starts[band + 1] - 1) < n:
            break
        k, d = cuts[band], apart[band]
        if not d:
            continue  # only equal sets link
        segment = ((found >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        held = np.add.reduceat(_mixed(found), begin)[: d + SHARED]
        mark = segment[begin][: d + SHARED] + np.uint64((band + 1) << 40)
        out.append(_mixed(held * np.uint64(0x9E3779B97F4A7C15) + _mixed(mark)))
        if len(begin) <= d:
            out.append(_mixed(np.array([(band + 1) << 40 | 1 << 39], np.uint64)))
        least = min(least, max(1, len(begin) - d))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), least


def named(found: np.ndarray, rule: Rule) -> tuple[int, np.ndarray]:
    """Signed name and tile keys of a set; 0 is the empty one."""
    if not len(found):
        return 0, np.zeros(0, np.uint64)
    tiles, least = keys(found, rule)
    return (xxhash.xxh64_intdigest(found.tobytes(), SEED) & ~3 | least - 1) - (1 << 63), tiles


def signature(found: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the shingles per bit; ``bits`` is a power of two from 64 on."""
    flips = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<u8")


def bits_for(n: int) -> int:
    """Four bits or more for each shingle."""
    return max(64, 1 << math.ceil(math.log2(4 * n)))


def sketch(found: np.ndarray) -> np.ndarray:
    """Size of a set and its signature of one to two bits for each shingle."""
    return np.concatenate(([np.uint64(len(found))], signature(found, max(64, 1 << (len(found) - 1).bit_length()))))


def folded(marks: np.ndarray, words: int) -> np.ndarray:
    """Signatures (one a row) brought to ``words`` words; as if they had been made of so many bits."""
    while marks.shape[1] > words:
        half = marks.shape[1] // 2
        marks = marks[:, :half] ^ marks[:, half:]
    return marks


def _long(values) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64))


def named_set(rule: Rule):
    """Per text: name of its set, size and sketch."""

    def run(texts: list[bytes]) -> list[dict]:
        sets = [shingles(text, rule.size) for text in texts]
        return [{"node": named(found, rule)[0], "n": len(found), "sketch": sketch(found).tobytes() if len(found) else None} for found in sets]

    return arrow_column(run, "node long, n long, sketch binary", pa.struct([("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())]))


def _tiles(rule: Rule):
    """mapInArrow over texts: a row (tile, node) per key; a task tells a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, part in steps(to_bytes(batch.column(0))):
                tile, node = [], []
                for text in part:
                    name, own = named(shingles(text, rule.size), rule)
                    if len(own) and name not in seen:
                        seen.add(name)
                        tile.append(own)
                        node.append(np.full(len(own), name, np.int64))
                if tile:
                    yield pa.RecordBatch.from_arrays([_long(np.concatenate(tile)), pa.array(np.concatenate(node))], ["tile", "node"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (tile, node) sorted so, without repetitions, those of tiles with several nodes; one row is held at most."""
    held: list[np.ndarray] | None = None  # the last row, and whether its tile has had another
    more = False
    for batch in batches:
        tile, node = (batch.column(i).to_numpy() for i in range(2))
        if held is not None:
            tile, node = np.concatenate((held[0], tile)), np.concatenate((held[1], node))
        new = np.concatenate(([True], (tile[1:] != tile[:-1]) | (node[1:] != node[:-1])))[: len(tile)]
        tile, node = tile[new], node[new]
        if not len(tile):
            continue
        same = tile[1:] == tile[:-1]
        several = np.concatenate(([more], same)) | np.concatenate((same, [False]))
        held, more = [tile[-1:], node[-1:]], bool(several[-1])
        keep = several[:-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(tile[:-1][keep]), pa.array(node[:-1][keep])], ["tile", "node"])
    if held is not None and more:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["tile", "node"])


def _several(rows: DataFrame) -> DataFrame:
    """The rows of tiles with several nodes."""
    ends = rows.groupBy("tile").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("tile")
    return rows.join(ends, "tile", "left_semi")


def _families(rows: DataFrame, near: DataFrame | None) -> DataFrame:
    """(node, family) of rows (tile, node): components of meeting in a tile, or of being in a pair of ``near``."""
    first = rows.groupBy("tile").agg(F.min("node").alias("a"))
    pairs = rows.join(first, "tile").select("a", F.col("node").alias("b"))
    return components(pairs if near is None else pairs.union(near.select("a", "b"))).withColumnRenamed("root", "family")


def _needed(docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """``nodes`` with their sorted shingles in ``found``."""
    # A filter of fixed size spares the shuffle most sets that nobody meets; the join is what decides.
    place = f"shiftrightunsigned(node, {64 - FILTER_BITS})"
    words = nodes.selectExpr(f"shiftright({place}, 6) AS word", f"shiftleft(1L, CAST({place} & 63 AS INT)) AS bit")
    kept = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** 18 rows at most
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[kept.column("word").to_numpy()] = kept.column("bits").to_numpy()
    wanted = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marks = set(), wanted.value
        for batch in batches:
            for _, part in steps(to_bytes(batch.column(0))):
                node, arrays = [], []
                for text in part:
                    found = shingles(text, rule.size)
                    name = named(found, rule)[0]
                    at = (name & ((1 << 64) - 1)) >> (64 - FILTER_BITS)
                    if len(found) and name not in seen and int(marks[at >> 6]) >> (at & 63) & 1:
                        seen.add(name)
                        node.append(name)
                        arrays.append(found.tobytes())
                if node:
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(arrays, pa.binary())], ["node", "found"])

    told = docs.select("text").mapInArrow(run, "node long, found binary")
    return shared_table(told.dropDuplicates(["node"]).join(nodes, "node"))


def similar(x: np.ndarray, y: np.ndarray, rule: Rule) -> bool:
    """Exact test on sorted arrays."""
    return bool(rule.enough(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)))


def forest(node: np.ndarray, root: np.ndarray, arrays: list[np.ndarray], rule: Rule, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``left`` and ``right`` places that connect all linking pairs of different roots."""
    n = np.fromiter(map(len, arrays), np.int64, len(arrays))
    bits = bits_for(int(n.max()))
    marks = np.stack([signature(x, bits) for x in arrays])
    right = right[np.argsort(n[right], kind="stable")]
    a, b, apart = [], [], []
    for row in left.tolist():
        low = np.searchsorted(n[right], -(-rule.under * n[row] // rule.over))
        high = np.searchsorted(n[right], rule.largest(n[row]), side="right")
        others = right[low:high]
        others = others[(root[others] != root[row]) & (node[others] > node[row])]
        differ = np.bitwise_count(marks[others] ^ marks[row]).sum(1, dtype=np.int64)
        near = differ <= rule.apart(n[others] + n[row])
        a.append(np.full(int(near.sum()), row))
        b.append(others[near])
        apart.append(differ[near])
    a, b, apart = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, apart))
    up = {r: r for r in root.tolist()}

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    kept = []
    for i in np.argsort(apart, kind="stable").tolist():
        x, y = top(int(root[a[i]])), top(int(root[b[i]]))
        if x != y and similar(arrays[a[i]], arrays[b[i]], rule):
            up[x] = y
            kept.append(i)
    return node[a[kept]], node[b[kept]]


def alike(node: np.ndarray, root: np.ndarray, arrays: list[np.ndarray], rule: Rule, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`forest`, over sketches: pairs that connect all whose bits leave a link possible."""
    n = np.fromiter((int(x[0]) for x in arrays), np.int64, len(arrays))
    words = np.fromiter((len(x) - 1 for x in arrays), np.int64, len(arrays))
    label = np.unique(root, return_inverse=True)[1]
    right = right[np.argsort(n[right], kind="stable")]
    classes = {int(w): right[words[right] == w] for w in np.unique(words[right])}
    marks = {w: np.stack([arrays[i][1:] for i in rows.tolist()]) for w, rows in classes.items()}
    a, b = [], []
    for own in np.unique(words[left]).tolist():
        for w, rows in classes.items():
            if not own <= 2 * w <= 4 * own:  # sizes that link differ less
                continue
            least = min(own, w)
            there, sizes = folded(marks[w], least), n[rows]
            for row in left[words[left] == own].tolist():
                low = np.searchsorted(sizes, -(-rule.under * n[row] // rule.over))
                high = np.searchsorted(sizes, rule.largest(n[row]), side="right")
                others = rows[low:high]
                places = np.flatnonzero((label[others] != label[row]) & (node[others] > node[row]))
                if not len(places):
                    continue
                others = others[places]
                differ = np.bitwise_count(there[low + places] ^ folded(arrays[row][None, 1:], least)).sum(1, dtype=np.int64)
                others = others[differ <= rule.apart(n[others] + n[row])]
                if len(others):
                    joined, first = np.unique(label[others], return_index=True)
                    a.extend([row] * len(first))
                    b.extend(others[first].tolist())
                    label[np.isin(label, joined)] = label[row]
    return node[np.array(a, np.int64)], node[np.array(b, np.int64)]


def _compared(rule: Rule, compare):
    """mapInArrow over sorted blocks: a forest of the links between the two sides of a block, or within its one side.

    ``compare`` is :func:`forest` over shingles or :func:`alike` over sketches.
    """

    def linked(rows: list[tuple]) -> pa.RecordBatch:
        side, node, root = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        arrays = [np.frombuffer(r[6], np.uint64) for r in rows]
        left, right = (np.flatnonzero(side == k) for k in (0, 1))
        a, b = compare(node, root, arrays, rule, left, right if len(right) else left)
        if len(right):  # the smaller name may be on either side
            c, d = compare(node, root, arrays, rule, right, left)
            a, b = np.concatenate((a, c)), np.concatenate((b, d))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0][:3] != row[:3]:
                    yield linked(held)
                    held = []
                held.append(row)
        if held:
            yield linked(held)

    return run


def _links(blocks: DataFrame, rule: Rule, compare) -> DataFrame:
    """Links of rows (family, i, j, side, node, root, found); equal (family, i, j) are one block."""
    rows = blocks.select("family", "i", "j", "side", "node", "root", "found").repartition("family", "i", "j")
    return stage(rows.sortWithinPartitions("family", "i", "j", "side", "node").mapInArrow(_compared(rule, compare), "a long, b long"))


def _large(arrays: DataFrame, rule: Rule, compare) -> DataFrame:
    """Links of families of several blocks."""
    side = lambda seed, blocks: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(blocks)).cast("int")
    rows = arrays.select("family", "blocks", side(0, "blocks").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", F.col("node").alias("root"), "found")
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("node", F.lit(1)), "node"))
    pivots = rows.withColumn("place", place).filter(F.col("place") <= PIVOTS).drop("place").withColumn("side", F.lit(1))
    pivots = pivots.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = _links(rows.unionByName(pivots), rule, compare)

    keys = stage(arrays.select("family", "blocks", "node").join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node")))
    parts = keys.groupBy("family", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("inside"))
    share = (F.col("all") - F.col("inside")) / F.col("all")
    told = keys.join(main, "family").withColumn("outer", F.ceil(share * F.col("blocks")).cast("int")).filter("outer > 0")
    number = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spot = lambda i, j, k: F.struct(i.alias("i"), j.alias("j"), F.lit(k).alias("side"))
    inner = F.transform(number("outer"), lambda i: spot(i, side(0, "blocks"), 0))
    outer = F.transform(number("blocks"), lambda j: spot(side(2, "outer"), j, 1))
    spots = told.select("family", "node", "root", F.explode(F.when(F.col("root") == F.col("main"), inner).otherwise(F.concat(inner, outer))).alias("at"))
    rest = spots.select("family", "at.i", "at.j", "at.side", "node", "root").join(arrays.select("family", "node", "found"), ["family", "node"])
    return first.union(_links(rest, rule, compare))


def _all_links(arrays: DataFrame, rule: Rule, compare) -> DataFrame:
    """Links of rows (family, blocks, node, found) within each family."""
    none = F.lit(0)
    small = arrays.filter("blocks = 1").select("family", none.alias("i"), none.alias("j"), none.alias("side"), "node", F.col("node").alias("root"), "found")
    found = _links(small, rule, compare)
    large = arrays.filter("blocks > 1")
    return found if large.isEmpty() else found.union(_large(large, rule, compare))


def _blocked(families: DataFrame, shingles: int) -> DataFrame:
    """(node, family, n) with the number of blocks of the family, of at most so many shingles."""
    sizes = families.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(shingles))).cast("int").alias("blocks"))
    return stage(families.join(sizes, "family").select("node", "family", "n", "blocks"))


def _by_size(members: DataFrame, rule: Rule, shingles: int) -> DataFrame:
    """Families of several blocks cut into overlapping size bands; a linking pair is in one band or in two next ones."""
    band = F.floor(F.log("n") / F.lit(math.log(rule.over / rule.under)))
    large = members.filter("blocks > 1").withColumn("band", F.explode(F.array(band, band - 1)))
    cut = _blocked(large.select("node", F.xxhash64("family", "band").alias("family"), "n"), shingles)
    return members.filter("blocks = 1").unionByName(cut)


def _refined(families: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """(node, family, n) of the components of sets whose sketches leave a link possible; sets without such a partner go."""
    members = _by_size(_blocked(families, SKETCH_SHINGLES), rule, SKETCH_SHINGLES)
    sketches = stage(members.join(nodes.select("node", F.col("sketch").alias("found")), "node").select("family", "blocks", "node", "found"))
    found = components(_all_links(sketches, rule, alike)).withColumnRenamed("root", "family")
    return stage(found.join(nodes.select("node", "n"), "node"))


def links(docs: DataFrame, nodes: DataFrame, rule: Rule, near: DataFrame | None = None, by_size: bool = False) -> DataFrame:
    """Edges (a, b) between names of sets that connect all linking ones. ``docs``: text; ``nodes``: node, n, sketch.

    ``near`` are candidates (a, b) from elsewhere; they are tested like those that meet in tiles. ``by_size`` cuts
    families of several blocks into size bands first, which ships each set twice but compares fewer.
    """
    tiles = docs.select("text").mapInArrow(_tiles(rule), "tile long, node long")
    met = shared_table(tiles.repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(_met, "tile long, node long"))
    enough = met.groupBy("node").agg(F.count("*").alias("tiles")).filter("tiles > (node & 3)").select("node")
    families = stage(_families(_several(met.join(enough, "node", "left_semi")), near).join(nodes.select("node", "n"), "node"))
    members = _blocked(_refined(families, nodes, rule), BLOCK_SHINGLES)
    if by_size:
        members = _by_size(members, rule, BLOCK_SHINGLES)
    return _all_links(_needed(docs, members.select("node", "family", "blocks"), rule), rule, forest)


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", rule: Rule | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links, its own included)."""
    rule = rule or Rule()
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = stage(docs.select("doc_id", named_set(rule)(F.col("text")).alias("set")).select("doc_id", "set.node", "set.n", "set.sketch"))
    nodes = stage(rows.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(docs, nodes, rule))
    of_node = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = of_node.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members"))
    # Only sets with another member need a look-up; a hot set is one row of it.
    shared = of_node.select("node", "root").join(of_root.filter("members > 1"), "root").select("node", "component_id")
    return rows.join(shared, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
