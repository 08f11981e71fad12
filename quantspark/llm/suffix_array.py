"""Repeated substrings by suffix sorting, and their removal.

Every byte covered by a string of LENGTH bytes that also starts in a document with a smaller id goes.

1. Runs. Of the GRAM-byte grams inside a window of LENGTH bytes the one with the least hash names the
   window, so equal windows have equal names; neighbouring windows of one name are a run. Tasks send the
   name and a 64-bit hash of the run's bytes, in packed blocks by bucket of the name. Runs with equal
   bytes are one class: all but the smallest id are repeats as a whole. A class whose name occurs with other
   bytes too must be compared; for that its smallest id is enough. Each task settles its own classes
   first. A name with more than LOCAL classes in one step is hot: the task sends one marker and treats its
   classes as to be compared. Blocks tell texts by id and a short mark: runs learn by class and id alone, so
   rows of one id that share a short mark may learn together.
2. Segments. The texts of the classes to be compared go to the bucket of their name, or window by window
   to the bucket of the window where the name is hot, so no bucket holds a large group. Texts are
   written once, bucketed by id, so that no later join shuffles them.
3. Sorting. In a bucket the suffixes at window starts are sorted in two stages: suffixes smaller than
   their successors directly, the others by bucket scans over the first byte, which place the
   predecessor of each sorted suffix. Common prefixes of neighbours then tell which windows are equal;
   all but those of the smallest id are repeats.
4. Removal. Repeats come back per document as byte ranges and are cut from the text.

Equal texts are settled before: all but the smallest id of a text lose everything (if it has LENGTH bytes).
Defined cases: null is empty; texts shorter than LENGTH lose nothing; rows of one id never remove
each other's bytes; a null id counts as larger than all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.rows import bucketed_table, shared_table, stage, steps, to_bytes

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1  # grams in a window
NAME_BITS = 40
LOCAL = 48
#: Input bytes per bucket of the two exchanges, and segment bytes sorted at once.
BUCKET_BYTES, SORT_BYTES = 8 << 20, 2 << 20
#: Buckets whose replies meet in one bucket of replies.
REPLY_BUCKETS = 4
#: Input bytes per bucket of the written texts.
TABLE_BYTES = 16 << 20
#: What blocks of runs keep of a text's mark.
SHORT = 0xFFFF
PAD = 56  # bytes of a sort key, seven words
NO_ID = (1 << 63) - 1


def _slide(a: np.ndarray, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over SPAN neighbours from each place on."""
    width, out = 1, a
    while width * 2 <= SPAN:
        out, width = pick(out[:-width], out[width:]), width * 2
    rest = SPAN - width
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


#: Odd multiplier, its inverse modulo 2**64, and a random number per byte: a sum over places is a text hash.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)


def runs(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes, and per run of windows: text number, first and last window (in the text), name, hash."""
    raw = b"".join(texts)
    a = np.frombuffer(raw, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    none = np.zeros(0, np.int64)
    if len(a) < LENGTH:
        return raw, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h, power, by_size = a.astype(np.uint64) + np.uint64(1), BASE, {}
    for width in (1, 2, 4, 8):  # hashes of 2, 4, 8 and 16 bytes from their halves
        by_size[width] = h
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % (1 << 64)
    m = len(a) - GRAM + 1
    h = h[:m] * np.uint64(0xD6E8FEB86659FD93) + by_size[8][16:][:m]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = ((h ^ (h >> np.uint64(29))) >> np.uint64(64 - NAME_BITS)) | np.uint64(1)
    least = _slide(h, np.minimum)  # one per window
    inside = np.zeros(len(least) + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, (starts + sizes - LENGTH + 1)[long], -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, np.uint64(0))  # 0: not in one text
    begin = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    end = np.append(begin[1:], len(least))
    real = least[begin] > 0
    begin, end = begin[real], end[real]
    # Hash of the bytes of each run, from the first byte of its first window to the last of its last.
    powers, inverse, total = (np.zeros(len(a) + 1, np.uint64) for _ in range(3))
    for array, factor in ((powers, BASE), (inverse, INVERSE)):
        array[0], array[1:] = 1, factor
        np.cumprod(array, out=array)
    np.cumsum(BYTES[a] * powers[:-1], out=total[1:])
    last = end - 1 + LENGTH
    x = (total[last] - total[begin]) * inverse[begin] + (last - begin).astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(29)
    owner = np.searchsorted(starts, begin, "right") - 1
    # Empty texts share their start with the next one, which the search already prefers.
    return raw, owner, begin - starts[owner], end - 1 - starts[owner], least[begin], x


def two_stage(u: np.ndarray, need: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Suffix order of the places in ``need``; ``smaller`` marks suffixes smaller than their successors."""
    direct = np.flatnonzero(need & smaller)
    keys = np.lib.stride_tricks.sliding_window_view(u, PAD)[direct].copy().view(">u8").astype(np.uint64)
    direct = direct[np.lexsort(keys.T[::-1])]
    del keys
    bounds = np.searchsorted(u[direct], np.arange(257))
    induced = need & ~smaller
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        queue = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        placed = [queue]
        while len(queue):  # predecessors that begin with the same byte follow in the same bucket
            before = queue - 1
            queue = before[induced[before] & (u[before] == c)]
            placed.append(queue)
        placed.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(placed)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (u[before] > c)]
        if len(before):
            order = np.argsort(u[before], kind="stable")
            before = before[order]
            heads = u[before]
            cuts = np.flatnonzero(np.diff(heads)) + 1
            for piece in np.split(before, cuts):
                waiting[int(u[piece[0]])].append(piece)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeats(parts: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """Per segment: which of its windows (one per start) also occur in a segment of a smaller id."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    gap = bytes(PAD)
    u = np.frombuffer(gap + b"".join([x for p in parts for x in (p, gap)]) + b"\xff" + gap, np.uint8)
    starts = PAD + np.cumsum(sizes + PAD) - sizes - PAD
    windows = sizes - LENGTH + 1
    # Type of each place: compare the next byte that differs.
    change = np.flatnonzero(np.diff(u))
    nearest = np.searchsorted(change, np.arange(len(u) - 1))
    at = change[np.minimum(nearest, len(change) - 1)]
    smaller = np.append((u[at] < u[at + 1]) & (nearest < len(change)), False)
    direct = np.flatnonzero(smaller)
    # Needed: the window starts, and after the last of them on to the first suffix that is sorted directly.
    last = starts + windows - 1
    until = direct[np.searchsorted(direct, last)]
    mark = np.zeros(len(u) + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, until + 1, -1)
    need = np.cumsum(mark[:-1]) > 0
    order = two_stage(u, need, smaller)
    segment = np.full(len(u), -1, np.int64)
    owner = np.repeat(np.arange(len(parts)), windows)
    place = np.repeat(starts, windows) + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    segment[place] = owner
    order = order[segment[order] >= 0]
    # Adjacent common prefixes, as far as LENGTH bytes.
    views = np.lib.stride_tricks.sliding_window_view(u, LENGTH)
    same = np.empty(max(len(order) - 1, 0), bool)
    for i in range(0, len(same), 1 << 18):
        left, right = order[i : i + (1 << 18)], order[i + 1 : i + 1 + (1 << 18)]
        left = left[: len(right)]
        same[i : i + len(right)] = (views[left] == views[right]).all(1)
    begin = np.flatnonzero(np.concatenate(([True], ~same)))
    of = ids[segment[order]]
    least = np.repeat(np.minimum.reduceat(of, begin), np.diff(np.append(begin, len(order)))) if len(order) else of
    repeated = np.zeros(len(u), bool)
    repeated[order[of > least]] = True
    return [repeated[s : s + w] for s, w in zip(starts.tolist(), windows.tolist(), strict=True)]


def _runs(flags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true in all of several arrays at once: number of the array, begin and end in it."""
    if not flags:
        return (np.zeros(0, np.int64),) * 3
    starts = np.cumsum([1] + [len(f) + 1 for f in flags])  # an array stands between two places that are false
    inside = np.ones(starts[-1], bool)
    inside[starts - 1] = False
    joined = np.zeros(len(inside), np.int8)
    joined[inside] = np.concatenate(flags)
    edges = np.diff(joined)
    begin, end = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    number = np.searchsorted(starts, begin, "right") - 1
    return number, begin - starts[number], end - starts[number]


# ---------------------------------------------------------------- 1. runs

BLOCK_SCHEMA = "bucket int, kind int, ids binary, marks binary, names binary, hashes binary, owners binary"
REPLY_SCHEMA = "reply int, ids binary, marks binary, kinds binary, owners binary, hashes binary"
LEARNED_SCHEMA = "doc_id long, mark long, repeated binary, compare binary, hot binary"
#: What a text learns about a class of its runs.
REPEATED, COMPARE, HOT = 0, 1, 2
MARKER, ENTRY = 3, 4


def _classes(names, hashes, ids, marks):
    """Sort by class, id and mark. Gives the order, class number, class sizes and first places, smallest id of each class."""
    order = np.lexsort((marks, ids, hashes, names))
    n, h = names[order], hashes[order]
    new = np.concatenate(([True], (n[1:] != n[:-1]) | (h[1:] != h[:-1])))
    first = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, first


def _planes(values: np.ndarray) -> bytes:
    """All first bytes of the values, then all second ones and so on: shuffles compress the high ones away."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _of_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _steps(values: np.ndarray) -> bytes:
    """Like :func:`_planes`, of the differences between neighbours; for values in order or nearly so."""
    return _planes(np.diff(values, prepend=values.dtype.type(0)))


def _of_steps(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_of_planes(data, kind), dtype=kind)


def _send_runs(buckets: int):
    """Blocks of classes by bucket; replies that a step can give itself travel with them."""
    fields = ["bucket", "kind", "ids", "marks", "names", "hashes", "owners"]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]

    def replies(kind, ids, marks, owner, hashes) -> list[list]:
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
        out = []
        for piece in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
            if len(piece):
                t = owner[piece[0]]
                out.append([int(ids[t] + marks[t]) % buckets, kind, _steps(ids[[t]]), marks[[t]].tobytes(), b"", np.unique(hashes[piece]).tobytes(), b""])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_marks = batch.column("doc_id").to_numpy(zero_copy_only=False), (batch.column("mark").to_numpy(zero_copy_only=False) & SHORT).astype(np.uint16)
            for start, part in steps(to_bytes(batch.column("text")), 2 << 20):
                ids, marks = all_ids[start : start + len(part)], all_marks[start : start + len(part)]
                _, owner, _, _, names, hashes = runs(part)
                if not len(owner):
                    continue
                order, number, first = _classes(names, hashes, ids[owner], marks[owner])
                owner, names, hashes = owner[order], names[order], hashes[order]
                least = ids[owner][first][number]
                repeated = ids[owner] > least
                rows = replies(REPEATED, ids, marks, owner[repeated], hashes[repeated])
                lead = first  # one text speaks for each class
                begin = np.flatnonzero(np.concatenate(([True], names[lead][1:] != names[lead][:-1])))
                many = np.diff(np.append(begin, len(lead)))
                hot = np.repeat(many > LOCAL, many)
                rows += replies(HOT, ids, marks, owner[lead[hot]], hashes[lead[hot]])
                where = (names % np.uint64(buckets)).astype(np.int64)
                for kind, chosen in ((MARKER, lead[begin][many > LOCAL]), (ENTRY, lead[~hot])):
                    chosen = chosen[np.argsort(where[chosen], kind="stable")]
                    cuts = np.searchsorted(where[chosen], np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(cuts)).tolist():
                        own = chosen[cuts[b] : cuts[b + 1]]
                        short = (names[own] // np.uint64(buckets)).astype(np.uint32)
                        if kind == MARKER:
                            rows.append([b, kind, b"", b"", _steps(short), b"", b""])
                        else:
                            used, local = np.unique(owner[own], return_inverse=True)
                            rows.append([b, kind, _steps(ids[used]), marks[used].tobytes(), _steps(short), hashes[own].tobytes(), local.astype(_numbers(len(used))).tobytes()])
                yield _blocks(rows, fields, types)

    return run


def _blocks(rows: list[list], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def _by_bucket(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[list[dict]]:
    """The rows of one bucket after the other, from batches in bucket order."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _numbers(count: int) -> type:
    """The type that numbers the texts of a block."""
    return np.uint32 if count > 65_535 else np.uint16


def _answer(replies: int):
    """What a bucket knows of its texts, their repeated classes and those to be compared, in one block per bucket of replies."""
    fields, types = ["reply", "ids", "marks", "kinds", "owners", "hashes"], [pa.int32(), *[pa.binary()] * 5]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        ids, marks, kinds, hashes = (np.concatenate(x) for x in zip(*out, strict=True))
        where = ((ids.view(np.uint64) * np.uint64(BASE) + marks) >> np.uint64(20)) % np.uint64(replies)
        order = np.lexsort((marks, ids, where))
        where, ids, marks, kinds, hashes = (x[order] for x in (where, ids, marks, kinds, hashes))
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])))
        number = np.cumsum(new) - 1
        rows = []
        for begin, end in zip(*_cuts(where), strict=True):
            own = slice(begin, end)
            used = begin + np.flatnonzero(new[own])
            owners = (number[own] - number[begin]).astype(_numbers(len(used)))
            rows.append([int(where[begin]), _steps(ids[used]), marks[used].tobytes(), kinds[own].tobytes(), owners.tobytes(), hashes[own].tobytes()])
        return _blocks(rows, fields, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            out, parts, hot_names = [], [], []

            def say(kind: int, ids, marks, hashes, out=out) -> None:
                out.append((ids, marks, np.full(len(hashes), kind, np.int8), hashes))

            for r in rows:
                if r["kind"] == MARKER:
                    hot_names.append(_of_steps(r["names"], np.uint32))
                    continue
                ids, marks, hashes = _of_steps(r["ids"], np.int64), np.frombuffer(r["marks"], np.uint16), np.frombuffer(r["hashes"], np.uint64)
                if r["kind"] == ENTRY:
                    own = np.frombuffer(r["owners"], _numbers(len(ids)))
                    parts.append((_of_steps(r["names"], np.uint32), hashes, ids[own], marks[own]))
                else:  # of one text
                    say(r["kind"], np.repeat(ids, len(hashes)), np.repeat(marks, len(hashes)), hashes)
            if parts:
                names, hashes, ids, marks = (np.concatenate(x) for x in zip(*parts, strict=True))
                order, number, first = _classes(names, hashes, ids, marks)
                names, hashes, ids, marks = names[order], hashes[order], ids[order], marks[order]
                repeated = ids > ids[first][number]
                begin = np.flatnonzero(np.concatenate(([True], names[first][1:] != names[first][:-1])))
                many = np.diff(np.append(begin, len(first)))  # classes of each name
                hot = np.isin(names[first][begin], np.unique(np.concatenate(hot_names))) if hot_names else np.zeros(len(begin), bool)
                hot |= many > 8 * LOCAL
                lead = np.zeros(len(names), bool)
                lead[first] = True
                of_name = np.repeat(np.arange(len(begin)), many)[number]
                for kind, chosen in ((REPEATED, repeated), (HOT, lead & hot[of_name]), (COMPARE, lead & ~hot[of_name] & (many > 1)[of_name])):
                    say(kind, ids[chosen], marks[chosen], hashes[chosen])
            if any(len(x[0]) for x in out):
                yield packed(out)

    return run


def _cuts(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs of equal values; there is one at least."""
    begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return begin.tolist(), [*begin[1:].tolist(), len(values)]


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text (id and short mark) of a bucket of replies all that the buckets know: the hashes of its classes by kind."""
    fields, types = ["doc_id", "mark", "repeated", "compare", "hot"], [pa.int64(), pa.int64(), *[pa.binary()] * 3]
    for rows in _by_bucket(batches, "reply"):
        parts = []
        for r in rows:
            ids = _of_steps(r["ids"], np.int64)
            own = np.frombuffer(r["owners"], _numbers(len(ids)))
            parts.append((ids[own], np.frombuffer(r["marks"], np.uint16).astype(np.int64)[own], np.frombuffer(r["kinds"], np.int8), np.frombuffer(r["hashes"], np.uint64)))
        ids, marks, kinds, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((kinds, marks, ids))
        ids, marks, kinds, hashes = ids[order], marks[order], kinds[order], hashes[order]
        text = np.cumsum(np.concatenate(([0], (np.diff(ids) != 0) | (np.diff(marks) != 0))))
        first = np.flatnonzero(np.concatenate(([True], np.diff(text) != 0)))
        cuts = {kind: np.searchsorted(text * 4 + kinds, np.arange(len(first)) * 4 + kind).tolist() for kind in range(4)}
        of = lambda kind: [hashes[b:e].tobytes() for b, e in zip(cuts[kind], cuts[kind + 1], strict=True)]  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids[first], marks[first], of(REPEATED), of(COMPARE), of(HOT)), types, strict=True)], fields)


# ---------------------------------------------------------------- 2. segments

SEGMENT_SCHEMA = "bucket int, ids binary, marks binary, begins binary, sizes binary, routes binary, bytes binary"
RANGE_SCHEMA = "doc_id long, mark long, begin long, end long"


def _pack(bucket: int, ids, marks, begins, routes, parts: list[bytes]) -> list:
    sizes = np.fromiter(map(len, parts), np.int32, len(parts))
    return [bucket, _steps(ids), marks.tobytes(), _planes(begins), _planes(sizes), _planes(routes), pa.compress(b"".join(parts), "zstd", asbytes=True)]


def _sorted_ranges(ids, marks, begins, routes, parts: list[bytes]):
    """Sort segments in portions of whole routes. Yields (places, repeated windows of each)."""
    order = np.argsort(routes, kind="stable")
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))[order]
    total = np.cumsum(sizes)
    group = np.concatenate(([0], np.cumsum(routes[order][1:] != routes[order][:-1])))
    ends = np.concatenate((np.flatnonzero(np.diff(group)), [len(order) - 1]))
    portion = (total[ends] // SORT_BYTES)[group]
    for piece in np.split(order, np.flatnonzero(np.diff(portion)) + 1):
        yield piece, repeats([parts[i] for i in piece], ids[piece])


def _ranges(ids, marks, begins, places, flags) -> list[list]:
    number, begin, end = _runs(flags)
    of = places[number]
    return np.column_stack((ids[of], marks[of], begins[of] + begin, begins[of] + end - 1 + LENGTH)).tolist()


def _status(owner: np.ndarray, hashes: np.ndarray, learned: dict[int, list[bytes]]) -> np.ndarray:
    """Per run what its text has learned about its class, -1 if nothing; of several kinds the last one in ``learned``."""
    told, places = [hashes], [owner]
    for joined in learned.values():
        told.append(np.frombuffer(b"".join(joined), np.uint64))
        places.append(np.repeat(np.arange(len(joined)), np.fromiter(map(len, joined), np.int64, len(joined)) // 8))
    all_hashes, all_places = np.concatenate(told), np.concatenate(places)
    order = np.lexsort((all_hashes, all_places))
    new = (np.diff(all_places[order]) != 0) | (all_hashes[order][1:] != all_hashes[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.concatenate(([0], np.cumsum(new)))[: len(order)]
    kinds = np.full(len(order), -1, np.int8)
    at = np.cumsum([len(x) for x in told])
    for i, kind in enumerate(learned):
        kinds[group[at[i] : at[i + 1]]] = kind
    return kinds[group[: len(hashes)]]


def _send_segments(buckets: int):
    """Settle what a step can, send the windows that must be compared. Settled ranges go to bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["bucket", "ids", "marks", "begins", "sizes", "routes", "bytes"], [pa.int32(), *[pa.binary()] * 6]
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("doc_id", "mark", "repeated", "compare", "hot")}
            for start, part in steps(to_bytes(batch.column("text")), 2 << 20):
                raw, owner, first, last, name, hashes = runs(part)
                offset = np.concatenate(([0], np.cumsum([len(p) for p in part])))
                bounds = np.searchsorted(owner, np.arange(len(part) + 1))
                status = _status(owner, hashes, {kind: columns[c][start : start + len(part)] for kind, c in ((COMPARE, "compare"), (HOT, "hot"), (REPEATED, "repeated"))})
                settled: list[list[int]] = []
                for t in range(len(part)):
                    at = np.flatnonzero(status[bounds[t] : bounds[t + 1]] == REPEATED) + bounds[t]
                    if len(at):  # neighbouring runs make one range
                        cutting = np.flatnonzero(first[at][1:] > last[at][:-1] + LENGTH) + 1
                        for piece in np.split(at, cutting):
                            settled.append([columns["doc_id"][start + t], columns["mark"][start + t], int(first[piece[0]]), int(last[piece[-1]]) + LENGTH])
                chosen = np.flatnonzero(status > REPEATED)
                left = []
                if len(chosen):
                    first, last, name, hot, of = first[chosen], last[chosen], name[chosen], status[chosen] == HOT, owner[chosen]
                    parts = [raw[b:e] for b, e in zip((offset[of] + first).tolist(), (offset[of] + last + LENGTH).tolist(), strict=True)]
                    doc = np.array(columns["doc_id"][start : start + len(part)], np.int64)[of]
                    mark = np.array(columns["mark"][start : start + len(part)], np.int64)[of]
                    for places, flags in _sorted_ranges(doc, mark, first, name, parts):
                        settled.extend(_ranges(doc, mark, first, places, flags))
                        new = [~f for f in flags]
                        for i in np.flatnonzero(hot[places]).tolist():
                            left.extend((int(places[i]), w, w + LENGTH, True) for w in np.flatnonzero(new[i]).tolist())
                            new[i] = new[i][:0]
                        number, begin, end = _runs(new)
                        left.extend(zip(places[number].tolist(), begin.tolist(), (end - 1 + LENGTH).tolist(), [False] * len(number), strict=True))
                rows = []
                if settled:
                    x = np.array(settled, np.int64)
                    x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))].T.copy()
                    rows.append([-1, _steps(x[0]), x[1].tobytes(), _planes(x[2]), _planes(x[3]), b"", b""])
                if left:
                    pieces = [parts[i][b:e] for i, b, e, _ in left]
                    index, at = np.array([x[0] for x in left]), np.array([x[1] for x in left])
                    route = name[index].copy()
                    for j in np.flatnonzero([x[3] for x in left]).tolist():
                        route[j] = int.from_bytes(hashlib.blake2b(pieces[j], digest_size=8).digest(), "little")
                    bucket = (route % np.uint64(buckets)).astype(np.int64)
                    order = np.lexsort((first[index] + at, mark[index], doc[index], bucket))
                    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(cuts)).tolist():
                        own = order[cuts[b] : cuts[b + 1]]
                        rows.append(_pack(b, doc[index[own]], mark[index[own]], first[index[own]] + at[own], route[own], [pieces[j] for j in own]))
                if rows:
                    yield _blocks(rows, names, types)

    return run


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated byte ranges of each bucket; settled ranges pass."""
    names, types = ["doc_id", "mark", "begin", "end"], [pa.int64()] * 4

    def emit(rows: list[list]) -> pa.RecordBatch:
        return _blocks(rows, names, types)

    def settled(row: dict) -> pa.RecordBatch:
        read = (_of_steps, np.frombuffer, _of_planes, _of_planes)
        return pa.RecordBatch.from_arrays([pa.array(f(row[k], np.int64)) for f, k in zip(read, ("ids", "marks", "begins", "sizes"), strict=True)], names)

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] < 0:
                yield settled(row)
                continue
            if held and row["bucket"] != held[0]["bucket"]:
                yield emit(_bucket_ranges(held))
                held = []
            held.append(row)
    if held:
        yield emit(_bucket_ranges(held))


def _bucket_ranges(rows: list[dict]) -> list[list]:
    read = (("ids", _of_steps, np.int64), ("marks", np.frombuffer, np.int64), ("begins", _of_planes, np.int64), ("sizes", _of_planes, np.int32), ("routes", _of_planes, np.uint64))
    joined = {k: np.concatenate([f(r[k], t) for r in rows]) for k, f, t in read}
    raw = b"".join(pa.decompress(r["bytes"], int(_of_planes(r["sizes"], np.int32).sum(dtype=np.int64)), "zstd", asbytes=True) for r in rows)
    ends = np.cumsum(joined["sizes"].astype(np.int64))
    parts = [raw[b:e] for b, e in zip((ends - joined["sizes"]).tolist(), ends.tolist(), strict=True)]
    out: list[list] = []
    for places, flags in _sorted_ranges(joined["ids"], joined["marks"], joined["begins"], joined["routes"], parts):
        out.extend(_ranges(joined["ids"], joined["marks"], joined["begins"], places, flags))
    return out


# ---------------------------------------------------------------- 4. removal


def cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the ranges, and the ranges merged."""
    merged: list[tuple[int, int]] = []
    for b, e in sorted(ranges):
        if merged and b <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((b, e))
    kept, at = [], 0
    for b, e in merged:
        kept.append(text[at:b])
        at = e
    return b"".join([*kept, text[at:]]), merged


def _cut_rows(with_text: bool):
    """Cut each text: its sums, or the text that is left."""
    names = ["doc_id", "mark", "kept"] if with_text else ["doc_id", "mark", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.binary()] if with_text else [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, mark, text, ranges in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "mark", "text", "ranges")), strict=True):
                kept, merged = cut(text, [(r["begin"], r["end"]) for r in ranges])
                sums = [sum(e - b for b, e in merged), len(merged), hashlib.sha256(kept).hexdigest()]
                out.append([doc_id, mark, kept] if with_text else [doc_id, mark, *sums])
            yield _blocks(out, names, types)

    return run


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; and the changed texts
    (doc_id, mark, kept), one per distinct text that keeps a part."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(whole).alias("mark"), whole.cast("binary").alias("text"))
    names = stage(rows.select("doc_id", "mark", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")))
    total = names.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, total // BUCKET_BYTES)
    spokesmen = names.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("mark").alias("mark"))

    texts = bucketed_table(rows, ["doc_id", "mark"], max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TABLE_BYTES))

    sent = rows.mapInArrow(_send_runs(buckets), BLOCK_SCHEMA)
    replies = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer(max(1, buckets // REPLY_BUCKETS)), REPLY_SCHEMA)
    lists = replies.repartition("reply").sortWithinPartitions("reply").mapInArrow(_learned, LEARNED_SCHEMA)
    told = spokesmen.select("doc_id", "mark", F.col("mark").bitwiseAND(F.lit(SHORT)).alias("short"))
    lists = lists.withColumnRenamed("mark", "short").join(told, ["doc_id", "short"]).drop("short")
    compared = texts.join(lists, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).mapInArrow(_send_segments(buckets), SEGMENT_SCHEMA)
    scattered = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("ids", "begins"), F.lit(1 << 20)).cast("int"))
    ranges = compared.repartition(scattered).sortWithinPartitions("bucket").mapInArrow(_sort_buckets, RANGE_SCHEMA)
    gathered = shared_table(ranges.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("begin", "end")).alias("ranges")))
    repeating = texts.join(gathered, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    done = repeating.mapInArrow(_cut_rows(False), "doc_id long, mark long, n_removed long, n_spans long, kept_sha256 string")
    first = spokesmen.select("sha", F.col("doc_id").alias("first_id"))
    known = names.join(first, "sha").join(done, ["doc_id", "mark"], "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= LENGTH)
    result = known.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).cast(docs.schema[key].dataType).alias("doc_id"), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    return result, repeating.mapInArrow(_cut_rows(True), "doc_id long, mark long, kept binary")
