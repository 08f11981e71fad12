"""Language identification: script ranges, per-word n-gram scores, Viterbi spans.

A word is a run of letters. The script of its letters (code point ranges) narrows the languages to those
seen with that script in training; among them a naive Bayes score over the word's character n-grams
(one to three, with word edges) rates each language. Viterbi with a penalty for every switch labels the
words, so a text in two languages becomes spans. The prediction is the language that labels most
letters; the score is its share of letters.

Training counts n-grams over a bounded sample: at most ``SAMPLE_ROWS`` labelled rows per language, by
hash of the id. Every distinct language is learned; a table with more than ``MAX_LANGUAGES`` of them, whose
model would not fit a worker, is refused with an error. Defined cases: a null text
or one without a letter is ``und`` with score 0; rows without language do not train; without any
training row everything is ``und``; ties go to the language first in code point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.rows import STEP_BYTES, arrow_column, steps, to_bytes

SAMPLE_ROWS = 1500
MAX_LANGUAGES = 1024
BITS = 16
#: Log cost of changing the language between two words.
SWITCH = 9.0
#: Scale of a word's log score; below one because n-grams overlap.
TEMPER = 0.6
#: Log cost of a language that was not seen with the word's script.
WRONG_SCRIPT = 60.0
BLOCK = 64

# First and last code point of the letters of each script.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x3134F),
]
SCRIPT_NAMES = sorted({name for name, _, _ in SCRIPTS}) + ["other"]


def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter; the number of its script."""
    letter = np.zeros(0x110000, bool)
    for begin in (0, 0x10000, 0x20000, 0x30000):
        letter[begin : begin + 0x10000] = [chr(c).isalpha() for c in range(begin, begin + 0x10000)]
    script = np.full(0x110000, len(SCRIPT_NAMES) - 1, np.int8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return letter, script


@dataclass
class Words:
    """The words of some texts: text number, letters and script of each; word number and bucket of each n-gram."""

    text: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]


def words_of(texts: list[bytes], tables: tuple[np.ndarray, np.ndarray]) -> Words:
    letter_at, script_at = tables
    decoded = [t.decode().lower() for t in texts]
    joined = " " + " ".join(decoded) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(d) + 1 for d in decoded])
    letter = letter_at[codes]
    first = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    after = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    codes = np.where(letter, codes, np.uint32(32))
    word = np.cumsum(np.concatenate(([False], letter[1:] & ~letter[:-1])), dtype=np.int32) - 1
    grams = []
    h = codes * np.uint32(0x9E3779B1)
    one = np.flatnonzero(letter)
    grams.append((word[one], _bucket(h[one])))
    h2 = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + h[1:]
    two = np.flatnonzero(letter[:-1] | letter[1:])
    grams.append((np.where(letter[two], word[two], word[two + 1]), _bucket(h2[two])))
    h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + h[2:]
    three = np.flatnonzero(letter[1:-1])
    grams.append((word[three + 1], _bucket(h3[three])))
    return Words(np.searchsorted(ends, first, "left").astype(np.int32), (after - first).astype(np.int64), script_at[codes[first]], grams)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (h ^ (h >> np.uint32(15))) >> np.uint32(32 - BITS)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language, float32
    allowed: np.ndarray  # script x language, float32: 0 or -WRONG_SCRIPT


def viterbi(emit: np.ndarray, starts: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of many word sequences laid end to end; ``starts`` are their first words.

    Each sequence is cut into blocks of BLOCK words, or four times the labels, so that memory stays a multiple of
    words times labels. All blocks advance together: first the best score
    from every label before a block to every label at its end, then a pass over the blocks of each
    sequence, then the labels inside. Every step is an array operation over blocks.
    """
    n, k = emit.shape
    if n == 0 or k < 2:
        return np.zeros(n, np.int32)
    width = max(BLOCK, 4 * k)
    sizes = np.diff(np.append(starts, n))
    blocks = -(-sizes // width)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = starts[owner] + rank * width
    size = np.minimum(width, sizes[owner] - rank * width)
    order = np.argsort(-size, kind="stable")
    alive = [int(np.count_nonzero(size > t)) for t in range(width)]
    begin_o = begin[order]

    def advance(score: np.ndarray, t: int) -> np.ndarray:
        """One word on; ``score`` has labels last."""
        best = np.maximum(score, score.max(-1, keepdims=True) - np.float32(switch))
        e = emit[begin_o[: len(score)] + t]
        return best + (e[:, None, :] if score.ndim == 3 else e)

    move = np.full((len(begin), k, k), -np.float32(1e30), np.float32)
    move[:, np.arange(k), np.arange(k)] = 0
    for t in range(width):
        if alive[t]:
            move[: alive[t]] = advance(move[: alive[t]], t)
    total = np.empty_like(move)
    total[order] = move
    # Scores of the labels before each block, sequence by sequence in step.
    enter = np.zeros((len(begin), k), np.float32)
    at_block = np.cumsum(blocks) - blocks
    longest = int(blocks.max())
    for b in range(1, longest):
        here = at_block[blocks > b] + b
        enter[here] = (enter[here - 1][:, :, None] + total[here - 1]).max(1)
        enter[here] -= enter[here].max(1, keepdims=True)
    # Inside the blocks: keep the best predecessor of every label.
    score, back = enter[order], np.zeros((width, len(begin), k), np.int16)
    for t in range(width):
        m = alive[t]
        if not m:
            break
        top = score[:m].argmax(1)
        peak = score[np.arange(m), top][:, None] - np.float32(switch)
        back[t, :m] = np.where(score[:m] >= peak, np.arange(k, dtype=np.int16)[None, :], top[:, None].astype(np.int16))
        score[:m] = np.maximum(score[:m], peak) + emit[begin_o[:m] + t]
    # For every final label of a block: the label before its first word.
    entry = np.tile(np.arange(k, dtype=np.int16), (len(begin), 1))
    for t in range(width - 1, -1, -1):
        if alive[t]:
            entry[: alive[t]] = np.take_along_axis(back[t, : alive[t]], entry[: alive[t]].astype(np.int64), 1)
    final, entered = np.empty_like(score), np.empty_like(entry)
    final[order], entered[order] = score, entry
    last = np.zeros(len(begin), np.int64)
    tail = at_block + blocks - 1
    last[tail] = final[tail].argmax(1)
    for b in range(longest - 1, 0, -1):
        here = at_block[blocks > b] + b
        last[here - 1] = entered[here, last[here]]
    labels = np.zeros(n, np.int32)
    current = last[order]
    for t in range(width - 1, -1, -1):
        m = alive[t]
        if m:
            labels[begin_o[:m] + t] = current[:m]
            current[:m] = back[t, np.arange(m), current[:m]]
    return labels


def emissions(words: Words, model: Model) -> np.ndarray:
    n, k = len(words.text), len(model.languages)
    emit = np.zeros((n, k), np.float32)
    for owner, bucket in words.grams:
        if len(owner):
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            emit[owner[begin]] += np.add.reduceat(model.scores[bucket], begin, axis=0)
    return emit * np.float32(TEMPER) + model.allowed[words.script]


def label_texts(texts: list[bytes], model: Model, tables) -> list[dict]:
    """Language, score and spans (first word, words, language) of each text."""
    words = words_of(texts, tables)
    out = [{"lang": "und", "score": 0.0, "spans": []} for _ in texts]
    if not len(words.text) or not model.languages:
        return out
    starts = np.flatnonzero(np.diff(words.text, prepend=-1))
    labels = viterbi(emissions(words, model), starts, SWITCH)
    k = len(model.languages)
    share = np.bincount(words.text.astype(np.int64) * k + labels, words.letters, len(texts) * k).reshape(len(texts), k)
    winner, whole = share.argmax(1), share.sum(1)
    change = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(words.text, prepend=-1) != 0))
    length = np.diff(np.append(change, len(labels)))
    start_of = np.full(len(texts), 0)
    start_of[words.text[starts]] = starts
    for text in words.text[starts].tolist():
        out[text].update(lang=model.languages[winner[text]], score=float(share[text, winner[text]] / whole[text]))
    for at, many in zip(change.tolist(), length.tolist(), strict=True):
        text = int(words.text[at])
        out[text]["spans"].append({"first": at - int(start_of[text]), "words": many, "lang": model.languages[labels[at]]})
    return out


def train(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Count n-grams per language over the bounded sample. Only counts per (language, bucket) reach the driver."""
    known = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key), F.lit("language sample")).alias("h"))
    known = known.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{lang} has more than {MAX_LANGUAGES} values; a model of that size does not fit a worker")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), np.float32))
    # At most MAX_LANGUAGES thresholds: a share of the hash range with about SAMPLE_ROWS rows each.
    limit = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(min(1.0, SAMPLE_ROWS / r["count"]) * 1_000_000)))])
    sample = known.filter(F.pmod("h", F.lit(1_000_000)) < limit[F.col("lang")]).select("text", "lang")
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = code_tables()
        grams = np.zeros((len(languages), 1 << BITS), np.int64)
        scripts = np.zeros((len(languages), len(SCRIPT_NAMES)), np.int64)
        for batch in batches:
            langs = [number[x] for x in batch.column("lang").to_pylist()]
            for start, part in steps(to_bytes(batch.column("text"))):
                words = words_of(part, tables)
                if not len(words.text):
                    continue
                of_word = np.array(langs[start : start + len(part)])[words.text]
                for owner, bucket in words.grams:
                    np.add.at(grams, (of_word[owner], bucket), 1)
                np.add.at(scripts, (of_word, words.script), words.letters)
        both = np.concatenate([grams, scripts], axis=1)
        at = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(both[at], pa.int64())], ["language", "bucket", "n"])

    counts = sample.mapInArrow(count, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((len(languages), (1 << BITS) + len(SCRIPT_NAMES)))
    both[counts["language"], counts["bucket"]] = counts["n"]
    grams, scripts = both[:, : 1 << BITS], both[:, 1 << BITS :]
    smooth = 0.5
    scores = np.log((grams + smooth) / (grams.sum(1, keepdims=True) + smooth * (1 << BITS)))
    scores -= scores.max(0, keepdims=True)  # only differences between languages count
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    allowed = np.where((share >= 0.01) | (share.max(0, keepdims=True) < 0.01), 0.0, -WRONG_SCRIPT)
    return Model(languages, np.ascontiguousarray(scores.T, np.float32), np.ascontiguousarray(allowed.T, np.float32))


def language(model: Model, spark):
    """A Column function: text -> struct(lang, score, spans). The model's size is languages x 2**BITS."""
    sent = spark.sparkContext.broadcast((model.languages, model.scores, model.allowed))
    kept: list = []

    def label(texts: list[bytes]) -> list[dict]:
        if not kept:
            kept.append(code_tables())
        model, out = Model(*sent.value), []
        # Emissions take words times languages: many languages, smaller steps.
        for _, part in steps(texts, STEP_BYTES * 16 // max(16, len(model.languages))):
            out.extend(label_texts(part, model, kept[0]))
        return out

    span = pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
    return arrow_column(label, "lang string, score double, spans array<struct<first:long,words:long,lang:string>>", kind)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with one more column ``language``; its name gets underscores if ``docs`` has that column."""
    from quantspark.llm.rows import fresh

    return docs.withColumn(fresh(docs, "language"), language(model, docs.sparkSession)(F.col(text)))


def is_known(found: Column) -> Column:
    return found["lang"] != "und"
