"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its byte n-grams (three to six, with word edges; hashed),
so a misspelling that was never seen shares most of it. A window of words is the mean of its word
vectors; a linear softmax over two classes rates it, and a text is as toxic as its worst window, so
a long text does not thin out what it contains. Embeddings and softmax are trained together on the
driver, on a bounded sample: the ``SAMPLE_ROWS`` labelled rows with the smallest hash of their id.
Training starts with every window carrying its text's label, then only the worst windows of toxic
texts keep it.

Because the softmax is linear, scoring needs one number per n-gram bucket: its embedding times the
difference of the two class weights. That table has 2**BITS floats and is what tasks receive.

Defined cases: a null or word-free text scores as the median clean text; labels that are null are
left out, several labels of one id count as toxic if any is; without labels of both classes every
score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.rows import arrow_column, steps

SAMPLE_ROWS = 4000
BITS = 18
DIMENSIONS = 8
WINDOW = 4
SIZES = (3, 4, 5, 6)
#: N-grams of fewer training texts are left out; weight decay of a training step.
MIN_TEXTS = 4
DECAY = 0.02
THRESHOLD = 0.3

#: A-Z fold to a-z, every digit to 0, bytes of non-ASCII characters stay, everything else separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class Grams:
    """N-grams of some texts: word number and bucket of each, text and window of each word."""

    word: np.ndarray
    bucket: np.ndarray
    text: np.ndarray
    window: np.ndarray
    window_text: np.ndarray


def grams_of(texts: list[bytes]) -> Grams:
    folded = [b" ".join(t.translate(FOLD).split()) for t in texts]
    a = np.frombuffer(b" " + b" ".join(folded) + b"       ", np.uint8)
    edge = a == 32
    starts = np.flatnonzero(edge[:-1] & ~edge[1:]) + 1
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return Grams(none, none, none, none, none)
    word = np.cumsum(np.concatenate(([False], edge[:-1] & ~edge[1:])), dtype=np.int32) - 1
    ends = np.cumsum([len(f) + 1 for f in folded])
    text = np.searchsorted(ends, starts, "left").astype(np.int32)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    per_text = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, per_text)
    new_window = place % WINDOW == 0
    window = np.cumsum(new_window) - 1
    b = a.astype(np.uint32)
    h = b * np.uint32(0x9E3779B1)
    inner = None  # no edge strictly inside the n-gram
    words, buckets = [], []
    for size in range(2, max(SIZES) + 1):
        m = len(a) - size + 1
        h = (h[:m] ^ (h[:m] >> np.uint32(15))) * np.uint32(0x85EBCA77) + b[size - 1 :][:m]
        inner = np.ones(m, bool) if inner is None else inner[:m] & ~edge[size - 2 :][:m]
        if size in SIZES:
            at = np.flatnonzero(inner)
            x = h[at] ^ np.uint32(size * 0x27D4EB2F & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
            words.append(word[at + 1])
            buckets.append((x ^ (x >> np.uint32(15))) >> np.uint32(32 - BITS))
    return Grams(np.concatenate(words), np.concatenate(buckets), text, window, text[new_window])


def word_scores(grams: Grams, table: np.ndarray) -> np.ndarray:
    n = len(grams.text)
    total = np.bincount(grams.word, table[grams.bucket], n)
    return total / np.maximum(np.bincount(grams.word, minlength=n), 1)


@dataclass
class Model:
    table: np.ndarray  # float32 per bucket
    slope: float
    bias: float
    empty: float  # stands for the worst window of a text without words
    usable: bool


def worst_windows(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """The largest window mean of every text; NaN without words."""
    worst = np.full(len(texts), -np.inf)
    grams = grams_of(texts)
    if len(grams.text):
        begin = np.flatnonzero(np.diff(grams.window, prepend=-1))
        mean = np.add.reduceat(word_scores(grams, table), begin) / np.diff(np.append(begin, len(grams.window)))
        np.maximum.at(worst, grams.window_text, mean)
    return np.where(np.isfinite(worst), worst, np.nan)


def score_texts(texts: list[bytes], model: Model) -> np.ndarray:
    if not model.usable:
        return np.zeros(len(texts))
    z = worst_windows(texts, model.table)
    return _sigmoid(np.where(np.isnan(z), model.empty, z) * model.slope + model.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def calibrated(table: np.ndarray, texts: list[bytes], labels: np.ndarray) -> Model:
    """Fit slope and bias of the worst window's logit on texts that did not train the table (Newton steps)."""
    z = np.concatenate([worst_windows(part, table) for _, part in steps(texts)])
    z, labels = z[~np.isnan(z)], labels[~np.isnan(z)]
    scale = max(float(np.abs(z).max(initial=0)), 1e-9)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ beta)
        gradient = x.T @ (labels - p) - 0.01 * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        beta += np.clip(np.linalg.solve(curve, gradient), -4, 4)
    clean = z[labels == 0]
    return Model(table, float(beta[0] / scale), float(beta[1]), float(np.median(clean)) if len(clean) else 0.0, True)


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    """Train on three quarters of the texts and calibrate on the rest, or on all where a class would be missing."""
    nothing = Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, 0.0, False)
    labels = np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        return nothing
    kept = np.arange(len(texts)) % 4 != 3
    if any(len(set(labels[part].tolist())) < 2 for part in (kept, ~kept)):
        table = embed(texts, labels)
        return calibrated(table, texts, labels)
    table = embed([t for t, k in zip(texts, kept, strict=True) if k], labels[kept])
    return calibrated(table, [t for t, k in zip(texts, kept, strict=True) if not k], labels[~kept])


def embed(texts: list[bytes], labels: np.ndarray, rounds: int = 3, epochs: int = 30, rate: float = 0.08) -> np.ndarray:
    """Train embeddings and softmax jointly (Adam, whole sample per step); gives one number per bucket.

    The gradient of a window's logit difference with respect to a bucket's embedding is its share of the
    window times the class difference, so only one number per bucket has to be gathered per step.
    """
    # Equal words share their n-grams: keep each distinct word once.
    lexicon: dict[bytes, int] = {}
    of_word, of_window, window_text = [], [], []
    for i, t in enumerate(texts):
        words = t.translate(FOLD).split()
        of_word.append(np.fromiter((lexicon.setdefault(w, len(lexicon)) for w in words), np.int32, len(words)))
        windows = -(-len(words) // WINDOW)
        of_window.append(np.arange(len(words)) // WINDOW + len(window_text))
        window_text.extend([i] * windows)
    if not lexicon:
        return np.zeros(1 << BITS, np.float32)
    token, window, owner = np.concatenate(of_word), np.concatenate(of_window), np.array(window_text)
    words, word, bucket = list(lexicon), [], []
    base = 0
    for _, part in steps(words):
        grams = grams_of(part)
        word.append(grams.word + base)
        bucket.append(grams.bucket)
        base += len(part)
    word, bucket = np.concatenate(word), np.concatenate(bucket)
    # Buckets of n-grams that hardly any text has cannot teach anything: they keep a zero vector.
    in_texts = np.zeros(len(words))
    for ids in of_word:
        in_texts[np.unique(ids)] += 1
    support = np.bincount(bucket, in_texts[word], 1 << BITS)
    in_word = np.bincount(word, minlength=len(words)).astype(np.float32)
    taught = support[bucket] >= MIN_TEXTS
    word, bucket = word[taught], bucket[taught]
    used, bucket = np.unique(bucket, return_inverse=True)
    in_window = np.bincount(window).astype(np.float32)
    n, m = len(in_window), len(used)

    random = np.random.default_rng(7)
    vectors = random.normal(0, 0.1, (m, DIMENSIONS)).astype(np.float32)
    softmax = random.normal(0, 1.0, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, softmax, bias)]
    target = labels[owner].astype(np.float32)
    weight = np.ones(n, np.float32)
    step = 0

    def logits() -> np.ndarray:
        value = (vectors @ (softmax[:, 1] - softmax[:, 0]))[bucket]
        per_word = np.bincount(word, value, len(words)) / in_word
        return np.bincount(window, per_word[token], n) / in_window + (bias[1] - bias[0])

    for turn in range(rounds):
        for _ in range(epochs):
            step += 1
            error = ((_sigmoid(logits()) - target) * weight / weight.sum()).astype(np.float32)
            per_word = np.bincount(token, (error / in_window)[window], len(words)) / in_word
            per_bucket = np.bincount(bucket, per_word[word], m).astype(np.float32)
            toward = softmax[:, 1] - softmax[:, 0]
            slope = per_bucket @ vectors
            total = error.sum()
            gradients = (np.outer(per_bucket, toward), np.stack([-slope, slope], 1) + 1e-4 * softmax, np.array([-total, total], np.float32))
            for p, g, (mean, square) in zip((vectors, softmax, bias), gradients, state, strict=True):
                mean += 0.1 * (g - mean)
                square += 0.01 * (g * g - square)
                p *= 1 - rate * DECAY
                p -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        if turn + 1 < rounds:
            # Only windows that stand out keep the label of a toxic text; each toxic text keeps its worst one.
            z = logits()
            worst = np.full(len(texts), -np.inf)
            np.maximum.at(worst, owner, z)
            toxic = (labels[owner] == 1) & ((z > 0) | (z >= worst[owner]))
            target = toxic.astype(np.float32)
            share = max(float(toxic.mean()), 1e-3)
            weight = np.where(toxic, min(0.3 / share, 20.0), np.where(labels[owner] == 1, 0.2, 1.0)).astype(np.float32)
    table = np.zeros(1 << BITS, np.float32)
    table[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return table


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Fit on at most SAMPLE_ROWS labelled rows of ``docs``. Only they reach the driver."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter("key IS NOT NULL AND label IS NOT NULL")
    marked = marked.groupBy("key").agg(F.max("label").cast("int").alias("label"))
    ids = docs.select(F.col(key).alias("key")).join(marked, "key").select("key", "label").distinct()
    chosen = ids.orderBy(F.xxhash64("key", F.lit("toxicity sample")), "key").limit(SAMPLE_ROWS)
    # Bounded by SAMPLE_ROWS rows of two numbers.
    picked = {r["key"]: r["label"] for r in chosen.collect()}
    if not picked:
        return fit([], np.zeros(0, int))
    spark = docs.sparkSession
    wanted = spark.createDataFrame(list(picked), docs.schema[key].dataType).toDF("key")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(wanted), "key").groupBy("key").agg(F.min("text").alias("text"))
    got = sorted((r["key"], (r["text"] or "").encode()) for r in rows.collect())
    return fit([t for _, t in got], np.array([picked[k] for k, _ in got]))


def toxicity(model: Model, spark):
    """A Column function: text -> probability that the text is toxic."""
    sent = spark.sparkContext.broadcast((model.table, model.slope, model.bias, model.empty, model.usable))
    return arrow_column(lambda texts: score_texts(texts, Model(*sent.value)).tolist(), "double", pa.float64())
