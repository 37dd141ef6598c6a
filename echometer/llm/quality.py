"""Document quality scores from random-indexing word vectors and a two-layer network.

Words (maximal ``[^\\x20\\x09-\\x0D]`` runs, lower-cased for vectors) hash into ``BUCKETS`` buckets. Each
bucket has a fixed sparse random index vector (``NONZERO`` entries of +1 or -1 among ``DIM``). A word's
vector is its random-indexing context vector: the sum of the index vectors of the words within
``WINDOW`` places of each of its occurrences in the training sample, normalised. A document is the
mean of its words' vectors (each occurrence counts), beside six statistics of its text (share of
upper-case letters, of letters, of punctuation, of distinct words, mean word length, log word count).

The network has one hidden layer of ``HIDDEN`` rectified units and a logistic output, trained in numpy
on the driver; a temperature for the logit is then fitted on a fifth of the sample that the network
didn't see, so that scores are calibrated probabilities of ``quality = 1``.

Learning sees only a bounded sample: at most ``SAMPLE`` labelled rows (a documented parameter) whose
crc32 of the decimal doc_id is not 0 mod 5, the first by a hash of their id. The sample ids are at most
``SAMPLE`` rows and reach the documents by broadcast; context vectors are summed per block of buckets in
Spark, so the driver gets ``BUCKETS x DIM`` numbers, whatever the corpus. Scoring is one narrow pass
over all documents, in Arrow batches.

Edge cases: null text is empty; an empty text has a zero vector and zero statistics, and its score is
what the network gives for that. A row without doc_id is never learned from and has ``held_out`` false.
Labels: an id's label is its largest non-null quality; ids without one are not learned from.
Repeated rows get equal scores. Extra columns are ignored. An empty table gives no rows; without any
labelled row to learn from, every score is 0.5.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echometer.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BUCKETS = 1 << 15
DIM = 64
NONZERO = 6
WINDOW = 2
#: Most labelled rows learned from.
SAMPLE = 4000
HIDDEN = 32
EPOCHS = 400
SEED = 20240601
#: Buckets summed together in one row of the context sums.
BLOCK = 1024
THRESHOLD = 0.3
STATISTICS = 6


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the decimal id is 0 mod 5 (contract)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def index_vectors() -> np.ndarray:
    """The fixed sparse random index vector of every bucket, as a dense ``BUCKETS x DIM`` matrix."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    signs = rng.choice(np.array([-1.0, 1.0], np.float32), (BUCKETS, NONZERO))
    out = np.zeros((BUCKETS, DIM), np.float32)
    np.put_along_axis(out, places, signs, axis=1)
    return out


def buckets_of(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    for word in set(words):
        known[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
    return np.fromiter((known[w] for w in words), np.int64, len(words))


def context_sums(texts: list[str], index: np.ndarray) -> np.ndarray:
    """Sum, per bucket, of the index vectors of the words near each occurrence."""
    sums = np.zeros((BUCKETS, DIM), np.float32)
    for text in texts:
        at = buckets_of(WORD.findall(text))
        for shift in range(1, WINDOW + 1):
            if len(at) > shift:
                np.add.at(sums, at[:-shift], index[at[shift:]])
                np.add.at(sums, at[shift:], index[at[:-shift]])
    return sums


@cache
def _kinds() -> np.ndarray:
    """Per code point: 1 letter, 2 upper-case letter, 4 punctuation (neither letter, digit nor space)."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        out[c] = (1 if s.isalpha() else 0) | (2 if s.isupper() else 0) | (4 if not s.isalnum() and not s.isspace() else 0)
    return out


def statistics(text: str, words: list[str]) -> np.ndarray:
    kinds = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    size = max(len(kinds), 1)
    letters = int(np.count_nonzero(kinds & 1))
    return np.array(
        [
            np.count_nonzero(kinds & 2) / max(letters, 1),
            letters / size,
            np.count_nonzero(kinds & 4) / size,
            len(set(words)) / max(len(words), 1),
            sum(map(len, words)) / max(len(words), 1) / 10,
            math.log1p(len(words)) / 10,
        ],
        np.float32,
    )


def features(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Pooled word vectors and text statistics of one document."""
    text = text or ""
    words = WORD.findall(text)
    pooled = np.zeros(DIM, np.float32)
    if words:
        counts = Counter(buckets_of(words).tolist())
        at = np.fromiter(counts.keys(), np.int64, len(counts))
        times = np.fromiter(counts.values(), np.float32, len(counts))
        pooled = times @ vectors[at] / len(words)
    return np.concatenate([pooled, statistics(text, words)])


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(0, ((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.stack([features(t, self.vectors) for t in texts])
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


def _adam_fit(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    w1 = rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)).astype(np.float64)
    b1, w2, b2 = np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)
    params = [w1, b1, w2, b2]
    moments = [np.zeros_like(p) for p in params]
    squares = [np.zeros_like(p) for p in params]
    for step in range(1, EPOCHS + 1):
        h_in = x @ w1 + b1
        hidden = np.maximum(0, h_in)
        p = 1 / (1 + np.exp(-(hidden @ w2 + b2)))
        d_out = (p - y) / len(y)
        d_hidden = np.outer(d_out, w2) * (h_in > 0)
        grads = [x.T @ d_hidden + 1e-4 * w1, d_hidden.sum(0), hidden.T @ d_out + 1e-4 * w2, np.array([d_out.sum()])]
        for param, grad, m, v in zip(params, grads, moments, squares):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.999
            v += 0.001 * grad * grad
            param -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w1, b1, w2, float(b2[0])


def train(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, vectors: np.ndarray) -> Model:
    """Network on the rows outside ``calibrate``, temperature on those inside."""
    fit_x, fit_y = (x[~calibrate], y[~calibrate]) if (~calibrate).any() else (x, y)
    mean, scale = fit_x.mean(0), fit_x.std(0) + 1e-6
    w1, b1, w2, b2 = _adam_fit((fit_x - mean) / scale, fit_y, np.random.default_rng(SEED))
    model = Model(vectors, mean, scale, w1, b1, w2, b2, 1.0)
    check_x, check_y = (x[calibrate], y[calibrate]) if calibrate.any() else (x, y)
    logits = model.logits(check_x)
    best, least = 1.0, math.inf
    for temperature in np.exp(np.linspace(math.log(0.2), math.log(5.0), 81)):
        p = np.clip(1 / (1 + np.exp(-logits / temperature)), 1e-7, 1 - 1e-7)
        loss = -np.mean(check_y * np.log(p) + (1 - check_y) * np.log(1 - p))
        if loss < least:
            best, least = float(temperature), loss
    return Model(vectors, mean, scale, w1, b1, w2, b2, best)


def training_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``text``, ``label``, ``calibrate`` of at most ``size`` labelled rows outside the held-out ids."""
    marks = (
        labels.select(common.plain("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"))
        .where(F.col("doc_id").isNotNull() & F.col("q").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("q").alias("label"))
        .withColumn("draw", F.xxhash64("doc_id"))
        .orderBy("draw", "doc_id")
        .limit(size)
    )
    chosen = common.stored(marks, "quality-sample-ids")
    rows = docs.select(common.plain("doc_id").cast("long").alias("doc_id"), common.plain("text").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "text", (F.col("label") == 1).cast("double").alias("label"), (F.pmod("draw", F.lit(5)) == 0).alias("calibrate")
    )


def _block_sums(sample: DataFrame, index: np.ndarray) -> np.ndarray:
    """Context sums over the sample: per task in numpy, per block of buckets summed in Spark."""
    shared = sample.sparkSession.sparkContext.broadcast(index)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, DIM), np.float32)
        for batch in batches:
            sums += context_sums(common.as_strings(batch.column(0)), shared.value)
        blocks = [b for b in range(BUCKETS // BLOCK) if sums[b * BLOCK : (b + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([sums[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in blocks], pa.binary())],
            names=["block", "data"],
        )

    def total(group: pd.DataFrame) -> pd.DataFrame:
        summed = sum(np.frombuffer(x, np.float32) for x in group["data"])
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "data": [summed.astype(np.float32).tobytes()]})

    parts = common.map_batches(sample.select("text"), partial, T.StructType.fromDDL("block int, data binary"))
    blocks = parts.groupBy("block").applyInPandas(total, "block int, data binary").collect()
    sums = np.zeros((BUCKETS, DIM), np.float32)
    for row in blocks:
        sums[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.data, np.float32).reshape(BLOCK, DIM)
    return sums


def fit(sample: DataFrame) -> Model:
    """Word vectors, network and temperature from a sample of ``training_sample``."""
    sample = common.stored(sample, "quality-sample")
    sums = _block_sums(sample, index_vectors())
    vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
    shared = sample.sparkSession.sparkContext.broadcast(vectors)
    width = DIM + STATISTICS

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, shared.value).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1), batch.column(2)], names=["x", "label", "calibrate"])

    rows = common.map_batches(
        sample.select("text", "label", "calibrate"), described, T.StructType.fromDDL("x binary, label double, calibrate boolean")
    ).collect()
    if not rows:
        zero = np.zeros(width)
        return Model(vectors, zero, zero + 1, np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(np.float64)
    y = np.array([r.label for r in rows])
    calibrate = np.array([r.calibrate for r in rows])
    return train(x, y, calibrate, vectors)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(common.plain(key).cast("long").alias("doc_id"), common.plain(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = common.map_batches(rows, run, T.StructType.fromDDL("doc_id long, score double"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    model = fit(training_sample(docs, common.table(spark, sf_dir, "labels")))
    return score(docs, model)
