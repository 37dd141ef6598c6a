"""Language identification by nearest centroid over TF-IDF character n-grams.

A text becomes a hashed vector of its letter bigrams and trigrams (lower case, everything else one
space), weighted by inverse document frequency and brought to length one. The labelled training rows of
each language are clustered by cosine into a few centroids. A text gets the language of the nearest
centroid; the cosine is its score, and a text too far from its nearest centroid is rejected.

How far is too far is learned for each language from its labelled rows: their cosines with its centroids, each
row left out of its own centroid. Short texts have lower cosines, so the rows are also cut to a few lengths, and
a text is held to the bound of the largest of these that it has. Texts shorter than the first are held to
``MIN_COSINE`` alone: a few letters don't tell a language from noise.

The model is fitted on a bounded sample of the labelled rows: at most ``SAMPLE`` rows, shared evenly among
the languages, those with the smallest hashes of their ids. What reaches the driver are the n-gram counts of
these rows. Predicting is one narrow map over all rows with the model as a broadcast of fixed size
(``DIMENSIONS`` x centroids); there is no shuffle, so no language or source can be hot.

A null text, or one without a letter, is ``und`` with score 0 and is rejected. Without any training row
every text is. Rows without an id are held out. Equal texts get equal predictions; extra columns come back
inside ``document``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echometer.llm import common

#: Most labelled rows that the model is fitted on.
SAMPLE = 2000
#: Buckets of hashed n-grams.
DIMENSIONS = 1 << 14
#: Centroids per language.
CLUSTERS = 3
ROUNDS = 10
#: Cosine to the nearest centroid below which a text of any length is rejected.
MIN_COSINE = 0.05
#: Numbers of n-grams, about twice as many as characters, that rows are cut to.
LENGTHS = tuple(1 << k for k in range(5, 14))
#: Share of a language's rows below the cosine that its bound starts from, and the share of it that a text needs.
LOW_QUANTILE = 0.02
LENIENCE = 0.6
#: Rows that a quantile of one language needs; with fewer those of all languages serve.
FEW_ROWS = 8
#: Distinct labels that a model may have.
MAX_LANGUAGES = 1000

UNKNOWN = "und"

PREDICTION = (
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
)

GRAMS = (
    T.StructField("buckets", T.ArrayType(T.IntegerType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())),
)

COSINES = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("cosines", T.ArrayType(T.DoubleType()))]
)

_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """Lower-case letter of every code point, a space for all that are no letters."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            out[c] = ord(low) if len(low := s.lower()) == 1 else c
    return out


#: Letters hashed at a time; bounds a worker's memory on very long texts.
GRAM_CHUNK = 1 << 20


def gram_parts(text: str, chunk: int = GRAM_CHUNK) -> Iterator[np.ndarray]:
    """Buckets of the letter bigrams and trigrams of the whole text, in consecutive parts; none without a letter."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letters = _letters()[points]
    space = letters == _SPACE
    if space.all():
        return
    padded = np.concatenate(([_SPACE], letters[~(space & np.concatenate(([True], space[:-1])))], [_SPACE]))
    del points, letters, space
    for low in range(0, len(padded) - 1, chunk):
        part = padded[low : low + chunk + 2]
        first, second = part[:-1].astype(np.uint64), part[1:].astype(np.uint64)
        pairs = (first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F))[:chunk]
        triples = (pairs[: len(part) - 2] * np.uint64(0xD6E8FEB86659FD93) + second[1:][:chunk] * np.uint64(0x165667B19E3779F9))
        mixed = np.empty(len(pairs) + len(triples), np.uint64)
        # In the order of the text, so that a first part of the n-grams is a first part of the text.
        mixed[: 2 * len(triples) : 2], mixed[1 : 2 * len(triples) : 2] = pairs[: len(triples)], triples
        if len(pairs) > len(triples):
            mixed[-1] = pairs[-1]
        yield ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64)


def grams(text: str) -> np.ndarray:
    """Bucket of every letter bigram and trigram of the whole text; empty if it has no letter."""
    return np.concatenate([np.empty(0, np.int64), *gram_parts(text)])


def gram_counts(text: str) -> tuple[np.ndarray, int]:
    """Counts of the buckets of ``grams(text)`` and their number, in bounded memory."""
    counts, total = np.zeros(DIMENSIONS, np.int64), 0
    for part in gram_parts(text):
        counts += np.bincount(part, minlength=DIMENSIONS)
        total += len(part)
    return counts, total


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: tuple[str, ...]
    #: Least cosine by centroid and, below ``LENGTHS``, at each of them.
    bounds: np.ndarray | None = None


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _centroids(rows: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the row nearest the mean and, each time, the row farthest from all chosen.

    Centres of length one, and the lengths of the sums of rows that they are.
    """
    chosen = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(chosen) < min(clusters, len(rows)):
        chosen.append(int(np.argmin((rows @ rows[chosen].T).max(axis=1))))
    centres = sums = rows[chosen]
    for _ in range(ROUNDS):
        nearest = np.argmax(rows @ centres.T, axis=1)
        # A product with flags: picking a cluster's rows would copy them.
        flags = (nearest == np.arange(len(centres))[:, None]).astype(np.float32)
        sums = np.where(flags.any(axis=1, keepdims=True), flags @ rows, centres)
        centres = _unit(sums)
    return centres, np.linalg.norm(sums, axis=1)


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is 2 modulo 4, or there is no id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def training_sample(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE
) -> DataFrame:
    """``lang``, ``text`` and ``place`` of at most ``rows`` labelled rows, evenly over the languages."""
    labelled = docs.select(
        common.plain(lang).alias("lang"),
        common.plain(text).alias("text"),
        F.xxhash64(common.plain(key)).alias("place"),
        held_out(common.plain(key)).alias("held_out"),
    ).filter("NOT held_out AND text IS NOT NULL AND lang IS NOT NULL")
    # Hashes spread evenly, so a share of them is about as large a share of the rows; the rank makes it exact.
    sizes = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    quota = max(1, rows // max(1, len(sizes)))
    shares = docs.sparkSession.createDataFrame(
        [(row["lang"], min(1.0, 1.5 * quota / row["count"])) for row in sizes], "lang string, share double"
    )
    ranked = Window.partitionBy("lang").orderBy("place")
    near = labelled.join(F.broadcast(shares), "lang").filter((F.col("place") / 2.0**64 + 0.5) < F.col("share"))
    return near.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= quota).select(
        "lang", "text", "place"
    )


def _count_grams() -> Callable[[pa.Array], Sequence[pa.Array]]:
    def run(texts: pa.Array) -> Sequence[pa.Array]:
        found = [np.unique(grams(text), return_counts=True) for text in common.as_strings(texts)]
        return [pa.array([x[i].astype(np.int32) for x in found], pa.list_(pa.int32())) for i in (0, 1)]

    return run


def fit(sample: DataFrame, clusters: int = CLUSTERS) -> Model:
    """Learn from a bounded sample; its n-gram counts come to the driver."""
    # Read twice: for the centroids, and for the rows' cosines with them.
    sample = common.stored(sample.select("lang", "text", "place"), "language-sample")
    counted = common.annotate(sample, _count_grams, GRAMS, ["lang", "place"])
    rows = counted.select("document.lang", "document.place", "buckets", "counts").filter(F.size("buckets") > 0)
    rows = rows.toPandas().sort_values(["lang", "place"], kind="stable")
    # Counts stay sparse; only one language's rows are a matrix at a time.
    seen = np.zeros(DIMENSIONS, np.int64)
    # Without Arrow, toPandas gives lists rather than arrays; both read the same way here.
    rows["buckets"] = [np.asarray(x, np.int64) for x in rows["buckets"]]
    rows["counts"] = [np.asarray(x, np.float32) for x in rows["counts"]]
    for buckets in rows["buckets"]:
        seen[buckets] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + np.float32(1)
    centroids, norms, languages = [np.zeros((0, DIMENSIONS), np.float32)], [np.zeros(0)], []
    for lang, own in rows.groupby("lang"):
        vectors = np.zeros((len(own), DIMENSIONS), np.float32)
        for vector, buckets, numbers in zip(vectors, own["buckets"], own["counts"]):
            weights = np.log1p(numbers) * idf[buckets]
            vector[buckets] = weights / np.linalg.norm(weights)
        centres, lengths = _centroids(vectors, clusters)
        centroids.append(centres)
        norms.append(lengths)
        languages += [lang] * len(centres)
    model = Model(idf, np.concatenate(centroids), tuple(languages))
    return replace(model, bounds=_bounds(model, _own_cosines(sample, model, np.concatenate(norms))))


def _own_cosines(sample: DataFrame, model: Model, norms: np.ndarray) -> list[tuple[str, list[float]]]:
    """Language of every row and its cosine with the nearest centroid of it, cut to each of ``LENGTHS`` it has.

    The row itself is taken out of the centroid that it is part of.
    """
    shared = sample.sparkSession.sparkContext.broadcast((model, norms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, norms = shared.value
        places: dict[str, list[int]] = {}
        for k, lang in enumerate(model.languages):
            places.setdefault(lang, []).append(k)

        def unit(found: np.ndarray) -> np.ndarray:
            return _unit(np.log1p(np.bincount(found, minlength=DIMENSIONS).astype(np.float32)) * model.idf)

        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), common.as_strings(batch.column(1))):
                found = grams(text)
                whole, own = unit(found), places.get(lang, [])
                centres = model.centroids[own]
                near = centres @ whole
                at = int(np.argmax(near)) if own else 0
                cosines = []
                for length in LENGTHS if own else ():
                    if len(found) < length:
                        break
                    part = unit(found[:length])
                    others = centres @ part
                    norm = float(norms[own[at]])
                    left = np.sqrt(max(0.0, norm * norm - 2 * norm * float(near[at]) + 1))
                    others[at] = (norm * others[at] - whole @ part) / left if left > 1e-3 else 0
                    cosines.append(float(others.max()))
                out.append((lang, cosines))
            columns = [pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=COSINES.names)

    rows = common.map_batches(sample.select("lang", "text"), run, COSINES).collect()
    return [(row["lang"], row["cosines"]) for row in rows]


def _bounds(model: Model, cosines: list[tuple[str, list[float]]]) -> np.ndarray:
    """Least cosine by centroid and length: from its language's rows, else of a shorter length, else of all rows."""

    def low(values: list[float]) -> float | None:
        return LENIENCE * float(np.quantile(values, LOW_QUANTILE)) if len(values) >= FEW_ROWS else None

    own: dict[str, list[list[float]]] = {}
    everyone: list[list[float]] = [[] for _ in LENGTHS]
    for lang, found in cosines:
        lists = own.setdefault(lang, [[] for _ in LENGTHS])
        for k, cosine in enumerate(found):
            lists[k].append(cosine)
            everyone[k].append(cosine)
    bounds = np.zeros((len(model.languages), len(LENGTHS) + 1))
    shared = list(map(low, everyone))
    learned: dict[str, list[float]] = {}
    for lang, lists in own.items():
        last = last_shared = None
        learned[lang] = [0.0]
        for k, values in enumerate(lists):
            last = last if (bound := low(values)) is None else bound
            last_shared = last_shared if shared[k] is None else shared[k]
            learned[lang].append(next((x for x in (last, last_shared) if x is not None), 0.0))
    for k, lang in enumerate(model.languages):
        bounds[k] = learned[lang]
    return bounds


def predict(
    docs: DataFrame, model: Model, carry: list[str] | None = None, text: str = "text", min_cosine: float = MIN_COSINE
) -> DataFrame:
    """``document``, ``lang_pred``, ``score`` and ``rejected`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[pa.Array], Sequence[pa.Array]]:
        model: Model = shared.value
        columns = np.ascontiguousarray(model.centroids.T)

        def run(texts: pa.Array) -> Sequence[pa.Array]:
            names, scores, bounds = [], [], []
            for text in common.as_strings(texts):
                counts, total = gram_counts(text)
                if not total or not model.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    bounds.append(min_cosine)
                    continue
                counts = counts.astype(np.float32)
                used = counts.nonzero()[0]
                weights = np.log1p(counts[used]) * model.idf[used]
                cosines = weights @ columns[used] / max(float(np.linalg.norm(weights)), 1e-12)
                best = int(np.argmax(cosines))
                names.append(model.languages[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
                learned = 0.0 if model.bounds is None else model.bounds[best, np.searchsorted(LENGTHS, total, "right")]
                bounds.append(max(min_cosine, learned))
            far = [n == UNKNOWN or s < least for n, s, least in zip(names, scores, bounds)]
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())]

        return run

    return common.annotate(docs, start, PREDICTION, carry, text)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(training_sample(common.documents(spark, sf_dir, "doc_id", "text", "lang")))
    found = predict(common.documents(spark, sf_dir, "doc_id", "text"), model, ["doc_id"])
    return found.select(
        "document.doc_id", held_out(F.col("document.doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )
