"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the polynomial hash of each of its prefixes, for two bases modulo a
Mersenne prime. Two entries give the hash of any span, so spans of any texts compare in constant time, and
the longest common prefix or suffix is found by binary search. The array of an edited text is put together
from the arrays of its parts. A fingerprint is the length, the hash of the whole text and the smallest
distinct hashes of its spans of ``SPAN`` code points, which estimate the share of spans that two texts have
in common.

To meet its successor by ascending id, each row goes to a bucket of ids between two quantiles, found by
binary search in a list with one bound per shuffle partition; the first row of each bucket goes to the
bucket before as well. Texts are shuffled once and read in order, in batches of bounded size.

A null text is an empty one; the fingerprint of an empty text equals only itself. Null ids come first;
rows with one id are ordered by a hash of their texts, and equal rows follow each other. A single row
follows itself. An empty table gives an empty result; extra columns are ignored. Rows that share one id
share a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echometer.llm import common, ordering

PRIME = (1 << 31) - 1
BASES = (1_000_003_061, 1_715_761_013)
#: Code points of a sampled span.
SPAN = 12
#: Span hashes in a fingerprint.
SKETCH = 64

FIELDS = (
    T.StructField("n_chars", T.LongType()),
    T.StructField("fingerprint", T.StringType()),
)

NEIGHBOURS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
        T.StructField("edited_prefix", T.LongType()),
        T.StructField("edited_suffix", T.LongType()),
    ]
)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2 ** 62 modulo the Mersenne prime."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x == PRIME, 0, x)


class _Powers:
    """Powers of a base and of its inverse, grown by doubling."""

    def __init__(self, base: int) -> None:
        self.steps = (base, pow(base, -1, PRIME))
        self.tables = [np.ones(1, np.int64), np.ones(1, np.int64)]

    def get(self, which: int, n: int) -> np.ndarray:
        table = self.tables[which]
        while len(table) < n:
            table = np.concatenate((table, _reduced(table * pow(self.steps[which], len(table), PRIME))))
        self.tables[which] = table
        return table[:n]


_POWERS = tuple(_Powers(base) for base in BASES)


@dataclass(frozen=True)
class Prefixes:
    """Prefix arrays of one text: entry i is the hash of its first i code points."""

    arrays: tuple[np.ndarray, ...]

    @staticmethod
    def of(text: str) -> Prefixes:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        arrays = []
        for powers in _POWERS:
            sums = np.zeros(len(points) + 1, np.int64)
            np.cumsum(_reduced(points * powers.get(0, len(points))), out=sums[1:])
            arrays.append(_reduced(sums))
        return Prefixes(tuple(arrays))

    def __len__(self) -> int:
        return len(self.arrays[0]) - 1

    def joined(self, length: int, other: Prefixes, other_length: int) -> Prefixes:
        """Arrays of the first ``length`` code points followed by the first ones of ``other``."""
        arrays = []
        for powers, mine, theirs in zip(_POWERS, self.arrays, other.arrays):
            shift = int(powers.get(0, length + 1)[length])
            moved = _reduced(_reduced(theirs[1 : other_length + 1] * shift) + mine[length])
            arrays.append(np.concatenate((mine[: length + 1], moved)))
        return Prefixes(tuple(arrays))

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hash of a span, wherever it stands."""
        return tuple(
            (int(a[end]) - int(a[start])) * int(p.get(1, start + 1)[start]) % PRIME
            for p, a in zip(_POWERS, self.arrays)
        )

    def spans(self, width: int) -> np.ndarray:
        """Mixed 32-bit hash of every span of ``width`` code points; of the whole text if it is shorter."""
        width = min(width, len(self))
        count = len(self) - width + 1 if width else 0
        mixed = np.zeros(count, np.uint64)
        for powers, array in zip(_POWERS, self.arrays):
            values = _reduced(_reduced(array[width:] - array[:-width] + PRIME) * powers.get(1, count)) if count else mixed
            mixed = (mixed << np.uint64(31)) | values.astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (mixed >> np.uint64(32)).astype(np.uint32)


def common_prefix(a: Prefixes, b: Prefixes) -> int:
    """Longest common prefix, by binary search over prefix hashes."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if all(x[middle] == y[middle] for x, y in zip(a.arrays, b.arrays)):
            low = middle
        else:
            high = middle - 1
    return low


def common_suffix(a: Prefixes, b: Prefixes) -> int:
    """Longest common suffix, by binary search over span hashes."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(len(a) - middle, len(a)) == b.span(len(b) - middle, len(b)):
            low = middle
        else:
            high = middle - 1
    return low


def sketch(prefixes: Prefixes, size: int = SKETCH, width: int = SPAN) -> np.ndarray:
    """The smallest distinct span hashes, in order."""
    spans = prefixes.spans(width)
    if len(spans) > 8 * size:
        # Enough values lie below this bound, unless many spans repeat.
        few = np.unique(spans[spans < np.uint32(2**32 * 4 * size // len(spans))])
        if len(few) >= size:
            return few[:size]
    return np.unique(spans)[:size]


def fingerprint(prefixes: Prefixes, smallest: np.ndarray) -> str:
    whole = "".join(f"{int(a[-1]):08x}" for a in prefixes.arrays)
    return f"{len(prefixes):x}-{whole}-{smallest.astype('>u4').tobytes().hex()}"


def _likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Estimated share of common spans, 0 to 1, from two sketches."""
    either = np.union1d(a, b)[:size]
    if not len(either):
        return 1.0
    return float(np.isin(either, np.intersect1d(a, b, assume_unique=True)).mean())


def likeness(one: str, other: str, size: int = SKETCH) -> float:
    """Likeness of two fingerprints: 1 for equal texts, else the estimated share of common spans."""
    if one == other:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(x.rpartition("-")[2]), ">u4").astype(np.uint32) for x in (one, other))
    return _likeness(a, b, size) if len(a) and len(b) else 0.0


def fingerprints(docs: DataFrame, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """``document``, ``n_chars`` and ``fingerprint`` of every row; one narrow map."""

    def start() -> Callable[[pa.Array], Sequence[pa.Array]]:
        def run(texts: pa.Array) -> Sequence[pa.Array]:
            found = [Prefixes.of(text) for text in common.as_strings(texts)]
            return [
                pa.array([len(p) for p in found], pa.int64()),
                pa.array([fingerprint(p, sketch(p)) for p in found], pa.string()),
            ]

        return run

    return common.annotate(docs, start, FIELDS, carry, text)


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows sorted by id within buckets of ascending ids; after a bucket's rows (``extra`` 1) its successor."""
    spark = docs.sparkSession
    partitions = common.shuffle_partitions(spark)
    rows = docs.select(
        common.plain(key).cast("long").alias("doc_id"),
        F.coalesce(common.plain(text), F.lit("")).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    bounds = ordering.id_bounds(rows)
    dealt = rows.withColumn("bucket", ordering.bucket_of(F.col("doc_id"), bounds)).withColumn("extra", F.lit(0))
    # One row per bucket: as many as there are shuffle partitions.
    heads = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "text_hash")).alias("head")).collect()
    heads = sorted((row.bucket, row["head"].doc_id, row["head"].text_hash) for row in heads)
    before = [(heads[k - 1][0], doc_id, text_hash) for k, (_, doc_id, text_hash) in enumerate(heads)]
    firsts = spark.createDataFrame(before, "target int, head_id bigint, head_hash bigint")
    extra = rows.join(
        F.broadcast(firsts), rows.doc_id.eqNullSafe(firsts.head_id) & (rows.text_hash == firsts.head_hash)
    ).select("doc_id", "text", "text_hash", F.col("target").alias("bucket"), F.lit(1).alias("extra"))
    return (
        dealt.unionByName(extra)
        .repartitionById(partitions, F.col("bucket"))
        .sortWithinPartitions("bucket", "extra", "doc_id", "text_hash")
    )


@dataclass(frozen=True)
class _Row:
    bucket: int
    extra: int
    doc_id: int | None
    text: str
    prefixes: Prefixes
    sketch: np.ndarray


def _compared(row: _Row, following: _Row) -> dict:
    n = len(row.prefixes)
    kept, taken = n - n // 2, min(n // 2, len(following.prefixes))
    edited = row.prefixes.joined(kept, following.prefixes, taken)
    edited_sketch = sketch(edited)
    own = fingerprint(row.prefixes, row.sketch)
    own_edited = fingerprint(edited, edited_sketch)
    other = fingerprint(following.prefixes, following.sketch)

    def near(fingerprint_: str, sketch_: np.ndarray) -> float:
        if own == fingerprint_:
            return 1.0
        return _likeness(row.sketch, sketch_) if len(row.sketch) and len(sketch_) else 0.0

    return {
        "doc_id": row.doc_id,
        "n_chars": n,
        "edited_sha256": hashlib.sha256((row.text[:kept] + following.text[:taken]).encode()).hexdigest(),
        "fingerprint": own,
        "edited_fingerprint": own_edited,
        "near_edited": near(own_edited, edited_sketch),
        "near_next": near(other, following.sketch),
        "edited_prefix": common_prefix(row.prefixes, edited),
        "edited_suffix": common_suffix(row.prefixes, edited),
    }


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint against that of its edited text and of the next row."""
    arrow = pa.schema(
        [
            (f.name, {"long": pa.int64(), "double": pa.float64()}.get(f.dataType.typeName(), pa.string()))
            for f in NEIGHBOURS
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Row | None = None
        for batch in batches:
            out = []
            columns = [batch.column(name).to_pylist() for name in ("bucket", "extra", "doc_id", "text")]
            for bucket, extra, doc_id, words in zip(*columns):
                if extra and (held is None or held.bucket != bucket or held.extra):
                    continue
                prefixes = Prefixes.of(words)
                row = _Row(bucket, extra, doc_id, words, prefixes, sketch(prefixes))
                if held is not None and held.bucket == bucket:
                    out.append(_compared(held, row))
                held = row
            yield pa.RecordBatch.from_pylist(out, arrow)

    ordered = in_order(docs, key, text).select("bucket", "extra", "doc_id", "text")
    return common.map_batches(ordered, run, NEIGHBOURS)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(common.documents(spark, sf_dir, "doc_id", "text"))
