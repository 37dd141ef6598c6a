"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array.

Each document's words (maximal ``[^\\x20\\x09-\\x0D]`` runs, case-sensitive) become integers. Per
document, inside Spark tasks over Arrow batches:

1. Suffix array, inverse suffix array and LCP array by prefix doubling in numpy; the rank arrays of
   every doubling step answer longest common extensions (LCE) in O(log n) for many pairs at once.
2. The LCP intervals are walked bottom up with a stack; no tree is built. For every interval of depth
   l, only suffixes outside its largest child are tested: suffix p with ISA[p + l] in the interval and
   unequal words after (a square of period l ending where the period breaks), and likewise ISA[p - l].
   These branching squares are the rightmost square of every run.
3. Each square is rotated left as far as the period holds (one reversed LCE), which gives its run.
   A run whose stretch has a smaller period (a divisor of l) is dropped: its own smaller period found it.
   Runs of length ``max(6, 4 * period)`` and more are kept.

The words after the first period of every run are dropped to collapse the text.

Planted runs (contract): with h = crc32 of the decimal doc_id and g = h // 10, a document whose h ends in
0 has its words from a = g % n on replaced by a repetition of period 1 + (n - a) // (3 + g % 8).

Edge cases: null text has no words; null doc_id plants nothing. Empty and one-word texts have no runs;
their digests are those of the empty string and the word. Repeated rows give equal rows. A very long
text costs O(n log n) time and memory in its task (a million words: some 200 MB). Extra columns are
ignored; the result names its own columns.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from echometer.llm import common

# Fixed values of the contract: word pattern, least run length and exponent, planting rule.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Smaller-child positions tested at once; bounds a task's memory on very long texts.
CHUNK = 1 << 22

FIELDS = [
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("n_runs", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("period", T.LongType()),
    T.StructField("exponent_milli", T.LongType()),
    T.StructField("runs_sha256", T.StringType()),
    T.StructField("collapsed_sha256", T.StringType()),
]


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words after the contract's planted repetition, if this document has one."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


class Ranks:
    """Rank arrays of prefix doubling: ``levels[j]`` is equal for two positions whose next 2^j items are."""

    def __init__(self, items: np.ndarray):
        n = len(items)
        self.n = n
        rank = items.astype(np.int64)
        self.levels = [rank]
        order = np.argsort(rank, kind="stable")
        step = 1
        while n > 1:
            following = np.full(n, -1, np.int64)
            following[: n - step] = rank[step:]
            order = np.lexsort((following, rank))
            a, b = rank[order], following[order]
            change = np.empty(n, bool)
            change[0] = True
            change[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(change) - 1
            self.levels.append(rank)
            if change.all() or step >= n:
                break
            step *= 2
        self.sa = order
        self.isa = np.empty(n, np.int64)
        self.isa[order] = np.arange(n)

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension of positions ``i`` and ``j``, pairwise."""
        found = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            x, y = i + found, j + found
            ok = (x < self.n) & (y < self.n)
            ok[ok] = self.levels[level][x[ok]] == self.levels[level][y[ok]]
            found += ok.astype(np.int64) << level
        return found


def lcp_intervals(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """``lb``, ``rb``, depth and the bounds of the largest child of every LCP interval of depth > 0.

    ``lcp[t]`` is the LCP of suffixes ``SA[t - 1]`` and ``SA[t]``. Bottom-up stack walk; a child
    interval is only remembered as its parent's largest so far.
    """
    found: list[tuple[int, int, int, int, int]] = []
    depth, left, best = [0], [0], [None]
    values = lcp.tolist()
    n = len(values) + 1
    for t in range(1, n + 1):
        here = values[t - 1] if t < n else 0
        lb, last = t - 1, None
        while here < depth[-1]:
            d, b, big = depth.pop(), left.pop(), best.pop()
            rb = t - 1
            big = big or (1, b, b)
            found.append((b, rb, d, big[1], big[2]))
            lb, last = b, (rb - b + 1, b, rb)
            if here <= depth[-1]:
                if best[-1] is None or best[-1][0] < last[0]:
                    best[-1] = last
                last = None
        if here > depth[-1]:
            depth.append(here)
            left.append(lb)
            best.append(last)
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.array(x, np.int64) for x in zip(*found))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ``starts[i] + k`` for ``k < counts[i]``, with the index ``i`` of each."""
    owner = np.repeat(np.arange(len(starts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return starts[owner] + np.arange(len(owner)) - first, owner


def branching_squares(items: np.ndarray, ranks: Ranks, lcp: np.ndarray | None = None) -> np.ndarray:
    """Distinct ``(start, period)`` of squares after which the period breaks, as an array of pairs."""
    n = len(items)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    if lcp is None:
        lcp = ranks.lce(ranks.sa[:-1], ranks.sa[1:])
    lb, rb, depth, blb, brb = lcp_intervals(lcp)
    padded = np.append(items, -1)
    found = []
    # Smaller children: the positions of each interval before and after its largest child.
    sides = [(lb, blb - lb), (brb + 1, rb - brb)]
    for begin, counts in sides:
        ends = np.cumsum(counts)
        cut = 0
        while cut < len(counts):
            stop = int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + CHUNK, "right"))
            stop = max(stop, cut + 1)
            k, owner = _ranges(begin[cut:stop], counts[cut:stop])
            owner += cut
            p, l = ranks.sa[k], depth[owner]
            low, high = lb[owner], rb[owner]
            q = p + l  # the square would start at p
            ok = q < n
            r = ranks.isa[np.minimum(q, n - 1)]
            ok &= (r >= low) & (r <= high)
            ok &= padded[np.minimum(p + l, n)] != padded[np.minimum(p + 2 * l, n)]
            found.append(np.stack([p[ok], l[ok]], 1))
            q = p - l  # the square would start at p - l
            ok = q >= 0
            r = ranks.isa[np.maximum(q, 0)]
            ok &= (r >= low) & (r <= high)
            ok &= padded[p] != padded[np.minimum(p + l, n)]
            found.append(np.stack([q[ok], l[ok]], 1))
            cut = stop
    squares = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return np.unique(squares, axis=0)


def _prime_factors(value: int) -> list[int]:
    out, d = [], 2
    while d * d <= value:
        if value % d == 0:
            out.append(d)
            while value % d == 0:
                value //= d
        d += 1
    return out + ([value] if value > 1 else [])


def runs_of(items: np.ndarray) -> np.ndarray:
    """Runs as rows ``(start, length, period)``, sorted by start, then period."""
    n = len(items)
    if n < MIN_LENGTH:
        return np.zeros((0, 3), np.int64)
    forward = Ranks(items)
    lcp = forward.lce(forward.sa[:-1], forward.sa[1:])
    # A run of period q shares max(6, 4q) - q >= 5 words with itself q places on; so do neighbours in SA order.
    if lcp.max() < MIN_LENGTH - 1:
        return np.zeros((0, 3), np.int64)
    squares = branching_squares(items, forward, lcp)
    if not len(squares):
        return np.zeros((0, 3), np.int64)
    backward = Ranks(items[::-1].copy())
    start, period = squares[:, 0], squares[:, 1]
    # Rotating a square left by one keeps it a square while the word before it equals the one a period on.
    reach = np.where(start > 0, backward.lce(n - start, n - start - period), 0)
    begin, end = start - reach, start + 2 * period
    runs = np.unique(np.stack([begin, end - begin, period], 1), axis=0)
    long = runs[:, 1] >= np.maximum(MIN_LENGTH, MIN_EXPONENT * runs[:, 2])
    runs = runs[long]
    keep = np.ones(len(runs), bool)
    for value in np.unique(runs[:, 2]).tolist():
        at = np.flatnonzero(runs[:, 2] == value)
        for prime in _prime_factors(value):
            d = value // prime
            b, length = runs[at, 0], runs[at, 1]
            keep[at[forward.lce(b, b + d) >= length - d]] = False
    runs = runs[keep]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def describe(text: str | None, doc_id: int | None) -> tuple:
    """The result columns after ``doc_id`` for one document."""
    words = planted(WORD.findall(text or ""), doc_id)
    index: dict[str, int] = {}
    items = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    runs = runs_of(items)
    listing = "".join(f"{s},{length},{p}\n" for s, length, p in runs.tolist())
    dropped = np.zeros(len(words) + 1, np.int64)
    if len(runs):
        np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
        np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(dropped)[: len(words)] == 0
    collapsed = " ".join(w for w, k in zip(words, kept.tolist()) if k)
    if len(runs):
        top = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        longest = (*top, 1000 * top[1] // top[2])
    else:
        longest = (None, None, None, None)
    return (
        len(words),
        len(runs),
        *longest,
        hashlib.sha256(listing.encode()).hexdigest(),
        hashlib.sha256(collapsed.encode("utf-8", "surrogatepass")).hexdigest(),
    )


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, word count, runs, longest run and digests (``FIELDS``)."""
    rows = docs.select(common.plain(key).cast("long").alias("doc_id"), common.plain(text).alias("text"))
    schema = T.StructType(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            found = [(doc_id, *describe(t, doc_id)) for doc_id, t in zip(ids, texts)]
            columns = list(zip(*found)) if found else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64() if f.dataType == T.LongType() else pa.string()) for c, f in zip(columns, FIELDS)],
                names=[f.name for f in FIELDS],
            )

    return common.map_batches(rows, run, schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(common.documents(spark, sf_dir, "doc_id", "text"))
