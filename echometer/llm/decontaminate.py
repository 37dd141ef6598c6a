"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of consecutive benchmark words. For each pattern length, a shift table
over blocks of two words tells how far the search may jump, a block whose shift is zero leads to the
patterns ending in it, and only those are compared word by word. A text of n words is therefore read
at about n / 9 places for windows of ten words.

The benchmark reaches the tasks in chunks of bounded size. Documents pass through one narrow map per
chunk, so that a larger benchmark means more maps in a row and never a larger broadcast; nothing is
shuffled and no document meets another, hence no key can be hot.

Null and empty texts have no words and no hits. Repeated items and repeated documents are each judged
alone. An item without an id marks words but can't be listed among the items. Columns of ``documents``
come back inside the struct ``document``, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echometer.llm import common

WINDOW = 10
#: Words of a block of the shift table.
BLOCK = 2
#: Bytes of benchmark text in one chunk of patterns.
CHUNK_BYTES = 1 << 20

#: Lower-cases A-Z and turns every byte outside words (0-9, a-z, all of 0x80 and above) into a space.
_WORDS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)

FIELDS = (
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.LongType())),
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Patterns:
    """Shift tables and suffix buckets of all windows, one set of tables per window length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        by_length: dict[int, dict[tuple[bytes, ...], set[str | None]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of((text or "").encode())
            length = min(window, len(words))
            for i in range(len(words) - length + 1 if length else 0):
                by_length[length][tuple(words[i : i + length])].add(item)
        self.tables = [self._table(length, found) for length, found in sorted(by_length.items())]

    @staticmethod
    def _table(length: int, patterns: dict[tuple[bytes, ...], set[str | None]]):
        block = min(BLOCK, length)
        shift: dict[tuple[bytes, ...], int] = {}
        buckets: dict[tuple[bytes, ...], list] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(block, length + 1):
                key = pattern[end - block : end]
                shift[key] = min(length - end, shift.get(key, length))
            buckets[pattern[-block:]].append((list(pattern), items))
        return length, block, shift, dict(buckets)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str | None]]]:
        """First word, word after the last, and items of every occurrence."""
        for length, block, shift, buckets in self.tables:
            longest = length - block + 1
            end, total = length, len(words)
            while end <= total:
                key = tuple(words[end - block : end])
                jump = shift.get(key, longest)
                if jump:
                    end += jump
                    continue
                candidate = words[end - length : end]
                for pattern, items in buckets[key]:
                    if pattern == candidate:
                        yield end - length, end, items
                end += 1


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _chunks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str | None, str | None]]]:
    rows, size = [], 0
    for row in benchmark.select(common.plain(item).cast("string"), common.plain(text)).toLocalIterator():
        rows.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= CHUNK_BYTES:
            yield rows
            rows, size = [], 0
    yield rows


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    carry: list[str] | None = None,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``document``, ``n_words``, ``n_hit``, ``items`` (sorted) and ``spans`` (first and last-plus-one word, flat)."""
    context = docs.sparkSession.sparkContext
    found = docs.select(
        F.struct(*map(common.plain, docs.columns)).alias("document"),
        common.plain(text).alias("searched"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<bigint>").alias("spans"),
    )
    chunks = list(_chunks(benchmark, item, item_text))
    for k, chunk in enumerate(chunks):
        found = _search_chunk(found, context.broadcast((chunk, window)), k == len(chunks) - 1, carry)
    return found


def _search_chunk(found: DataFrame, shared, last: bool, carry: list[str] | None) -> DataFrame:
    names = [f.name for f in found.schema["document"].dataType]
    kept = names if carry is None or not last else list(carry)
    document = T.StructType([found.schema["document"].dataType[name] for name in kept])
    searched = [] if last else [T.StructField("searched", T.StringType())]
    schema = T.StructType([T.StructField("document", document), *searched, *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(*shared.value)
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            n_words, n_hit, all_items, all_spans = [], [], [], []
            earlier = zip(columns["items"].to_pylist(), columns["spans"].to_pylist())
            for data, (items, flat) in zip(common.as_bytes(columns["searched"]), earlier):
                words = words_of(data)
                spans, ids = list(zip(flat[::2], flat[1::2])), set(items)
                for start, end, owners in patterns.search(words):
                    spans.append((start, end))
                    ids |= owners
                spans = _merged(spans)
                n_words.append(len(words))
                n_hit.append(sum(end - start for start, end in spans))
                all_items.append(sorted(ids - {None}))
                all_spans.append([x for span in spans for x in span])
            whole = columns["document"]
            part = pa.StructArray.from_arrays([whole.field(names.index(n)) for n in kept], names=kept)
            out = [part, *([] if last else [columns["searched"]])]
            out += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())]
            out += [pa.array(all_items, pa.list_(pa.string())), pa.array(all_spans, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return common.map_batches(found, run, schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    found = find_passages(docs, common.table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "document.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

