"""Token ids as a binary file format: adaptive context-mixing range coder in checksummed blocks.

Documents are tokenized where they are, then their ids go to buckets of ascending document ids and are
read in order. Each bucket becomes a run of segments, rows of a table in the shared folder: a segment lists
its documents with their numbers of ids, the number of ids before it in its bucket, and its blocks. A block
has ``rangecoder.BLOCK`` ids of the run (the last one of a segment fewer), its number of ids, the crc32 of
its ids as little-endian 32-bit integers, and the coded bytes; each block starts from a fresh model, so
blocks are read alone. Segments end between documents, at ``SEGMENT`` ids or more. Up to ``rangecoder.LANES``
blocks are coded side by side, those of several segments together; a task gets about that many, whatever the
number of buckets. Reading checks every sum and cuts the ids into documents.

The tokenizer encodes each distinct word once per worker where a text's characters make words independent
of their surroundings (Latin letters; no normalization, no letter whose lower case depends on others); such
texts are split into words together, as arrays. Every other text goes through the tokenizer as a whole.

A null or empty text has only its end id. Null ids come first; equal ids are ordered by their tokens. An
empty table gives a file without segments; extra columns are ignored. Rows that share one id share a bucket.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from echometer.llm import common, ordering, rangecoder
from echometer.session import scratch_path

END = 2
#: Ids from which on a segment ends with its document.
SEGMENT = 1 << 22
#: Bytes of text whose ids one task codes, some three a token.
CODED_TOGETHER = 3 * rangecoder.LANES * rangecoder.BLOCK
#: Words whose ids a worker remembers.
REMEMBERED = 800_000
#: Code points of texts that are handled together, and new words that are learned at a time.
TOGETHER, AT_ONCE = 1 << 22, 2000

SEGMENTS = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_tokens", T.ArrayType(T.LongType())),
        T.StructField("block_tokens", T.ArrayType(T.IntegerType())),
        T.StructField("block_crc32", T.ArrayType(T.LongType())),
        T.StructField("blocks", T.ArrayType(T.BinaryType())),
    ]
)
_ARROW_SEGMENTS = pa.schema(
    [("bucket", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
     ("doc_tokens", pa.list_(pa.int64())), ("block_tokens", pa.list_(pa.int32())),
     ("block_crc32", pa.list_(pa.int64())), ("blocks", pa.list_(pa.binary()))]
)

#: Texts of these characters alone are normalized letter by letter and white space is plain.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-įı-ɏ]*")
#: Kinds of characters in the tokenizer's own splitting rule (fixed value), which is
#: 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+, and of the mark that ends a text here.
_SPACE, _LETTER, _NUMBER, _OTHER, _MARK = range(5)
_ENDING = "\0"


def _kinds() -> np.ndarray:
    """Kind of each character of lower-cased plain texts."""
    out = np.full(1 << 16, _SPACE, np.uint8)
    for c in {x for c in map(chr, range(0x250)) if _PLAIN.fullmatch(c) for x in c.lower()}:
        if not c.isspace():
            out[ord(c)] = _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _OTHER
    out[ord(_ENDING)] = _MARK
    return out


_KINDS = _kinds()


def split_words(text: str) -> pa.LargeBinaryArray:
    """The words, in UTF-16, of lower-cased plain texts that each end with a mark; marks are words too."""
    codes = np.frombuffer((text + _ENDING * 2).encode("utf-16-le"), "<u2")
    kinds = _KINDS.take(codes)
    begins = np.empty(len(codes), bool)
    begins[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    begins |= (kinds == _NUMBER) | (kinds == _MARK)
    # An apostrophe at the begin of a word takes the letters of its ending along.
    at = np.flatnonzero((codes == ord("'")) & begins)
    first, second = codes[at + 1], codes[at + 2]
    short = at[np.isin(first, [ord(c) for c in "stmd"])]
    pairs = [(first == ord(a)) & (second == ord(b)) for a, b in ("re", "ve", "ll")]
    long = at[np.logical_or.reduce(pairs)]
    begins[short + 1] = begins[long + 1] = False
    begins[short + 2] = begins[long + 3] = True
    # The last two marks only fill up.
    starts = np.flatnonzero(begins[:-2])
    sizes = np.diff(starts, append=len(codes) - 2)
    offsets = np.zeros(1 + np.count_nonzero(words := kinds.take(starts) != _SPACE), np.int64)
    np.cumsum(sizes[words], out=offsets[1:])
    offsets *= 2
    data = codes[:-2][kinds[:-2] != _SPACE]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


def _byte_letters() -> dict[int, str]:
    """Bytes as a byte-level model reads them: printable ones as they are, the others as the letters from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters = {byte: chr(256 + k) for k, byte in enumerate(b for b in range(256) if b not in printable)}
    # Line ends part words here and are in none.
    return {byte: letter for byte, letter in letters.items() if byte != ord("\n")}


_BYTE_LETTERS = _byte_letters()


class WordTokenizer:
    """Token ids of whole texts, remembering words."""

    def __init__(self, definition: str) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        #: Ids as 16-bit integers, by the word in UTF-16.
        self.words: dict[bytes, bytes] = {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded([text])[0], "<u2").tolist()

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 16-bit little-endian integers; words of many texts are looked up together."""
        out: list[bytes] = []
        held: list[str | bytes] = []
        size = 0
        for text in texts:
            if _PLAIN.fullmatch(text):
                held.append(text.lower())
                size += len(text)
            else:
                held.append(np.array(self.whole(text), "<u2").tobytes())
            if size >= TOGETHER:
                out += self._joined(held)
                held, size = [], 0
        return out + self._joined(held)

    def _joined(self, held: list[str | bytes]) -> list[bytes]:
        plain = [text for text in held if type(text) is str]
        if not plain:
            return held
        words = split_words(_ENDING.join(plain) + _ENDING).dictionary_encode()
        _, offsets, data = words.dictionary.buffers()
        data, offsets = data.to_pybytes(), np.frombuffer(offsets, np.int64).tolist()
        distinct = [data[i:j] for i, j in zip(offsets, offsets[1 : len(words.dictionary) + 1])]
        mark = _ENDING.encode("utf-16-le")
        ids_of = [self.words.get(word) for word in distinct]
        ids_of[at := distinct.index(mark)] = b""
        if None in ids_of:
            unknown = [word for word, ids in zip(distinct, ids_of) if ids is None]
            if len(self.words) + len(unknown) > REMEMBERED:
                self.words.clear()
                unknown = [word for word in distinct if word != mark]
            for low in range(0, len(unknown), AT_ONCE):
                self._learn(unknown[low : low + AT_ONCE])
            ids_of = [self.words[word] if ids is None else ids for word, ids in zip(distinct, ids_of)]
        ids = pa.array(ids_of, pa.large_binary()).take(words.indices)
        _, offsets, data = ids.buffers()
        ends = np.flatnonzero(words.indices.to_numpy() == at)
        ends = np.frombuffer(offsets, np.int64)[ends].tolist()
        view = memoryview(data) if data else b""
        found = (bytes(view[i:j]) for i, j in zip([0, *ends], ends))
        return [next(found) if type(text) is str else text for text in held]

    def _learn(self, words: list[bytes]) -> None:
        # Normalized and split already, so that the tokenizer's model alone remains, which reads bytes as letters.
        texts = b"\n\0".join(words).decode("utf-16-le")
        if not texts.isascii():
            texts = texts.encode().decode("latin-1").translate(_BYTE_LETTERS)
        found = list(map(self.tokenizer.model.tokenize, texts.split("\n")))
        data = np.array([token.id for tokens in found for token in tokens], "<u2").tobytes()
        ends = list(itertools.accumulate(2 * len(tokens) for tokens in found))
        self.words.update((word, data[i:j]) for word, i, j in zip(words, [0, *ends], ends))


_tokenizers: dict[int, WordTokenizer] = {}


def worker_tokenizer(definition: str | None) -> WordTokenizer | None:
    """The worker's own tokenizer, with the words of its tasks before; none given frees it.

    A function of this module, since what tasks refer to by a variable is sent to each anew.
    """
    if definition is None:
        _tokenizers.clear()
        return None
    if (mark := hash(definition)) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[mark] = WordTokenizer(definition)
    return _tokenizers[mark]


def tokenized(docs: DataFrame, definition: str, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``, 16-bit little-endian, of every row, the end id included."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last = worker_tokenizer(shared.value), np.array([end], "<u2").tobytes()
        for batch in batches:
            ids = [found + last for found in tokenizer.encoded(common.as_strings(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(common.plain(key).cast("long").alias("doc_id"), common.plain(text).alias("text"))
    return common.map_batches(rows, run, schema)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_file(tokens: DataFrame, bounds: list[int], path: str, tasks: int | None = None) -> None:
    """Write the ids of all documents, by ascending id, as segments; ``tasks`` code them at most."""

    def coded(segments: list[tuple[int, int, list[tuple[int | None, np.ndarray]]]]) -> Iterator[pa.RecordBatch]:
        """Segments whose blocks are coded side by side."""
        rows, every = [], []
        for bucket, first, docs in segments:
            ids = np.concatenate([x for _, x in docs])
            blocks = [ids[i : i + rangecoder.BLOCK] for i in range(0, len(ids), rangecoder.BLOCK)]
            every += blocks
            rows.append({
                "bucket": bucket,
                "first": first,
                "n_tokens": len(ids),
                "doc_ids": [doc_id for doc_id, _ in docs],
                "doc_tokens": [len(x) for _, x in docs],
                "block_tokens": [len(b) for b in blocks],
                "block_crc32": [crc32_of(b) for b in blocks],
            })
        blocks = iter(rangecoder.encode_blocks(every))
        for row in rows:
            row["blocks"] = [next(blocks) for _ in row["block_tokens"]]
            yield pa.RecordBatch.from_pylist([row], _ARROW_SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker that codes makes room for it.
        worker_tokenizer(None)
        held: list[tuple[int | None, np.ndarray]] = []
        segments: list[tuple[int, int, list[tuple[int | None, np.ndarray]]]] = []
        bucket, first, size, waiting = None, 0, 0, 0
        for batch in batches:
            for own, doc_id, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (own != bucket or size >= SEGMENT):
                    segments.append((bucket, first, held))
                    waiting += size
                    first, held, size = first + size, [], 0
                    if waiting >= rangecoder.LANES * rangecoder.BLOCK:
                        yield from coded(segments)
                        segments, waiting = [], 0
                if own != bucket:
                    bucket, first = own, 0
                held.append((doc_id, np.frombuffer(data, "<u2")))
                size += len(held[-1][1])
        if held:
            segments.append((bucket, first, held))
            yield from coded(segments)

    ordered = (
        tokens.withColumn("bucket", ordering.bucket_of(F.col("doc_id"), bounds))
        .repartitionById(common.shuffle_partitions(tokens.sparkSession), F.col("bucket"))
        .sortWithinPartitions("bucket", "doc_id", "ids")
        .select("bucket", "doc_id", "ids")
    )
    if tasks is not None:
        ordered = ordered.coalesce(tasks)
    common.map_batches(ordered, run, SEGMENTS).write.parquet(path)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document in a file, from its blocks."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # One row per bucket, as many as there are partitions that wrote.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        segments.groupBy("bucket")
        .agg(F.sum("n_tokens").alias("tokens"))
        .select("bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    )
    placed = segments.join(F.broadcast(starts), "bucket").select(
        (F.col("before") + F.col("first")).alias("start"), "doc_ids", "doc_tokens", "block_tokens", "block_crc32",
        "blocks",
    )
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]
    )

    def decoded(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Documents of segments whose blocks are decoded side by side."""
        coded, sizes = ([x for row in rows for x in row[name]] for name in ("blocks", "block_tokens"))
        blocks = rangecoder.decode_blocks(coded, sizes)
        if [crc32_of(b) for b in blocks] != [c for r in rows for c in r["block_crc32"]]:
            raise ValueError("a block does not match its checksum")
        last = 0
        for row in rows:
            first, last = last, last + len(row["blocks"])
            ids = np.concatenate(blocks[first:last])
            ends = np.cumsum(row["doc_tokens"])
            sums = [crc32_of(x) for x in np.split(ids, ends[:-1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - row["doc_tokens"], pa.int64()),
                 pa.array(row["doc_tokens"], pa.int64()), pa.array(sums, pa.int64())], names=schema.names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, waiting = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if rows and waiting + len(row["blocks"]) > rangecoder.LANES:
                    yield from decoded(rows)
                    rows, waiting = [], 0
                rows.append(row)
                waiting += len(row["blocks"])
        if rows:
            yield from decoded(rows)

    return common.map_batches(placed, run, schema)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as definition:
        docs = common.documents(spark, sf_dir, "doc_id", "text")
        tokens = tokenized(docs, definition.read())
    path = scratch_path(spark, "token-file")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    write_file(tokens, ordering.id_bounds(docs.select(F.col("doc_id").cast("long"))), path, 1 + size // CODED_TOGETHER)
    return read_file(spark, path)
