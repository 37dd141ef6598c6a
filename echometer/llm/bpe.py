"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Encoding: the pattern splits a text into words. The words that a task has not met before become
token-position rows, one per byte. A recursive query joins neighbouring rows with the merge table and
contracts each word's leftmost pair of minimum rank, until no pair is left. Where no longer token of
lower rank can arise from a merge, all its places in the word that do not overlap are contracted in one
step, which gives the same tokens in fewer steps; a table column says for which ranks that holds.
Decoding: token-position rows are joined with the vocabulary in the order of their places, and their bytes
are cut where a text ends.

Everything happens in one narrow map over the rows: nothing is shuffled, so no key can be hot. A worker
remembers a bounded number of words, half of them from task to task, and closes its database with each task. Very long texts go through in pieces of ``PIECE`` words, and a
recursion that would grow too large is cut into several queries.

A null or empty text has no tokens. Bytes of control strings are ordinary text; there are no special
tokens. Equal texts get equal ids, an empty table gives an empty result, and columns of the rows come
back inside ``document``, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from echometer.llm import common

#: Words of a text handled together, and words of many short texts handled together.
PIECE = 1 << 17
#: Texts above this many code points are split into words lazily.
LONG_TEXT = 1 << 20
#: Words that a worker remembers; at most twice as many while one half replaces the other.
REMEMBERED = 300_000
#: Rows that one recursive query may build up.
RECURSION_ROWS = 2_000_000
#: Bytes of new words handled by one recursive query.
QUERY_BYTES = 1 << 17
#: Bytes from which on a word is long.
LONG_WORD = 256

#: Code points up to which texts are split by the standard library's expressions.
LETTERS_END = 0x250
PLAIN = re.compile(f"[\x00-{chr(LETTERS_END - 1)}]*")

TOKENS = (
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
)
IDS = (T.StructField("ids", T.ArrayType(T.IntegerType())),)

#: ``place`` is the word's number in the upper and the byte's in the lower 32 bits; ``next`` is the
#: place of the token after it. ``{step}`` makes the rows of the words that still have a pair to contract.
_CONTRACT = """
CREATE OR REPLACE TEMP TABLE state AS
WITH RECURSIVE run(step, place, next, token) AS (
  SELECT 0, place, next, token FROM state
  UNION ALL
  (WITH pairs AS (
     SELECT a.place >> 32 AS word, a.place, b.place AS gone, b.next, m.token, m.everywhere,
            (m.token::BIGINT << 32) | (a.place & 4294967295) AS rank
     FROM run a JOIN run b ON b.place = a.next
     JOIN merges m ON m.pair = (a.token::BIGINT << 32 | b.token)
   ), {step} AND r.step < {steps})
), last AS (
  SELECT place >> 32 AS word, max(step) AS step FROM run GROUP BY ALL
)
SELECT run.place, run.next, run.token, run.step FROM run JOIN last ON run.place >> 32 = last.word AND run.step = last.step
"""

#: The leftmost pair of minimum rank: one a word, so that a single join brings it to the word's rows.
_LEFTMOST = """
  chosen AS (
     SELECT word, min(rank) AS rank, arg_min(gone, rank) AS gone, arg_min(next, rank) AS next FROM pairs GROUP BY word
   )
   SELECT r.step + 1, r.place, CASE WHEN r.next = c.gone THEN c.next ELSE r.next END,
          CASE WHEN r.next = c.gone THEN (c.rank >> 32)::INTEGER ELSE r.token END
   FROM run r JOIN chosen c ON c.word = r.place >> 32
   WHERE r.place <> c.gone
"""

#: For long words: all pairs of minimum rank that do not overlap, where that gives the same tokens.
_EVERYWHERE = """
  lowest AS (
     SELECT word, min(rank) AS rank FROM pairs GROUP BY word
   ), hits AS (
     SELECT pairs.*, row_number() OVER w AS nth,
            CASE WHEN lag(gone) OVER w = place THEN 0 ELSE 1 END AS starts
     FROM pairs JOIN lowest ON pairs.word = lowest.word AND pairs.token = lowest.rank >> 32
     WINDOW w AS (PARTITION BY pairs.word ORDER BY place)
   ), chains AS (
     SELECT *, sum(starts) OVER (PARTITION BY word ORDER BY place) AS chain FROM hits
   ), chosen AS (
     SELECT * FROM chains
     QUALIFY CASE WHEN everywhere THEN row_number() OVER (PARTITION BY word, chain ORDER BY place) % 2 = 1
                  ELSE nth = 1 END
   )
   SELECT r.step + 1, r.place, coalesce(c.next, r.next), coalesce(c.token, r.token)
   FROM run r
   SEMI JOIN lowest ON lowest.word = r.place >> 32
   ANTI JOIN chosen g ON g.gone = r.place
   LEFT JOIN chosen c ON c.place = r.place
   WHERE true
"""

_DECODE = "SELECT place, data FROM encoded JOIN vocabulary USING (token) ORDER BY place"


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str) -> regex.Pattern:
    """``pattern`` with white space as Unicode defines it, which leaves out the separators 1C to 1F."""
    space = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
    inside = pattern.replace(r"[^\s", f"[^{space}")
    return regex.compile(inside.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


def plain_splitter(pattern: str) -> re.Pattern | None:
    """The same for texts of ``PLAIN`` characters, faster, with letters and numbers listed; None for other patterns."""
    inside = splitter(pattern).pattern
    for name in ("L", "N"):
        listed = "".join(regex.escape(chr(c)) for c in range(LETTERS_END) if regex.match(rf"\p{{{name}}}", chr(c)))
        inside = regex.sub(r"\[[^]]*\]", lambda m: m[0].replace(rf"\p{{{name}}}", listed), inside)
        inside = inside.replace(rf"\p{{{name}}}", f"[{listed}]")
    if regex.search(r"\\[a-oq-zA-Z]|\\p|\(\?(?!!)", inside.replace(r"\t-\r", "").replace(r"\x", "").replace(r"\u", "")):
        return None
    return re.compile(inside)


def _joined(values: pa.BinaryArray) -> bytes:
    """The bytes of all values, one after the other."""
    if not len(values):
        return b""
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1]
    return data[int(ends[0]) : int(ends[-1])].to_pybytes() if data else b""


class Codec:
    """Encoder and decoder of one worker, around an in-memory DuckDB."""

    def __init__(self, vocabulary: dict[bytes, int], pattern: str) -> None:
        self.pattern, self.plain = splitter(pattern), plain_splitter(pattern)
        self.single = np.array([vocabulary[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in vocabulary.items():
            for i in range(1, len(token)):
                a, b = vocabulary.get(token[:i]), vocabulary.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        # A token that is part of one with a lower rank must be contracted one place at a time.
        alone = {x for a, b, r in zip(left, right, merged) for x in (a, b) if x > r}
        pairs = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        everywhere = np.array([r not in alone for r in merged])
        self.tables = {
            "merges": {"pair": pairs, "token": np.array(merged, np.int32), "everywhere": everywhere},
            "vocabulary": {
                "token": np.array(list(vocabulary.values()), np.int32), "data": pa.array(list(vocabulary), pa.binary())
            },
        }
        self.opened: duckdb.DuckDBPyConnection | None = None
        # A space and the digits of every rank.
        self.digits = pa.array([b" %d" % rank for rank in range(max(vocabulary.values()) + 1)])
        # Ids as the bytes of 32-bit integers: a list of integers takes several times as much memory.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @property
    def db(self) -> duckdb.DuckDBPyConnection:
        if self.opened is None:
            self.opened = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
            for name, columns in self.tables.items():
                self._load(name, **columns)
        return self.opened

    def rest(self) -> None:
        """Give back working memory and the older half of the words; the worker may go on with another stage."""
        if self.opened is not None:
            self.opened.close()
        self.opened, self.older = None, {}
        pa.default_memory_pool().release_unused()

    def _load(self, name: str, **columns) -> None:
        self.db.register("loaded", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM loaded")
        self.db.unregister("loaded")

    def split(self, text: str) -> Iterator[list[str]]:
        """Words of a text, in pieces."""
        pattern = self.plain if self.plain and PLAIN.fullmatch(text) else self.pattern
        if len(text) <= LONG_TEXT:
            if text:
                yield pattern.findall(text)
            return
        words = (match[0] for match in pattern.finditer(text))
        while piece := list(islice(words, PIECE)):
            yield piece

    def encode_words(self, words: Sequence[str]) -> dict[str, bytes]:
        """Token ids of distinct words, as the bytes of 32-bit integers."""
        out: dict[str, bytes] = {}
        groups: dict[str, list[str]] = {_LEFTMOST: [], _EVERYWHERE: []}
        sizes = dict.fromkeys(groups, 0)

        def settle(chosen: str) -> None:
            if groups[chosen]:
                out.update(zip(groups[chosen], self._contract([w.encode() for w in groups[chosen]], chosen)))
            groups[chosen], sizes[chosen] = [], 0

        for word in words:
            chosen = _LEFTMOST if len(word) * 4 < LONG_WORD else _EVERYWHERE
            groups[chosen].append(word)
            sizes[chosen] += len(word)
            if sizes[chosen] >= QUERY_BYTES:
                settle(chosen)
        for chosen in groups:
            settle(chosen)
        return out

    def _contract(self, words: list[bytes], step: str) -> list[bytes]:
        lengths = np.array([len(w) for w in words], np.int64)
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        places = (np.repeat(np.arange(len(words)), lengths) << 32) | inside
        tokens = self.single[np.frombuffer(b"".join(words), np.uint8)]
        self._load("state", place=places, next=places + 1, token=tokens)
        steps = max(4, RECURSION_ROWS // len(places))
        done = False
        while not done:
            self.db.execute(_CONTRACT.format(steps=steps, step=step))
            done = self.db.execute("SELECT max(step) FROM state").fetchone()[0] < steps
        found = self.db.execute("SELECT place >> 32 AS word, token FROM state ORDER BY place").fetchnumpy()
        ends = (4 * np.searchsorted(np.asarray(found["word"]), np.arange(1, len(words)))).tolist()
        data = np.asarray(found["token"], np.int32).tobytes()
        return [data[i:j] for i, j in zip([0, *ends], [*ends, len(data)])]

    def encode(self, pieces: list[list[str]]) -> list[np.ndarray]:
        """Token ids of each piece of words."""
        distinct = set().union(*pieces)
        if len(self.words) > REMEMBERED:
            self.older, self.words = self.words, {}
        known = self.words
        unknown = []
        for word in distinct:
            if word not in known:
                if (ids := self.older.get(word)) is None:
                    unknown.append(word)
                else:
                    known[word] = ids
        known.update(self.encode_words(unknown))
        return [np.frombuffer(b"".join(map(known.__getitem__, piece)), np.int32) for piece in pieces]

    def decode(self, pieces: Sequence[Sequence[int]]) -> list[bytes]:
        """Bytes of each piece of token ids."""
        ids = np.concatenate([np.empty(0, np.int32), *(np.asarray(piece, np.int32) for piece in pieces)])
        self.db.register("encoded", pa.table({"place": np.arange(len(ids)), "token": ids}))
        found = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("encoded")
        lengths = np.zeros(len(ids) + 1, np.int64)
        lengths[np.asarray(found["place"]) + 1] = np.asarray(pc.binary_length(found["data"]))
        ends = np.cumsum(lengths)[np.cumsum([0, *map(len, pieces)])].tolist()
        data = b"".join(map(_joined, found["data"].chunks))
        return [data[i:j] for i, j in zip(ends, ends[1:])]

    def written(self, ids: np.ndarray) -> bytes:
        """Decimal ids, a space before each."""
        return _joined(self.digits.take(pa.array(ids)))

    def encoded(self, texts: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, ids of one of its pieces) in order."""
        for k, ids in self.pieces(texts):
            yield k, ids.tolist()

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """The same with ids as arrays."""
        pieces, owners, size = [], [], 0
        for k, text in enumerate(texts):
            for words in self.split(text):
                pieces.append(words)
                owners.append(k)
                size += len(words)
                if size >= PIECE:
                    yield from zip(owners, self.encode(pieces))
                    pieces, owners, size = [], [], 0
        if pieces:
            yield from zip(owners, self.encode(pieces))


_codecs: dict[str, Codec] = {}


def _rest() -> None:
    for codec in _codecs.values():
        codec.rest()


def _codec(vocabulary: dict[bytes, int], pattern: str, key: str) -> Codec:
    """A worker's codec, kept between its tasks without its database."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary, pattern)
    return _codecs[key]


def _shared(spark: SparkSession, vocabulary: dict[bytes, int], pattern: str):
    """The vocabulary for all tasks: as large as its file, whatever the corpus."""
    key = hashlib.sha256(repr((sorted(vocabulary.items()), pattern)).encode()).hexdigest()
    return spark.sparkContext.broadcast((vocabulary, pattern, key))


def encode(
    docs: DataFrame, vocabulary: dict[bytes, int], pattern: str, carry: list[str] | None = None, text: str = "text"
) -> DataFrame:
    """``document`` and its whole list of ``ids``."""
    shared = _shared(docs.sparkSession, vocabulary, pattern)

    def start() -> Callable[[pa.Array], Sequence[pa.Array]]:
        codec = _codec(*shared.value)

        def run(texts: pa.Array) -> Sequence[pa.Array]:
            ids = [[np.empty(0, np.int32)] for _ in range(len(texts))]
            for k, piece in codec.pieces(common.as_strings(texts)):
                ids[k].append(piece)
            return [pa.array([np.concatenate(pieces) for pieces in ids], pa.list_(pa.int32()))]

        return run

    return common.annotate(docs, start, IDS, carry, text, _rest)


def decode(rows: DataFrame, vocabulary: dict[bytes, int], pattern: str, ids: str = "ids") -> DataFrame:
    """``document`` with all columns of ``rows``, and the ``decoded`` bytes of its ids."""
    shared = _shared(rows.sparkSession, vocabulary, pattern)

    def start() -> Callable[[pa.Array], Sequence[pa.Array]]:
        codec = _codec(*shared.value)

        def run(lists: pa.Array) -> Sequence[pa.Array]:
            return [pa.array(codec.decode([x or [] for x in lists.to_pylist()]), pa.binary())]

        return run

    return common.annotate(rows, start, (T.StructField("decoded", T.BinaryType()),), None, ids, _rest)


def round_trip(
    docs: DataFrame, vocabulary: dict[bytes, int], pattern: str, carry: list[str] | None = None, text: str = "text"
) -> DataFrame:
    """``document``, ``n_tokens``, and digests of the ids and of the bytes decoded from them."""
    shared = _shared(docs.sparkSession, vocabulary, pattern)

    def start() -> Callable[[pa.Array], Sequence[pa.Array]]:
        codec = _codec(*shared.value)

        def run(texts: pa.Array) -> Sequence[pa.Array]:
            counts = [0] * len(texts)
            of_ids = [hashlib.sha256() for _ in counts]
            of_bytes = [hashlib.sha256() for _ in counts]

            def settle(pieces: list[tuple[int, np.ndarray]]) -> None:
                for (k, ids), data in zip(pieces, codec.decode([ids for _, ids in pieces])):
                    of_ids[k].update(codec.written(ids)[0 if counts[k] else 1 :])
                    of_bytes[k].update(data)
                    counts[k] += len(ids)

            pieces, size = [], 0
            for k, ids in codec.pieces(common.as_strings(texts)):
                pieces.append((k, ids))
                size += len(ids)
                if size >= PIECE:
                    settle(pieces)
                    pieces, size = [], 0
            settle(pieces)
            return [
                pa.array(counts, pa.int64()),
                pa.array([d.hexdigest() for d in of_ids]),
                pa.array([d.hexdigest() for d in of_bytes]),
            ]

        return run

    return common.annotate(docs, start, TOKENS, carry, text, _rest)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    found = round_trip(docs, vocabulary, public_tokenizers.PATTERN, ["doc_id"])
    return found.select("document.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
