import hashlib
import random

import pytest
from pyspark.sql import functions as F

from echometer.llm import bpe
from tests.llm.conftest import EDGES

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def oracle(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})


def test_codec_equals_library(vocabulary, oracle):
    codec, rng = bpe.Codec(vocabulary, public_tokenizers.PATTERN), random.Random(2)
    texts = ["", "a" * 999, "ab" * 300, "====----" * 60, " " * 300 + "x", "<|endoftext|>", "a\x1cb\x85c d　e ½ ٣ don't I'LL"]
    texts += ["".join(rng.choice("abcdeéñ\n\t\x1c 0123'=*") for _ in range(rng.randrange(300))) for _ in range(150)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(2000))]
    ids = [[] for _ in texts]
    for k, piece in codec.encoded(texts):
        ids[k] += piece
    assert ids == [oracle.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def test_pieces_of_long_texts(vocabulary, oracle, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "PIECE", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "RECURSION_ROWS", 1)
    monkeypatch.setattr(bpe, "LONG_WORD", 40)
    codec, text = bpe.Codec(vocabulary, public_tokenizers.PATTERN), "understandable unpronounceabilities, isn't it? " * 20
    assert [i for _, piece in codec.encoded([text]) for i in piece] == oracle.encode_ordinary(text)


def test_plain_texts_are_split_alike():
    plain, whole = bpe.plain_splitter(public_tokenizers.PATTERN), bpe.splitter(public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(chr(rng.choice((rng.randrange(0x250), rng.randrange(128), 32, 10, 0x85, 0xA0, 39))) for _ in range(30))
        assert bpe.PLAIN.fullmatch(text) and plain.findall(text) == whole.findall(text)
    assert bpe.plain_splitter(r"(?i:'s)|\p{L}+") is None and bpe.plain_splitter(r"\w+|\p{Lu}") is None


def test_codec_at_rest_is_small(vocabulary, oracle, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    codec = bpe.Codec(vocabulary, public_tokenizers.PATTERN)
    for k in range(4):
        text = " ".join(f"unpronounceable{'abcdefgh'[i % 8] * (i // 8 + 1)}{k}" for i in range(60))
        ids = [i for _, piece in codec.encoded([text]) for i in piece]
        assert ids == oracle.encode_ordinary(text) and codec.decode([ids]) == [text.encode()]
        # A word's ids take four bytes each beside one object.
        assert all(type(found) is bytes and len(found) % 4 == 0 for found in codec.words.values())
        codec.rest()
        assert codec.opened is None and not codec.older and codec.words


def test_edges(edges, nothing, vocabulary, oracle):
    expected = sorted(
        (len(ids := oracle.encode_ordinary(row[1] or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
         hashlib.sha256((row[1] or "").encode()).hexdigest()) for row in EDGES
    )
    rows = bpe.round_trip(edges, vocabulary, public_tokenizers.PATTERN).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expected
    assert bpe.round_trip(nothing, vocabulary, public_tokenizers.PATTERN).count() == 0
    encoded = bpe.encode(edges, vocabulary, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, vocabulary, public_tokenizers.PATTERN)
    text = F.coalesce(F.col("document.document.text"), F.lit("")).cast("binary")
    assert back.filter(F.col("decoded") != text).count() == 0


def test_query(spark, tables, texts, oracle):
    rows = {r.doc_id: r for r in bpe.op7_byte_bpe(spark, tables).collect()}
    for doc_id, text in texts:
        ids = oracle.encode_ordinary(text)
        assert rows[doc_id].n_tokens == len(ids)
        assert rows[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
