import random
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from echometer.llm import ordering, rangecoder, tokens
from echometer.session import scratch_path

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def oracle(definition):
    found = tokenizers.Tokenizer.from_str(definition)
    found.encode_special_tokens = True
    return found


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    blocks = [
        np.array([], np.uint16), np.array([65535]), rng.integers(0, 65536, 400), np.zeros(900, np.int64),
        np.tile([7, 8, 9], 200), rng.integers(0, 40, 300), np.full(rangecoder.BLOCK, 65535),
    ]
    coded = rangecoder.encode_blocks(blocks)
    back = rangecoder.decode_blocks(coded, [len(b) for b in blocks])
    assert all(len(a) == len(b) and (a == b).all() for a, b in zip(blocks, back))
    assert len(coded[4]) < 200 and len(coded[3]) < 40
    alone = rangecoder.encode_blocks([blocks[2]])
    assert alone[0] == coded[2]


def test_words_equal_whole_texts(definition):
    rng, tokenizer = random.Random(5), tokens.WordTokenizer(definition)
    letters = "abcXYZ éÉñÑßüŒœÿŸ'’\"\n\t\x0b\x1c\x85\xa0 0123½²ªº!?.,İıſKǅ́'sT'RE'Ll<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|startoftext|>", "é ΑΣ σ"]
    assert [tokenizer.encode(t) for t in texts] == [tokenizer.whole(t) for t in texts]


def test_new_words_of_many_texts_take_one_call(definition, oracle, monkeypatch):
    tokenizer = tokens.WordTokenizer(definition)
    calls, learn = [], tokenizer._learn
    monkeypatch.setattr(tokenizer, "_learn", lambda words: calls.append(len(words)) or learn(words))
    texts = [f"word{'abcdefgh'[k % 8] * (k // 8)} don't ½ x{k} ɏȺ" for k in range(100)] + ["", "日本 語", "é" * 50]
    expected = [np.array(oracle.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert tokenizer.encoded(texts) == expected
    assert len(calls) == 1
    # Few words together, few remembered: the same ids.
    monkeypatch.setattr(tokens, "TOGETHER", 3)
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    monkeypatch.setattr(tokens, "AT_ONCE", 2)
    assert tokens.WordTokenizer(definition).encoded(texts) == expected


def written(spark, df, definition):
    path = scratch_path(spark, "tokens")
    tokens.write_file(tokens.tokenized(df, definition), ordering.id_bounds(df.select("doc_id")), path)
    return path


def check(rows, texts, oracle):
    start = 0
    for r, (doc_id, text) in zip(sorted(rows, key=lambda r: r.start), texts, strict=True):
        ids = [*oracle.encode(text, add_special_tokens=False).ids, tokens.END]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_segments_and_order(spark, definition, oracle, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 50)
    monkeypatch.setattr(rangecoder, "BLOCK", 16)
    texts = [(i * 3, f"text number {i} " * (i % 9)) for i in range(60)]
    df = spark.createDataFrame(random.Random(1).sample(texts, 60), "doc_id long, text string").repartition(5)
    check(tokens.read_file(spark, written(spark, df, definition)).collect(), texts, oracle)


def test_edges(spark, edges, nothing, definition, oracle):
    rows = tokens.read_file(spark, written(spark, edges, definition)).collect()
    assert len(rows) == edges.count()
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {1}
    assert min(rows, key=lambda r: r.start).doc_id is None
    assert tokens.read_file(spark, written(spark, nothing, definition)).count() == 0


def test_checksums_are_checked(spark, edges, definition):
    segments = spark.read.parquet(written(spark, edges, definition))
    path = scratch_path(spark, "broken")
    segments.withColumn("block_crc32", F.transform("block_crc32", lambda c: c + 1)).write.parquet(path)
    with pytest.raises(Exception, match="checksum"):
        tokens.read_file(spark, path).collect()


def test_query(spark, tables, texts, oracle):
    check(tokens.op5_token_files(spark, tables).collect(), texts, oracle)


def test_split_is_the_rule_of_the_tokenizer():
    rule = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    rng, letters = random.Random(7), "aéÿsrtvemldȺ'''\"!? \t\n\xa11½²0|"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))).lower() for _ in range(3000)]
    found = tokens.split_words("\0".join(texts) + "\0").to_pylist()
    assert [word.decode("utf-16-le") for word in found] == [w for t in texts for w in [*rule.findall(t), "\0"]]


def test_one_tokenizer_per_worker(definition):
    assert tokens.worker_tokenizer(definition) is tokens.worker_tokenizer(definition)
    assert tokens.worker_tokenizer(None) is None and not tokens._tokenizers


def test_segments_are_coded_side_by_side(spark, definition, oracle, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 40)
    monkeypatch.setattr(rangecoder, "BLOCK", 16)
    texts = [(i, f"text number {i} " * (i % 9)) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    ids, path = tokens.tokenized(df, definition), scratch_path(spark, "tokens")
    rows = ids.selectExpr("0 AS bucket", "doc_id", "ids").orderBy("doc_id").toArrow().to_batches()
    tokens.write_file(ids, [], path, 1)
    segments = spark.read.parquet(path)
    assert segments.select(F.input_file_name()).distinct().count() == 1
    check(tokens.read_file(spark, path).collect(), texts, oracle)
    # The same here, to see how often the coder is called.
    held, calls, coder = [], [], rangecoder.encode_blocks
    monkeypatch.setattr(tokens.common, "map_batches", lambda df, run, schema: held.append(run) or df)
    monkeypatch.setattr(rangecoder, "encode_blocks", lambda blocks: calls.append(len(blocks)) or coder(blocks))
    tokens.write_file(ids, [], scratch_path(spark, "tokens"), 1)
    out = [row for batch in held[0](iter(rows)) for row in batch.to_pylist()]
    assert len(out) > 3
    assert calls == [sum(len(row["blocks"]) for row in out)]
