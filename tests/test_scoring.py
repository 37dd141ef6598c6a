import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echometer.operators import scoring
from echometer.operators.joins import join_dimension, join_value, text_digest

WEIGHTS = {"bien": 1.0, "mal": -2.0, "eso": 0.5}


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def lexicon(spark):
    return spark.createDataFrame(list(WEIGHTS.items()), "word string, weight double")


def rows(spark, copies=1):
    data = [
        (1, "abc", "RT @abc bien", "abc bien"),
        (2, "abc", "eso bien mal", "eso bien mal"),
        (3, "abc", "nada", "nada"),
        (4, "xyz", "RT @abc bien", "abc bien"),
        (5, "xyz", "", ""),
        (6, "xyz", None, None),
    ] * copies
    return spark.createDataFrame(data, "TWEET_ID long, ACCOUNT string, FULL_TEXT string, PROCESSED_TEXT string")


WANT = {1: 1.0, 2: sigmoid(-0.5), 3: 0.5, 4: sigmoid(1.0), 5: 0.5, 6: None}


def scores(df, out="SENTIMENT"):
    return {r["TWEET_ID"]: r[out] for r in df.collect()}


def close(got, want):
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] is None if value is None else got[key] == pytest.approx(value), key


@pytest.mark.parametrize("inline_words", [100, 0])
@pytest.mark.parametrize("combine", [scoring.score_with_rule, scoring.score_by_branches, scoring.score_deduplicated])
def test_rule_and_lexicon(spark, combine, inline_words):
    scorer = scoring.LexiconScorer(lexicon(spark), inline_words)
    scored = combine(rows(spark), scorer)
    assert scored.columns == [*rows(spark).columns, "SENTIMENT"]
    close(scores(scored), WANT)


def test_repeated_words_count_each_time(spark):
    frame = spark.createDataFrame([(1, "mal mal bien"), (2, "mal mal bien")], "TWEET_ID long, t string")
    for inline_words in (100, 0):
        scored = scoring.LexiconScorer(lexicon(spark), inline_words).score(frame, "t", "s")
        close(scores(scored, "s"), {1: sigmoid(-3.0), 2: sigmoid(-3.0)})


def test_model_sees_no_ruled_or_repeated_text(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def predict(texts):
            assert len(texts) <= 2 and all(isinstance(t, str) for t in texts)
            seen.add(len(texts))
            return np.array([[len(t), -1.0] for t in texts])

        return predict

    scorer = scoring.ModelScorer(load, batch_rows=2)
    want = {1: 1.0, 2: sigmoid(12), 3: sigmoid(4), 4: sigmoid(8), 5: sigmoid(0), 6: None}
    frame = rows(spark, copies=20).coalesce(1)
    close(scores(scoring.score_with_rule(frame, scorer)), want)
    assert seen.value == 4
    seen.value = 0
    close(scores(scoring.score_deduplicated(frame.repartition(4), scorer)), want)
    assert seen.value == 4


def test_join_back_matches_null_texts(spark):
    frame = rows(spark)
    known = frame.select("FULL_TEXT", "PROCESSED_TEXT").distinct().withColumn("SENTIMENT", F.coalesce(F.length("FULL_TEXT"), F.lit(-1)).cast("double"))
    want = {1: 12.0, 2: 12.0, 3: 4.0, 4: 12.0, 5: 0.0, 6: -1.0}
    joined = scoring.join_back(frame, known)
    assert joined.columns == [*frame.columns, "SENTIMENT"]
    close(scores(joined), want)
    close(scores(scoring.join_back(frame, known.where("FULL_TEXT is null"))), {k: (-1.0 if k == 6 else None) for k in want})


def test_digest_keeps_texts_apart(spark):
    data = [("a", "bc"), ("ab", "c"), (None, "x"), ("null;", "x"), ("", None), (None, ""), ("1:a", ""), ("a", "1:")]
    frame = spark.createDataFrame(data, "x string, y string").select(text_digest("x", "y").alias("d"))
    assert frame.distinct().count() == len(data)
    assert frame.where("d is null").count() == 0


@pytest.mark.parametrize("broadcast_rows, hot_keys", [(1000, 10), (0, 10), (0, 1000), (0, 1)])
def test_join_value_with_hot_keys(spark, broadcast_rows, hot_keys):
    data = [(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(600)] + [(1000, "unknown")]
    frame = spark.createDataFrame(data, "i long, k string").repartition(8)
    values = frame.where("k <> 'unknown'").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.upper("k"))
    joined = join_value(frame, values, "k", "n", broadcast_rows, hot_keys)
    assert joined.columns == ["i", "k", "v"] if broadcast_rows == 0 else True
    got = {r["i"]: r["v"] for r in joined.collect()}
    assert got == {i: None if k == "unknown" else k.upper() for i, k in data}


def test_hot_rows_are_spread(spark):
    frame = spark.range(0, 8000, 1, 64).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"))
    values = frame.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_value(frame, values, "k", "n", broadcast_rows=0, hot_keys=100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 8000 and max(sizes) < 2500


def test_learned_scorer(spark):
    data = [("bien bueno", 1), ("muy bien", 1), ("mal malo", 0), ("muy mal", 0)] * 5
    labelled = spark.createDataFrame(data, "PROCESSED_TEXT string, label int")
    scorer = scoring.LearnedScorer.train(labelled)
    frame = spark.createDataFrame([(1, "bien"), (2, "mal"), (3, None), (4, "")], "TWEET_ID long, t string")
    scored = scorer.score(frame, "t", "s")
    assert scored.columns == ["TWEET_ID", "t", "s"]
    got = scores(scored, "s")
    assert got[1] > 0.5 > got[2] and got[3] is None and got[4] is not None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_dimension_beyond_its_bound(spark, how):
    frame = spark.range(0, 900, 1, 16).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"))
    dimension = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("other", 4)], "k string, v int")
    want = frame.join(dimension, "k", how)
    got = join_dimension(frame, dimension, "k", how, broadcast_rows=0, lanes=4)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_a_word_meets_its_weight_once_a_batch(spark):
    texts = [None, "", "hola  hola mal ", "mal hola", "x " * 2000, "hola  hola mal "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    lexicon = spark.createDataFrame([("hola", 1.5), ("mal", -1.0), ("", 0.25), ("x", 0.001)], "word string, weight double")
    scores = [
        {r["id"]: r["s"] for r in scoring.LexiconScorer(lexicon, **words).score(rows, "t", "s").collect()} for words in ({}, {"inline_words": 0})
    ]
    assert scores[1] == {i: s if s is None else pytest.approx(s) for i, s in scores[0].items()} and len(scores[1]) == 6

    batch = pa.RecordBatch.from_pydict({"place": pa.array([7, 8, 9], pa.int64()), "text": ["a b a", "b", ""]})
    (found,) = scoring._words_with_texts([batch])
    assert {r["word"]: (r["places"], r["times"]) for r in found.to_pylist()} == {"a": ([7], [2]), "b": ([7, 8], [1, 1]), "": ([9], [1])}
    assert scoring._words_with_texts([batch.slice(0, 0)]).__next__().num_rows == 0
