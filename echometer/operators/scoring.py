"""Sentiment scores: the retweet rule, scorers, and scoring each text once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echometer.operators.joins import BROADCAST_ROWS, join_value, text_digest
from echometer.operators.relevance import repeats_account
from echometer.session import holds_at_most, settled

# The score of a retweet of the target, and the model's rows per forward pass.
RETWEET_SCORE = 1.0
BATCH_ROWS = 32


class Scorer(Protocol):
    """Adds a score in [0, 1] of a text column; a null text gets a null score."""

    costly: bool

    def score(self, rows: DataFrame, text: str, out: str) -> DataFrame: ...


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


class LexiconScorer:
    """Sigmoid of the summed weights of a text's words."""

    costly = False

    def __init__(self, lexicon: DataFrame, inline_words: int = 100_000):
        """``lexicon`` has ``word`` and ``weight``; small ones travel with the tasks.

        The weights of a word that is listed several times add up.
        """
        self._lexicon = lexicon.where("word IS NOT NULL").groupBy("word").agg(F.sum("weight").alias("weight"))
        self._inline = self._settled = None
        if inline_words > 0:
            rows = self._lexicon.limit(inline_words + 1).collect()
            self._inline = rows if len(rows) <= inline_words else None

    def score(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        if self._inline is None:
            return self._score_by_join(rows, text, out)
        weigh = _word_weigher([r["word"] for r in self._inline], [r["weight"] for r in self._inline])
        return rows.withColumn(out, sigmoid(weigh(F.col(text))))

    def _score_by_join(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        """For a lexicon beyond the tasks' memory: words meet their weights in a join.

        Distinct texts are scored once, and a text's equal words are counted before the join. A word
        goes to the join once for each Arrow batch, with the texts that hold it, so that a common
        word neither floods one task nor repeats beside each of its texts.
        """
        keyed = rows.withColumn("_words_of", text_digest(text))
        texts = settled(
            keyed.where(F.col(text).isNotNull())
            .groupBy("_words_of", text)
            .agg(F.count(F.lit(1)).alias("_repeats"))
            .withColumn("_place", F.monotonically_increasing_id())
        )
        if self._settled is None:
            self._settled = settled(self._lexicon)
        lexicon = self._settled
        if holds_at_most(lexicon, BROADCAST_ROWS):
            lexicon = F.broadcast(lexicon)
        weights = (
            texts.select("_place", text)
            .mapInArrow(_words_with_texts, "word string, places array<bigint>, times array<int>")
            .join(lexicon, "word")
            .select("weight", F.explode(F.arrays_zip("places", "times")).alias("_at"))
            .groupBy(F.col("_at.places").alias("_place"))
            .agg(F.sum(F.col("weight") * F.col("_at.times")).alias("_weight"))
        )
        scores = settled(
            texts.drop(text)
            .join(weights, "_place", "left")
            .select("_words_of", "_repeats", sigmoid(F.coalesce("_weight", F.lit(0.0))).alias(out))
        )
        return join_value(keyed, scores, "_words_of", "_repeats").drop("_words_of")


def _words_with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From places and texts: each word of a batch with the places of its texts and how often each holds it."""
    for batch in batches:
        places, texts = batch.columns
        tokens = pc.split_pattern(texts, " ")
        words = pc.list_flatten(tokens).dictionary_encode()
        owners = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, times = np.unique(codes * len(batch) + owners, return_counts=True)
        code, owner = np.divmod(pairs, max(len(batch), 1))
        starts = pa.array(np.searchsorted(code, np.arange(len(words.dictionary) + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                words.dictionary.cast(pa.string()),
                pa.ListArray.from_arrays(starts, places.take(pa.array(owner))),
                pa.ListArray.from_arrays(starts, pa.array(times, pa.int32())),
            ],
            names=["word", "places", "times"],
        )


def _word_weigher(words: Sequence[str], weights: Sequence[float]):
    known = pa.array(words, pa.string())
    by_place = np.append(np.asarray(weights, dtype=float), 0.0)

    @F.arrow_udf("double")
    def weigh(texts: pa.Array) -> pa.Array:
        tokens = pc.split_pattern(texts, " ")
        places = pc.fill_null(pc.index_in(pc.list_flatten(tokens), value_set=known), len(known))
        owners = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
        sums = np.bincount(
            owners, weights=by_place[places.to_numpy(zero_copy_only=False)], minlength=len(texts)
        )
        return pa.array(sums, pa.float64(), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return weigh


def log_odds_lexicon(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """``word, weight`` learned from texts with a label of 0 or 1, for ``LexiconScorer``.

    The weight of a word is the log of how much likelier it is in texts of label 1, from word counts
    with one added to each. One aggregate over words with partial sums, so no word is hot.
    """
    words = labelled.where(F.col(label).isin(0, 1)).select(
        F.col(label).alias("_label"), F.explode(F.split(text, " ")).alias("word")
    )
    counts = words.groupBy("word").agg(
        F.count_if(F.col("_label") == 1).alias("_with"), F.count_if(F.col("_label") == 0).alias("_without")
    )
    # One row: the words in all texts of each label, and the distinct ones.
    totals = counts.agg(
        F.sum("_with").alias("_all_with"), F.sum("_without").alias("_all_without"), F.count(F.lit(1)).alias("_words")
    )
    likelihood = (F.col("_with") + 1) / (F.col("_all_with") + F.col("_words"))
    against = (F.col("_without") + 1) / (F.col("_all_without") + F.col("_words"))
    return counts.join(F.broadcast(totals)).select("word", F.log(likelihood / against).alias("weight"))


class ModelScorer:
    """Sigmoid of the first output of a model that runs in Arrow batches.

    ``load`` returns a function from a list of texts to their outputs (a row each). It is called
    once per task; equal texts of one Arrow batch are predicted once.
    """

    costly = True

    def __init__(
        self, load: Callable[[], Callable[[list[str]], np.ndarray]], batch_rows: int = BATCH_ROWS
    ):
        self._load = load
        self._batch_rows = batch_rows

    def score(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        load, batch_rows = self._load, self._batch_rows

        @F.pandas_udf("double")
        def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            predict = load()
            for texts in batches:
                distinct = texts.dropna().unique().tolist()
                first = {}
                for start in range(0, len(distinct), batch_rows):
                    part = distinct[start : start + batch_rows]
                    outputs = np.asarray(predict(part), dtype=float).reshape(len(part), -1)
                    first.update(zip(part, outputs[:, 0]))
                yield texts.map(first).astype(float)

        logit = logits(F.col(text))
        return rows.withColumn(out, F.when(F.col(text).isNotNull(), sigmoid(logit)))


class LearnedScorer:
    """Logistic regression over hashed words, trained on texts normalised the same way."""

    costly = False

    def __init__(self, model: PipelineModel):
        self._model = model

    @classmethod
    def train(
        cls,
        labelled: DataFrame,
        text: str = "PROCESSED_TEXT",
        label: str = "label",
        features: int = 1 << 16,
        rounds: int = 20,
    ) -> LearnedScorer:
        stages = Pipeline(
            stages=[
                RegexTokenizer(inputCol="_text", outputCol="_words", pattern=" ", toLowercase=False),
                HashingTF(inputCol="_words", outputCol="_features", numFeatures=features),
                LogisticRegression(
                    featuresCol="_features",
                    labelCol="_label",
                    probabilityCol="_probability",
                    predictionCol="_prediction",
                    rawPredictionCol="_raw",
                    maxIter=rounds,
                    regParam=0.01,
                ),
            ]
        )
        return cls(
            stages.fit(
                labelled.where(F.col(text).isNotNull()).select(
                    F.col(text).alias("_text"), F.col(label).cast("double").alias("_label")
                )
            )
        )

    def score(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        filled = rows.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        probability = vector_to_array(F.col("_probability"))[1]
        return (
            self._model.transform(filled)
            .withColumn(out, F.when(F.col(text).isNotNull(), probability))
            .drop("_text", "_words", "_features", "_raw", "_probability", "_prediction")
        )


def _is_ruled(full_text: str, account: str) -> Column:
    return F.coalesce(repeats_account(F.col(full_text), F.col(account)), F.lit(False))


def score_with_rule(
    rows: DataFrame,
    scorer: Scorer,
    full_text: str = "FULL_TEXT",
    text: str = "PROCESSED_TEXT",
    account: str = "ACCOUNT",
    out: str = "SENTIMENT",
) -> DataFrame:
    """Retweets of the target score 1, the others what the scorer says.

    The scorer gets null for ruled rows, so that a model copies and predicts only the others
    although all rows stay in one pass.
    """
    masked = rows.withColumn("_asked", F.when(~_is_ruled(full_text, account), F.col(text)))
    return (
        scorer.score(masked, "_asked", "_answer")
        .withColumn(
            out, F.when(_is_ruled(full_text, account), RETWEET_SCORE).otherwise(F.col("_answer"))
        )
        .drop("_asked", "_answer")
    )


def score_by_branches(
    rows: DataFrame,
    scorer: Scorer,
    full_text: str = "FULL_TEXT",
    text: str = "PROCESSED_TEXT",
    account: str = "ACCOUNT",
    out: str = "SENTIMENT",
) -> DataFrame:
    """The same by splitting the rows and putting both parts together again.

    For scorers that cannot take nulls; reads its input twice.
    """
    ruled = rows.where(_is_ruled(full_text, account)).withColumn(out, F.lit(RETWEET_SCORE))
    asked = scorer.score(rows.where(~_is_ruled(full_text, account)), text, out)
    return ruled.unionByName(asked)


def score_deduplicated(
    rows: DataFrame,
    scorer: Scorer,
    full_text: str = "FULL_TEXT",
    text: str = "PROCESSED_TEXT",
    account: str = "ACCOUNT",
    out: str = "SENTIMENT",
) -> DataFrame:
    """``score_with_rule`` that shows every distinct text to the scorer once.

    Worth its shuffle for a costly scorer. The model sees the normalised text only, so that rows
    beyond the rule are distinct by that alone. The scores are checkpointed: they are read for
    the join's size checks and never predicted again.
    """
    keyed = rows.withColumn("_digest", text_digest(text))
    texts = (
        keyed.where(~_is_ruled(full_text, account))
        .groupBy("_digest", text)
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    answers = settled(scorer.score(texts, text, "_answer").select("_digest", "_copies", "_answer"))
    return (
        join_value(keyed, answers, "_digest", "_copies")
        .withColumn(
            out, F.when(_is_ruled(full_text, account), RETWEET_SCORE).otherwise(F.col("_answer"))
        )
        .drop("_digest", "_answer")
    )


def join_back(rows: DataFrame, scores: DataFrame, out: str = "SENTIMENT") -> DataFrame:
    """Left join rows to scores of their distinct text pairs; null texts match each other."""
    pair = text_digest("FULL_TEXT", "PROCESSED_TEXT")
    keyed = rows.withColumn("_digest", pair)
    known = settled(scores.select(pair.alias("_digest"), out))
    if holds_at_most(known, BROADCAST_ROWS):
        joined = keyed.join(F.broadcast(known), "_digest", "left")
    else:
        copies = keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_copies"))
        joined = join_value(keyed, settled(known.join(copies, "_digest")), "_digest", "_copies")
    return joined.drop("_digest")
