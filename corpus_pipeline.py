"""A training corpus from the table of documents, in five stages.

Each stage takes the documents that the one before kept and, but for the last, returns the columns of
documents again. Empty tables pass through; nulls, empty texts, repeated rows and extra columns are handled as
the operators say, and extra columns end here.

1. Language: texts that no language's centroids are near to go, as do texts without a letter.
2. Lines: of equal or nearly equal lines the earliest stays; a document that loses every line goes.
3. Near duplicates: of each group of documents linked by word shingles the one with the smallest id stays.
   Rows without an id can't be named by a group and stay.
4. Benchmark: documents with a passage of a benchmark item go.
5. Tokens: each text is encoded and decoded; digests of both are the result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echometer.llm import bpe, common, decontaminate, jaccard, language, lines

#: A character that is no white space, in Unicode and for Python's ``strip``.
NOT_BLANK = r"(?U)[^\s\x1C-\x1F]"


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*common.DOCUMENT_COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _columns(docs)
    model = language.fit(language.training_sample(docs))
    return common.documents_of(language.predict(docs, model).filter("NOT rejected"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _columns(docs)
    found = lines.with_dropped(docs)
    text = lines.without_lines(F.col("document.text"), F.col("dropped"))
    left = found.withColumn("text", text).filter(F.col("dropped").isNull() | F.col("text").rlike(NOT_BLANK))
    return left.select(
        "document.doc_id",
        "text",
        "document.lang",
        "document.source",
        F.when(F.col("dropped").isNull(), F.col("document.n_chars")).otherwise(F.length("text").cast("long")).alias("n_chars"),
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _columns(docs)
    groups = jaccard.similar_groups(docs)
    gone = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*common.DOCUMENT_COLUMNS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(_columns(docs), common.table(spark, sf_dir, "benchmark"))
    return common.documents_of(found.filter("n_hit = 0"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = bpe.round_trip(_columns(docs), vocabulary, public_tokenizers.PATTERN, ["doc_id"])
    return found.select("document.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("byte_bpe", encode_tokens),
]

#: The rows depend on a fitted language model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
