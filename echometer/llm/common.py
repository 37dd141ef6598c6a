"""What the operators share: reading tables, Arrow passes over texts, stored intermediate results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echometer.session import scratch_path

#: Bytes of text that one Arrow batch hands to Python at a time; bounds a worker's memory.
BATCH_BYTES = 4 << 20

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: From a batch of texts to one array per new column.
Annotator = Callable[[pa.Array], Sequence[pa.Array]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or DOCUMENT_COLUMNS))


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def map_batches(
    df: DataFrame, transform: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(transform, schema)


def annotate(
    docs: DataFrame,
    start: Callable[[], Annotator],
    fields: Sequence[T.StructField],
    carry: Sequence[str] | None = None,
    text: str = "text",
    finish: Callable[[], None] | None = None,
) -> DataFrame:
    """Rows of ``docs`` as a struct ``document`` (its columns in ``carry``, or all) beside new columns.

    A struct keeps the document's own columns apart, so no name of theirs can clash with a result.
    ``start`` is called once per task, ``finish`` when the task has no more rows.
    """
    carry = list(docs.columns if carry is None else carry)
    kept = T.StructType([docs.schema[name] for name in carry])
    schema = T.StructType([T.StructField("document", kept), *fields])
    names = [f.name for f in schema]
    positions = [docs.columns.index(name) for name in carry]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annotator = start()
        for batch in batches:
            document = pa.StructArray.from_arrays([batch.column(i) for i in positions], names=carry)
            yield pa.RecordBatch.from_arrays([document, *annotator(batch.column(at))], names=names)
        if finish is not None:
            finish()

    return map_batches(docs, run, schema)


def documents_of(annotated: DataFrame) -> DataFrame:
    """The carried columns again, without the results."""
    return annotated.select("document.*")


def as_strings(texts: pa.Array) -> list[str]:
    """Whole texts; null is empty."""
    return pc.fill_null(texts, "").to_pylist()


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of whole texts; null is empty."""
    return pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()


#: Row group of a stored table; the Parquet writer holds one in memory per task until it is full.
ROW_GROUP_BYTES = 16 << 20


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table of the shared folder; cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")
