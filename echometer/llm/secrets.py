"""Secret scans with corpus-wide ownership frequency.

Every whole text is scanned for candidates. The hash of each candidate value is then counted over the
corpus by distinct owners and distinct repositories: a value that many owners carry is a widely copied
example, one that a single owner carries looks like a live credential. The verdict adds a span of kind
``example`` or ``live`` over the value; base spans are always kept.

The candidates of a document are written once, without texts, under a row number that later jobs
read back, so that repeated documents stay apart. Counting goes (value, owner, repository), then
(value, owner), then value, each step with partial sums, and the verdicts join the candidates on a salted
value: a value on a third of all rows spreads over all tasks. No text is shuffled.

A null text has no candidates; a null owner or repository counts as one nameless owner or repository.
Ties, repeated rows and extra columns change nothing in other rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echometer.llm import common

KINDS = ("assign", "access", "hex")

#: A value of at least this many distinct owners is a copied example.
COPIED_OWNERS = 3

#: Parts over which the candidates of one value are dealt for the join with its verdict.
SALTS = 32

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 24 and more starts where its run of any length starts, so shorter ones need no match.
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.ASCII | re.IGNORECASE)

SPAN = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("end", T.LongType()),
        T.StructField("value_start", T.LongType()),
        T.StructField("value_hash", T.StringType()),
    ]
)


def base_spans(text: str) -> list[tuple[int, int, int, int, str]]:
    """(start, kind's rank, end, start of the value, the value) by start, then kind; end exclusive."""
    found = []
    if _NAMES.search(text):
        found += [
            (m.start(), 0, m.end(), m.start(2), m[2]) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6
        ]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m.start(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def _start():
    kind = pa.list_(
        pa.struct(
            [
                ("start", pa.int64()),
                ("rank", pa.int32()),
                ("end", pa.int64()),
                ("value_start", pa.int64()),
                ("value_hash", pa.string()),
            ]
        )
    )
    names = [field.name for field in SPAN]

    def scan(texts: pa.Array) -> Iterator[pa.Array]:
        rows = [
            [
                dict(zip(names, (*span[:4], xxhash.xxh3_128_hexdigest(span[4].encode()))))
                for span in base_spans(text)
            ]
            for text in common.as_strings(texts)
        ]
        return [pa.array(rows, kind)]

    return scan


def find_candidates(
    docs: DataFrame, owner: Column, repository: Column, carry: list[str], text: str = "text"
) -> DataFrame:
    """``document``, ``owner``, ``repository`` and ``candidates`` of every row, under a stored ``row``."""
    keyed = docs.select(F.struct(*map(common.plain, carry)).alias("carried"), owner.alias("owner"),
                        repository.alias("repository"), common.plain(text).alias("searched"))
    found = common.annotate(
        keyed, _start, [T.StructField("candidates", T.ArrayType(SPAN))], ["carried", "owner", "repository"], "searched"
    )
    return common.stored(
        found.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("document.carried").alias("document"),
            "document.owner",
            "document.repository",
            "candidates",
        ),
        "secret-candidates",
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every value hash."""
    values = candidates.select("owner", "repository", F.explode("candidates.value_hash").alias("value_hash"))
    by_repository = values.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("copies"))
    by_owner = by_repository.groupBy("value_hash", "owner").agg(
        F.count("*").alias("repositories"), F.sum("copies").alias("copies")
    )
    return by_owner.groupBy("value_hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("copies").alias("copies")
    )


def judged(candidates: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """``document``, ``candidates`` and ``verdicts``: start and end of each value, its kind, owners, repositories."""
    spans = candidates.select("row", F.explode("candidates").alias("span")).select(
        "row", "span.*", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt")
    )
    frequency = ownership(candidates).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1))))
    verdicts = (
        spans.join(frequency, ["value_hash", "salt"])
        .groupBy("row")
        .agg(
            F.array_sort(
                F.collect_set(
                    F.struct(
                        F.col("value_start").alias("start"),
                        F.when(F.col("owners") >= copied_owners, "example").otherwise("live").alias("kind"),
                        "end",
                        "owners",
                        "repositories",
                    )
                )
            ).alias("verdicts")
        )
    )
    return candidates.join(verdicts, "row", "left").select("document", "candidates", "verdicts")


#: Order of kinds among spans with one start.
_ORDER = (*KINDS, "live", "example")


def _span(start: Column, rank: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), rank.cast("int").alias("rank"), end.alias("end"))


def _count_of(kind: str) -> Column:
    """Candidates of one kind. A second parameter of the lambda would be the place in the array."""
    rank = KINDS.index(kind)
    return F.size(F.filter("candidates", lambda s: s["rank"] == rank)).cast("long")


def _listed(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, _ORDER))
    named = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])
    )
    return F.array_join(named, ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is the repository of its text, its source the owner."""
    docs = common.documents(spark, sf_dir, "doc_id", "text", "source")
    found = judged(find_candidates(docs, F.col("source"), F.col("doc_id"), ["doc_id"]))
    base = F.transform("candidates", lambda s: _span(s["start"], s["rank"], s["end"]))
    added = F.transform(
        "verdicts", lambda s: _span(s["start"], F.when(s["kind"] == "live", 3).otherwise(4), s["end"])
    )
    return found.select(
        "document.doc_id",
        *(_count_of(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.when(F.col("verdicts").isNull(), base).otherwise(F.concat(base, added))).alias("spans"),
    )
