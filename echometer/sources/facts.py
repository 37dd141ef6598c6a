"""The table of stored interactions: create, append, read, expire."""

from __future__ import annotations

import datetime
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echometer.functions.clock import AsOf, days_before
from echometer.functions.display import export_time
from echometer.schemas import FACT, PARTITION_BATCH, PARTITION_DAY

RETENTION_DAYS = 2
_DROPS_PER_STATEMENT = 500
_DAYS_PER_WRITE = 100
# Batches of one run are numbered; a merged partition names the last one in it.
_NUMBERED = re.compile(r"(?P<run>.+)-(?P<number>\d+)")
_MERGED = re.compile(r"(?P<run>.+)-to-(?P<number>\d+)")
_PENDING = "pending-"


def create_table(spark: SparkSession, table: str) -> None:
    """Drop ``table`` if it exists and create it empty.

    Rows are partitioned by event day and by the batch that wrote them. An overwrite replaces
    only the partitions it writes to, which makes a repeated batch harmless.
    """
    columns = ", ".join(
        f"{field.name} {field.dataType.simpleString()}{'' if field.nullable else ' NOT NULL'}"
        for field in FACT.fields
    )
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(
        f"CREATE TABLE {table} ({columns}, {PARTITION_DAY} DATE, {PARTITION_BATCH} STRING) "
        "USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
        f"PARTITIONED BY ({PARTITION_DAY}, {PARTITION_BATCH})"
    )


def _laid_out(interactions: DataFrame, batch: str) -> DataFrame:
    """Columns in table order, grouped by day and sorted for row-group pruning.

    ``rebalance`` gathers a day's rows into files of the advised size and splits a day that holds
    most of the rows. That takes adaptive execution; without it the rows are written by the tasks
    that hold them.
    """
    rows = interactions.select(
        *(F.col(field.name).cast(field.dataType) for field in FACT.fields),
        F.to_date("TWEET_TIMESTAMP").alias(PARTITION_DAY),
        F.lit(batch).alias(PARTITION_BATCH),
    )
    if interactions.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        rows = rows.hint("rebalance", PARTITION_DAY)
    return rows.sortWithinPartitions(PARTITION_DAY, "TWEET_TIMESTAMP", "TARGET")


def append(interactions: DataFrame, table: str, batch: str = "direct") -> None:
    """Add rows; nothing is checked for uniqueness."""
    _laid_out(interactions, batch).write.insertInto(table)


def write_batch(interactions: DataFrame, table: str, batch: str) -> None:
    """Write the rows of one named batch; writing the same batch again replaces its rows."""
    _laid_out(interactions, batch).write.insertInto(table, overwrite=True)


def read_facts(spark: SparkSession, table: str) -> DataFrame:
    """The stored rows with their ``event_date``, which time bounds prune on."""
    shown = ~F.startswith(PARTITION_BATCH, F.lit(_PENDING))
    return spark.table(table).where(shown).drop(PARTITION_BATCH)


def compact(spark: SparkSession, table: str) -> int:
    """Merge the closed batches of each day and run into one partition; returns how many went.

    The last batch of a run is left alone, since it is the only one that can be written again; a batch
    is closed once a later one of its run is there. The merged rows are first written beside the
    others under a name that readers skip; then the merged batches are dropped and the name is
    changed. A compaction that broke off is brought to its end by the next one: a partition
    is entered in the catalog only when all of it is written. Readers miss a day's merged rows
    between those last two statements. One compaction may run at a time.
    """
    gone = 0
    days = _batches(spark, table)
    if broken := _batches(spark, table, pending=True):
        for (day, run), numbers in broken.items():
            gone += _swap(spark, table, day, run, max(numbers), days)
        days = _batches(spark, table)
    newest: dict[str, int] = {}
    for (_, run), numbers in days.items():
        newest[run] = max(newest.get(run, -1), *(n for n, name in numbers.items() if _NUMBERED.fullmatch(name)), -1)
    # Days that merge the same batches are written by one job.
    alike: dict[tuple[str, int, tuple[str, ...]], list[str]] = defaultdict(list)
    for (day, run), numbers in days.items():
        closed = {n: name for n, name in numbers.items() if n < newest[run] or _MERGED.fullmatch(name)}
        if len(closed) > 1:
            alike[run, max(closed), tuple(sorted(closed.values()))].append(day)
    for (run, last, names), together in alike.items():
        for start in range(0, len(together), _DAYS_PER_WRITE):
            part = together[start : start + _DAYS_PER_WRITE]
            rows = spark.table(table).where(
                F.col(PARTITION_DAY).isin([datetime.date.fromisoformat(day) for day in part])
                & F.col(PARTITION_BATCH).isin(list(names))
            )
            write_batch(rows, table, f"{_PENDING}{run}-to-{last}")
            listed = _batches(spark, table)
            gone += sum(_swap(spark, table, day, run, last, listed) for day in part)
    return gone


def _batches(spark: SparkSession, table: str, pending: bool = False) -> dict[tuple[str, str], dict[int, str]]:
    """Partition names by day and run, under the number of their (last) batch.

    After a compaction each day has a few for each run, so their number stays bounded by the
    batches since the last one.
    """
    found: dict[tuple[str, str], dict[int, str]] = defaultdict(dict)
    for day, name in _partitions(spark, table):
        if name.startswith(_PENDING) != pending:
            continue
        name = name.removeprefix(_PENDING)
        if match := _MERGED.fullmatch(name) or _NUMBERED.fullmatch(name):
            found[day, match["run"]][int(match["number"])] = name
    return found


def _partitions(spark: SparkSession, table: str) -> Iterator[tuple[str, str]]:
    for row in spark.sql(f"SHOW PARTITIONS {table}").toLocalIterator():
        spec = dict(_spec(row["partition"]))
        yield spec[PARTITION_DAY], spec[PARTITION_BATCH]


def _swap(
    spark: SparkSession, table: str, day: str, run: str, last: int, listed: dict[tuple[str, str], dict[int, str]]
) -> int:
    """Drop what a pending partition replaces of those ``listed``, then give it its name."""
    replaced = [name for n, name in listed.get((day, run), {}).items() if n <= last]
    names = [f"{PARTITION_DAY}={day}/{PARTITION_BATCH}={name}" for name in replaced]
    for start in range(0, len(names), _DROPS_PER_STATEMENT):
        _drop(spark, table, names[start : start + _DROPS_PER_STATEMENT])
    merged = f"{run}-to-{last}"
    spark.sql(
        f"ALTER TABLE {table} PARTITION ({PARTITION_DAY}='{day}', {PARTITION_BATCH}='{_PENDING}{merged}') "
        f"RENAME TO PARTITION ({PARTITION_DAY}='{day}', {PARTITION_BATCH}='{merged}')"
    )
    return len(names)


def kept_rows(
    facts: DataFrame,
    as_of: AsOf = None,
    days: int = RETENTION_DAYS,
    moment: str = "TWEET_TIMESTAMP",
) -> DataFrame:
    """Rows of the current day and the ``days`` days before it."""
    first_day = days_before(as_of, days).cast(facts.schema[moment].dataType)
    kept = F.col(moment) >= first_day
    if PARTITION_DAY in facts.columns:
        kept = kept & (F.col(PARTITION_DAY) >= days_before(as_of, days))
    return facts.where(kept)


def drop_expired(
    spark: SparkSession, table: str, as_of: AsOf = None, days: int = RETENTION_DAYS
) -> int:
    """Drop whole partitions older than the retention; returns how many.

    Partition names come to the driver a bounded number at a time. Each is dropped by its full
    specification, which every catalog understands.
    """
    day = F.regexp_extract("partition", f"{PARTITION_DAY}=([0-9-]+)", 1)
    names = spark.sql(f"SHOW PARTITIONS {table}").where(F.try_to_date(day) < days_before(as_of, days))
    dropped, part = 0, []
    for row in names.toLocalIterator():
        part.append(row["partition"])
        if len(part) == _DROPS_PER_STATEMENT:
            dropped += _drop(spark, table, part)
            part = []
    return dropped + _drop(spark, table, part)


def _drop(spark: SparkSession, table: str, partitions: list[str]) -> int:
    clauses = ", ".join(
        "PARTITION (" + ", ".join(f"{k}='{v}'" for k, v in _spec(name)) + ")" for name in partitions
    )
    if clauses:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {clauses}")
    return len(partitions)


def _spec(partition: str) -> list[tuple[str, str]]:
    return [tuple(part.split("=", 1)) for part in partition.split("/")]


def as_export(facts: DataFrame) -> DataFrame:
    """Timestamps as text, for consumers without a timestamp type."""
    return facts.withColumns(
        {
            field.name: export_time(F.col(field.name))
            for field in facts.schema.fields
            if field.dataType.typeName().startswith("timestamp")
        }
    )
