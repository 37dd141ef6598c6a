"""Sharding over fixed virtual slots.

Every record hashes into one of a fixed number of slots. Bytes and rows are summed per slot, and a
versioned map from slots to shards is planned from those sums: version 0 deals the slots round-robin,
and each later version is the one before with a few entries edited, so that a rebalancing moves only
the slots it names. The map has as many rows as there are slots, whatever the size of the corpus; it
is stored in the shared folder under its version.

Texts are read for their size and checksum and are never shuffled. Places within a shard come from the
rows before each slot and a row number within the slot, so no task holds a whole shard. Rows hash by
id and text: only byte-equal rows must share a slot.

A null text has no bytes and only the fixed overhead; a null id hashes like any other value. Equal rows
get neighbouring places. Empty tables give an empty result and the map of version 0. Extra columns of
``documents`` are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echometer.llm import common
from echometer.session import scratch_path

SLOTS = 8192
SHARDS = 40
#: Bytes of a record besides its text.
OVERHEAD = 16

MAP_SCHEMA = "virtual_slot int, shard int"


def slotted(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32`` and ``virtual_slot`` of every record."""
    data = F.coalesce(common.plain(text), F.lit("")).cast("binary")
    records = docs.select(
        common.plain(key).alias("doc_id"),
        (F.octet_length(data) + OVERHEAD).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    return records.withColumn(
        "virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int")
    )


def slot_sums(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(slots: int, shards: int) -> dict[int, int]:
    """Version 0: slots dealt round-robin."""
    return {slot: slot % shards for slot in range(slots)}


def rebalanced(slot_map: dict[int, int], weights: dict[int, int], shards: int) -> dict[int, int]:
    """The next version: slots change places between the heaviest and the lightest shard.

    Each edit moves a slot of the heaviest shard, or exchanges it for a slot of the lightest, so that
    the difference of the two comes closest to zero; the rest of the map stays. A shard that no edit
    helps, as one slot outweighs the others, is passed over for the next heaviest. It ends when no edit
    makes any shard and the lightest more equal. ``shards`` may exceed those of the former map.
    """
    edited = dict(slot_map)
    held: list[list[tuple[int, int]]] = [[(0, -1)] for _ in range(shards)]
    for slot, shard in slot_map.items():
        if weights.get(slot, 0):
            held[shard].append((weights[slot], slot))
    for slots in held:
        slots.sort()
    loads = [sum(w for w, _ in slots) for slots in held]
    while True:
        light = min(range(shards), key=loads.__getitem__)
        for heavy in sorted(range(shards), key=lambda shard: -loads[shard]):
            edit = _best_exchange(held[heavy], held[light], loads[heavy] - loads[light])
            if edit is not None:
                break
        else:
            return edited
        given, taken = edit
        for (weight, slot), source, target in ((given, heavy, light), (taken, light, heavy)):
            if slot >= 0:
                held[source].remove((weight, slot))
                bisect.insort(held[target], (weight, slot))
                loads[source] -= weight
                loads[target] += weight
                edited[slot] = target


def _best_exchange(
    heavy: list[tuple[int, int]], light: list[tuple[int, int]], gap: int
) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """What to give and to take so that the gap shrinks most; slot -1 of weight 0 stands for nothing."""
    best, edit = gap, None
    for given in heavy:
        # Shifting gap / 2 makes the two equal.
        at = bisect.bisect_left(light, (given[0] - gap / 2, -1))
        for taken in light[max(0, at - 1) : at + 1]:
            left = abs(gap - 2 * (given[0] - taken[0]))
            if left < best:
                best, edit = left, (given, taken)
    return edit


def store_map(spark: SparkSession, slot_map: dict[int, int], version: int, folder: str) -> DataFrame:
    """Write one version of the map and read it back."""
    path = f"{folder}/version={version}"
    rows = spark.createDataFrame(sorted(slot_map.items()), MAP_SCHEMA)
    rows.coalesce(1).write.parquet(path)
    return spark.read.schema(MAP_SCHEMA).parquet(path)


def weights_of(sums: DataFrame) -> dict[int, int]:
    """Bytes per slot; one row per slot at most."""
    return {row.virtual_slot: row.bytes for row in sums.collect()}


def placed(records: DataFrame, sums: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with ``shard`` and ``slot``, their gapless place in it."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slot_map.join(sums.select("virtual_slot", "rows"), "virtual_slot")
        .withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .select("virtual_slot", "shard", "before")
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    # The map holds one row per slot, a fixed number.
    return records.join(F.broadcast(offsets), "virtual_slot").withColumn(
        "slot", (F.row_number().over(within) - 1 + F.col("before")).cast("long")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = slotted(common.documents(spark, sf_dir, "doc_id", "text"))
    sums = common.stored(slot_sums(records).coalesce(1), "slot-sums")
    folder = scratch_path(spark, "slot-map")
    start = first_map(SLOTS, SHARDS)
    store_map(spark, start, 0, folder)
    current = store_map(spark, rebalanced(start, weights_of(sums), SHARDS), 1, folder)
    return placed(records, sums, current).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(1).alias("map_version"),
    )
