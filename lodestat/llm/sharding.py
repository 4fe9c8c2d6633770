"""Sharding over fixed virtual slots, DataFrame functions only.

Records are hashed by ``doc_id`` and text into ``SLOTS`` virtual slots, bytes and rows are summed per slot, and a
versioned table maps slots to shards. Rebalancing edits that table: version 0 deals the slots in turn, and
each later version differs from the one before by the slots that moved. What reaches the driver is one row
per virtual slot, whatever the number of records.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestat.llm.stored import stored, whole_text

SLOTS = 4096


def virtual_slot(column: str = "doc_id", slots: int = SLOTS, text: str = "text") -> Column:
    """Slot of a record, by its key and its text, so that a NULL or repeated key does not fill one slot."""
    return F.pmod(F.xxhash64(F.col(column), whole_text(text)), F.lit(slots)).cast("int")


def text_size(column: str = "text") -> Column:
    """UTF-8 bytes of the text (NULL: none) plus one."""
    return (F.octet_length(whole_text(column)) + F.lit(1)).cast("bigint")


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, n) of the slots that hold records."""
    return (
        records.select(virtual_slot(slots=slots).alias("virtual_slot"), text_size().alias("size"))
        .groupBy("virtual_slot")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    )


def map_table(spark: SparkSession, versions: list[list[int]]) -> DataFrame:
    """(version, virtual_slot, shard): the versions of a map as one table, one row per slot and version."""
    text = json.dumps(versions)
    maps = F.from_json(F.lit(text), "array<array<int>>")
    return (
        spark.range(1)
        .select(F.posexplode(maps).alias("version", "shards"))
        .select("version", F.posexplode("shards").alias("virtual_slot", "shard"))
    )


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt in turn."""
    return [slot % shards for slot in range(slots)]


def rebalanced(shard_of: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """The next version: slots move, one at a time, from the fullest shard to the emptiest.

    The slot moved is the one whose size is nearest to half the gap, so that each move narrows it. A shard
    that one large slot fills is passed over. The edit ends when no move helps; ties go to the smaller number.
    """
    shard_of = list(shard_of)
    held: list[dict[int, int]] = [{} for _ in range(shards)]
    for slot, size in sizes.items():
        held[shard_of[slot]][slot] = size
    load = [sum(h.values()) for h in held]
    while True:
        empty = min(range(shards), key=lambda s: (load[s], s))
        for full in sorted(range(shards), key=lambda s: (-load[s], s)):
            gap = load[full] - load[empty]
            movable = [(abs(2 * size - gap), slot) for slot, size in held[full].items() if 0 < size < gap]
            if movable:
                break
        else:
            return shard_of
        slot = min(movable)[1]
        size = held[full].pop(slot)
        held[empty][slot] = size
        load[full] -= size
        load[empty] += size
        shard_of[slot] = empty


def grown(shard_of: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """A version with one shard more, which takes its fair share of bytes; no other slot moves."""
    shard_of = list(shard_of)
    load = [0] * shards
    for slot, size in sizes.items():
        load[shard_of[slot]] += size
    fair = sum(load) / (shards + 1)
    taken = 0
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if taken + size <= fair and load[shard_of[slot]] - size >= fair - size:
            load[shard_of[slot]] -= size
            taken += size
            shard_of[slot] = shards
    return shard_of


def balanced_versions(records: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(sizes, map): the slots' sizes and both versions of the map, as tables."""
    sizes = stored(slot_sizes(records, slots))
    weights = {r.virtual_slot: r.bytes for r in sizes.collect()}  # one row per virtual slot
    start = first_map(shards, slots)
    return sizes, map_table(records.sparkSession, [start, rebalanced(start, weights, shards)])


def shard_documents(records: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of every record.

    The law is ``bytes``: shard sizes are near equal. ``slot`` is the place of the record in its shard,
    without gaps: the rows of the shard's earlier virtual slots, then the rank by ``doc_id``, size and
    checksum in its own. A NULL text counts one byte and has the checksum of an empty text; rows
    without ``doc_id`` are spread by their texts; repeated rows all have places of their own; an empty table gives no
    rows. ``grown_shard`` belongs to another law and is NULL.
    """
    sizes, versions = balanced_versions(records, shards, slots)
    current = versions.where(F.col("version") == 1)
    places = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        current.join(sizes, "virtual_slot")
        .withColumn("before", F.coalesce(F.sum("n").over(places), F.lit(0)))
        .select("virtual_slot", "shard", "before", F.col("version").alias("map_version"))
    )
    rank = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    return (
        records.select(
            "doc_id",
            text_size().alias("size"),
            F.crc32(whole_text()).alias("text_crc32"),
            virtual_slot(slots=slots).alias("virtual_slot"),
        )
        .withColumn("rank", F.row_number().over(rank))
        .join(F.broadcast(offsets), "virtual_slot")  # one row per virtual slot
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("rank") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            "map_version",
        )
    )
