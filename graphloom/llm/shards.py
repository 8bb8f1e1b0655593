"""Sharding over fixed virtual slots.

Every record hashes to one of a few thousand slots and stays there for good. Bytes and rows are
aggregated per slot, and a versioned table maps slots to shards: version 1 packs slots by size,
a later version is the former one with the edits of a rebalancing. Only the table, of as many rows
as there are slots, is ever broadcast or brought to the driver.

Defined results: a null text counts no bytes; the size of a row is its bytes plus ``overhead``;
equal rows land in one slot; null ids hash like a value of their own; an empty table gives an empty
result and an evenly dealt map.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.shared import shared_folder, whole

SLOTS = 8192
MAP_SCHEMA = "version int, v_slot int, shard int, n_bytes bigint, n_rows bigint, base bigint"


def with_slots(docs: DataFrame, id_col="doc_id", text_col="text", slots=SLOTS, overhead=8) -> DataFrame:
    """Id, size, content crc and virtual slot of every row."""
    text = whole(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(id_col, text), F.lit(slots)).cast("int").alias("v_slot"),
    )


def slot_sizes(placed: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use: at most as many rows as there are slots."""
    return [tuple(r) for r in placed.groupBy("v_slot").agg(F.sum("size"), F.count(F.lit(1))).collect()]


def packed(sizes: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """First map: largest slots first, each to the shard with the fewest bytes."""
    known = {s: (b, n) for s, b, n in sizes}
    heap = [(0, 0, k) for k in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-known.get(s, (0, 0))[0], s)):
        total, many, shard = heap[0]
        heapq.heapreplace(heap, (total + known.get(slot, (0, 0))[0], many + 1, shard))
        out[slot] = shard
    return out


def rebalanced(current: dict[int, int], sizes: list[tuple[int, int, int]], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """Edit of a map for new sizes or another number of shards: slots of shards that are gone, then slots of
    overfull shards, move one by one to the emptiest shard until each is within ``tolerance`` of the mean."""
    known = {s: b for s, b, _ in sizes}
    out, load = dict(current), dict.fromkeys(range(shards), 0)
    homeless = [s for s, k in out.items() if k >= shards]
    for s, k in out.items():
        if k < shards:
            load[k] += known.get(s, 0)
    mean = sum(known.values()) / shards
    for k in load:
        held = sorted((s for s, x in out.items() if x == k), key=lambda s: (known.get(s, 0), s))
        while load[k] > mean * (1 + tolerance) and held:
            s = held.pop()
            if load[k] - known.get(s, 0) < mean * (1 - tolerance) and held:
                continue
            load[k] -= known.get(s, 0)
            homeless.append(s)
    for s in sorted(homeless, key=lambda s: (-known.get(s, 0), s)):
        k = min(load, key=lambda x: (load[x], x))
        out[s], load[k] = k, load[k] + known.get(s, 0)
    return out


def store_map(spark: SparkSession, path: str, version: int, mapping: dict[int, int], sizes: list[tuple[int, int, int]]) -> None:
    """Append one version; ``base`` is the number of rows in lower slots of the same shard."""
    known, seen, rows = {s: (b, n) for s, b, n in sizes}, {}, []
    for slot, shard in sorted(mapping.items()):
        size, many = known.get(slot, (0, 0))
        rows.append((version, slot, shard, size, many, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + many
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, by default the latest."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version)


def assign(placed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Shard of every row and its gapless position in the shard, counted slot by slot so that no task holds a whole shard."""
    rank = F.row_number().over(W.partitionBy("v_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        placed.withColumn("_at", rank)
        .join(F.broadcast(mapping.select("v_slot", "shard", "base")), "v_slot")
        .withColumn("slot", (F.col("base") + F.col("_at")).cast("long"))
        .drop("_at", "base")
    )


def shard(docs: DataFrame, shards: int, id_col="doc_id", text_col="text", slots=SLOTS, map_path: str | None = None) -> DataFrame:
    """Deal all rows to ``shards`` shards of near equal bytes; the map goes to ``map_path`` as version 1."""
    spark = docs.sparkSession
    path = map_path or shared_folder(spark, "slot-map")
    placed = with_slots(docs, id_col, text_col, slots)
    sizes = slot_sizes(placed)
    store_map(spark, path, 1, packed(sizes, shards, slots), sizes)
    return assign(placed, read_map(spark, path, 1))


def rebalance(docs: DataFrame, map_path: str, shards: int, id_col="doc_id", text_col="text", tolerance=0.01) -> DataFrame:
    """Deal all rows by the stored map, edited for their sizes now and for ``shards`` shards; the edit is stored as the next version.

    The slots stay as they are, so only rows of slots that the edit moves change their shard."""
    spark = docs.sparkSession
    version = read_map(spark, map_path).agg(F.max("version")).first()[0]
    current = {r["v_slot"]: r["shard"] for r in read_map(spark, map_path, version).collect()}
    placed = with_slots(docs, id_col, text_col, len(current))
    sizes = slot_sizes(placed)
    store_map(spark, map_path, version + 1, rebalanced(current, sizes, shards, tolerance), sizes)
    return assign(placed, read_map(spark, map_path, version + 1))
