"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots; a slot is the unit that is weighed, assigned and moved. The map from
slots to shards is a small versioned table, so shards are rebalanced by editing that map: no record is hashed again and only the
records of moved slots travel.

Each record's virtual slot comes from its id and the hash of its text, so equal rows share a slot and a null id does not gather rows.
The number of slots is a parameter, which bounds everything that reaches the driver: one row of weights for each slot.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS = 8192


def virtual_slot(id_col: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(id_col, F.xxhash64(F.coalesce(text, F.lit("")))), F.lit(slots)).cast("int")


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def slot_weights(records: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot in use, from records(vslot, size)."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def assign(weights: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """A first map: heaviest slot first, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), shard))
    return out


def rebalance(current: list[int], weights: dict[int, int], shards: int) -> list[int]:
    """The next version of a map: slots leave shards that are gone or above the mean, for the lightest shard.

    From each overfull shard the smallest slots that are needed go first, so few bytes move. A slot stays if no move brings the two
    shards closer together.
    """
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(current):
        if shard < shards:
            load[shard] += weights.get(slot, 0)
            held[shard].append((weights.get(slot, 0), slot))
        else:
            homeless.append((weights.get(slot, 0), slot))
    out = list(current)
    mean = sum(weights.values()) / shards
    for shard in range(shards):
        held[shard].sort()
        for weight, slot in held[shard]:
            if load[shard] - weight < mean:
                break
            homeless.append((weight, slot))
            load[shard] -= weight
    heap = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(heap)
    for weight, slot in sorted(homeless, key=lambda x: (-x[0], x[1])):
        x, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (x + weight, shard))
    return out


def map_table(spark: SparkSession, versions: list[list[int]]) -> DataFrame:
    """All versions of a map as rows (version, vslot, shard), ready to be written as a table."""
    out = None
    for version, shards in enumerate(versions):
        one = spark.range(1).select(F.lit(version).alias("version"), F.posexplode(F.split(F.lit(",".join(map(str, shards))), ",")).alias("vslot", "s"))
        one = one.select("version", "vslot", F.col("s").cast("int").alias("shard"))
        out = one if out is None else out.unionAll(one)
    return out


def latest(table: DataFrame) -> DataFrame:
    """The newest version of a stored map."""
    return table.groupBy("vslot").agg(F.max_by("shard", "version").alias("shard"))


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", store: str | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, vslot) for every row of docs.

    Law `bytes`: shards are near equal in bytes; grown_shard is null, as the map and not the id alone decides. slot numbers the rows of a
    shard from 0 without gaps: virtual slots in order, and within one by id and checksum. A null text counts as an empty one, repeated
    rows each get a slot, an empty table gives none, and other columns are left alone.
    If store is given, the map is written there as version 0.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = docs.select(F.col(id_col).alias("id"), record_bytes(F.col(text_col)).alias("size"), F.crc32(text).alias("text_crc32"), virtual_slot(F.col(id_col), F.col(text_col), slots).alias("vslot"))
    found = {r["vslot"]: (r["bytes"], r["rows"]) for r in slot_weights(records).collect()}  # one row for each slot at most
    placed = assign({k: v[0] for k, v in found.items()}, shards, slots)
    offsets, filled = [0] * slots, [0] * shards
    for s in range(slots):
        offsets[s] = filled[placed[s]]
        filled[placed[s]] += found.get(s, (0, 0))[1]
    table = map_table(spark, [placed])
    if store:
        table.write.parquet(store)
    starts = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, offsets))), ",")).alias("vslot", "o")).select("vslot", F.col("o").cast("bigint").alias("start"))
    placing = F.broadcast(latest(table).join(starts, "vslot"))  # as many rows as slots, a parameter
    within = F.row_number().over(W.partitionBy("vslot").orderBy("id", "text_crc32", "size")) - 1
    return (
        records.withColumn("nth", within)
        .join(placing, "vslot")
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")
    )
