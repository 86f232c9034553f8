"""Operators on ordered command tables: playback range, keyframes, as-of seek, segments, changes, lifecycle and overlays.

A command table has demo_id, idx (place in the file), tick and cmd. All windows are partitioned by demo_id (or by the keys of state), so work is spread
over files; nothing is ordered over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STOP, SYNC_TICK, PACKET, SIGNON_PACKET, FULL_PACKET = 0, 3, 7, 8, 13
LAST_TICK = 2147483647


def playback(commands: DataFrame) -> DataFrame:
    """Commands after a demo's first sync tick and before its first stop, without sync ticks."""
    bounds = commands.groupBy("demo_id").agg(F.min(F.when(F.col("cmd") == SYNC_TICK, F.col("idx"))).alias("__sync"), F.min(F.when(F.col("cmd") == STOP, F.col("idx"))).alias("__stop"))
    kept = (F.col("idx") > F.col("__sync")) & (F.col("__stop").isNull() | (F.col("idx") < F.col("__stop"))) & (F.col("cmd") != SYNC_TICK)
    return commands.join(bounds, "demo_id").filter(kept).drop("__sync", "__stop")


def tick_starts(commands: DataFrame) -> DataFrame:
    """The first row of every run of equal ticks. Negative ticks are none and do not end a run."""
    before = F.lag("tick").over(W.partitionBy("demo_id").orderBy("idx"))
    return commands.filter("tick >= 0").withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("__before") != F.col("tick"))).drop("__before")


def keyframes(commands: DataFrame) -> DataFrame:
    return commands.filter(F.col("cmd") == FULL_PACKET)


def seek_asof(commands: DataFrame) -> DataFrame:
    """(demo_id, tick, keyframe) for each tick: the last keyframe at or before it, by one ordered pass and no range join."""
    per_tick = commands.groupBy("demo_id", "tick").agg(F.max(F.when(F.col("cmd") == FULL_PACKET, F.col("idx"))).alias("own"))
    upto = W.partitionBy("demo_id").orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    return per_tick.select("demo_id", "tick", F.max("own").over(upto).alias("keyframe"))


def segment_plan(commands: DataFrame, most: int) -> DataFrame:
    """(demo_id, seg, start_idx, end_tick): up to `most` stretches that begin at keyframes, of near equal numbers of keyframes."""
    per = W.partitionBy("demo_id")
    keys = keyframes(commands).select("demo_id", "idx", "tick").withColumn("rn", F.row_number().over(per.orderBy("idx")) - 1).withColumn("n", F.count(F.lit(1)).over(per) + 1)
    plan = commands.select("demo_id").distinct().join(keys.groupBy("demo_id").agg(F.max("n").alias("n")), "demo_id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    plan = plan.withColumn("c", F.least(F.lit(most), F.col("n"))).withColumn("seg", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c").cast("bigint") - 1)))
    edge = lambda i: (F.floor(i * F.col("n") / F.col("c")) - 1).cast("bigint")
    plan = plan.withColumn("a", edge(F.col("seg"))).withColumn("b", edge(F.col("seg") + 1))
    starts = keys.select("demo_id", F.col("rn").alias("a"), F.col("idx").alias("start_idx"))
    ends = keys.select("demo_id", F.col("rn").alias("b"), F.col("tick").alias("end"))
    out = plan.join(starts, ["demo_id", "a"], "left").join(ends, ["demo_id", "b"], "left")
    return out.select("demo_id", F.col("seg").cast("int").alias("seg"), F.when(F.col("seg") > 0, F.col("start_idx")).alias("start_idx"), F.when(F.col("seg") == F.col("c") - 1, LAST_TICK).otherwise(F.col("end")).alias("end_tick"))


def lifecycle(changes: DataFrame, slot: str, order: list[str], op: str = "op") -> DataFrame:
    """Adds st (absent, active, dormant): the state of the slot after each change U (create or update), L (leave) or D (delete).

    Only the first L or D after a U has an effect, so windows over stretches between updates give the state.
    """
    per = W.partitionBy(slot).orderBy(*order)
    u = (F.col(op) == "U").cast("int")
    stretch = changes.withColumn("__stretch", F.sum(u).over(per.rowsBetween(W.unboundedPreceding, 0)))
    first = F.first(op).over(W.partitionBy(slot, "__stretch", u).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    state = F.when(F.col("__stretch") == 0, "absent").when(F.col(op) == "U", "active").when(first == "L", "dormant").otherwise("absent")
    return stretch.withColumn("st", state).drop("__stretch")


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last value of each key, by aggregation, so that each task sends one row for a key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__last")).select(*keys, *(F.col(f"__last.{v}").alias(v) for v in values))


def overlay(base: DataFrame, changes: DataFrame, key: str, value: Column, default: Column) -> DataFrame:
    """Adds v, the change where there is one and else the base's own, and from_baseline."""
    return base.join(changes, key, "left").withColumn("from_baseline", value.isNull()).withColumn("v", F.coalesce(value, default))
