"""Queries that apply the operators to the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import values
from millrace.operators import frames
from millrace.plans import reports


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame, order: list[str], bucket, name: str = "idx") -> DataFrame:
    """Numbers rows from 0 in their order; bucket ascends with the order and bounds what one task sorts."""
    within = F.row_number().over(W.partitionBy("__bucket").orderBy(*order)) - 1
    cut = rows.withColumn("__bucket", bucket)
    sizes = cut.groupBy("__bucket").count().withColumn("__before", F.coalesce(F.sum("count").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__bucket", "__before")
    return cut.join(sizes, "__bucket").withColumn(name, (within + F.col("__before")).cast("bigint")).drop("__bucket", "__before")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as one demo's commands, four to a tick."""
    events = table(spark, sf_dir, "events")
    rows = numbered(events, ["ts", "event_id"], F.date_trunc("hour", F.col("ts")))
    n = events.agg(F.count(F.lit(1)).alias("n"))
    kind = (
        F.when(F.col("idx") == F.col("n") - 20, 0).when(F.col("idx").isin(50, 500), 3).when(F.col("event_type") == "signup", 13).when(F.col("event_type") == "view", 7)
        .when(F.col("event_type") == "click", 12).when(F.col("event_type") == "purchase", 15).otherwise(9)
    )
    rows = rows.crossJoin(F.broadcast(n))  # one row: the count
    return rows.select(F.lit(0).alias("demo_id"), "idx", "event_id", "ts", "user_id", "event_type", "value", "props", F.floor(F.col("idx") / 4).cast("int").alias("tick"), kind.alias("cmd"), F.octet_length("props").cast("bigint").alias("body_size"))


def _played(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.playback(commands(spark, sf_dir))


def _entity_state(s: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "L").when(F.col("event_type") == "signup", "D").otherwise("U")
    return frames.lifecycle(table(s, d, "events").withColumn("op", op), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "st")


def _baseline_overlay(s: SparkSession, d: str) -> DataFrame:
    changed = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return frames.overlay(table(s, d, "customer"), changed, "c_custkey", F.col("top"), F.col("c_nationkey").cast("double")).select("c_custkey", "v", "from_baseline")


def _snapshot_merge(s: SparkSession, d: str) -> DataFrame:
    old, new = table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels").select("doc_id", "quality")
    return old.join(new, "doc_id", "left").select(F.col("doc_id").alias("entry"), F.coalesce("lang", F.lit("none")).alias("k"), F.coalesce("quality", F.lit(-1)).alias("v"))


def _class_filter(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    wanted = part.join(F.broadcast(part.agg(F.min("p_brand").alias("p_brand"))), "p_brand", "left_semi").select(F.col("p_partkey").alias("l_partkey"))
    return table(s, d, "lineitem").join(wanted, "l_partkey", "left_semi").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("l_linenumber").cast("bigint")).alias("s"))


def _handle_lookup(s: SparkSession, d: str) -> DataFrame:
    slots = table(s, d, "events").select("event_id", values.handle_index(F.col("user_id") * 16384 + F.col("user_id")).alias("slot"))
    names = table(s, d, "customer").select(F.col("c_custkey").alias("slot"), "c_name")
    return slots.join(names, "slot").select("event_id", "slot", "c_name")


def _zigzag(s: SparkSession, d: str) -> DataFrame:
    signed = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).otherwise(-F.col("l_orderkey"))
    return table(s, d, "lineitem").select("l_orderkey", values.zigzag(signed).alias("zz"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "command_counts": lambda s, d: reports.command_counts(commands(s, d)),
    "inspect_summary": lambda s, d: reports.summary(commands(s, d)),
    "playback_tick_range": lambda s, d: reports.tick_range(_played(s, d)),
    "adjacent_distinct_ticks": lambda s, d: frames.tick_starts(_played(s, d)).select("tick"),
    "keyframes": lambda s, d: frames.keyframes(_played(s, d)).select("idx", "tick"),
    "seek_asof": lambda s, d: frames.seek_asof(_played(s, d)).select("tick", F.col("keyframe").alias("kf")),
    "segment_plan_8": lambda s, d: frames.segment_plan(_played(s, d), 8).drop("demo_id"),
    "tick_changes": lambda s, d: reports.tick_changes(_played(s, d), "user_id", (7, 12)),
    "entity_state": _entity_state,
    "field_overlay": lambda s, d: frames.latest(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"]),
    "baseline_overlay": _baseline_overlay,
    "string_table_upsert": lambda s, d: table(s, d, "events").groupBy((F.col("user_id") % 64).alias("entry")).agg(F.count(F.lit(1)).alias("writes"), F.max("event_id").alias("last_event")),
    "snapshot_merge": _snapshot_merge,
    "class_filter_semi": _class_filter,
    "handle_lookup": _handle_lookup,
    "cell_to_world": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", values.cell_to_world(F.col("l_linenumber"), F.col("l_quantity")).alias("w")),
    "dequantize_12": lambda s, d: table(s, d, "part").select("p_partkey", values.dequantize(F.col("p_partkey") % 4096, 12, 0.0, 100.0).alias("q")),
    "bitangle_20": lambda s, d: table(s, d, "events").select("event_id", values.bit_angle(F.col("event_id") * 7919 % 1048576, 20).alias("a")),
    "uvarint_len": lambda s, d: table(s, d, "lineitem").groupBy(values.uvarint_length(F.col("l_orderkey")).alias("len")).agg(F.count(F.lit(1)).alias("c")),
    "zigzag": _zigzag,
    "class_bits": lambda s, d: table(s, d, "part").agg(values.class_bits(F.max("p_partkey")).alias("bits")),
    "limit_violations": lambda s, d: table(s, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("nbytes")).filter("nbytes > 2000"),
    "last_definition_wins": lambda s, d: table(s, d, "part").groupBy("p_name").agg(F.max("p_partkey").alias("p_partkey")),
}

CMDS = """
with b as (select *, row_number() over (order by ts, event_id) - 1 as idx, count(*) over () as n from events),
cmds as (select cast(idx as bigint) as idx, event_id, user_id, cast(idx // 4 as int) as tick, cast(octet_length(encode(props)) as bigint) as body_size,
  case when idx = n - 20 then 0 when idx in (50, 500) then 3 when event_type = 'signup' then 13 when event_type = 'view' then 7 when event_type = 'click' then 12 when event_type = 'purchase' then 15 else 9 end as cmd from b),
g as (select *, coalesce(max(case when cmd = 3 then 1 else 0 end) over (order by idx rows between unbounded preceding and 1 preceding), 0) as past_sync,
  max(case when cmd = 0 then 1 else 0 end) over (order by idx rows between unbounded preceding and current row) as stopped from cmds),
x as (select * from g where past_sync = 1 and stopped = 0 and cmd <> 3)
"""

ORACLES: dict[str, str] = {
    "command_counts": CMDS + "select cmd, count(*) as c, cast(sum(body_size) as bigint) as bytes from cmds group by cmd",
    "inspect_summary": CMDS + "select count(*) as commands, min(tick) as first_tick, max(tick) as last_tick, count(distinct tick) as distinct_ticks, min(case when cmd = 0 then idx end) as first_stop, cast(sum(case when cmd = 3 then 1 else 0 end) as bigint) as syncs from cmds",
    "playback_tick_range": CMDS + "select min(tick) as f, max(tick) as l, count(distinct tick) as n from x",
    "adjacent_distinct_ticks": CMDS + "select tick from (select tick, lag(tick) over (order by idx) as p from x) where p is null or p <> tick",
    "keyframes": CMDS + "select idx, tick from x where cmd = 13",
    "seek_asof": CMDS + ", k as (select idx, tick from x where cmd = 13), t as (select distinct tick from x) select t.tick, max(k.idx) as kf from t left join k on k.tick <= t.tick group by t.tick",
    "segment_plan_8": CMDS + ", k as (select idx, tick, row_number() over (order by idx) - 1 as rn, count(*) over () as m from x where cmd = 13), p as (select coalesce(max(m), 0) + 1 as n, least(8, coalesce(max(m), 0) + 1) as c from k), s as (select i, n, c from p, range(8) r(i) where i < c) select cast(s.i as int) as seg, a.idx as start_idx, cast(case when s.i = s.c - 1 then 2147483647 else b.tick end as int) as end_tick from s left join k a on s.i > 0 and a.rn = s.i * s.n // s.c - 1 left join k b on b.rn = (s.i + 1) * s.n // s.c - 1",
    "tick_changes": CMDS + "select tick, count(*) as updates, count(distinct user_id) as ents from x where cmd in (7, 12) group by tick",
    "entity_state": "with e as (select *, case event_type when 'error' then 'L' when 'signup' then 'D' else 'U' end as op from events), i as (select *, sum(case when op = 'U' then 1 else 0 end) over (partition by user_id order by ts, event_id) as isl from e) select event_id, user_id, case when isl = 0 then 'absent' when op = 'U' then 'active' when first_value(op) over (partition by user_id, isl, case when op = 'U' then 1 else 0 end order by ts, event_id) = 'L' then 'dormant' else 'absent' end as st from i",
    "field_overlay": "select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1",
    "baseline_overlay": "select c_custkey, coalesce(v, cast(c_nationkey as double)) as v, v is null as from_baseline from customer left join (select o_custkey, max(o_totalprice) as v from orders group by o_custkey) on c_custkey = o_custkey",
    "string_table_upsert": "select user_id % 64 as entry, count(*) as writes, max(event_id) as last_event from events group by user_id % 64",
    "snapshot_merge": "select d.doc_id as entry, coalesce(lang, 'none') as k, coalesce(quality, -1) as v from documents d left join labels b on b.doc_id = d.doc_id",
    "class_filter_semi": "select count(*) as c, cast(sum(l_linenumber) as bigint) as s from lineitem where l_partkey in (select p_partkey from part where p_brand = (select min(p_brand) from part))",
    "handle_lookup": "select event_id, (user_id * 16384 + user_id) & 16383 as slot, c_name from events join customer on c_custkey = ((user_id * 16384 + user_id) & 16383)",
    "cell_to_world": "select l_orderkey, l_linenumber, cast(cast(l_linenumber as float) * cast(512 as float) - cast(16384 as float) + cast(l_quantity as float) as float) as w from lineitem",
    "dequantize_12": "select p_partkey, cast(cast(0 as float) + cast(100 as float) * (cast(p_partkey % 4096 as float) * cast(cast(1 as float) / cast(4095 as float) as float)) as float) as q from part",
    "bitangle_20": "select event_id, cast(cast(event_id * 7919 % 1048576 as float) * cast(360 as float) / cast(1048576 as float) - cast(180 as float) as float) as a from events",
    "uvarint_len": "select case when l_orderkey < 128 then 1 when l_orderkey < 16384 then 2 when l_orderkey < 2097152 then 3 else 4 end as len, count(*) as c from lineitem group by 1",
    "zigzag": "select l_orderkey, case when v >= 0 then v * 2 else -v * 2 - 1 end as zz from (select l_orderkey, case when l_linenumber % 2 = 0 then l_orderkey else -l_orderkey end as v from lineitem)",
    "class_bits": "select greatest(1, cast(floor(log2(max(p_partkey))) + 1 as int)) as bits from part",
    "limit_violations": "select doc_id, cast(octet_length(encode(text)) as bigint) as nbytes from documents where octet_length(encode(text)) > 2000",
    "last_definition_wins": "select p_name, max(p_partkey) as p_partkey from part group by p_name",
}
