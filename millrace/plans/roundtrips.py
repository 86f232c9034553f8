"""Queries that write the driver's tables as recordings and read them back with the replay engine, and SQL that gives the same rows.

Each user's events are one recording; recordings are made and replayed in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fields, paths, wire
from millrace.functions.bits import BitReader, BitWriter
from millrace.operators import frames, replay
from millrace.plans import reports
from millrace.sources import plain
from millrace.sources import recordings as rec

KINDS = ("click", "error", "purchase", "signup", "view")
#: Command numbers of the kinds where events become commands: two packets, two others, one unknown.
COMMAND_OF = {"click": 7, "error": 9, "purchase": 12, "signup": 13, "view": 63}
SLOTS = 5
TABLE = "props"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("demo_id"), "event_id", "event_type", "value", "props")


def written(rows: DataFrame, write: Callable[[list[dict]], bytes]) -> DataFrame:
    """(demo_id, content): a recording of each demo's events in order of their ids."""

    def each(table: pa.Table) -> pa.Table:
        own = sorted(table.to_pylist(), key=lambda r: r["event_id"])
        return pa.table({"demo_id": [own[0]["demo_id"]], "content": pa.array([write(own)], pa.binary())})

    return rows.groupBy("demo_id").applyInArrow(each, "demo_id string, content binary")


def _body(r: dict) -> bytes:
    return r["event_id"].to_bytes(8, "little") + r["props"].encode()


def as_commands(own: list[dict]) -> bytes:
    """Events as commands: a sync tick first, a stop before the last ten; ticks begin below zero; every third body is compressed."""
    out = [plain.command(3, -1)]
    for i, r in enumerate(own):
        if i == len(own) - 10:
            out.append(plain.command(0, i // 3))
        out.append(plain.command(COMMAND_OF[r["event_type"]], i // 3 - 2, _body(r), r["event_id"] % 3 == 0))
    return plain.recording(out)


def as_packets(own: list[dict]) -> bytes:
    """Four events a packet, each a message."""
    packets = [own[i : i + 4] for i in range(0, len(own), 4)]
    return plain.recording(plain.command(7, i, plain.packet((KINDS.index(r["event_type"]) * 40, _body(r)) for r in p), i % 2 == 1) for i, p in enumerate(packets))


def _signon(fields_of: dict) -> list[bytes]:
    schema, classes = plain.simple_schema(fields_of)
    return [plain.command(4, -1, schema, True), plain.command(5, -1, classes)]


def as_tables(own: list[dict]) -> bytes:
    """A string table: an entry for each event; then, event by event, the data of every fifth is changed and of every seventh the string too."""
    entries = [(i, r["props"].encode(), r["event_type"].encode()) for i, r in enumerate(own)]
    made = plain.message(plain.CREATE_TABLE, pa.compress(plain.table_entries(entries, flags=1), "snappy", asbytes=True), name=TABLE, count=len(entries), flags=1, squeezed=True)
    out = [*_signon({"C": [("a", "bool")]}), plain.command(3, 0), plain.command(7, 1, plain.packet([made]))]
    for i, r in enumerate(own):
        if r["event_id"] % 5 == 0:
            new = (i, b"new" + r["props"].encode() if r["event_id"] % 7 == 0 else None, str(r["event_id"]).encode())
            out.append(plain.command(7, 2 + i, plain.packet([plain.message(plain.UPDATE_TABLE, plain.table_entries([new], flags=1), table=0, count=1)])))
    return plain.recording([*out, plain.command(0, 2 + len(own))])


ENTITY = {"CEvent": [("m_value", "float32"), ("m_id", "uint64"), ("m_kind", "CUtlString"), ("m_signed", "int64")], "COther": [("m_flag", "bool"), ("m_id", "uint64")]}


def _changes(own: list[dict]) -> Iterator[tuple]:
    """(event, slot, op, class): errors put a slot to rest, signups delete it, all else creates or updates it; slots of multiples of three are COther."""
    state: dict[int, str] = {}
    for r in own:
        slot = r["event_id"] % SLOTS
        now = state.get(slot, "absent")
        op = {"error": "leave", "signup": "delete"}.get(r["event_type"], "create" if now == "absent" else "update")
        if op in ("create", "update"):
            state[slot] = "active"
        elif now == "active":
            state[slot] = "dormant" if op == "leave" else "absent"
        yield r, slot, op, int(slot % 3 == 0)


def _values(r: dict, kind: int) -> list[tuple]:
    if kind:
        return [((0,), "bool", r["event_id"] % 2 == 0), ((1,), "uint64", r["event_id"])]
    return [((0,), "float32", r["value"]), ((1,), "uint64", r["event_id"]), ((2,), "CUtlString", r["event_type"]), ((3,), "int64", -r["event_id"])]


def as_entities(own: list[dict]) -> bytes:
    """A tick for each event."""
    return _as_entities(own, False)


def as_effective(own: list[dict]) -> bytes:
    """as_entities() without what has no effect: a filter forgets which of the slots that it leaves out are at rest."""
    return _as_entities(own, True)


def _as_entities(own: list[dict], effective: bool) -> bytes:
    out, live = [*_signon(ENTITY), plain.command(3, 0)], {}
    for i, (r, slot, op, kind) in enumerate(_changes(own)):
        if effective and op in ("leave", "delete") and live.get(slot) not in ("create", "update"):
            continue
        live[slot] = op
        data = plain.entity_changes([(slot, op, kind, _values(r, kind))])
        out.append(plain.command(7, i + 1, plain.packet([plain.message(plain.ENTITIES, data, count=1)]), i % 5 == 0))
    return plain.recording(out)


def as_keyframes(own: list[dict]) -> bytes:
    """A tick for each event, each a new entity in its slot; signups are keyframes, so ticks can be replayed from any of them."""
    out = [*_signon(ENTITY), plain.command(3, 0)]
    for i, r in enumerate(own):
        slot = r["event_id"] % SLOTS
        data = plain.entity_changes([(slot, "create", int(slot % 3 == 0), _values(r, int(slot % 3 == 0)))])
        out.append(plain.command(13 if r["event_type"] == "signup" else 7, i + 1, plain.packet([plain.message(plain.ENTITIES, data, count=1)])))
    return plain.recording([*out, plain.command(0, len(own))])


def _event_of(body: Column) -> tuple[Column, Column]:
    """event_id and props of a body, as columns."""
    number = F.conv(F.hex(F.concat(*(F.substring(body, 8 - i, 1) for i in range(8)))), 16, 10).cast("bigint")
    return number.alias("event_id"), F.substring(body, 9, 1 << 20).cast("string").alias("props")


def rt_commands(s: SparkSession, d: str) -> DataFrame:
    found = rec.commands(written(events(s, d), as_commands), plain.MAGIC).filter("not cmd in (0, 3)")
    return found.select(F.col("demo_id").cast("bigint").alias("demo"), "tick", "cmd", "command_type", "compressed", F.col("decoded_size").alias("size"), *_event_of(F.col("body")))


def rt_messages(s: SparkSession, d: str) -> DataFrame:
    packets = rec.commands(written(events(s, d), as_packets), plain.MAGIC).select("demo_id", "idx", "body")
    return rec.messages(packets).select(F.col("demo_id").cast("bigint").alias("demo"), "idx", "msg", "message_type", "encoded_size", *_event_of(F.col("payload")))


def rt_inspection(s: SparkSession, d: str) -> DataFrame:
    """Reports of the recordings: ranges, first stop, what follows it, unknown commands."""
    return reports.inspection(rec.commands(written(events(s, d), as_commands), plain.MAGIC, bodies=False)).select(
        F.col("demo_id").cast("bigint").alias("demo"), "commands", "first_tick", "last_tick", "distinct_ticks", "playback_first", "playback_last", "playback_ticks", "seek_points", "sync_points", "first_stop_command", "commands_after_stop", "unknown_commands",
    )


def rt_index(s: SparkSession, d: str) -> DataFrame:
    """Keyframes and ticks of the recordings' indexes, numbered."""
    found = replay.indexes(written(events(s, d), as_commands), plain.MAGIC).filter("what <> 'start'")
    return found.groupBy(F.col("demo_id").cast("bigint").alias("demo"), "what", "tick").agg(F.count(F.lit(1)).alias("n"))


def rt_strings(s: SparkSession, d: str) -> DataFrame:
    """The string table after the last tick, from what ticks wrote."""
    found = replay.strings(written(events(s, d), as_tables), plain.MAGIC, plain.PlainAdapter)
    last = frames.latest(found, ["demo_id", "entry"], ["tick"], ["string", "user_data"])
    return last.select(F.col("demo_id").cast("bigint").alias("demo"), "entry", "string", F.col("user_data").cast("string").alias("data"))


def rt_entities(s: SparkSession, d: str) -> DataFrame:
    """What happened to slots: one row for each change that had an effect."""
    found = replay.deltas(written(events(s, d), as_entities), plain.MAGIC, plain.PlainAdapter).filter("key is null")
    return found.select(F.col("demo_id").cast("bigint").alias("demo"), "tick", F.col("entity_index").alias("slot"), "op", "class_name")


def rt_fields(s: SparkSession, d: str) -> DataFrame:
    """The last values of every incarnation's fields."""
    found = fields.latest_fields(replay.deltas(written(events(s, d), as_entities), plain.MAGIC, plain.PlainAdapter))
    wide = found.groupBy("demo_id", "entity_index", "incarnation").agg(*(F.max(F.when(F.col("field_name") == n, F.col(c))).alias(a) for n, c, a in (("m_value", "value.f", "v"), ("m_id", "value.u", "id"), ("m_kind", "value.s", "k"), ("m_signed", "value.i", "neg"), ("m_flag", "value.b", "flag"))))
    return wide.select(F.col("demo_id").cast("bigint").alias("demo"), F.col("entity_index").alias("slot"), F.col("incarnation.tick").alias("born"), "v", F.col("id").cast("bigint").alias("id"), F.col("k").cast("string").alias("k"), "neg", "flag")


def rt_filtered(s: SparkSession, d: str) -> DataFrame:
    """Changes of one class, the other's being passed over."""
    found = replay.deltas(written(events(s, d), as_effective), plain.MAGIC, plain.PlainAdapter, wanted={"COther"})
    return found.filter("key is not null and field_name = 'm_id'").select(F.col("demo_id").cast("bigint").alias("demo"), "tick", F.col("entity_index").alias("slot"), "op", fields.get_i64(F.struct("i", "u")).alias("id"))


def rt_segments(s: SparkSession, d: str) -> DataFrame:
    """Values of recordings replayed in up to six stretches each, one task a stretch."""
    found = replay.segments(written(events(s, d), as_keyframes), plain.MAGIC, plain.PlainAdapter, 6, replay.delta_rows, replay.DELTAS)
    return found.filter("field_name = 'm_id'").select(F.col("demo_id").cast("bigint").alias("demo"), "tick", F.col("entity_index").alias("slot"), F.col("u").cast("bigint").alias("id"))


def rt_seek(s: SparkSession, d: str) -> DataFrame:
    """The entities of every recording at tick 40."""
    found = replay.states_at(written(events(s, d), as_keyframes), plain.MAGIC, plain.PlainAdapter, 40)
    return found.filter("field_name = 'm_id'").select(F.col("demo_id").cast("bigint").alias("demo"), "tick", F.col("entity_index").alias("slot"), "active", F.col("u").cast("bigint").alias("id"))


def _operation_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each operation makes of the path (10, 20, 30) with small operands."""
    give = {"p": lambda w, _: w.ubitvarfp(3), "v": lambda w, kind: w.ubitvar(2 if kind == "N" else 4), "z": lambda w, _: w.svarint(-2)}
    for batch in batches:
        rows = []
        for op in batch.column(0).to_pylist():
            w = BitWriter()
            paths.write_paths(w, [(10, 20, 30)])
            w = BitWriter().bits(int.from_bytes(w.data(), "little"), w.at - paths.BY_OPERATION[paths.FINISH][0])  # without the end
            w.bits(paths.BY_OPERATION[op][1], paths.BY_OPERATION[op][0])
            for kind, _, code in paths.steps(op):
                for _ in range({"E": 2 if op == 35 else 3, "M": 2}.get(kind, 1)):
                    if kind == "E":
                        w.flag(True)
                    if code:
                        w.ubitvarfp(1) if kind == "D" else w.bits(2, int(code[1:])) if code[0] == "b" else give[code](w, kind)
            if op != paths.FINISH:
                w.bits(paths.BY_OPERATION[paths.FINISH][1], paths.BY_OPERATION[paths.FINISH][0])
            rows.append((op, ",".join(map(str, paths.read_paths(BitReader(w.data()))[-1]))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["op", "path"])


def field_path_operations(s: SparkSession, d: str) -> DataFrame:
    return s.range(len(paths.OPERATIONS)).mapInArrow(_operation_paths, "op bigint, path string")


_CODECS = "p_partkey bigint, flag boolean, signed bigint, fixed bigint, coord float, normal float, angle float, centred float, pitch float, quantized float, ammo int, seconds float, text string, blob string, poly boolean, third float, upright float, quaternion float"


def _codecs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's number written in every codec and read again."""
    schema, quantized = rec.arrow_schema(_CODECS), wire.Quantized(8, wire.ROUND_DOWN, 0.0, 10.0)
    codecs = [
        wire.BOOL, wire.I64, wire.FIXED64, wire.COORD, wire.NORMAL, wire.angles(12), wire.precise_angles(True), wire.angles(12, 2), quantized, wire.AMMO, wire.simulation_time,
        wire.TEXT, wire.BLOB, wire.POLY, wire.several("vector3", 3, wire.FLOAT), wire.NORMALS, wire.several("floats", 4, wire.FLOAT),
    ]
    pick = {3: lambda x: x, 5: lambda x: x[1], 6: lambda x: x[2], 7: lambda x: x[1], 11: bytes.decode, 12: bytes.decode, 14: lambda x: x[2], 15: lambda x: x[2], 16: lambda x: x[3]}
    for batch in batches:
        rows = []
        for k, name, brand in zip(*(batch.column(i).to_pylist() for i in range(3))):
            w = BitWriter().flag(k % 2 == 1).svarint(k if k % 2 == 0 else -k).bytes((k * 1000003).to_bytes(8, "little"))
            whole, parts = k % 2, k // 2 % 2
            w.bits(whole, 1).bits(parts, 1)
            if whole or parts:
                w.bits(k // 4 % 2, 1).bits(k % 16384, 14 * whole).bits(k % 32, 5 * parts)
            w.bits(k % 2, 1).bits(k % 2048, 11)
            w.bits(1, 12).bits(k % 4096, 12).bits(2, 12).bits(4, 3).bits(k * 7919 % (1 << 20), 20).bits(1, 12).bits(k % 4096, 12)
            w.bits(k % 256, 8).uvarint(k % 3).uvarint(k).text(name.encode()).uvarint(len(brand)).bytes(brand.encode()).bits(k % 2, 1).ubitvar(k)
            w.float32(k).float32(k / 2).float32(k / 4).bits(1, 2).bits(0, 1).bits(k % 2048, 11).bits(k % 2, 1)
            w.float32(1).float32(2).float32(3).float32(k / 8)
            r, ctx = BitReader(w.data()), wire.Reading()
            rows.append((k, *(pick.get(i, lambda x: x)(codec(r, ctx)[1]) for i, codec in enumerate(codecs))))
        yield from rec.in_batches(iter(rows), schema)


def wire_codecs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand").mapInArrow(_codecs, _CODECS)


def typed_reads(s: SparkSession, d: str) -> DataFrame:
    """Lenient reads of values whose kind differs from row to row."""
    kind, n = F.col("event_id") % 4, F.col("event_id")
    v = F.struct(
        F.element_at(F.array(*map(F.lit, ("i64", "u64", "f32", "bool"))), (kind + 1).cast("int")).alias("kind"), F.when(kind == 3, n % 8 == 3).alias("b"), F.when(kind == 0, -n * 1000003).alias("i"),
        F.when(kind == 1, n.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)").alias("u"), F.when(kind == 2, F.col("value").cast("float")).alias("f"),
    )
    rows = events(s, d).select("event_id", v.alias("v"))
    v = F.col("v")
    return rows.select("event_id", fields.get_i64(v).alias("i64"), fields.get_u32(v).alias("u32"), fields.get_u64(v).cast("string").alias("u64"), fields.get_handle(v).alias("handle"), fields.get_f32(v).alias("f32"), fields.get_bool(v).alias("flag"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rt_commands": rt_commands, "rt_messages": rt_messages, "rt_inspection": rt_inspection, "rt_index": rt_index, "rt_strings": rt_strings, "rt_entities": rt_entities,
    "rt_fields": rt_fields, "rt_filtered": rt_filtered, "rt_segments": rt_segments, "rt_seek": rt_seek,
    "field_path_operations": field_path_operations, "wire_codecs": wire_codecs, "typed_reads": typed_reads,
}

_E = """
with e as (select user_id as demo, event_id, event_type, value, props, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from events)
"""
_C = _E + """,
c as (
  select demo, 0 as idx, 3 as cmd, -1 as tick from (select distinct demo from e)
  union all select demo, 1 + i + case when i >= n - 10 then 1 else 0 end, case event_type when 'click' then 7 when 'error' then 9 when 'purchase' then 12 when 'signup' then 13 else 63 end, i // 3 - 2 from e
  union all select demo, 1 + i, 0, i // 3 from e where i = n - 10),
st as (select demo, min(case when cmd = 0 then idx end) as stop from c group by demo),
p as (select c.* from c join st using (demo) where cmd <> 3 and (stop is null or idx < stop))
"""
_T = _E + """,
o as (select *, cast(event_id % 5 as int) as slot, case event_type when 'error' then 'L' when 'signup' then 'D' else 'U' end as op from e),
isl as (select *, sum(case when op = 'U' then 1 else 0 end) over (partition by demo, slot order by i) as g from o),
st as (select *, case when g = 0 then 'absent' when op = 'U' then 'active' when first_value(op) over (partition by demo, slot, g, case when op = 'U' then 1 else 0 end order by i) = 'L' then 'dormant' else 'absent' end as s from isl),
ch as (select *, coalesce(lag(s) over (partition by demo, slot order by i), 'absent') as b from st),
eff as (
  select *, cast(i + 1 as int) as tick, case when slot % 3 = 0 then 'COther' else 'CEvent' end as class_name,
    case when op = 'U' then case when b = 'absent' then 'create' else 'update' end when b = 'active' then case op when 'L' then 'leave' else 'delete' end end as what
  from ch)
"""

ORACLES: dict[str, str] = {
    "rt_commands": _E + "select demo, cast(i // 3 - 2 as int) as tick, cast(case event_type when 'click' then 7 when 'error' then 9 when 'purchase' then 12 when 'signup' then 13 else 63 end as int) as cmd, case event_type when 'click' then 'Packet' when 'error' then 'ConsoleCmd' when 'purchase' then 'UserCmd' when 'signup' then 'FullPacket' else 'Unknown' end as command_type, event_id % 3 = 0 as compressed, cast(8 + octet_length(encode(props)) as bigint) as size, event_id, props from e",
    "rt_messages": _E + "select demo, i // 4 as idx, i % 4 as msg, cast(case event_type when 'click' then 0 when 'error' then 40 when 'purchase' then 80 when 'signup' then 120 else 160 end as bigint) as message_type, cast(8 + octet_length(encode(props)) as bigint) as encoded_size, event_id, props from e",
    "rt_inspection": _C + ", w as (select demo, count(*) as commands, cast(min(case when tick >= 0 then tick end) as int) as first_tick, cast(max(case when tick >= 0 then tick end) as int) as last_tick, count(distinct case when tick >= 0 then tick end) as distinct_ticks, count(case when cmd = 3 then 1 end) as sync_points, count(case when cmd = 63 then 1 end) as unknown_commands from c group by demo), r as (select demo, cast(min(case when tick >= 0 then tick end) as int) as playback_first, cast(max(case when tick >= 0 then tick end) as int) as playback_last, count(distinct case when tick >= 0 then tick end) as playback_ticks, count(case when cmd = 13 then 1 end) as seek_points from p group by demo) select demo, commands, first_tick, last_tick, distinct_ticks, playback_first, playback_last, playback_ticks, seek_points, sync_points, cast(stop as bigint) as first_stop_command, coalesce(commands - 1 - stop, 0) as commands_after_stop, unknown_commands from w left join r using (demo) left join st using (demo)",
    "rt_index": _C + "select demo, 'keyframe' as what, cast(tick as int) as tick, count(*) as n from p where cmd = 13 group by demo, tick union all select demo, 'tick', cast(tick as int), count(*) from (select demo, tick, lag(tick) over (partition by demo order by idx) as b from p where tick >= 0) where b is null or b <> tick group by demo, tick",
    "rt_strings": _E + "select demo, cast(i as int) as entry, case when event_id % 35 = 0 then 'new' || props else props end as string, case when event_id % 5 = 0 then cast(event_id as varchar) else event_type end as data from e",
    "rt_entities": _T + "select demo, tick, slot, what as op, class_name from eff where what is not null",
    "rt_fields": _T + ", u as (select *, max(case when what = 'create' then tick end) over (partition by demo, slot order by i) as born from eff where op = 'U') select demo, slot, born, case when class_name = 'CEvent' then cast(arg_max(value, i) as float) end as v, max(event_id) as id, case when class_name = 'CEvent' then arg_max(event_type, i) end as k, case when class_name = 'CEvent' then -max(event_id) end as neg, case when class_name = 'COther' then max(event_id) % 2 = 0 end as flag from u group by demo, slot, born, class_name",
    "rt_filtered": _T + "select demo, tick, slot, what as op, event_id as id from eff where op = 'U' and class_name = 'COther'",
    "rt_segments": _E + "select demo, cast(i + 1 as int) as tick, cast(event_id % 5 as int) as slot, event_id as id from e",
    "rt_seek": _E + ", k as (select demo, max(i) as i from e where event_type = 'signup' and i < 40 group by demo) select e.demo, cast(least(40, n) as int) as tick, cast(event_id % 5 as int) as slot, true as active, max(event_id) as id from e left join k using (demo) where e.i < 40 and e.i >= coalesce(k.i, 0) group by e.demo, n, event_id % 5",
    # Worked out by hand for operands p = 3, v = 4 (a count: 2), z = -2, b = 2, and dropping 1.
    "field_path_operations": """select cast(op as bigint) as op, path from (values
      (0, '10,20,31'), (1, '10,20,32'), (2, '10,20,33'), (3, '10,20,34'), (4, '10,20,38'), (5, '10,20,30,0'), (6, '10,20,30,3'), (7, '10,20,31,0'), (8, '10,20,31,3'), (9, '10,20,33,0'),
      (10, '10,20,35,4'), (11, '10,20,34,3'), (12, '10,20,34,3'), (13, '10,20,30,3,3'), (14, '10,20,30,2,2'), (15, '10,20,30,3,3,3'), (16, '10,20,30,2,2,2'), (17, '10,20,31,3,3'), (18, '10,20,31,2,2'), (19, '10,20,31,3,3,3'),
      (20, '10,20,31,2,2,2'), (21, '10,20,36,3,3'), (22, '10,20,36,2,2'), (23, '10,20,36,3,3,3'), (24, '10,20,36,2,2,2'), (25, '10,20,34,3,3'), (26, '9,19,29,3,3'), (27, '10,21'), (28, '10,24'), (29, '11'),
      (30, '14'), (31, '13'), (32, '13'), (33, '10,21'), (34, '10,18'), (35, '8,18'), (36, '8,18,28'), (37, '10,21,30'), (38, '5,15,25'), (39, '10,20,30')) t(op, path)""",
    "wire_codecs": """with k as (select *, p_partkey as k, cast(cast(p_partkey % 2048 as float) * cast(1.0::double / 2047 as float) as float) as x from part)
      select p_partkey, k % 2 = 1 as flag, case when k % 2 = 0 then k else -k end as signed, k * 1000003 as fixed,
        cast((case when k // 4 % 2 = 1 then -1 else 1 end) * (case when k % 2 = 1 then k % 16384 + 1 else 0 end + case when k // 2 % 2 = 1 then (k % 32) / 32.0 else 0 end) as float) as coord,
        cast(case when k % 2 = 1 then -x else x end as float) as normal, cast(cast(k % 4096 as float) * cast(360 as float) / cast(4096 as float) as float) as angle,
        cast(cast(cast(k * 7919 % 1048576 as float) * cast(360 as float) as float) / cast(1048576 as float) - cast(180 as float) as float) as centred,
        cast(cast(k % 4096 as float) * cast(360 as float) / cast(4096 as float) as float) as pitch,
        cast(cast(9.9609375 as float) * cast(cast(k % 256 as float) * cast(1.0::double / 255 as float) as float) as float) as quantized,
        cast(greatest(k % 3 - 1, 0) as int) as ammo, cast(cast(k as float) * cast(0.015625 as float) as float) as seconds, p_name as text, p_brand as blob, k % 2 = 1 as poly, cast(k / 4.0 as float) as third,
        cast((case when k % 2 = 1 then -1 else 1 end) * cast(sqrt(greatest(cast(cast(1 as float) - cast(x * x as float) as float), cast(0 as float))) as float) as float) as upright, cast(k / 8.0 as float) as quaternion
      from k""",
    "typed_reads": """with v as (select event_id, event_id % 4 as kind, cast(case when event_id % 4 = 0 then -event_id * 1000003 when event_id % 4 = 1 then event_id end as hugeint) as n, value from events)
      select event_id, cast(case kind when 0 then n when 1 then n - 9223372036854775808 else 0 end as bigint) as i64, cast(case when kind < 2 then ((n % 4294967296) + 4294967296) % 4294967296 else 0 end as bigint) as u32,
        case kind when 0 then cast(case when n < 0 then n + 18446744073709551616 else n end as varchar) when 1 then cast(n + 9223372036854775808 as varchar) end as u64,
        cast(case when kind < 2 then ((n % 4294967296) + 4294967296) % 4294967296 end as bigint) as handle, cast(case when kind = 2 then value else 0 end as float) as f32, kind = 3 and event_id % 8 = 3 as flag
      from v""",
}
