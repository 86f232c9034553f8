"""Schemas, codecs, tables, entities and playback, on inputs that the writers of this package make."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import fields, paths, wire
from millrace.functions.bits import BitReader, BitWriter
from millrace.limits import FormatError, Limits
from millrace.operators import replay
from millrace.operators.entities import Entities, Entity, Message
from millrace.operators.schema import Classes, FieldSpec, NetworkClass, Profile, Schema, parse_type
from millrace.operators.tables import StringTable, StringTables
from millrace.sources import plain
from millrace.sources.plain import MAGIC, PlainAdapter, command, entity_changes, message, packet, recording, table_entries

f32 = np.float32


# --- codecs


def read(codec, w: BitWriter, ctx=None):
    r = BitReader(w.data())
    out = codec(r, ctx or wire.Reading())
    assert r.at == w.at
    return out


def test_scalar_codecs():
    assert read(wire.BOOL, BitWriter().flag(True)) == ("bool", True)
    assert read(wire.I64, BitWriter().svarint(-(1 << 60))) == ("i64", -(1 << 60))
    assert read(wire.U64, BitWriter().uvarint((1 << 64) - 1)) == ("u64", (1 << 64) - 1)
    assert [read(wire.AMMO, BitWriter().uvarint(n))[1] for n in (0, 1, 31)] == [0, 0, 30]
    assert read(wire.simulation_time, BitWriter().uvarint(3), wire.Reading(f32(0.5))) == ("f32", f32(1.5))
    assert read(wire.TEXT, BitWriter().text(b"caf\xe9")) == ("string", b"caf\xe9")
    assert read(wire.BLOB, BitWriter().uvarint(2).bytes(b"\0\1")) == ("string", b"\0\1")
    assert read(wire.POLY, BitWriter().flag(False).ubitvar(9)) == ("bool", False)
    for codec, w in ((wire.TEXT, BitWriter().text(b"abcd")), (wire.BLOB, BitWriter().uvarint(4).bytes(b"abcd"))):
        with pytest.raises(ValueError):
            codec(BitReader(w.data()), wire.Reading(limits=Limits(text=3)))
        assert codec(BitReader(w.data()), wire.Reading(limits=None))[1] == b"abcd"


def test_coordinates_and_angles():
    assert read(wire.COORD, BitWriter().bits(0, 2)) == ("f32", 0)
    assert read(wire.COORD, BitWriter().bits(3, 2).flag(True).bits(6, 14).bits(8, 5)) == ("f32", f32(-7.25))
    assert read(wire.COORD, BitWriter().bits(2, 2).flag(False).bits(16, 5)) == ("f32", f32(0.5))
    assert read(wire.NORMAL, BitWriter().flag(True).bits(2047, 11))[1] == f32(-1)
    assert read(wire.ANGLE_COORDS, BitWriter().bits(2, 3).bits(1, 2).flag(False).bits(0, 14)) == ("qangle", [0, 1, 0])
    kind, (x, y, z) = read(wire.NORMALS, BitWriter().bits(1, 2).flag(False).bits(1228, 11).flag(True))
    assert kind == "vector3" and y == 0 and z < 0 and abs(float(x) ** 2 + float(z) ** 2 - 1) < 1e-6
    assert read(wire.precise_angles(True), BitWriter().bits(5, 3).bits(0, 20).bits(1 << 19, 20)) == ("qangle", [-180, 0, 0])
    assert read(wire.precise_angles(False), BitWriter().bits(1, 3).bits(1 << 18, 20)) == ("qangle", [90, 0, 0])
    assert read(wire.angles(4, 2), BitWriter().bits(4, 4).bits(8, 4)) == ("qangle", [90, 180, 0])
    assert read(wire.several("vector2", 2, wire.U64), BitWriter().uvarint(5).uvarint(6)) == ("vector2", [0, 0])


def test_quantized_numbers():
    q = wire.Quantized(12, 0, 0, 100)
    assert float(read(q, BitWriter().bits(1370, 12))[1]) == pytest.approx(33.455433, abs=1e-6) and q.own == []
    down, up = wire.Quantized(8, wire.ROUND_DOWN, -10, 10), wire.Quantized(8, wire.ROUND_UP, -10, 10)
    assert down.high == f32(10) - f32(20 / 256) and up.low == f32(-10) + f32(20 / 256)
    zero = wire.Quantized(8, wire.ZERO, -10, 11)
    assert zero.own == [0] and read(zero, BitWriter().flag(True)) == ("f32", 0) and read(zero, BitWriter().flag(False).bits(255, 8))[1] == f32(11)
    assert wire.Quantized(8, wire.ZERO, 0, 5).flags & wire.ZERO == 0 and wire.Quantized(8, wire.ZERO, 1, 5).own == []
    whole = wire.Quantized(4, wire.WHOLE | wire.ROUND_UP, 0, 10)
    assert whole.flags == wire.WHOLE and whole.high == f32(2) - f32(2 / 16)
    assert wire.Quantized(2, wire.WHOLE, 20, 3).bits == 5  # seventeen whole numbers need five bits
    rnd = random.Random(1)
    for _ in range(300):
        bits, low = rnd.randrange(1, 20), rnd.uniform(-1000, 900)
        q = wire.Quantized(bits, 0, low, low + rnd.uniform(0.01, 500))
        assert float(q.scale) * float(q.high - q.low) <= (1 << bits) - 1 + 1e-9 and q.at(0) == q.low
    for bits in (0, 32):
        with pytest.raises(FormatError):
            wire.Quantized(bits, 0, 0, 1)


def test_paths():
    assert paths.read_paths(BitReader(bytes.fromhex("3eda1806"))) == [(0,), (3, 3), (4,)]
    assert sum(2.0**-n for n, _ in paths.CODES) == 1 and sorted(paths.CODES.values()) == list(range(40))
    assert paths.pack((5,)) == 5 and paths.pack((3, 3)) == 72057594037928707
    rnd = random.Random(2)
    for _ in range(50):
        p = tuple(rnd.randrange(256) for _ in range(rnd.randrange(1, 8)))
        assert paths.unpack(paths.pack(p)) == p
    want = [(0,), (1,), (5,), (60,), (61, 2, 3), (61, 2, 9), (200,), (255,)]
    w = BitWriter()
    paths.write_paths(w, want)
    assert paths.read_paths(BitReader(w.data())) == want
    with pytest.raises(FormatError):
        paths.read_paths(BitReader(w.data()), Limits(paths=7))

    def run(*ops):
        w = BitWriter()
        for op in ops:
            w.bits(paths.BY_OPERATION[op][1], paths.BY_OPERATION[op][0])
        return paths.read_paths(BitReader(w.bits(0, 64).data()))

    for bad in ((27,), (37,), (0, *[5] * 7)):  # below one number, no last but one, over seven
        with pytest.raises(FormatError):
            run(*bad, 39)


# --- schemas


def shape(type_name, profile=Profile(), nested=None, **hints):
    symbols = ["C", "m_x", type_name, *(nested or ()), *(x for x in hints.values() if isinstance(x, str))]
    spec = {k: (symbols.index(v) if isinstance(v, str) else v) for k, v in hints.items()}
    spec.setdefault("name_sym", 1)
    return Schema.build(symbols, [FieldSpec(type_sym=2, **spec, serializer_sym=symbols.index(nested[0]) if nested else None)], [(0, [0])], profile)["C"].fields[0]


def test_type_names():
    assert parse_type(" CFoo * ").pointer and parse_type("int32[ 4 ]").length == 4 and parse_type("T[MAX_X]").symbol == "MAX_X"
    t = parse_type("CUtlVector< CHandle< CFoo > >")
    assert (t.base, t.inner.base, t.inner.inner.base) == ("CUtlVector", "CHandle", "CFoo")


def test_types_pick_codecs():
    codec = lambda *a, **k: shape(*a, **k).shape.codec
    kind = lambda *a, **k: shape(*a, **k).shape.kind
    assert codec("int16") is wire.I64 and codec("bool") is wire.BOOL and codec("uint32") is wire.U64 and codec("CHandle< CFoo >") is wire.U64
    assert codec("uint64", encoder_sym="fixed64") is wire.FIXED64 and codec("CUtlString") is wire.TEXT and codec("char[16]") is wire.TEXT and codec("CUtlBinaryBlock") is wire.BLOB
    assert codec("char") is wire.TEXT and codec("char", Profile(char_is_text=False)) is wire.U64
    assert codec("CFoo*") is wire.BOOL and kind("CFoo*") == "pointer" and kind("CBodyComponent") == "pointer" and kind("COdd", Profile(pointers=frozenset({"COdd"}))) == "pointer"
    f = shape("int32[3]")
    assert (f.shape.kind, f.shape.length, len(f.children)) == ("fixed", 3, 3) and shape("int32[N]").shape.length == 64 and shape("int32[N]", Profile(lengths={"N": 5})).shape.length == 5
    f = shape("CNetworkUtlVectorBase< bool >")
    assert f.shape.kind == "vector" and f.shape.codec is wire.U64 and f.children[0].shape.codec is wire.BOOL
    assert kind("CUtlVector< CFoo >", nested=("CNone",)) == "table" and kind("COdd", Profile(tables=frozenset({"COdd"}))) == "table"
    assert codec("float32") is wire.FLOAT and codec("float32", bits=32) is wire.FLOAT and codec("float32", bits=40) is wire.FLOAT and isinstance(codec("GameTime_t", bits=8, high=1.0), wire.Quantized)
    assert codec("float32", encoder_sym="coord") is wire.COORD and codec("float32", encoder_sym="normal") is wire.NORMAL and codec("float32", name_sym="m_flAnimTime") is wire.simulation_time
    assert codec("Vector", encoder_sym="normal") is wire.NORMALS and codec("QAngle") is wire.ANGLE_COORDS and codec("uint8", Profile(ammo="m_x")) is wire.AMMO
    assert codec("CFoo*", polymorphic=True) is wire.POLY and kind("CFoo*", polymorphic=True) == "pointer"
    for t, n, want in (("Vector2D", 2, "vector2"), ("VectorWS", 3, "vector3"), ("Vector4D", 4, "vector4"), ("Quaternion", 4, "floats"), ("CTransform", 6, "floats")):
        w = BitWriter()
        for i in range(n):
            w.float32(i)
        assert read(codec(t), w) == (want, list(range(n)))
    assert read(codec("QAngle", bits=4), BitWriter().bits(4, 4).bits(0, 8))[1] == [90, 0, 0]
    assert read(codec("QAngle", Profile(pitch_yaw=True), bits=4, encoder_sym="qangle_pitch_yaw"), BitWriter().bits(4, 8))[1] == [90, 0, 0]
    assert read(codec("QAngle", Profile(centred_angles=False), encoder_sym="qangle_precise"), BitWriter().bits(0, 3))[1] == [0, 0, 0]


SYMBOLS = ["CInner", "CPawn", "m_a", "int32", "m_b", "bool", "m_list", "CUtlVector< CInner >", "m_fixed", "int32[3]", "m_ptr", "CInner*", "body.part", "m_ints", "CUtlVector< int32 >", "CLate"]
AT = {s: i for i, s in enumerate(SYMBOLS)}
SPECS = [
    FieldSpec(AT["int32"], AT["m_a"]), FieldSpec(AT["bool"], AT["m_b"]), FieldSpec(AT[SYMBOLS[7]], AT["m_list"], serializer_sym=AT["CInner"]), FieldSpec(AT["int32[3]"], AT["m_fixed"]),
    FieldSpec(AT["CInner*"], AT["m_ptr"], serializer_sym=AT["CInner"]), FieldSpec(AT["int32"], AT["m_a"], node_sym=AT["body.part"]), FieldSpec(AT[SYMBOLS[14]], AT["m_ints"]), FieldSpec(AT["CInner*"], AT["m_ptr"], serializer_sym=AT["CLate"]),
]


def test_names_and_keys():
    schema = Schema.build(SYMBOLS, SPECS, [(AT["CInner"], [0, 1]), (AT["CPawn"], [1, 2, 3, 4, 5, 6])])
    pawn = schema["CPawn"]
    for name, path in (("m_b", (0,)), ("m_list.4", (1, 4)), ("m_list.4.m_b", (1, 4, 1)), ("m_ptr.m_a", (3, 0)), ("body.part.m_a", (4,)), ("m_ints.7", (5, 7)), ("m_fixed", (2,))):
        assert pawn.key(name) == paths.pack(path) and pawn.name_of(paths.pack(path)) == name
    assert pawn.key("m_fixed.m_fixed") == paths.pack((2, 0)) and pawn.name_of(paths.pack((2, 2))) == "m_fixed.m_fixed"
    assert pawn.key("m_none") is None and pawn.key("m_list.x") is None and pawn.key("m_b.m_b") is None and pawn.name_of(paths.pack((9,))) is None
    assert pawn.at((1, 200, 1)).shape.codec is wire.BOOL and pawn.at((5, 3)).shape.codec is wire.I64 and pawn.child(3, 1).name == "m_b" and pawn.child(0, 0) is None
    for bad in ((6,), (2, 3), (3, 2)):
        with pytest.raises(FormatError):
            pawn.at(bad)
    late = Schema.build(SYMBOLS, SPECS, [(AT["CPawn"], [7]), (AT["CLate"], [0])])
    assert late["CPawn"].fields[0].children is None  # defined too late
    again = Schema.build(SYMBOLS, SPECS, [(AT["CInner"], [0]), (AT["CInner"], [0, 1])])
    assert len(again) == 1 and len(again["CInner"].fields) == 2
    for specs, definitions, limits in (([FieldSpec(99)], [], Limits()), ([], [(0, [0])], Limits()), ([], [(99, [])], Limits()), (SPECS, [], Limits(fields=3)), (SPECS, [], Limits(symbols=3)), (SPECS, [(0, []), (1, [])], Limits(serializers=1)), (SPECS, [(0, [3])], Limits(array=2))):
        with pytest.raises(FormatError):
            Schema.build(SYMBOLS, specs, definitions, limits=limits)


def test_classes():
    c = Classes([NetworkClass(4, "CB"), NetworkClass(0, "CA")])
    assert c.bits == 3 and len(c) == 2 and c.get(4).name == "CB" and c.id_of("CA") == 0 and c.name_of(3) is None and c.id_of("x") is None and Classes([]).bits == 1
    for bad, limits in (([(0, "A"), (0, "B")], Limits()), ([(0, "A"), (1, "A")], Limits()), ([(-1, "A")], Limits()), ([(9, "A")], Limits(class_id=8)), ([(0, "A"), (1, "B")], Limits(classes=1))):
        with pytest.raises(FormatError):
            Classes([NetworkClass(*x) for x in bad], limits)
    with pytest.raises(FormatError):
        c.get(3)


# --- string tables


def test_string_tables():
    rnd = random.Random(5)
    keys = [f"{'models/props/' * rnd.randrange(4)}{rnd.randrange(30)}".encode() for _ in range(200)]
    entries = [(i, k, rnd.randbytes(rnd.randrange(40))) for i, k in enumerate(keys)]
    for flags, variable in ((0, False), (1, False), (1, True)):
        t = StringTables()
        t.create(StringTable("t", None, flags, variable), table_entries(entries, None, flags, variable), len(entries))
        assert [(i, k.encode(), d) for i, (k, d) in enumerate(t.named("t").entries)] == entries and t.named("t").dirty == list(range(200))
    fixed = StringTables()
    fixed.create(StringTable("f", (2, 12)), table_entries([(0, b"a", b"\xab\x0c")], (2, 12)), 1)
    assert fixed.tables[0].entries == [["a", b"\xab\x0c"]]
    sparse = StringTables()
    sparse.create(StringTable("s"), table_entries([(2, b"third", None)]), 1)
    assert sparse.tables[0].entries == [[None, None], [None, None], ["third", None]] and sparse.tables[0].dirty == [2]
    sparse.update(0, table_entries([(2, None, b"d"), (3, b"x", None)]), 2)
    assert sparse.tables[0].entries[2:] == [["third", b"d"], ["x", None]] and sparse.tables[0].dirty == [2, 2, 3]
    sparse.overwrite([("s", [("no", None), (None, b"n"), ("no", b"e"), ("no", None), ("new", None)]), ("unknown", [("a", b"b")])])
    assert sparse.tables[0].entries == [[None, None], [None, b"n"], ["third", b"e"], ["x", None], ["new", None]] and len(sparse.tables) == 1
    sparse.clear()
    assert not sparse.tables[0].dirty
    packed = StringTables()
    assert packed.create(StringTable("instancebaseline"), pa.compress(table_entries([(0, b"7", b"base"), (1, b"x", b"n"), (2, b"8", None)]), "snappy", asbytes=True), 3, True)
    packed.refresh()
    assert packed.baselines == {7: b"base"}
    for act in (lambda: packed.update(1, b"", 0), lambda: packed.update(-1, b"", 0), lambda: packed.update(0, b"", -1), lambda: packed.update(0, b"1234", 0, Limits(table=3)), lambda: packed.update(0, b"", 9, Limits(table_entries=8)), lambda: packed.create(StringTable("c"), b"\xff\xff\xff\xff\x0f", 1, True), lambda: packed.update(0, table_entries([(0, b"k", b"12345")]), 1, Limits(entry=4))):
        with pytest.raises(FormatError):
            act()


# --- entities

SCHEMA, CLASSES = plain.simple_schema({"CThing": [("m_n", "int64"), ("m_s", "CUtlString"), ("m_h", "uint64")], "CSkip": [("m_n", "int64")]})


class Log:
    """What an adapter gave to a state, for tests without recordings."""

    def __init__(self, wanted=None, limits=Limits()):
        self.state = replay.State(f32(1))
        self.context = replay.Context(self.state, limits, wanted)
        for cmd, body in ((4, SCHEMA), (5, CLASSES)):
            PlainAdapter().handle(replay.Frame(0, 0, cmd, 0), body, self.context)

    def do(self, *changes, **said):
        data = entity_changes(changes)
        PlainAdapter().handle(replay.Frame(0, 0, 7, 0), packet([message(plain.ENTITIES, data, count=said.pop("count", len(changes)), **said)]), self.context)
        return [(c.index, c.op) for c in self.state.changes]


thing = lambda n: [((0,), "int64", n)]


def test_entities_live_and_rest():
    log = Log()
    assert log.do((5, "create", 0, [*thing(3), ((1,), "CUtlString", "x")]), (9, "create", 1, thing(1))) == [(5, "create"), (9, "create")]
    e, s = log.state.entities, log.state.schema["CThing"]
    assert e.get(5).get("m_n", s) == ("i64", 3) and e.get(5).serial == 0 and log.state.changes[0].decoded_serial == 7 and [x.index for x in e] == [5, 9] and e.updated == [5, 9]
    log.state.clear()
    log.do((5, "leave", 0, ()), (9, "delete", 0, ()))
    assert not e.get(5).active and e.get(9) is None and len(e) == 1 and not e.updated
    log.state.clear()
    assert log.do((5, "delete", 0, ())) == [] and e.get(5)  # what rests stays
    assert log.do((5, "update", 0, thing(4))) == [(5, "update")] and e.get(5).active and e.get(5).get("m_s", s) == ("string", b"x")
    assert e.by_handle((3 << 14) | 5) is e.get(5) and e.by_handle(0x00FFFFFF) is None and e.by_handle(None) is None
    with pytest.raises(FormatError):
        log.do((8, "update", 0, thing(1)))
    log.state.entities.reserve(5)
    assert len(log.state.entities) == 0
    for bad in (lambda: Entity(1 << 14, 0, "x"), lambda: Entities().reserve(1 << 15), lambda: log.do(count=-1), lambda: Log(limits=Limits(updates=1)).do((1, "create", 0, ()), (2, "create", 0, ()))):
        with pytest.raises(FormatError):
            bad()
    with pytest.raises(FormatError):
        Log().do((1 << 14, "create", 0, ()))


def test_baselines_come_before_deltas():
    log = Log()
    w = BitWriter()
    paths.write_paths(w, [(0,), (1,)])
    w.svarint(40).text(b"base")
    log.context.create_table(StringTable("instancebaseline"), table_entries([(0, b"0", w.data())]), 1)
    log.do((2, "create", 0, [((1,), "CUtlString", "own"), ((2,), "uint64", 1 << 63)]))
    assert [fields.plain(v) for v in log.state.entities.get(2).fields.values()] == [40, "own", 1 << 63]
    assert [b for b, *_ in log.state.changes[0].values] == [True, True, False, False]
    assert fields.named(log.state.entities.get(2).fields, log.state.schema["CThing"]) == {"m_n": 40, "m_s": "own", "m_h": 1 << 63}


def test_filters_leave_no_trace():
    log = Log(frozenset({"CThing"}))
    assert log.do((1, "create", 1, thing(8)), (2, "create", 0, thing(9))) == [(2, "create")]
    assert log.do((1, "update", 1, thing(7)), (2, "update", 0, thing(6)))[-1:] == [(2, "update")] and log.state.entities.get(1) is None
    log.do((1, "leave", 0, ()))
    log.do((1, "update", 1, thing(5)))
    log.do((1, "delete", 0, ()))
    with pytest.raises(FormatError):
        log.do((1, "update", 1, thing(5)))
    log.do((2, "create", 1, thing(5)))
    assert log.state.entities.get(2) is None
    log.do((2, "create", 0, thing(5)))
    assert log.state.entities.get(2).get("m_n", log.state.schema["CThing"]) == ("i64", 5)
    seen = Log()
    seen.do((1, "create", 0, thing(1)))
    w = BitWriter().ubitvar(1).bits(0, 2).bits(1, 2)
    list(seen.state.entities.apply(Message(1, w.data(), True), seen.state.classes, seen.state.schema, {}, seen.context.reading))
    assert seen.state.entities.updated == [1]


# --- playback


def tick(n, *changes, cmd=7):
    return command(cmd, n, packet([message(plain.ENTITIES, entity_changes(changes), count=len(changes))]))


START = [command(4, -1, SCHEMA), command(5, -1, CLASSES), command(3, 0)]
#: Keyframes create the only entity anew.
GAME = recording([*START, tick(1, (1, "create", 0, thing(1))), *(tick(n, (1, "create" if n % 2 == 0 else "update", 0, thing(n)), cmd=13 if n % 2 == 0 else 7) for n in range(2, 10)), command(0, 10)])


def played(data, until=None, wanted=None):
    state, start = replay.signon(data, PlainAdapter())
    return [(s.tick, [fields.plain(v) for e in s.entities for v in e.fields.values()], list(s.entities.updated)) for s in replay.play(data, PlainAdapter(), state, start, until, wanted)]


def test_playback():
    assert [t for t, *_ in played(GAME)] == list(range(1, 11)) and played(GAME)[4] == (5, [5], [1]) and played(GAME)[9] == (10, [9], [])
    assert [t for t, *_ in played(GAME, until=3)] == [1, 2, 3] and [t for t, *_ in played(GAME, until=9)][-1] == 10  # a stop behind the bound is read
    assert replay.seek(GAME, PlainAdapter(), 5).tick == 5 and replay.seek(GAME, PlainAdapter(), 1).entities.get(1).fields[0] == ("i64", 1)
    assert all(not v for _, v, _ in played(GAME, wanted=frozenset({"CSkip"})))
    index = replay.index_of(GAME)
    assert index.ticks == tuple(range(1, 10)) and [t for _, t in index.keyframes] == [2, 4, 6, 8] and index.keyframe(1) is None and index.keyframe(5) == index.keyframes[1][0]
    for bad in (recording([command(3, 0)]), recording([command(4, 0, SCHEMA), command(3, 0)])):
        with pytest.raises(FormatError):
            replay.signon(bad, PlainAdapter())
    assert replay.signon(recording(START[:2]), PlainAdapter())[1] is None
    for seconds in (0, -1.0, float("inf"), float("nan")):
        with pytest.raises(FormatError):
            replay.tick_interval(seconds)


def test_sessions_equal_cold_playback():
    prepared = replay.Prepared(GAME, PlainAdapter())
    shown = lambda states: [(s.tick, [v for e in s.entities for v in e.fields.values()]) for s in states]
    for _ in range(2):
        assert [(t, [fields.plain(x) for x in v]) for t, v in shown(prepared.session().run())] == [(t, v) for t, v, _ in played(GAME)]
    assert prepared.session().seek(4).entities.get(1).fields[0] == ("i64", 4) and prepared.session().state.tick == -1
    for most in (0, 1, 2, 3, 5, 99):
        plan = prepared.index.segments(most)
        assert len(plan) == max(1, min(most, 5)) and plan[0][0] is None and plan[-1][1] == 2147483647
        pieces = [shown(prepared.session().segment(*p)) for p in plan]
        assert [x for p in pieces for x in p] == shown(prepared.session().run())
    assert [e for _, e in prepared.index.segments(3)] == [2, 6, 2147483647] and replay.segment_end(-(1 << 31)) == -(1 << 31)


def test_frames(spark):
    files = spark.createDataFrame([("g", bytearray(GAME)), ("cut", bytearray(GAME[:-30]))], "demo_id string, content binary")
    whole = replay.deltas(files.filter("demo_id = 'g'"), MAGIC, PlainAdapter).filter("key is not null")
    assert sorted((r.tick, r.i, r.field_name) for r in whole.collect()) == [(n, n, "m_n") for n in range(1, 10)]
    cut = replay.segments(files.filter("demo_id = 'g'"), MAGIC, PlainAdapter(), 3, replay.delta_rows, replay.DELTAS)
    assert sorted(map(str, cut.filter("key is not null").collect())) == sorted(map(str, whole.collect()))
    with pytest.raises(Exception, match="cut"):
        replay.deltas(files, MAGIC, PlainAdapter).collect()
    assert replay.deltas(files, MAGIC, PlainAdapter, failfast=False).filter("demo_id = 'cut'").count() > 0
    at = replay.states_at(files.filter("demo_id = 'g'"), MAGIC, PlainAdapter, 6).filter("key is not null").collect()
    assert [(r.tick, r.entity_index, r.i, r.active) for r in at] == [(6, 1, 6, True)]

    def per_tick(state, adapter):
        if state.tick == 4:
            raise ValueError("a sink's own error")
        yield state.tick, len(state.entities)

    rows = replay.ticks(files.filter("demo_id = 'g'"), MAGIC, PlainAdapter, per_tick, "demo_id string, tick int, n int", until=3)
    assert sorted((r.tick, r.n) for r in rows.collect()) == [(1, 1), (2, 1), (3, 1)]
    with pytest.raises(Exception, match="own error"):
        replay.ticks(files.filter("demo_id = 'g'"), MAGIC, PlainAdapter, per_tick, "demo_id string, tick int, n int").collect()
    last = fields.latest_fields(replay.deltas(files.filter("demo_id = 'g'"), MAGIC, PlainAdapter)).orderBy("incarnation").collect()
    assert [(r.incarnation.tick, r.value.i) for r in last] == [(1, 1), (2, 3), (4, 5), (6, 7), (8, 9)]


def test_arriving_recordings(spark, tmp_path):
    from millrace.streaming import live

    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / name).write_bytes(GAME)
        live.write(replay.deltas(live.arriving(spark, str(folder)), MAGIC, PlainAdapter), str(out), str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(str(out)).filter("op = 'create' and key is null").count() == (5 if name == "a" else 10)
    seen = []
    live.call(live.arriving(spark, str(folder)).select("demo_id", "arrived"), lambda rows, n: seen.append(rows.count()), str(tmp_path / "d")).awaitTermination()
    assert sum(seen) == 2


# --- typed reads


def test_strict_reads(spark):
    rows = [("i64", None, -5, None, None, None, None), ("u64", None, None, 1 << 40, None, None, None), ("f32", None, None, None, 1.5, None, None), ("string", None, None, None, None, bytearray(b"ok\xff"), None), ("vector3", None, None, None, None, None, [1.0, 2.0, 3.0]), ("qangle", None, None, None, None, None, [4.0, 5.0, 6.0]), ("floats", None, None, None, None, None, [7.0, 8.0, 9.0, 1.0]), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, kind string, b boolean, i bigint, u bigint, f float, s binary, v array<float>")
    df = df.select("n", F.struct("kind", "b", "i", F.col("u").cast("decimal(20,0)").alias("u"), "f", "s", "v").alias("v"))
    v = F.col("v")
    got = df.select("n", fields.get_vector3(v).alias("vec"), fields.get_qangle(v).alias("q"), fields.get_str(v).alias("str"), fields.get_string(v).alias("text"), fields.get_u64(v).alias("u64"), fields.get_handle(v).alias("h")).orderBy("n").collect()
    assert got[4].vec == [1, 2, 3] and got[5].vec == [0, 0, 0] and got[6].vec == [7, 8, 9] and got[5].q == [4, 5, 6] and got[4].q == [0, 0, 0]
    assert got[3].str is None and got[3].text == "ok�" and int(got[0].u64) == (1 << 64) - 5 and got[0].h == (1 << 32) - 5 and got[2].h is None
    one = lambda n, kind, owned=True: df.filter(f"n = {n}").select(fields.strict(v, kind, owned).alias("x")).first().x
    assert one(0, "i8") == -5 and one(1, "u64") == 1 << 40 and one(1, "i64", False) == 1 << 40 and one(2, "f32") == 1.5 and one(5, "vector3") == [4, 5, 6] and one(7, "i64") is None
    for n, kind, owned in ((0, "u8", True), (1, "i64", True), (1, "i32", False), (2, "i64", True), (4, "vector2", True)):
        with pytest.raises(Exception, match="no "):
            one(n, kind, owned)
    assert fields.convert(("i32", 5), "i8") == 5 and fields.convert(("i32", 5), "u8", False) == 5 and fields.convert(None, "f32") is None and fields.convert(("qangle", [1]), "vector3") == [1]
    for value, kind in ((("i64", 300), "u8"), (("i64", 300), "i8"), (("f32", 1.0), "i8"), (("bool", True), "f32")):
        with pytest.raises(ValueError):
            fields.convert(value, kind)
    assert fields.shown(("qangle", [1, 2.5, 3])) == "QAngle(1, 2.5, 3)" and fields.shown(("vector2", [1, 2])) == "[1, 2]" and fields.shown(("string", b"a\xff")) == "a�"
