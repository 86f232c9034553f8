"""Playback: state that commands build up tick by tick, whole, up to a tick, or in stretches that start at keyframes.

What a body means differs between games, so an adapter reads it: `handle(frame, body, context)` is called for each command and hands neutral
inputs to the context. Adapters travel to the tasks, so they can be pickled. A recording is replayed where it is read, one after another; with
`segments`, its stretches go to as many tasks, each with a checkpoint of the state before the first tick.

Sinks are called with (state, adapter) after each tick and give rows; an error in one ends the query.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import unpack
from millrace.functions.wire import Reading
from millrace.limits import FormatError, Limits
from millrace.operators.entities import Change, Entities, Message
from millrace.operators.frames import FULL_PACKET, LAST_TICK, STOP, SYNC_TICK
from millrace.operators.schema import Classes, FieldSpec, NetworkClass, Profile, Schema
from millrace.operators.tables import StringTable, StringTables
from millrace.sources.recordings import HEADER_SIZE, arrow_schema, decode, each_file, frames, header, in_batches, message_frames

INTERVAL = 1 / 64
VALUE = "kind string, b boolean, i bigint, u decimal(20,0), f float, s binary, v array<float>"
DELTAS = f"demo_id string, tick int, seq bigint, entity_index int, op string, class_id int, class_name string, decoded_serial bigint, from_baseline boolean, key bigint, field_path array<int>, field_name string, {VALUE}"
STATES = f"demo_id string, tick int, entity_index int, class_id int, class_name string, active boolean, key bigint, field_path array<int>, field_name string, {VALUE}"
STRINGS = "demo_id string, tick int, table_id int, table_name string, entry int, string string, user_data binary"


@dataclass(frozen=True)
class Frame:
    """A command without its body."""

    offset: int
    end: int
    cmd: int
    tick: int


@dataclass
class State:
    """Everything that has been read up to a tick; before the first the tick is -1."""

    interval: np.float32
    schema: Schema | None = None
    classes: Classes | None = None
    tables: StringTables = field(default_factory=StringTables)
    entities: Entities = field(default_factory=Entities)
    tick: int = -1
    changes: list[Change] = field(default_factory=list)
    """Changes of entities since the last tick."""

    @property
    def ready(self) -> bool:
        return self.schema is not None and self.classes is not None

    def clear(self) -> None:
        self.changes.clear()
        self.entities.updated.clear()
        self.tables.clear()


class Adapter(Protocol):
    def handle(self, frame: Frame, body: bytes, context: Context) -> None: ...


class Context:
    """What an adapter may do with a command."""

    def __init__(self, state: State, limits: Limits, wanted: frozenset[str] | None = None):
        self.state, self.limits, self.wanted = state, limits, wanted
        self.reading = Reading(state.interval, limits)

    def messages(self, body: bytes) -> Iterator[tuple[int, bytes]]:
        """(type, payload) of a packet's messages."""
        return ((kind, payload) for *_, kind, _, _, payload in message_frames(body, self.limits))

    def check(self, what: str, size: int) -> None:
        self.limits.need(what, size)

    def interval(self, seconds: float) -> None:
        self.state.interval = self.reading.interval = tick_interval(seconds)

    def schema(self, symbols: list[str], specs: list[FieldSpec], definitions: list[tuple[int, list[int]]], profile: Profile = Profile()) -> None:
        """Takes the place of any schema before."""
        self.state.schema = Schema.build(symbols, specs, definitions, profile, self.limits)

    def classes(self, entries: list[NetworkClass]) -> None:
        self.state.classes = Classes(entries, self.limits)
        self.state.tables.refresh()

    def create_table(self, table: StringTable, data: bytes, count: int, squeezed: bool = False) -> None:
        if self.state.tables.create(table, data, count, squeezed, self.limits):
            self.state.tables.refresh()

    def update_table(self, number: int, data: bytes, count: int) -> None:
        if self.state.tables.update(number, data, count, self.limits):
            self.state.tables.refresh()

    def overwrite_tables(self, snapshot: list[tuple[str, list[tuple[str | None, bytes | None]]]]) -> None:
        self.state.tables.overwrite(snapshot, self.limits)
        self.state.tables.refresh()

    def entities(self, message: Message) -> None:
        s = self.state
        if not s.ready:
            raise FormatError("entities come before their schema")
        # Changes before an error stay.
        for change in s.entities.apply(message, s.classes, s.schema, s.tables.baselines, self.reading, self.wanted):
            if change.op:
                s.changes.append(change)


def tick_interval(seconds: float) -> np.float32:
    if not (math.isfinite(seconds) and seconds > 0):
        raise FormatError(f"a tick of {seconds} seconds")
    return np.float32(seconds)


def signon(data: bytes, adapter: Adapter, interval: float = INTERVAL, limits: Limits = Limits()) -> tuple[State, int | None]:
    """The state before the first tick, of whatever classes, and where playback begins (none without a sync tick)."""
    state, start = State(tick_interval(interval)), None
    for offset, end, cmd, tick, squeezed, _, body in frames(data, limits):
        if cmd == STOP:
            break
        if cmd == SYNC_TICK:
            start = end
            break
        adapter.handle(Frame(offset, end, cmd, tick), decode(body, squeezed, limits), Context(state, limits))
    if not state.ready:
        raise FormatError("playback begins without a schema or without classes")
    state.tables.refresh()
    return state, start


def play(data: bytes, adapter: Adapter, state: State, start: int, until: int | None = None, wanted: frozenset[str] | None = None, limits: Limits = Limits()) -> Iterator[State]:
    """The state after each tick, from the command at start to the first one after tick `until`; a stop there is still read.

    A run of equal ticks is one tick; negative ones end runs and are not given last.
    """
    last, ended = None, False
    for offset, end, cmd, tick, squeezed, _, body in frames(data, limits, start):
        if until is not None and tick > until and cmd != STOP:
            break
        if last is not None and last != tick:
            yield state
            state.clear()
        last = state.tick = tick
        if cmd == STOP:
            ended = True
            if tick >= 0:
                yield state
            break
        adapter.handle(Frame(offset, end, cmd, tick), decode(body, squeezed, limits), Context(state, limits, wanted))
    if not ended and last is not None and last >= 0:
        yield state


@dataclass(frozen=True)
class Index:
    """Where playback begins, (offset, tick) of keyframes, and ticks, all between the first sync tick and the first stop."""

    start: int | None
    keyframes: tuple[tuple[int, int], ...]
    ticks: tuple[int, ...]

    def keyframe(self, tick: int) -> int | None:
        """The last keyframe at or before a tick, in the order of the file."""
        return next((at for at, t in reversed(self.keyframes) if t <= tick), None)

    def segments(self, most: int) -> list[tuple[int | None, int]]:
        """(offset or none for the start, tick before which it ends) of up to `most` stretches with near equal numbers of keyframes."""
        n = len(self.keyframes) + 1
        c = max(1, min(most, n))
        edge = [self.keyframes[i * n // c - 1] if i else None for i in range(c)]
        return [(edge[i] and edge[i][0], edge[i + 1][1] if i + 1 < c else LAST_TICK) for i in range(c)]


def index_of(data: bytes, limits: Limits = Limits()) -> Index:
    start, keys, ticks = None, [], []
    for offset, end, cmd, tick, *_ in frames(data, limits):
        if cmd == STOP:
            break
        if cmd == SYNC_TICK:
            start = end if start is None else start
        elif start is not None:
            if cmd == FULL_PACKET:
                keys.append((offset, tick))
            if tick >= 0 and ticks[-1:] != [tick]:
                ticks.append(tick)
    return Index(start, tuple(keys), tuple(ticks))


def segment_end(tick: int) -> int | None:
    """The last tick of a stretch that ends before `tick`; none where it has no end."""
    return None if tick == LAST_TICK else max(tick - 1, -(1 << 31))


class Prepared:
    """A recording whose beginning has been read once; sessions start from copies of that state."""

    def __init__(self, data: bytes, adapter: Adapter, interval: float = INTERVAL, limits: Limits = Limits()):
        state, start = signon(data, adapter, interval, limits)
        self.data, self.limits, self.index = data, limits, index_of(data, limits)
        if start != self.index.start:
            raise FormatError("two readings disagree on where playback begins")
        self.checkpoint = cloudpickle.dumps((state, adapter))

    def session(self) -> Session:
        return Session(self, *pickle.loads(self.checkpoint))


class Session:
    """A playback of its own; each of its runs uses it up."""

    def __init__(self, prepared: Prepared, state: State, adapter: Adapter):
        self.prepared, self.state, self.adapter = prepared, state, adapter

    def run(self, wanted: frozenset[str] | None = None) -> Iterator[State]:
        return self.segment(None, LAST_TICK, wanted)

    def segment(self, start: int | None, end: int, wanted: frozenset[str] | None = None) -> Iterator[State]:
        p = self.prepared
        at = p.index.start if start is None else start
        return iter(()) if at is None else play(p.data, self.adapter, self.state, at, segment_end(end), wanted, p.limits)

    def seek(self, tick: int) -> State:
        """The state at a tick: from the last keyframe at or before it."""
        p = self.prepared
        at = p.index.keyframe(tick)
        at = p.index.start if at is None else at
        for _ in () if at is None else play(p.data, self.adapter, self.state, at, tick, None, p.limits):
            pass
        return self.state


def seek(data: bytes, adapter: Adapter, tick: int, interval: float = INTERVAL, limits: Limits = Limits()) -> State:
    return Prepared(data, adapter, interval, limits).session().seek(tick)


_SLOT = {"bool": 0, "i32": 1, "i64": 1, "u32": 1, "u64": 2, "f32": 3, "string": 4}


def value_columns(value: tuple[str, object]) -> tuple:
    """A value as VALUE."""
    kind, x = value
    out: list = [None] * 6
    at = _SLOT.get(kind, 5)
    out[at] = float(x) if at == 3 else [float(y) for y in x] if at == 5 else x
    return kind, *out


def delta_rows(state: State, _: Adapter) -> Iterator[tuple]:
    """Rows of DELTAS after the demo's id: one for each change without a key, and one for each of its values."""
    seq = 0
    for c in state.changes:
        head = (c.index, c.op, c.class_id, c.class_name, c.decoded_serial)
        yield state.tick, seq, *head, None, None, None, None, *[None] * 7
        serializer = state.schema[c.class_name]
        for based, key, value in c.values:
            seq += 1
            yield state.tick, seq, *head, based, key, list(unpack(key)), serializer.name_of(key), *value_columns(value)
        seq += 1


def state_rows(state: State, _: Adapter) -> Iterator[tuple]:
    """Rows of STATES after the demo's id: every value of every entity, at rest or not; one without a key for each entity."""
    for e in state.entities:
        head = (state.tick, e.index, e.class_id, e.class_name, e.active)
        yield *head, None, None, None, *[None] * 7
        for key in sorted(e.fields):
            yield *head, key, list(unpack(key)), state.schema[e.class_name].name_of(key), *value_columns(e.fields[key])


def string_rows(state: State, _: Adapter) -> Iterator[tuple]:
    """Rows of STRINGS after the demo's id: the entries written in this tick, as they are after it, as often as they were written."""
    for number, t in enumerate(state.tables.tables):
        for at in t.dirty:
            yield state.tick, number, t.name, at, *t.entries[at]


Sink = Callable[[State, Adapter], Iterator[tuple]]


def _adapter(make: Callable[[], Adapter] | Adapter) -> Adapter:
    return make() if isinstance(make, type) else pickle.loads(cloudpickle.dumps(make))


def ticks(recordings: DataFrame, magic: bytes, adapter: Adapter | type, sink: Sink, ddl: str, wanted: set[str] | None = None, until: int | None = None, interval: float = INTERVAL, limits: Limits = Limits(), failfast: bool = True) -> DataFrame:
    """The rows that sink gives after each tick of recordings(demo_id, content), as ddl says; demo_id comes first.

    Only classes in wanted, where given, are kept. With until, playback ends with that tick. Without failfast, damage ends a recording and the
    ticks before it stand.
    """
    only = None if wanted is None else frozenset(wanted)

    def rows_of(name, data):
        try:
            header(data, magic)
            own = _adapter(adapter)
            state, start = signon(data, own, interval, limits)
            for now in () if start is None else play(data, own, state, start, until, only, limits):
                yield from ((name, *row) for row in sink(now, own))
        except (FormatError, EOFError) as e:
            if failfast:
                raise FormatError(f"{name}: {e}") from e

    return each_file(recordings, rows_of, ddl)


def deltas(recordings: DataFrame, magic: bytes, adapter: Adapter | type, **options) -> DataFrame:
    """All changes of entities, as DELTAS; seq counts within a tick."""
    return ticks(recordings, magic, adapter, delta_rows, DELTAS, **options)


def strings(recordings: DataFrame, magic: bytes, adapter: Adapter | type, **options) -> DataFrame:
    """Entries of string tables that ticks write, as STRINGS."""
    return ticks(recordings, magic, adapter, string_rows, STRINGS, **options)


def states_at(recordings: DataFrame, magic: bytes, adapter: Adapter | type, target: int, interval: float = INTERVAL, limits: Limits = Limits()) -> DataFrame:
    """The state of every recording at a tick, as STATES, replayed from the last keyframe at or before it."""

    def rows_of(name, data):
        header(data, magic)
        state = seek(data, own := _adapter(adapter), target, interval, limits)
        return ((name, *row) for row in state_rows(state, own))

    return each_file(recordings, rows_of, STATES)


def indexes(recordings: DataFrame, magic: bytes, limits: Limits = Limits()) -> DataFrame:
    """(demo_id, what, offset, tick) in the order of the file: start (tick null), ticks (offset null) and keyframes."""

    def rows_of(name, data):
        header(data, magic)
        found = index_of(data, limits)
        if found.start is not None:
            yield name, "start", found.start, None
        yield from ((name, "keyframe", at, tick) for at, tick in found.keyframes)
        yield from ((name, "tick", None, tick) for tick in found.ticks)

    return each_file(recordings, rows_of, "demo_id string, what string, offset bigint, tick int")


def segments(recordings: DataFrame, magic: bytes, adapter: Adapter | type, most: int, sink: Sink, ddl: str, wanted: set[str] | None = None, interval: float = INTERVAL, limits: Limits = Limits(), tasks: int | None = None) -> DataFrame:
    """As ticks(), in up to `most` stretches of each recording, each in a task of its own.

    The rows are those of ticks() where keyframes name every entity anew. A recording is cut where it is read; each stretch carries its own bytes and
    the checkpoint, compressed, so bytes travel once.
    """
    schema, only = arrow_schema(ddl), None if wanted is None else frozenset(wanted)
    pieces_ddl = "demo_id string, seg int, until int, start binary, body binary"

    def pieces(name, data):
        header(data, magic)
        prepared = Prepared(data, _adapter(adapter), interval, limits)
        checkpoint = zlib.compress(prepared.checkpoint, 1)
        for seg, (start, end) in enumerate(prepared.index.segments(most)):
            at, until, stop = prepared.index.start if start is None else start, segment_end(end), len(data)
            if at is None:
                return
            for offset, _, cmd, tick, *_ in frames(data, limits, at):
                if until is not None and tick > until and cmd != STOP:
                    stop = offset
                    break
            yield name, seg, until, checkpoint, data[at:stop]

    def replayed(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                name, _, until, start, body = (batch.column(i)[r].as_py() for i in range(5))
                state, own = pickle.loads(zlib.decompress(start))
                rows = ((name, *row) for now in play(bytes(HEADER_SIZE) + body, own, state, HEADER_SIZE, until, only, limits) for row in sink(now, own))
                yield from in_batches(rows, schema)

    cuts = each_file(recordings, pieces, pieces_ddl)
    return (cuts.repartition(tasks, "demo_id", "seg") if tasks else cuts.repartition("demo_id", "seg")).mapInArrow(replayed, ddl)
