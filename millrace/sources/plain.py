"""Recordings that this package writes itself, and the adapter that reads them: a neutral game, for round trips and tests.

Schemas, classes and whole string tables are JSON. A packet's messages are a type and a payload: a line of JSON, then bits.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa

from millrace.functions.bits import BitWriter
from millrace.functions.paths import write_paths
from millrace.operators.entities import SERIAL_BITS, Message
from millrace.operators.replay import Context, Frame
from millrace.operators.schema import FieldSpec, NetworkClass, Profile
from millrace.operators.tables import HISTORY, PREFIX_BITS, StringTable
from millrace.sources.recordings import COMPRESSED

MAGIC = b"MILLRACE"
CREATE_TABLE, UPDATE_TABLE, ENTITIES = 1, 2, 55


class PlainAdapter:
    """Reads what the functions below write."""

    def handle(self, frame: Frame, body: bytes, context: Context) -> None:
        if frame.cmd == 4:
            s = json.loads(body)
            context.schema(s["symbols"], [FieldSpec(**f) for f in s["fields"]], [(n, f) for n, f in s["serializers"]], Profile(**s.get("profile", {})))
        elif frame.cmd == 5:
            context.classes([NetworkClass(*c) for c in json.loads(body)])
        elif frame.cmd == 6:
            data = lambda x: None if x is None else base64.b64decode(x)
            context.overwrite_tables([(name, [(k, data(d)) for k, d in entries]) for name, entries in json.loads(body)])
        elif frame.cmd in (7, 8, 13):
            for kind, payload in context.messages(body):
                head, _, data = payload.partition(b"\n")
                said = json.loads(head) if kind in (CREATE_TABLE, UPDATE_TABLE, ENTITIES) else {}
                if kind == CREATE_TABLE:
                    fixed = tuple(said["fixed"]) if said.get("fixed") else None
                    context.create_table(StringTable(said["name"], fixed, said.get("flags", 0), said.get("variable", False)), data, said["count"], said.get("squeezed", False))
                elif kind == UPDATE_TABLE:
                    context.update_table(said["table"], data, said["count"])
                elif kind == ENTITIES:
                    context.entities(Message(said["count"], data, said.get("visibility", False)))


def _number(n: int) -> bytes:
    return BitWriter().uvarint(n & 0xFFFFFFFF).data()


def command(cmd: int, tick: int, body: bytes = b"", squeeze: bool = False) -> bytes:
    body = pa.compress(body, "snappy", asbytes=True) if squeeze else body
    return _number(cmd | (COMPRESSED if squeeze else 0)) + _number(tick) + _number(len(body)) + body


def recording(commands: Iterable[bytes], magic: bytes = MAGIC, info: int = 0, spawn: int = 0) -> bytes:
    """A whole file. info and spawn are offsets; 0 is none."""
    return magic + info.to_bytes(4, "little") + spawn.to_bytes(4, "little") + b"".join(commands)


def packet(messages: Iterable[tuple[int, bytes]]) -> bytes:
    """Messages one after another without regard to bytes; a byte at the end is none."""
    w = BitWriter()
    for kind, payload in messages:
        w.ubitvar(kind).uvarint(len(payload)).bytes(payload)
    return w.data()


def message(kind: int, data: bytes, **said) -> tuple[int, bytes]:
    return kind, json.dumps(said).encode() + b"\n" + data


def schema(symbols: Sequence[str], fields: Sequence[dict], serializers: Sequence[tuple[int, Sequence[int]]], **profile) -> bytes:
    return json.dumps({"symbols": list(symbols), "fields": list(fields), "serializers": [[n, list(f)] for n, f in serializers], "profile": profile}).encode()


def simple_schema(classes: dict[str, Sequence[tuple[str, str]]]) -> tuple[bytes, bytes]:
    """Bodies of a schema and of its classes, numbered in order, from (name, type) of each class's fields."""
    symbols = list(dict.fromkeys(x for name, fields in classes.items() for x in (name, *(y for f in fields for y in f))))
    at, specs, definitions = {s: i for i, s in enumerate(symbols)}, [], []
    for name, fields in classes.items():
        definitions.append((at[name], range(len(specs), len(specs) + len(fields))))
        specs += [{"name_sym": at[n], "type_sym": at[t]} for n, t in fields]
    return schema(symbols, specs, definitions), json.dumps([[i, n, n] for i, n in enumerate(classes)]).encode()


def table_entries(entries: Sequence[tuple[int, bytes | None, bytes | None]], fixed: tuple[int, int] | None = None, flags: int = 0, variable: bool = False) -> bytes:
    """Entries (place, string, data) in ascending order of place; strings that begin as one of the last did say so."""
    w, past, last = BitWriter(), [], -1
    for at, string, data in entries:
        w.flag(at == last + 1)
        if at != last + 1:
            w.uvarint(at - 1)
        last = at
        w.flag(string is not None)
        if string is not None:
            prefix = lambda other: next((i for i, (x, y) in enumerate(zip(other, string)) if x != y), min(len(other), len(string)))
            recent = past[-HISTORY:] if len(past) > HISTORY else past
            best = max(range(len(recent)), key=lambda i: prefix(recent[i]), default=None)
            shared = min(prefix(recent[best]), (1 << PREFIX_BITS) - 1) if best is not None else 0
            w.flag(shared > 0)
            if shared:
                w.bits(best, 5).bits(shared, PREFIX_BITS)
            w.text(string[shared:])
            past.append(string)
        w.flag(data is not None)
        if data is not None:
            if fixed:
                w.bits(int.from_bytes(data, "little"), fixed[1])
                continue
            if flags & 1:
                w.flag(True)
                data = pa.compress(data, "snappy", asbytes=True)
            if variable:
                w.ubitvar(len(data))
            else:
                w.bits(len(data), 17)
            w.bytes(data)
    return w.data()


def _value(w: BitWriter, kind: str, value) -> None:
    {
        "bool": w.flag, "int64": w.svarint, "uint64": w.uvarint, "float32": lambda x: w.float32(float(np.float32(x))), "CUtlString": lambda x: w.text(x.encode()),
    }[kind](value)


def entity_changes(changes: Sequence[tuple[int, str, int, Sequence[tuple[tuple[int, ...], str, object]]]], class_bits: int = 1) -> bytes:
    """Bits of (slot, op, class, [(path, type, value)]), slots ascending; op is create, update, leave or delete."""
    w, last = BitWriter(), -1
    for index, op, kind, values in changes:
        w.ubitvar(index - last - 1)
        last = index
        w.bits({"update": 0, "leave": 1, "create": 2, "delete": 3}[op], 2)
        if op == "create":
            w.bits(kind, class_bits).bits(7, SERIAL_BITS).uvarint(0)
        if op in ("create", "update"):
            write_paths(w, [path for path, _, _ in values])
            for _, type_name, value in values:
                _value(w, type_name, value)
    return w.data()
