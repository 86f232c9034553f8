"""String tables: numbered entries of an optional string and optional data, made, changed and overwritten by messages."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa

from millrace.functions.bits import BitReader
from millrace.limits import FormatError, Limits

#: Fixed values of the format.
HISTORY, PREFIX_BITS, KEY_BYTES, DATA_BITS = 32, 5, 1024, 17
BASELINES = "instancebaseline"


def unsnap(data: bytes, limits: Limits, what: str) -> bytes:
    size = BitReader(data).uvarint()
    limits.need(what, size)
    try:
        return pa.decompress(data, size, "snappy", asbytes=True) if size else b""
    except (pa.ArrowException, OSError) as e:
        raise FormatError(f"what should be compressed is not: {e}") from e


@dataclass
class StringTable:
    name: str
    fixed: tuple[int, int] | None = None
    """Bytes and bits of an entry's data where all are alike."""
    flags: int = 0
    variable_sizes: bool = False
    entries: list[list] = field(default_factory=list)
    """[string, data] each."""
    dirty: list[int] = field(default_factory=list)
    """Entries written since the last tick, as often as they were."""

    def put(self, at: int, string: str | None, data: bytes | None) -> None:
        """Writes what is there and leaves the rest; entries before it come to be."""
        while len(self.entries) <= at:
            self.entries.append([None, None])
        old = self.entries[at]
        self.entries[at] = [old[0] if string is None else string, old[1] if data is None else data]
        self.dirty.append(at)

    def read(self, data: bytes, count: int, limits: Limits) -> None:
        """Applies `count` coded entries."""
        if count < 0:
            raise FormatError(f"a string table with {count} entries")
        limits.need("table_entries", count)
        r, at, keys = BitReader(data), -1, _Keys()
        for _ in range(count):
            at = at + 1 if r.flag() else r.uvarint() + 1
            limits.need("table_entries", at + 1)
            string = keys.read(r) if r.flag() else None
            self.put(at, string, self._data(r, limits) if r.flag() else None)

    def _data(self, r: BitReader, limits: Limits) -> bytes:
        scratch = 1 << DATA_BITS
        if self.fixed:
            size, bits = self.fixed
            need = max(size, (bits + 7) // 8) if min(size, bits) >= 0 else scratch + 1
            limits.need("entry", need)
            if need > scratch:
                raise FormatError(f"{need} bytes of data exceed {scratch}")
            return r.bit_bytes(bits)[:size].ljust(size, b"\0")
        squeezed = bool(self.flags & 1) and r.flag()
        size = r.ubitvar() if self.variable_sizes else r.bits(DATA_BITS)
        limits.need("entry", size)
        if size > scratch:
            raise FormatError(f"{size} bytes of data exceed {scratch}")
        out = r.bytes(size)
        return unsnap(out, limits, "entry") if squeezed else out


class _Keys:
    """Strings that may begin as one of the last ones did."""

    def __init__(self):
        self.past: list[bytes] = [b""] * HISTORY
        self.count = 0

    def read(self, r: BitReader) -> str:
        start = b""
        if r.flag():
            oldest = self.count % HISTORY if self.count > HISTORY else 0
            past = self.past[(oldest + r.bits(5)) % HISTORY]
            start = past.ljust(HISTORY, b"\0")[: r.bits(PREFIX_BITS)]
        out = (start + r.text(r.end))[:KEY_BYTES]
        self.past[self.count % HISTORY] = out[:HISTORY]
        self.count += 1
        return out.decode("utf-8", "replace")


class StringTables:
    def __init__(self):
        self.tables: list[StringTable] = []
        self.baselines: dict[int, bytes] = {}

    def named(self, name: str) -> StringTable | None:
        """The first table of that name."""
        return next((t for t in self.tables if t.name == name), None)

    def numbered(self, number: int) -> StringTable:
        if not 0 <= number < len(self.tables):
            raise FormatError(f"there is no string table {number}")
        return self.tables[number]

    def create(self, table: StringTable, data: bytes, count: int, squeezed: bool = False, limits: Limits = Limits()) -> bool:
        """Adds a table; whether it is the one of baselines."""
        limits.need("table", len(data))
        table.read(unsnap(data, limits, "table_decoded") if squeezed else data, count, limits)
        self.tables.append(table)
        return table.name == BASELINES

    def update(self, number: int, data: bytes, count: int, limits: Limits = Limits()) -> bool:
        limits.need("table", len(data))
        table = self.numbered(number)
        table.read(data, count, limits)
        return table.name == BASELINES

    def overwrite(self, snapshot: Iterable[tuple[str, Sequence[tuple[str | None, bytes | None]]]], limits: Limits = Limits()) -> None:
        """Applies whole tables by name: entries that exist take new data and keep their string, others are added; unknown tables are left out."""
        for name, entries in snapshot:
            limits.need("table_entries", len(entries))
            table = self.named(name)
            for at, (string, data) in enumerate(entries if table else ()):
                new = at >= len(table.entries)
                if new or data is not None:
                    table.put(at, string if new else None, data)

    def refresh(self) -> None:
        """Takes over baselines: data of entries whose string is a class number. None is ever removed."""
        for string, data in (self.named(BASELINES) or StringTable("")).entries:
            if string is not None and data is not None and string.removeprefix("+").removeprefix("-").isdigit() and string.isascii():
                number = int(string)
                if -(1 << 31) <= number < 1 << 31:
                    self.baselines[number] = data

    def clear(self) -> None:
        for t in self.tables:
            t.dirty.clear()
