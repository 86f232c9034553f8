"""Recordings as tables: file headers, commands and packet messages.

A file is a header of 16 bytes, then commands: number and flag, tick, size (seven-bit groups), body. Files are read by Spark's binary reader, so
from any store; each is framed where it is read, and bodies are dropped there unless asked for. Later work is spread by command, not by file.
The header begins with eight bytes that tell recordings from other files; callers name them, as they name their game's other conventions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.bits import BitReader
from millrace.limits import FormatError, Limits

__all__ = ["COMMAND_TYPES", "FormatError", "Limits", "commands", "decode", "files", "frames", "header", "headers", "messages", "metadata"]

#: Fixed values of the format.
HEADER_SIZE = 16
COMPRESSED = 64
COMMAND_TYPES = {
    0: "Stop", 1: "FileHeader", 2: "FileInfo", 3: "SyncTick", 4: "SendTables", 5: "ClassInfo", 6: "StringTables", 7: "Packet", 8: "SignonPacket", 9: "ConsoleCmd",
    10: "CustomData", 11: "CustomDataCallbacks", 12: "UserCmd", 13: "FullPacket", 14: "SaveGame", 15: "SpawnGroups", 16: "AnimationData", 17: "AnimationHeader", 18: "Recovery",
}

COMMANDS = "demo_id string, idx bigint, offset bigint, end_offset bigint, cmd int, command_type string, tick int, compressed boolean, header_size bigint, encoded_size bigint, decoded_size bigint, compression_ratio double, body binary, error string"
MESSAGES = "demo_id string, idx bigint, msg bigint, bit_offset bigint, payload_bit_offset bigint, end_bit_offset bigint, message_type bigint, encoded_size bigint, aligned boolean, payload binary, error string"
HEADERS = "demo_id string, file_size bigint, file_info_offset bigint, spawn_groups_offset bigint, error string"
_ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "float": pa.float32(),
    "decimal(20,0)": pa.decimal128(20, 0), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


_SIZED = frozenset((bytes, bytearray, str, list))


def weight(row: tuple) -> int:
    """About the bytes that a row takes in Python."""
    return 64 * len(row) + sum(len(x) for x in row if type(x) in _SIZED)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, room: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about `room` bytes, one row at least."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size > room:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def header(data: bytes, magic: bytes, size: int | None = None) -> tuple[int | None, int | None]:
    """Offsets of file information and spawn groups; null where absent. size is the file's, where data is only its beginning."""
    size = len(data) if size is None else size
    if len(data) < HEADER_SIZE:
        raise FormatError(f"a header has {HEADER_SIZE} bytes, not {len(data)}")
    if data[: len(magic)] != magic:
        raise FormatError("the magic bytes are missing")
    out = [int.from_bytes(data[i : i + 4], "little") or None for i in (8, 12)]
    for x in out:
        if x is not None and not HEADER_SIZE <= x < size:
            raise FormatError(f"the header names offset {x} of {size}")
    return out[0], out[1]


def decoded_size(body: bytes) -> int:
    """The size that a Snappy block says it has."""
    return BitReader(body).uvarint()


def decode(body: bytes, compressed: bool, limits: Limits) -> bytes:
    if not compressed:
        return body
    size = decoded_size(body)
    if size > limits.decoded:
        raise FormatError(f"a body of {size} bytes exceeds {limits.decoded}")
    return pa.decompress(body, size, "snappy", asbytes=True) if size else b""


def frames(data: bytes, limits: Limits, start: int = HEADER_SIZE) -> Iterator[tuple]:
    """(offset, end, cmd, tick, compressed, header size, encoded body) of each command from start to the end of the file, stop commands included."""
    if not HEADER_SIZE <= start <= len(data):
        raise FormatError(f"offset {start} is outside the commands")
    view, at = memoryview(data), start
    while at < len(data):
        head = BitReader(bytes(view[at : at + 15]))
        kind, tick, size = head.uvarint(), head.uvarint(), head.uvarint()
        body = at + head.at // 8
        if size > limits.body:
            raise FormatError(f"a body of {size} bytes exceeds {limits.body}")
        if size > len(data) - body:
            raise FormatError(f"a body of {size} bytes ends after the file")
        yield at, body + size, kind & ~COMPRESSED, tick - (tick >> 31 << 32), bool(kind & COMPRESSED), body - at, bytes(view[body : body + size])
        at = body + size


def files(spark: SparkSession, path: str) -> DataFrame:
    """(demo_id, content) of each file under a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("demo_id"), "content")


def each_file(recordings: DataFrame, rows_of, ddl: str) -> DataFrame:
    """The rows that rows_of gives for each recording's id and bytes."""
    schema = arrow_schema(ddl)

    def each(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from in_batches(rows_of(name, data.as_py() or b""), schema)

    return recordings.select(F.col("demo_id").cast("string"), "content").mapInArrow(each, ddl)


def headers(recordings: DataFrame, magic: bytes) -> DataFrame:
    """HEADERS of recordings(demo_id, content); what is no recording has an error. Only the first bytes of a file reach Python."""
    schema = arrow_schema(HEADERS)

    def row_of(name, size, start):
        try:
            return name, size, *header(start or b"", magic, size), None
        except FormatError as e:
            return name, size, None, None, str(e)

    def each(batches):
        for batch in batches:
            yield from in_batches((row_of(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(3)))), schema)

    begun = recordings.select(F.col("demo_id").cast("string"), F.octet_length("content").cast("bigint").alias("size"), F.substring("content", 1, HEADER_SIZE).alias("start"))
    return begun.mapInArrow(each, HEADERS)


def commands(recordings: DataFrame, magic: bytes, bodies: bool = True, limits: Limits = Limits(), start: int = HEADER_SIZE, failfast: bool = True) -> DataFrame:
    """The commands of recordings(demo_id, content), as COMMANDS says; bodies are decoded where asked for, else only the sizes they say they have are read.

    At damage or a limit the query fails, or, without failfast, a last row of the file has the error and nulls. A file without commands has no rows.
    """

    def rows_of(name, data):
        idx = 0
        try:
            header(data, magic)
            for offset, end, cmd, tick, squeezed, head, body in frames(data, limits, start):
                whole = decode(body, squeezed, limits) if bodies else None
                size = len(whole) if bodies else decoded_size(body) if squeezed else len(body)
                yield name, idx, offset, end, cmd, COMMAND_TYPES.get(cmd, "Unknown"), tick, squeezed, head, len(body), size, len(body) / size if size else None, whole, None
                idx += 1
        except (FormatError, EOFError, pa.ArrowException, OSError) as e:
            if failfast:
                raise FormatError(f"{name}, command {idx}: {e}") from e
            yield name, idx, *[None] * 11, str(e)

    return each_file(recordings, rows_of, COMMANDS)


def metadata(recordings: DataFrame, magic: bytes, limits: Limits = Limits()) -> DataFrame:
    """(demo_id, what, cmd, tick, body): the commands that a header's offsets name, without a scan of those before; what is file_info or spawn_groups."""

    def rows_of(name, data):
        for what, at in zip(("file_info", "spawn_groups"), header(data, magic)):
            if at is not None:
                _, _, cmd, tick, squeezed, _, body = next(frames(data, limits, at))
                yield name, what, cmd, tick, decode(body, squeezed, limits)

    return each_file(recordings, rows_of, "demo_id string, what string, cmd int, tick int, body binary")


def message_frames(data: bytes, limits: Limits = Limits()) -> Iterator[tuple]:
    """(bit offset, payload's, end's, type, size, aligned, payload) of each message of a packet; eight bits or fewer at the end are padding."""
    r = BitReader(data)
    while r.left() > 8:
        begin = r.at
        kind, size = r.ubitvar(), r.uvarint()
        if size > limits.message:
            raise FormatError(f"a message of {size} bytes exceeds {limits.message}")
        at = r.at
        yield begin, at, at + 8 * size, kind, size, at % 8 == 0, r.bytes(size)


def messages(packets: DataFrame, limits: Limits = Limits(), failfast: bool = True) -> DataFrame:
    """The messages of packets(demo_id, idx, body), as MESSAGES says. A null or empty body has none; damage is treated as in commands()."""
    schema = arrow_schema(MESSAGES)

    def rows_of(demo, idx, body):
        n = 0
        try:
            for x in message_frames(body or b"", limits):
                yield demo, idx, n, *x, None
                n += 1
        except (FormatError, EOFError) as e:
            if failfast:
                raise FormatError(f"{demo}, command {idx}, message {n}: {e}") from e
            yield demo, idx, n, *[None] * 7, str(e)

    def each(batches):
        for batch in batches:
            rows = (row for r in zip(*(batch.column(c).to_pylist() for c in ("demo_id", "idx", "body"))) for row in rows_of(*r))
            yield from in_batches(rows, schema)

    return packets.select(F.col("demo_id").cast("string").alias("demo_id"), F.col("idx").cast("bigint").alias("idx"), "body").mapInArrow(each, MESSAGES)
