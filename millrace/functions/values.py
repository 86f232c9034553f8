"""Value functions as columns: coordinates, handles, quantized numbers, angles and integer codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of an entity handle that hold the index; the largest index means none.
HANDLE_BITS = 14
NO_HANDLE = 0x00FFFFFF
#: Width of a world cell and the offset of the world's origin.
CELL_WIDTH, WORLD_ORIGIN = 512, 16384


def cell_to_world(cell: Column, offset: Column) -> Column:
    """A position from a cell number and an offset in it, in single precision."""
    return (cell.cast("float") * F.lit(CELL_WIDTH).cast("float") - F.lit(WORLD_ORIGIN).cast("float") + offset.cast("float")).cast("float")


def handle_index(handle: Column, bits: int = HANDLE_BITS) -> Column:
    """The slot that a handle names; null for none."""
    return F.when(handle != NO_HANDLE, handle.bitwiseAND(F.lit((1 << bits) - 1)))


def dequantize(raw: Column, bits: int, low: float, high: float) -> Column:
    """A number of `bits` bits spread over low..high, in single precision."""
    step = (F.lit(1.0).cast("float") / F.lit(float((1 << bits) - 1)).cast("float")).cast("float")
    span = F.lit(high - low).cast("float")
    return (F.lit(low).cast("float") + span * (raw.cast("float") * step).cast("float")).cast("float")


def bit_angle(raw: Column, bits: int) -> Column:
    """Degrees in -180..180 from a number of `bits` bits, in single precision."""
    turned = (raw.cast("float") * F.lit(360.0).cast("float")).cast("float")
    return ((turned / F.lit(float(1 << bits)).cast("float")).cast("float") - F.lit(180.0).cast("float")).cast("float")


def uvarint_length(value: Column) -> Column:
    """Bytes of a non-negative number in seven-bit groups."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(value < F.lit(1 << (7 * n)).cast("bigint"), n).otherwise(out)
    return out


def zigzag(value: Column) -> Column:
    return F.when(value >= 0, value * 2).otherwise(-value * 2 - 1)


def class_bits(largest: Column) -> Column:
    """Bits that hold every class number up to the largest, one at least."""
    return F.greatest(F.lit(1), (F.floor(F.log2(largest)) + 1).cast("int"))
