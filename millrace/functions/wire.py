"""Codecs of field values: each reads one value from a BitReader as (kind, value).

Kinds are the columns' tags: bool, i32, i64, u64, f32, string (bytes), vector2, vector3, vector4, floats and qangle. Numbers are in single precision
where the format's are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from millrace.functions.bits import BitReader
from millrace.limits import FormatError, Limits

F = np.float32
#: Fixed values of quantized numbers: flags, and the factors by which a scale steps back until its product fits.
ROUND_DOWN, ROUND_UP, ZERO, WHOLE = 1, 2, 4, 8
BACK = (0.9999, 0.99, 0.9, 0.8, 0.7)
#: Bits of an angle component of the precise form.
PRECISE = 20


@dataclass
class Reading:
    """What codecs need besides bits: seconds of a tick, and limits (none where values are skipped)."""

    interval: np.float32 = field(default_factory=lambda: F(1 / 64))
    limits: Limits | None = field(default_factory=Limits)


Codec = Callable[[BitReader, Reading], tuple[str, object]]


class Quantized:
    """A number in low..high on a grid of 2^bits steps, with up to three values that have a bit of their own."""

    def __init__(self, bits: int, flags: int, low: float, high: float):
        if not 0 < bits < 32:
            raise FormatError(f"a quantized number of {bits} bits")
        low, high = F(low), F(high)
        flags = self._settle(flags, low, high)
        part = (high - low) / F(1 << bits)
        if flags & ROUND_DOWN:
            high = high - part
        elif flags & ROUND_UP:
            low = low + part
        if flags & WHOLE:
            # Kept as the format has it: low less high, so one wherever low does not exceed high.
            span = 1 << max(1, int(low) - int(high)).bit_length()
            bits = max(bits, span.bit_length() - 1)
            if bits > 31:
                raise FormatError(f"a quantized number of {bits} bits")
            high = low + F(span) - F(span) / F(1 << bits)
        self.bits, self.low, self.high = bits, low, high
        self.scale, self.step = self._scale((1 << bits) - 1, float(high - low)), F(1) / F((1 << bits) - 1)
        for flag, value in ((ROUND_DOWN, low), (ROUND_UP, high), (ZERO, F(0))):
            if flags & flag and self.nearest(value) == value:
                flags &= ~flag  # the grid has the value itself
        self.own = [value for flag, value in ((ROUND_DOWN, low), (ROUND_UP, high), (ZERO, F(0))) if flags & flag]
        self.flags = flags

    @staticmethod
    def _settle(flags: int, low: np.float32, high: np.float32) -> int:
        """Flags without those that say nothing, with zero at an end of the range as rounding to that end."""
        if low == 0 and flags & ROUND_DOWN or high == 0 and flags & ROUND_UP:
            flags &= ~ZERO
        for end, rounding in ((low, ROUND_DOWN), (high, ROUND_UP)):
            if end == 0 and flags & ZERO:
                flags = flags & ~ZERO | rounding
        if not low < 0 < high:
            flags &= ~ZERO
        return flags & WHOLE if flags & WHOLE else flags

    @staticmethod
    def _scale(top: int, span: float) -> np.float32:
        out = F(top) if abs(F(span)) <= F(0.001) else F(top / span)
        for back in BACK:
            if float(out) * span <= top:
                break
            out = F(top / span) * F(back)
        return out

    def at(self, step: int) -> np.float32:
        return self.low + (self.high - self.low) * (F(step) * self.step)

    def nearest(self, value: np.float32) -> np.float32:
        inside = min(max(value, self.low), self.high)
        return self.at(int((inside - self.low) * self.scale))

    def __call__(self, r: BitReader, _: Reading) -> tuple[str, np.float32]:
        for value in self.own:
            if r.flag():
                return "f32", value
        return "f32", self.at(r.bits(self.bits))


def _of(kind: str, get: Callable[[BitReader], object]) -> Codec:
    return lambda r, _: (kind, get(r))


def _blob(r: BitReader, ctx: Reading) -> tuple[str, bytes]:
    size = r.uvarint()
    if ctx.limits:
        ctx.limits.need("text", size)
    return "string", r.bytes(size)


def _ammo(r: BitReader) -> int:
    raw = r.uvarint()
    return max(raw - 1, 0) - (max(raw - 1, 0) >> 31 << 32)


def _poly(r: BitReader) -> bool:
    there = r.flag()
    r.ubitvar()  # which type it is
    return there


def _text(r: BitReader, ctx: Reading) -> tuple[str, bytes]:
    return "string", r.text(ctx.limits.text if ctx.limits else r.end)


BOOL, I64, U64, FIXED64 = _of("bool", BitReader.flag), _of("i64", lambda r: r.svarint(64)), _of("u64", lambda r: r.uvarint(64)), _of("u64", lambda r: r.whole(8))
FLOAT, COORD, NORMAL = _of("f32", lambda r: F(r.float32())), _of("f32", BitReader.coord), _of("f32", BitReader.normal)
TEXT, BLOB, AMMO, POLY = _text, _blob, _of("i32", _ammo), _of("bool", _poly)
NORMALS, ANGLE_COORDS = _of("vector3", BitReader.normals), _of("qangle", BitReader.coords)


def simulation_time(r: BitReader, ctx: Reading) -> tuple[str, np.float32]:
    return "f32", F(r.uvarint()) * ctx.interval


def several(kind: str, n: int, inner: Codec) -> Codec:
    """n numbers one after another; what is no float counts as 0."""

    def read(r: BitReader, ctx: Reading) -> tuple[str, list]:
        found = [inner(r, ctx) for _ in range(n)]
        return kind, [value if k == "f32" else F(0) for k, value in found]

    return read


def angles(bits: int, n: int = 3) -> Codec:
    """n components of `bits` bits each; the others are 0."""
    return _of("qangle", lambda r: [r.angle(bits) for _ in range(n)] + [F(0)] * (3 - n))


def precise_angles(centred: bool) -> Codec:
    turn = F(180 if centred else 0)
    return _of("qangle", lambda r: [r.angle(PRECISE) - turn if there else F(0) for there in [r.flag() for _ in range(3)]])
