"""Reading and writing numbers as bit strings, least significant bit first."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the formats: widths by the two selector bits of a variable number, and by the zeros before a path number's first one.
UBITVAR_MORE = (0, 4, 8, 28)
UBITVARFP_BITS = (2, 4, 10, 17, 31)
COORD_WHOLE, COORD_PARTS, NORMAL_PARTS = 14, 5, 11
F = np.float32


class BitReader:
    """A place in bytes, counted in bits. Reading past the end raises EOFError and leaves the place as it was."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def left(self) -> int:
        return self.end - self.at

    def peek(self, n: int) -> int:
        if n > self.end - self.at:
            raise EOFError(f"{n} bits needed, {self.end - self.at} left")
        first, shift = divmod(self.at, 8)
        return int.from_bytes(self.data[first : (self.at + n + 7) >> 3], "little") >> shift & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        return out

    def flag(self) -> bool:
        return bool(self.bits(1))

    def bytes(self, n: int) -> bytes:
        return self.bits(8 * n).to_bytes(n, "little")

    def uvarint(self, width: int = 32) -> int:
        """Seven bits a byte, five bytes at most for 32 bits and ten for 64; what exceeds the width is dropped."""
        start, out = self.at, 0
        try:
            for i in range(-(-width // 7)):
                byte = self.bits(8)
                out |= (byte & 0x7F) << (7 * i)
                if byte < 0x80:
                    break
        except EOFError:
            self.at = start
            raise
        return out & ((1 << width) - 1)

    def svarint(self, width: int = 32) -> int:
        """A signed number: even codes are not negative, odd ones are."""
        raw = self.uvarint(width)
        return (raw >> 1) ^ -(raw & 1)

    def ubitvar(self) -> int:
        head = self.peek(6)
        more = UBITVAR_MORE[head >> 4]
        if not more:
            return self.bits(6)
        whole = self.bits(6 + more)
        return whole & 15 | whole >> 6 << 4

    def ubitvarfp(self) -> int:
        start = self.at
        try:
            zeros = 0
            while zeros < 4 and not self.flag():
                zeros += 1
            return self.bits(UBITVARFP_BITS[zeros])
        except EOFError:
            self.at = start
            raise

    def float32(self) -> float:
        return struct.unpack("<f", self.bytes(4))[0]

    def text(self, most: int = 1 << 20) -> bytes:
        """Bytes up to a zero byte, which is read too."""
        out = bytearray()
        while byte := self.bits(8):
            if len(out) == most:
                raise ValueError(f"a string has over {most} bytes")
            out.append(byte)
        return bytes(out)

    def whole(self, size: int) -> int:
        """An unsigned number of `size` bytes."""
        return self.bits(8 * size)

    def seek(self, at: int) -> None:
        if not 0 <= at <= self.end:
            raise EOFError(f"place {at} is outside {self.end} bits")
        self.at = at

    def skip(self, n: int) -> None:
        self.seek(self.at + n)

    def bit_bytes(self, n: int) -> bytes:
        """n bits as bytes; the last byte holds what is left in its low bits."""
        return self.bits(n).to_bytes((n + 7) >> 3, "little")

    def coord(self) -> np.float32:
        """A coordinate: whole part (one more than it says), parts of 32, sign; neither part is zero."""
        has_whole, has_parts = self.flag(), self.flag()
        if not (has_whole or has_parts):
            return F(0)
        sign = F(-1 if self.flag() else 1)
        out = F(self.bits(COORD_WHOLE) + 1) if has_whole else F(0)
        return sign * (out + F(self.bits(COORD_PARTS)) * F(1 / 32) if has_parts else out)

    def normal(self) -> np.float32:
        sign = F(-1 if self.flag() else 1)
        return sign * (F(self.bits(NORMAL_PARTS)) * F(1 / 2047))

    def coords(self) -> list[np.float32]:
        return [self.coord() if there else F(0) for there in [self.flag() for _ in range(3)]]

    def normals(self) -> list[np.float32]:
        """Two components and the sign of the third, which makes the length one."""
        x, y = [self.normal() if there else F(0) for there in [self.flag() for _ in range(2)]]
        sign, rest = self.flag(), F(1) - x * x - y * y
        z = np.sqrt(rest) if rest > 0 else F(0)
        return [x, y, -z if sign else z]

    def angle(self, n: int) -> np.float32:
        """Degrees from n bits, below 360."""
        return F(self.bits(n)) * F(360) / F(1 << n)


class BitWriter:
    """The inverse of BitReader."""

    def __init__(self):
        self.value, self.at = 0, 0
        self.done = bytearray()

    def bits(self, value: int, n: int) -> BitWriter:
        self.value |= (value & ((1 << n) - 1)) << self.at
        self.at += n
        if self.at >= 4096:
            whole = self.at // 8
            self.done += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.at -= 8 * whole
        return self

    def flag(self, value: bool) -> BitWriter:
        return self.bits(int(value), 1)

    def bytes(self, data: bytes) -> BitWriter:
        return self.bits(int.from_bytes(data, "little"), 8 * len(data))

    def uvarint(self, value: int) -> BitWriter:
        while value > 127:
            self.bits(value & 127 | 128, 8)
            value >>= 7
        return self.bits(value, 8)

    def svarint(self, value: int) -> BitWriter:
        return self.uvarint(2 * value if value >= 0 else -2 * value - 1)

    def ubitvar(self, value: int) -> BitWriter:
        which = next(i for i, more in enumerate(UBITVAR_MORE) if value < 1 << (4 + more))
        return self.bits(value & 15 | which << 4, 6).bits(value >> 4, UBITVAR_MORE[which])

    def ubitvarfp(self, value: int) -> BitWriter:
        zeros = next(i for i, n in enumerate(UBITVARFP_BITS) if value < 1 << n)
        return self.bits(1 << zeros if zeros < 4 else 0, min(zeros + 1, 4)).bits(value, UBITVARFP_BITS[zeros])

    def float32(self, value: float) -> BitWriter:
        return self.bytes(struct.pack("<f", value))

    def text(self, value: bytes) -> BitWriter:
        return self.bytes(value + b"\0")

    def data(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.at + 7) >> 3, "little")
