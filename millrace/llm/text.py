"""Words, as columns and as Python: both follow the same rules."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
#: ASCII characters that are neither digits nor letters.
MARKS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts without other alphabets take the quick way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _words(text: Column, separators: str, pattern: str) -> Column:
    inner = F.btrim(text, F.lit(separators))
    return F.when(F.length(inner) > 0, F.split(inner, pattern)).otherwise(F.array().cast("array<string>"))


def space_words(text: Column) -> Column:
    """Runs of anything but ASCII white space. Null has none."""
    return _words(F.coalesce(text, F.lit("")), SPACES, r"[\x20\x09-\x0D]+")


def mark_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and anything beyond ASCII. Null has none."""
    return _words(lower_ascii(F.coalesce(text, F.lit(""))), MARKS, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class WordHashes(dict):
    """64-bit hashes of words, the same on every machine; forgets all when it holds too many."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def split_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space, as space_words does."""
    return (text or "").encode("utf-8", "replace").lower().split()


_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _SHIFT)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _SHIFT)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> _SHIFT)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; of fewer words, the whole sequence as one; of none, none."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.full(n, np.uint64(min(k, len(words))), dtype=np.uint64)
    for i in range(min(k, len(words))):
        out = mix(out * _ODD + words[i : i + n])
    return out
