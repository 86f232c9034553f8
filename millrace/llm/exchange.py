"""Counts of all n-grams of a corpus, returned to the texts that hold them, in one exchange.

Texts are dealt into blocks of about BLOCK bytes. Each block sends the distinct n-grams of its texts, sorted and packed, to shards, which are ranges of hashes and
so pieces of what is sorted (a block's work does not grow with the number of shards), with how often its training texts hold them; a shard adds these up and answers each block, in the order asked, with how many more the others hold. So an n-gram travels once
for each block, however common it is, and an answer is a small number without its key, mostly 0. Single words are told apart by 64-bit hashes; longer ones by
as many bits as the corpus's size asks for: one in 2^SPARE of them shares its key with another.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.ngrams import END, START
from millrace.llm.text import WordHashes, lower_ascii, mix, split_words

BLOCK, SHARD_TOKENS, SPARE = 9 << 20, 2_000_000, 10
_ODD, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Levels of compression for what travels, and for what is kept and read twice.
QUICK, DENSE = 1, 6


@lru_cache(maxsize=None)
def _codec(level: int = QUICK) -> pa.Codec:
    return pa.Codec("zstd", compression_level=level)


def squeeze(x: np.ndarray, level: int = QUICK) -> bytes:
    """Whole numbers that are not negative, mostly small: byte by byte of all of them, each such plane compressed by itself."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 0
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    parts = [_codec(level).compress(p.tobytes(), asbytes=True) for p in planes]
    return len(x).to_bytes(4, "little") + b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def spread(data: bytes) -> np.ndarray:
    n, at = int.from_bytes(data[:4], "little"), 4
    wide = np.zeros((n, 8), np.uint8)
    for plane in range(8):
        if at == len(data):
            break
        size = int.from_bytes(data[at : at + 4], "little")
        wide[:, plane] = np.frombuffer(_codec().decompress(data[at + 4 : at + 4 + size], n, asbytes=True), np.uint8)
        at += 4 + size
    return wide.view(np.int64).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as steps, byte by byte of all steps, the empty high bytes left out."""
    if not len(keys):
        return b"\0"
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width].T
    # Of the highest plane most is zero, so it is compressed; the others are noise.
    return bytes([width]) + len(keys).to_bytes(4, "little") + planes[:-1].tobytes() + _codec().compress(planes[-1].tobytes(), asbytes=True)


def unpack_sorted(data: bytes) -> np.ndarray:
    if data == b"\0":
        return np.zeros(0, np.uint64)
    width, n = data[0], int.from_bytes(data[1:5], "little")
    wide = np.zeros((n, 8), np.uint8)
    at = 5 + n * (width - 1)
    wide[:, : width - 1] = np.frombuffer(data[5:at], np.uint8).reshape(width - 1, n).T
    wide[:, width - 1] = np.frombuffer(_codec().decompress(data[at:], n, asbytes=True), np.uint8)
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def edges(bits: int, shards: int) -> list[int]:
    """Where the keys of each shard begin, of keys of so many bits; hashes fill the ranges evenly."""
    return [-(-(s << bits) // shards) for s in range(shards)]


def cuts(keys: np.ndarray, begin: list[int]) -> list[int]:
    """Where in ascending keys each shard's begin, and the end."""
    return [*np.searchsorted(keys, np.array(begin, dtype=np.uint64)).tolist(), len(keys)]


def distinct(keys: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys of less than 64 bits, and how often each is marked."""
    coded = keys << np.uint64(1) | marked.astype(np.uint64)
    coded.sort()
    unique = coded >> np.uint64(1)
    new = np.flatnonzero(np.diff(unique, prepend=~unique[:1]))
    return unique[new], np.add.reduceat((coded & np.uint64(1)).astype(np.int64), new) if len(new) else np.zeros(0, np.int64)


class Tokens:
    """The tokens of some texts, each text with one end: hashes of words, of pairs and of threes, and where texts begin."""

    def __init__(self, texts: list[str | None], hashes: WordHashes, bits: int):
        words = [hashes.of(split_words(t)) for t in texts]
        self.sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        ends = np.cumsum(self.sizes)
        self.first = ends - self.sizes
        self.one = np.full(int(ends[-1]) if len(ends) else 0, END, dtype=np.uint64)
        for at, w in zip(self.first, words):
            self.one[at : at + len(w)] = w
        before = np.roll(self.one, 1)
        before[self.first] = START
        pair = mix(before * _ODD + self.one)
        last_pair = np.roll(pair, 1)
        last_pair[self.first] = START
        three = mix(last_pair * _SALT + self.one)
        top = np.uint64(64 - bits + 1)
        self.more = np.concatenate([pair >> top << np.uint64(1), three >> top << np.uint64(1) | np.uint64(1)])


_ASK = "shard int, block int, one binary, one_own binary, more binary, more_own binary"
_ANSWER = "block int, shard int, one binary, more binary, kinds bigint, total bigint"
_COUNTED = "block int, ids array<bigint>, held array<boolean>, sizes array<int>, one binary, two binary, three binary, kinds bigint, total bigint"


def counted(base: DataFrame) -> DataFrame:
    """(block, ids, held, sizes, one, two, three, kinds, total) for blocks of base(id, held, text): for every token of its texts the number of times
    that training texts (not held) hold the word, the pair and the three words that end there, as squeeze() packs them.

    Sums of kinds and total over all rows are the numbers of distinct and of all training tokens.
    """
    found = base.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit("")))), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    tokens = found["bytes"] // 4 + 2 * found["rows"] + 1
    blocks, shards = max(1, math.ceil(found["bytes"] / BLOCK)), max(1, math.ceil(tokens / SHARD_TOKENS))
    bits = min(63, tokens.bit_length() + 1 + SPARE)
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "id", "held", lower_ascii(F.col("text")).alias("text")).repartition(parts, "block")
    hashes, begins = WordHashes(300_000), (edges(64, shards), edges(bits, shards))

    def training(t: Tokens, docs: pa.Table) -> np.ndarray:
        return np.repeat(~np.array(docs.column("held").to_pylist(), dtype=bool), t.sizes)

    def own_counts(t: Tokens, docs: pa.Table):
        """(distinct keys, where each token's is, how often training texts of this block hold it), of words and of what is longer."""
        train = training(t, docs)
        for keys, own in ((t.one, train), (t.more, np.tile(train, 2))):
            unique, at = np.unique(keys, return_inverse=True)
            yield unique, at, np.bincount(at, weights=own, minlength=len(unique)).astype(np.int64)

    def ask(table: pa.Table) -> pa.Table:
        t = Tokens(table.column("text").to_pylist(), hashes, bits)
        train = training(t, table)
        one, held = np.unique(t.one), np.unique(t.one[train], return_counts=True)
        count = np.zeros(len(one), np.int64)
        count[np.searchsorted(one, held[0])] = held[1]
        asked = [(*x, begin, cuts(x[0], begin)) for x, begin in zip(((one, count), distinct(t.more, np.tile(train, 2))), begins)]
        block, rows = table.column("block")[0].as_py(), []
        for s in range(shards):
            row = [s, block]
            for unique, count, begin, cut in asked:
                own = slice(cut[s], cut[s + 1])
                row += [pack_sorted(unique[own] - np.uint64(begin[s])), squeeze(count[own])]
            rows.append(row)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=[f.split()[0] for f in _ASK.split(", ")])

    def answers(waiting):
        out = []
        for i in (0, 1):
            keys, own = [unpack_sorted(r[2 + 2 * i]) for r in waiting], [spread(r[3 + 2 * i]) for r in waiting]
            unique, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(own), minlength=len(unique)).astype(np.int64)
            out.append([squeeze(total[x] - o) for x, o in zip(np.split(at, np.cumsum([len(k) for k in keys])[:-1]), own)])
            if i == 0:
                kinds, everything = int((total > 0).sum()), int(total.sum())
        for j, r in enumerate(waiting):
            yield r[1], r[0], out[0][j], out[1][j], kinds if j == 0 else 0, everything if j == 0 else 0

    def answer(batches):
        types, names = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), [f.split()[0] for f in _ANSWER.split(", ")]

        def packed(waiting):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*answers(waiting)), types)], names)

        waiting = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in range(6)]
                if waiting and row[0] != waiting[0][0]:
                    yield packed(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield packed(waiting)

    def take(docs: pa.Table, said: pa.Table) -> pa.Table:
        t = Tokens(docs.column("text").to_pylist(), hashes, bits)
        by_shard = {r["shard"]: r for r in said.to_pylist()}
        counts = []
        for (unique, at, found), name, begin in zip(own_counts(t, docs), ("one", "more"), begins):
            cut = cuts(unique, begin)
            for s, r in by_shard.items():
                found[cut[s] : cut[s + 1]] += spread(r[name])
            counts.append(found[at])
        one, (two, three) = counts[0], np.split(counts[1], 2)
        row = [[docs.column("block")[0].as_py()], [docs.column("id").to_pylist()], [docs.column("held").to_pylist()], [t.sizes.tolist()], *([squeeze(x, DENSE)] for x in (one, two, three)), [sum(r["kinds"] for r in by_shard.values())], [sum(r["total"] for r in by_shard.values())]]
        types = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 3, pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(row, types)], names=[f.split()[0] for f in _COUNTED.split(", ")])

    asked = dealt.groupBy("block").applyInArrow(ask, _ASK).repartition(max(parts, 1), "shard").sortWithinPartitions("shard")
    said = asked.mapInArrow(answer, _ANSWER)
    return dealt.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(take, _COUNTED)
