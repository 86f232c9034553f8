"""Sums over each text of values that a table holds for words and for pairs of neighbouring words; what it does not hold counts nothing.

Texts stay where they are read. A task deals them into blocks of about BLOCK bytes and sends, for a block, one sorted packed run of (key, text, times) to
each shard, a range of keys; a shard adds up what its part of the table gives and returns a packed sum for each text it met. A key thus travels once for
each text that holds it. The most frequent keys of the table (at most HEAD words and HEAD pairs, so of a fixed size) go to the tasks and never travel, all
others take the exchange. Keys have as many bits as the table's size asks for: one unknown key in 2^SPARE is taken for a known one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.exchange import pack_sorted, spread, squeeze, unpack_sorted
from millrace.llm.ngrams import END, START
from millrace.llm.text import WordHashes, mix, split_words

BLOCK, SHARD_ENTRIES, HEAD, SPARE = 4 << 20, 4_000_000, 16384, 16
#: Bits for a text's place in its block.
PLACE = 12
_ODD, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_OWN = "ids array<bigint>, langs array<string>, sizes array<int>, local array<double>"
_ASK = f"shard int, block bigint, codes binary, times binary, {_OWN}"
_ANSWER = f"shard int, block bigint, places binary, sums binary, {_OWN}"
_TYPES = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float64()))


def word_keys(words: np.ndarray) -> np.ndarray:
    return mix(words * _WORD)


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * _ODD + words)


def keyed(values: DataFrame) -> DataFrame:
    """(key, value) from values(ctx, word, value); words alone have no ctx."""

    def each(batches):
        for b in batches:
            words = b.column("word").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            before = b.column("ctx").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            key = np.where(b.column("ctx").is_null().to_numpy(zero_copy_only=False), word_keys(words), pair_keys(before, words))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("value")], ["key", "value"])

    return values.select("ctx", "word", "value").mapInArrow(each, "key bigint, value double")


def least_often(counts: DataFrame, often: str) -> int:
    """The least power of two that at most HEAD rows of counts reach, found from the number of rows between each two powers."""
    level, n = 64, 0
    rows = counts.filter(F.col(often) > 0).groupBy(F.floor(F.log2(often)).cast("int").alias("level")).count().collect()  # 64 at most
    for r in sorted(rows, key=lambda r: -r["level"]):
        n += r["count"]
        if n > HEAD:
            break
        level = r["level"]
    return 1 << min(level, 62)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), _TYPES)], names=names)


def sums(docs: DataFrame, words: DataFrame, pairs: DataFrame, top: DataFrame, known: int) -> DataFrame:
    """(doc_id, lang, n_tokens, total) for every row of docs(doc_id, lang, text): total adds the values of the start, of each word and of the end, and those of each pair of neighbours.

    words(word, value, top) and pairs(ctx, word, value) have `known` rows together, each key once. Words marked top and the pairs of top, the most frequent
    ones (see least_often), go to the tasks with the start and the end. A null or empty text is start and end; repeated rows each give a row. When an executor is lost, docs has to give each part's rows in the same order again, as files do.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    entries = 2 * (size["bytes"] // 5 + 2 * size["rows"]) + 1
    shards, bits = max(1, math.ceil(entries / SHARD_ENTRIES)), min(63 - PLACE, int(known).bit_length() + SPARE)
    bounds = [(s << bits) // shards for s in range(shards + 1)]
    low, mask, cut = np.uint64(PLACE), np.uint64((1 << PLACE) - 1), np.uint64(64 - bits)
    no_ctx, ends = F.lit(None).cast("bigint").alias("ctx"), F.col("word").isin(int(START), int(END))
    head = [r for t in (words.filter(ends | F.col("top")).select(no_ctx, "word", "value"), top) for r in keyed(t).collect()]
    head_keys = np.array([r["key"] for r in head], dtype=np.int64).view(np.uint64)
    order = np.argsort(head_keys)
    head_keys, head_values = head_keys[order], np.array([r["value"] for r in head])[order]
    hashes = WordHashes(300_000)

    def runs(keys: np.ndarray, shift: np.uint64):
        """(shard, from, to, first) of ascending keys."""
        edges = np.searchsorted(keys, np.array([b << int(shift) for b in bounds], dtype=np.uint64))
        return [(s, edges[s], edges[s + 1], np.uint64(bounds[s] << int(shift))) for s in range(shards) if edges[s + 1] > edges[s]]

    def asked(block: int, ids: list, langs: list, texts: list) -> list[tuple]:
        parts = [np.concatenate([[START], hashes.of(split_words(t)), [END]]).astype(np.uint64) for t in texts]
        sizes = np.array([len(p) for p in parts])
        every, place = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
        inside = place[1:] == place[:-1]
        keys = np.concatenate([word_keys(every), pair_keys(every[:-1], every[1:])[inside]])
        place = np.concatenate([place, place[1:][inside]])
        at = np.minimum(np.searchsorted(head_keys, keys), max(0, len(head_keys) - 1))
        met = head_keys[at] == keys if len(head_keys) else np.zeros(len(keys), dtype=bool)
        local = np.bincount(place[met], weights=head_values[at[met]], minlength=len(parts)) if len(head_keys) else np.zeros(len(parts))
        codes, times = np.unique((keys[~met] >> cut) << low | place[~met].astype(np.uint64), return_counts=True)
        rows = [(s, block, pack_sorted(codes[a:b] - first), squeeze(times[a:b] - 1), None, None, None, None) for s, a, b, first in runs(codes, low)]
        return [*rows, (block % shards, block, None, None, ids, langs, (sizes - 1).tolist(), local.tolist())]

    def ask(batches):
        part, n = TaskContext.get().partitionId() << 32, 0
        ids, langs, texts, held = [], [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py() or ""
                if texts and (held + len(text) > BLOCK or len(texts) > int(mask)):
                    yield from _table(asked(part + n, ids, langs, texts), _ASK).to_batches()
                    ids, langs, texts, held, n = [], [], [], 0, n + 1
                ids.append(batch.column("doc_id")[i].as_py())
                langs.append(batch.column("lang")[i].as_py())
                texts.append(text)
                held += len(text)
        if texts:
            yield from _table(asked(part + n, ids, langs, texts), _ASK).to_batches()

    def pack(batches):
        def packed(keys: np.ndarray, values: np.ndarray):
            keys = keys >> cut
            order = np.lexsort((values, keys))
            keys, values = keys[order], values[order]
            rows = [(s, pack_sorted(keys[a:b] - first), values[a:b].astype("<f4").tobytes()) for s, a, b, first in runs(keys, np.uint64(0))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["shard", "keys", "values"])

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if b.num_rows:
                waiting.append((b.column("key").to_numpy(zero_copy_only=False).view(np.uint64), b.column("value").to_numpy(zero_copy_only=False)))
            if sum(len(k) for k, _ in waiting) > 1_000_000:
                yield packed(*map(np.concatenate, zip(*waiting)))
                waiting = []
        if waiting:
            yield packed(*map(np.concatenate, zip(*waiting)))

    def answer(table: pa.Table, asks: pa.Table) -> pa.Table:
        rows, keys, values = [], np.zeros(0, np.uint64), np.zeros(0, "<f4")
        if table.num_rows:
            first = np.uint64(bounds[table.column("shard")[0].as_py()])
            keys = np.concatenate([unpack_sorted(x.as_py()) + first for x in table.column("keys")])
            values = np.concatenate([np.frombuffer(x.as_py(), "<f4") for x in table.column("values")])
            order = np.lexsort((values, keys))
            keys, new = np.unique(keys[order], return_index=True)
            values = values[order][new]
        for i in range(asks.num_rows):
            shard, block, codes, times, *own = (asks.column(c)[i].as_py() for c in range(8))
            if codes is None:
                rows.append((shard, block, None, None, *own))
            elif len(keys):
                code = unpack_sorted(codes) + np.uint64(bounds[shard] << PLACE)
                at = np.minimum(np.searchsorted(keys, code >> low), len(keys) - 1)
                met = keys[at] == code >> low
                total = np.bincount((code[met] & mask).astype(np.int64), weights=values[at[met]].astype(float) * (spread(times)[met] + 1))
                places = np.flatnonzero(total)
                if len(places):
                    rows.append((shard, block, squeeze(np.diff(places, prepend=0)), total[places].astype("<f4").tobytes(), *[None] * 4))
        return _table(rows, _ANSWER)

    def finish(found: pa.Table) -> pa.Table:
        rows = sorted(zip(*(found.column(c).to_pylist() for c in ("shard", "places", "sums", "ids", "langs", "sizes", "local"))), key=lambda r: (r[0], r[1] is None))
        ids, langs, sizes, local = next(r[3:] for r in rows if r[3] is not None)
        total = np.array(local)
        for _, places, got, *_ in rows:
            if places is not None:
                total[np.cumsum(spread(places))] += np.frombuffer(got, "<f4")
        return pa.table([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(sizes, pa.int64()), pa.array(total)], names=["doc_id", "lang", "n_tokens", "total"])

    asks = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), "text").mapInArrow(ask, _ASK)
    values = keyed(words.select(no_ctx, "word", "value").unionByName(pairs)).mapInArrow(pack, "shard int, keys binary, values binary")
    answers = values.groupBy("shard").cogroup(asks.groupBy("shard")).applyInArrow(answer, _ANSWER)
    return answers.groupBy("block").applyInArrow(finish, "doc_id bigint, lang string, n_tokens bigint, total double")
