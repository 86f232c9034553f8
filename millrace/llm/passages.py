"""Fuzzy passages that documents share, by collinear chaining.

Seeds are runs of K words; of every WINDOW consecutive ones the smallest hash is kept, so any K + WINDOW - 1 equal words share a seed. Each occurrence of a
seed meets the seed's first one (smallest id and place), so a passage in many documents gives a row for each and not one for each pair. This is
done twice: among the texts of a batch, where they are read, and then among the batches' first occurrences, so a seed is sent once for each batch that has
it, however common it is, and most copies are compared without being sent anywhere.

Matches of two documents are chained in order on both sides: a Fenwick tree over the other side's places holds the best chain so far, and the cost of a gap
grows with its length; if that one ends too far away, the best within the gap counts. Words between seeds are aligned, ends are extended across a few other
words, and chains are cut where the words between disagree. Spans of a document that touch are taken together, whoever shares them, and count if they are
LEAST words long.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.storage import materialize
from millrace.llm.text import WordHashes, shingles, split_words

K, WINDOW, LEAST, GAP = 8, 8, 50, 30
#: Words that differ, at an alignment's ends, up to which as many equal ones carry on.
SLIP = 4
COST = 0.05
#: Words of the texts that are compared where they are read.
BATCH_WORDS = 400_000
#: Stands for a null id: before all others.
NO_ID = -(1 << 63)


def kept_seeds(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of hashes that are the smallest of some run of `window`."""
    if len(h) <= window:
        return np.array([int(np.argmin(h))]) if len(h) else np.zeros(0, dtype=int)
    runs = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(runs.argmin(1) + np.arange(len(runs)))


def chains(matches: list[tuple[int, int]], k: int = K, gap: int = GAP, cost: float = COST) -> list[list[tuple[int, int]]]:
    """Chains of (place, other place), ascending in both, best first; each match is in one chain."""
    matches = sorted(set(matches))
    ranks = sorted({y for _, y in matches})
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ranks) + 1)
    score, back = [0.0] * len(matches), [-1] * len(matches)
    i = 0
    while i < len(matches):
        j = i
        while j < len(matches) and matches[j][0] == matches[i][0]:
            x, y = matches[j]
            at, best = bisect_left(ranks, y), (-1e18, -1)
            while at > 0:
                best = max(best, tree[at])
                at -= at & -at
            near = lambda m: x - matches[m][0] <= gap + k and 0 < y - matches[m][1] <= gap + k
            if best[1] >= 0 and not near(best[1]):  # the best of all is too far: the best of those within the gap
                since = bisect_left(matches, (x - gap - k,))
                best = max(((score[m] + cost * sum(matches[m]), m) for m in range(since, i) if near(m)), default=(-1e18, -1))
            score[j] = float(k)
            if best[1] >= 0:
                px, py = matches[best[1]]
                gain = best[0] - cost * (x + y)
                if gain > 0:
                    score[j], back[j] = gain + min(k, x - px, y - py), best[1]
            j += 1
        for m in range(i, j):
            at = bisect_left(ranks, matches[m][1]) + 1
            entry = (score[m] + cost * sum(matches[m]), m)
            while at <= len(ranks):
                tree[at] = max(tree[at], entry)
                at += at & -at
        i = j
    used, out = [False] * len(matches), []
    for m in sorted(range(len(matches)), key=lambda m: -score[m]):
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(matches[m])
            m = back[m]
        if chain:
            out.append(chain[::-1])
    return out


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """Words in the longest common subsequence."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        row = np.maximum.accumulate(row)
    return int(row[-1])


def _equal_run(a: np.ndarray, b: np.ndarray, x: int, y: int) -> int:
    """How many words are equal from places x and y on."""
    at, most = 0, min(len(a) - x, len(b) - y)
    while at < most:
        n = min(256, most - at)
        off = np.flatnonzero(a[x + at : x + at + n] != b[y + at : y + at + n])
        if len(off):
            return at + int(off[0])
        at += n
    return at


def extension(a: np.ndarray, b: np.ndarray, slip: int = SLIP) -> tuple[int, int, int]:
    """(words of a, words of b, equal words) that agree from the start: equal runs, across at most `slip` other words where `slip` equal ones follow."""
    slips = sorted(((i, j) for i in range(slip + 1) for j in range(slip + 1) if i or j), key=lambda s: (max(s), sum(s)))
    x = y = same = 0
    while True:
        n = _equal_run(a, b, x, y)
        x, y, same = x + n, y + n, same + n
        for i, j in slips:
            if x + i + slip <= len(a) and y + j + slip <= len(b) and np.array_equal(a[x + i : x + i + slip], b[y + j : y + j + slip]):
                same += agreement(a[x : x + i], b[y : y + j])
                x, y = x + i, y + j
                break
        else:
            return x, y, same


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], k: int = K) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, end, other start, other end, equal words) along a chain, cut where fewer than half the words of a gap agree."""
    out = []
    s, t = chain[0]
    x, y, same = s + k, t + k, k
    for p, q in chain[1:]:
        over = max(0, x - p, y - q)
        between = agreement(a[x:p], b[y:q]) if p > x and q > y else 0
        wide = max(p - x, q - y, 0)
        if wide > 4 and between * 2 < wide:
            out.append((s, x, t, y, same))
            s, t, same, over, between = p, q, 0, 0, 0
        same += between + k - min(k, over)
        x, y = p + k, q + k
    out.append((s, x, t, y, same))
    whole = []
    for s, x, t, y, same in out:
        left, other_left, more = extension(a[:s][::-1], b[:t][::-1])
        right, other_right, still_more = extension(a[x:], b[y:])
        whole.append((s - left, x + right, t - other_left, y + other_right, same + more + still_more))
    return whole


_SPAN = ("key", "id", "other_key", "other_id", "start", "end", "other_start", "other_end", "n_equal")
_SPANS = "key bigint, id bigint, other_key bigint, other_id bigint, start int, end int, other_start int, other_end int, n_equal int"
_SPAN_TYPES = [pa.int64()] * 4 + [pa.int32()] * 5
#: Of 64 bits of a seed's hash these travel; words are compared in the end.
_KEPT = np.uint64((1 << 48) - 1)


def passages_of(a: np.ndarray, b: np.ndarray, matches: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, end, other start, other end, equal words) of two texts' words that hold the given pairs of places, where those are equal."""
    found: set[tuple[int, int, int, int, int]] = set()
    sure = [(p, q) for p, q in matches if max(p - len(a), q - len(b)) <= -K and np.array_equal(a[p : p + K], b[q : q + K])]
    for chain in chains(sure):
        if not any(s <= chain[0][0] and chain[-1][0] + K <= x and t <= chain[0][1] and chain[-1][1] + K <= y for s, x, t, y, _ in found):
            found.update(align(a, b, chain))
    return sorted(tuple(map(int, f)) for f in found)


def firsts_and_matches(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lead, other) of occurrences of hashes in documents, numbered as they come: indices in order of hash, document and place; for each of these
    the index of its hash's first one; and whether it is in another document than that."""
    order = np.lexsort((pos, doc, h))
    if not len(order):
        return order, order, np.zeros(0, bool)
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return order, lead, doc[order] != doc[lead]


def _grouped(doc: np.ndarray, other: np.ndarray, pos: np.ndarray, other_pos: np.ndarray):
    """(doc, other, [(pos, other_pos)]) of equal pairs of documents."""
    order = np.lexsort((other, doc))
    doc, other, pos, other_pos = doc[order], other[order], pos[order], other_pos[order]
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])])) if len(doc) else []
    for x, y in zip(cuts, [*cuts[1:], len(doc)]):
        yield int(doc[x]), int(other[x]), list(zip(pos[x:y].tolist(), other_pos[x:y].tolist()))


_DEALT = "bucket int, kind int, seeds binary, places binary, docs binary, runs binary, spans binary"
_DEALT_NAMES = [f.split()[0] for f in _DEALT.split(", ")]


def _dealt(texts: DataFrame, buckets: int) -> DataFrame:
    """Passages within batches of texts(key, id, text), and each batch's first occurrences of its seeds, packed by bucket.

    Rows of kind 0 hold passages (nine numbers each); rows of kind 1 hold hashes of 48 bits, places, documents (id and key) and their numbers of seeds.
    """

    def batch_rows(keys, ids, words):
        rank = np.lexsort((keys, ids))  # documents are numbered in their order
        keys, ids, words = np.array(keys)[rank], np.array(ids)[rank], [words[i] for i in rank]
        again = np.concatenate([[False], (keys[1:] == keys[:-1]) & (ids[1:] == ids[:-1])])
        h, doc, pos = [], [], []
        for i, w in enumerate(words):
            if len(w) >= K and not again[i]:  # a repeated row has the passages of the first
                run = shingles(w, K)
                at = kept_seeds(run)
                h.append(run[at] & _KEPT)
                doc.append(np.full(len(at), i))
                pos.append(at)
        if not h:
            return
        h, doc, pos = map(np.concatenate, (h, doc, pos))
        order, lead, other = firsts_and_matches(h, doc, pos)
        own, its = order[other], lead[other]
        spans = [(keys[d], ids[d], keys[o], ids[o], *f) for d, o, m in _grouped(doc[own], doc[its], pos[own], pos[its]) for f in passages_of(words[d], words[o], m)]
        for at in range(0, len(spans), 100_000):
            yield int((keys[0] + at // 100_000) % buckets), 0, None, None, None, None, np.array(spans[at : at + 100_000], dtype=np.int64).tobytes()
        firsts = np.sort(order[order == lead])  # in order of documents and places
        bucket = (h[firsts] % np.uint64(buckets)).astype(np.int64)
        firsts = firsts[np.argsort(bucket, kind="stable")]
        edges = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
        short = h[firsts].view(np.uint8).reshape(-1, 8)[:, :6]
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            d = doc[firsts[part]]
            new = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            who = np.stack([ids[d[new]], keys[d[new]]], 1).astype(np.int64)
            yield int(b), 1, short[part].tobytes(), pos[firsts[part]].astype(np.uint32).tobytes(), who.tobytes(), np.diff(np.append(new, len(d))).astype(np.uint32).tobytes(), None

    def each(batches):
        hashes, types = WordHashes(), [pa.int32(), pa.int32(), *[pa.binary()] * 5]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _DEALT_NAMES)

        keys, ids, words, room = [], [], [], BATCH_WORDS
        for batch in batches:
            for key, id_, text in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), batch.column("text")):
                w = hashes.of(split_words(text.as_py()))
                keys.append(key)
                ids.append(NO_ID if id_ is None else id_)
                words.append(w)
                room -= len(w) + 20
                if room < 0:
                    if rows := list(batch_rows(keys, ids, words)):
                        yield packed(rows)
                    keys, ids, words, room = [], [], [], BATCH_WORDS
        if keys and (rows := list(batch_rows(keys, ids, words))):
            yield packed(rows)

    return texts.select("key", "id", "text").mapInArrow(each, _DEALT)


def _met(dealt: DataFrame, buckets: int) -> DataFrame:
    """Passages as they came, and matches of batches' first occurrences with the first of all: _SPANS, where matches have a place each in start and other_start and no end."""

    def rows_of(waiting):
        h, pos, who, runs = (b"".join(x) for x in zip(*waiting))
        wide = np.zeros((len(h) // 6, 8), dtype=np.uint8)
        wide[:, :6] = np.frombuffer(h, np.uint8).reshape(-1, 6)
        who, pos = np.frombuffer(who, np.int64).reshape(-1, 2), np.frombuffer(pos, np.uint32).astype(np.int64)
        named, number = np.unique(who, axis=0, return_inverse=True)  # in order of id and key
        doc = np.repeat(number.ravel(), np.frombuffer(runs, np.uint32))
        order, lead, other = firsts_and_matches(wide.view(np.uint64).ravel(), doc, pos)
        own, its = order[other], lead[other]
        a, b = named[doc[own]], named[doc[its]]
        none = pa.nulls(len(own), pa.int32())
        columns = [pa.array(x) for x in (a[:, 1], a[:, 0], b[:, 1], b[:, 0])] + [pa.array(pos[own].astype(np.int32)), none, pa.array(pos[its].astype(np.int32)), none, none]
        return pa.RecordBatch.from_arrays(columns, list(_SPAN))

    def each(batches):
        now, waiting = None, []
        for batch in batches:
            for bucket, kind, *part, spans in zip(*(batch.column(c).to_pylist() for c in _DEALT_NAMES)):
                if waiting and bucket != now:
                    yield rows_of(waiting)
                    waiting = []
                now = bucket
                if kind:
                    waiting.append(part)
                else:
                    rows = np.frombuffer(spans, np.int64).reshape(-1, len(_SPAN))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[:, i], pa.int64()).cast(t) for i, t in enumerate(_SPAN_TYPES)], list(_SPAN))
        if waiting:
            yield rows_of(waiting)

    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(each, _SPANS)


def _align(rows: DataFrame) -> DataFrame:
    """The passages of pairs (key, id, other_key, other_id, matches, text, other_text); pairs of one other text follow each other, so it is hashed once."""

    def each(batches):
        hashes, last, b = WordHashes(), None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("key", "id", "other_key", "other_id", "matches", "text")}
                if r["other_key"] != last:
                    last, b = r["other_key"], hashes.of(split_words(batch.column("other_text")[i].as_py()))
                found = passages_of(hashes.of(split_words(r["text"])), b, [(m["start"], m["other_start"]) for m in r["matches"]])
                out += [(r["key"], r["id"], r["other_key"], r["other_id"], *f) for f in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SPAN_TYPES)], list(_SPAN))

    return rows.mapInArrow(each, _SPANS)


def shared_passages(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, other_id, start, end, other_start, other_end, n_equal): passages of a document that an earlier id has as well, in word places.

    Every passage of at least `least` words that stands in several documents has a row for each but the first of them, with an earlier one; of rows
    for one span the one with the most equal words stays. A row's own span may be shorter where several documents cover the passage together. Null ids come first, rows that share an id in order of a hash of their text; an id of
    -2^63 counts as null. Repeated rows are one document. Texts of fewer than K words and null texts have none; texts of any length are read
    whole. An empty table gives no rows; other columns are left alone.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    texts = texts.select(F.xxhash64("id", "text").alias("key"), "id", "text")
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = materialize(_met(_dealt(texts, buckets), buckets))
    near, far = met.filter("end is not null"), met.filter("end is null")
    pairs = materialize(far.groupBy("key", "id", "other_key", "other_id").agg(F.collect_set(F.struct("start", "other_start")).alias("matches")))
    wanted = pairs.select(F.explode(F.array("key", "other_key")).alias("key")).distinct()
    one = materialize(texts.select("key", "text").join(wanted, "key", "left_semi")).dropDuplicates(["key"])
    both = pairs.join(one, "key").join(one.select(F.col("key").alias("other_key"), F.col("text").alias("other_text")), "other_key")
    found = materialize(near.unionByName(_align(both.select("key", "id", "other_key", "other_id", "matches", "text", "other_text"))))
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    zero = F.array().cast("array<struct<start:int,end:int>>")

    def extend(done, s):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"] + 2), joined).otherwise(F.concat(done, F.array(s)))

    runs = found.groupBy("key", "id").agg(spans.alias("s")).select("key", F.explode(F.filter(F.aggregate("s", zero, extend), lambda r: r["end"] - r["start"] >= least)).alias("run"))
    kept = found.join(runs, "key").filter("start >= run.start and end <= run.end")
    closest = F.max_by(F.struct("id", "other_id", "other_start", "other_end", "n_equal"), F.struct("n_equal", "other_key"))
    kept = kept.groupBy("key", "start", "end").agg(closest.alias("best")).select("start", "end", "best.*")
    real = lambda c: F.when(F.col(c) != F.lit(NO_ID), F.col(c))
    return kept.select(real("id").alias(id_col), real("other_id").alias("other_id"), "start", "end", "other_start", "other_end", "n_equal")
