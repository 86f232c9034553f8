"""Sets of shingles that overlap, found without comparing all pairs: a partition of the universe and the pigeonhole principle.

Two sets with a Jaccard likeness of at least t differ in at most (r + s)(1 - t)/(1 + t) members. Members are hashed into segments, as many as
the sizes of a band need: then some segment of the two is equal, or, where a segment counts double, equal but for one deletion. Signatures
are hashes of segments and of their one-deletion neighbours; how many segments count double is what costs least by `allocate`. Sets
that share a signature are candidates and are verified on their whole sets.

Equal sets are one class before anything else. A signature's sets are compared with one of them, links are contracted, and only signatures
whose sets are then still apart are gone through again, the last time pair by pair, each pair by its sizes and the parities of 256 cells first: they
give a bound that no pair of alike sets fails. Texts travel for pairs that pass it, and the finer parities of all cells, alone.

Where more than CROWD sets share a signature, as in a large group of edited copies, the last round does not pair them. They are held against one set, the
lead, and the members that a set or the lead has alone are its difference. Two alike sets of which one is not alike to the lead have much of their differences
in common, so they share one of the rarest members of these (see `_met_in_differences`); most edits are a set's own and meet nothing.

How many segments a band has is chosen for the number of sets that it really holds, so that strangers meet as rarely in large corpora as in small ones.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.storage import materialize
from millrace.llm.text import SPACES, WordHashes, mix, shingles, split_words

#: Numerator and denominator of the likeness, words of a shingle.
OVER, UNDER, WORDS = 90, 100, 3
#: For the choice of segments: how likely two strange sets share a member.
SHARED = 0.01
#: Cells of the parities that join conditions compare, as 64-bit numbers.
FOLDED = 4
#: Of a signature that more sets share, the last round compares differences from one set.
CROWD = 32
_SEED = np.uint64(0xA0761D6478BD642F)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Signatures travel as 48 bits; what meets by chance is verified like the rest.
_LOW = np.uint64((1 << 48) - 1)


def _unpack(sigs: bytes, nodes: bytes, runs: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(sigs) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(sigs, dtype=np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel(), np.repeat(np.frombuffer(nodes, dtype=np.int64), np.frombuffer(runs, dtype=np.uint32))


@lru_cache(maxsize=None)
def bands(over: int, under: int, most: int = 1 << 40) -> tuple[int, ...]:
    """First sizes of the bands: partners are in one band or in neighbours."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, -(-out[-1] * under // over)))
    return tuple(out)


@lru_cache(maxsize=None)
def allocate(band: int, over: int, under: int, strangers: int = 1000) -> tuple[int, int, int]:
    """(segments, those among them that count double, poorest ones left out) for pairs whose larger set is in that band; zeros where only equal sets are alike.
    strangers is how many sets the pairs' bands hold, as a power of two or so.

    With as many spare segments as are left out, some equal segment is kept by both sets: the richest of the equal ones (order: members, then
    hash) is among the poorest of neither, as all the equal ones would have to be. Empty segments, which strange sets share, go this way.
    """
    low = bands(over, under)[max(band - 1, 0)]
    top = bands(over, under)[band + 1] - 1
    differ = 2 * top * (under - over) // (under + over)
    if not differ:
        return 0, 0, 0
    best = None
    for double in range(0, differ // 2 + 2):
        for spare in range(0, differ // 2 + 2) if not double else (0,):
            m = double + max(0, differ + 1 - 2 * double) + spare
            alone = (1 - (1 - SHARED) / m) ** low
            miss = low / m * (1 - (1 - SHARED) / m) ** (low - 1)
            common = (m - double) * alone
            common = max(0.0, common + 2 * common**0.5 - spare) if spare else common
            cost = m - spare + double * top / m + strangers * (common * alone + double * (alone + miss) ** 2)
            if best is None or cost < best[0]:
                best = (cost, m, double, spare)
    return best[1:]


def _strangers(band: int, held: dict[int, int] | None) -> int:
    """Sets in a band and the one below, rounded up to a power of two; a thousand where nothing is known."""
    return 1000 if held is None else 1 << max(0, held.get(band, 0) + held.get(band - 1, 0) - 1).bit_length()


def band_of(size: int, over: int, under: int) -> int:
    return int(np.searchsorted(bands(over, under), size, side="right")) - 1


def signatures(members: np.ndarray, over: int = OVER, under: int = UNDER, held: dict[int, int] | None = None) -> np.ndarray:
    """All signatures of a set of distinct 64-bit numbers, for pairs in which it is the larger or the smaller one; held is the number of sets by band."""
    out = []
    own = band_of(len(members), over, under) if len(members) else 0
    for band in (own, own + 1) if len(members) else ():
        m, double, spare = allocate(band, over, under, _strangers(band, held))
        if not m:
            continue
        seg = (mix(members ^ _SEED) % np.uint64(m)).astype(np.int64)
        inner = mix(members + _STEP)
        sums = np.zeros(m, dtype=np.uint64)
        np.add.at(sums, seg, inner)
        tag = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
        whole = mix(sums + tag)
        out.append(whole[np.lexsort((whole, np.bincount(seg, minlength=m)))[spare:]])
        if double:
            near = seg < double
            out.append(mix(sums[seg[near]] - inner[near] + tag[seg[near]]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def _digests(lists: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes and two hashes of sets; the first hash names a set from here on."""
    h1 = [np.add.reduce(mix(s ^ _SEED), dtype=np.uint64) for s in lists]
    h2 = [np.bitwise_xor.reduce(mix(s + _STEP), dtype=np.uint64) for s in lists]
    return [len(s) for s in lists], *(np.array(h, dtype=np.uint64).view(np.int64) for h in (h1, h2))


def _set_of(text: str | None, hashes: WordHashes, words: int) -> np.ndarray:
    return np.unique(shingles(hashes.of(split_words(text)), words))


def parities(members: np.ndarray) -> bytes:
    """A bit for each of a power of two of cells, no fewer than members: whether the cell holds an odd number of them."""
    cells = max(64 * FOLDED, 1 << (len(members) - 1).bit_length())
    at = (mix(members + _SEED) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of members that two sets differ in, from their parities; the longer ones are folded."""
    if len(x) > len(y):
        x, y = y, x
    v = np.bitwise_xor.reduce(np.frombuffer(y, np.uint8).reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(v ^ np.frombuffer(x, np.uint8)).sum())


def folded(parity: bytes) -> np.ndarray:
    """Parities of 64 * FOLDED cells as signed 64-bit numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(parity, np.uint64).reshape(-1, FOLDED), axis=0).view(np.int64)


_QS = [f"q{i}" for i in range(FOLDED)]


def _named(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, h1, h2, par, q0...) for each text, and key where docs have it."""
    extra = [c for c in docs.columns if c == "key"]

    def each(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lists = [_set_of(t, hashes, words) for t in part.column("text").to_pylist()]
                n, h1, h2 = _digests(lists)
                par = [parities(x) for x in lists]
                q = np.array([folded(x) for x in par], dtype=np.int64).reshape(-1, FOLDED)
                columns = [part.column("id"), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), pa.array(par, pa.binary()), *(pa.array(q[:, i]) for i in range(FOLDED)), *map(part.column, extra)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "h1", "h2", "par", *_QS, *extra])

    return docs.mapInArrow(each, "id bigint, n bigint, h1 bigint, h2 bigint, par binary" + "".join(f", {c} bigint" for c in [*_QS, *extra]))


def _node_texts(docs: DataFrame, words: int) -> DataFrame:
    """(node, text): texts by the names of their sets."""

    def each(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                texts = batch.column("text").slice(at, 200)
                yield pa.RecordBatch.from_arrays([pa.array(_digests([_set_of(t, hashes, words) for t in texts.to_pylist()])[1]), texts], ["node", "text"])

    return docs.mapInArrow(each, "node bigint, text string")


def _packed(docs: DataFrame, words: int, over: int, under: int, buckets: int, held: dict[int, int]) -> DataFrame:
    """(bucket, sigs, nodes, runs): the signatures of many texts (48 bits each), the sets they belong to, and how many in a row each has."""

    def each(batches):
        hashes = WordHashes()
        for batch in batches:
            sigs, nodes, seen = [], [], set()
            for at in range(0, batch.num_rows, 200):
                lists = [_set_of(t, hashes, words) for t in batch.column("text").slice(at, 200).to_pylist()]
                for s, node in zip(lists, _digests(lists)[1]):
                    if node not in seen:
                        seen.add(node)
                        sigs.append(signatures(s, over, under, held) & _LOW)
                        nodes.append(np.full(len(sigs[-1]), node, dtype=np.int64))
            if not sigs:
                continue
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            bucket = (sig % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            sig, node, bucket = sig[order], node[order], bucket[order]
            at = np.searchsorted(bucket, np.arange(buckets + 1))
            short = sig.view(np.uint8).reshape(-1, 8)[:, :6]
            out = []
            for b in np.flatnonzero(np.diff(at)):
                own = node[at[b] : at[b + 1]]
                new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                out.append((int(b), short[at[b] : at[b + 1]].tobytes(), own[new].tobytes(), np.diff(np.append(new, len(own))).astype(np.uint32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 3))], ["bucket", "sigs", "nodes", "runs"])

    return docs.mapInArrow(each, "bucket int, sigs binary, nodes binary, runs binary")


class _Met:
    """The signatures of a bucket with the set that came first; what is held grows with distinct signatures, not with the sets of one."""

    def __init__(self):
        self.sig, self.lead, self.shared = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, sig: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Rows (sig, node, lead) of signatures that two sets or more have by now, each pair of a signature and a set not named before."""
        first = np.unique(sig, return_index=True)
        fresh = ~np.isin(first[0], self.sig, assume_unique=True)
        keys, leads = np.concatenate([self.sig, first[0][fresh]]), np.concatenate([self.lead, node[first[1][fresh]]])
        order = np.argsort(keys)
        self.shared = np.concatenate([self.shared, np.zeros(fresh.sum(), bool)])[order]
        self.sig, self.lead = keys[order], leads[order]
        at = np.searchsorted(self.sig, sig)
        other = node != self.lead[at]
        begun = np.unique(at[other])
        begun = begun[~self.shared[begun]]
        self.shared[begun] = True
        s = np.concatenate([sig[other], self.sig[begun]]).view(np.int64)
        return np.stack([s, np.concatenate([node[other], self.lead[begun]]), np.concatenate([self.lead[at][other], self.lead[begun]])])


def _shared(packed: DataFrame, buckets: int) -> DataFrame:
    """(sig, id, lead) for every signature that several sets have."""

    def each(batches):
        now, met, waiting, size = None, None, [], 0

        def flush():
            out = met.add(*map(np.concatenate, zip(*(_unpack(*x) for x in waiting))))
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["sig", "id", "lead"])

        for batch in batches:
            for bucket, *part in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sigs", "nodes", "runs"))):
                if waiting and (bucket != now or size > 500_000):
                    yield flush()
                    size = 0
                if bucket != now:
                    now, met = bucket, _Met()
                waiting.append(part)
                size += len(part[0]) // 6
        if waiting:
            yield flush()

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(each, "sig bigint, id bigint, lead bigint")


def _alike(both: int, na: int, nb: int, over: int, under: int) -> bool:
    return both * under >= (na + nb - both) * over


def _possible(pairs: DataFrame, classes: DataFrame, over: int, under: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parities do not rule out that they are alike; none that is alike is lost."""
    side = lambda c: classes.select(F.col("h1").alias(c), F.col("n").alias("n" + c), F.col("par").alias("p" + c))
    fits = F.least("na", "nb") * under >= F.greatest("na", "nb") * over
    met = pairs.join(side("a"), "a").join(side("b"), "b").filter(fits).select("a", "b", "na", "nb", "pa", "pb")

    def each(batches):
        for batch in batches:
            found = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "pa", "pb"))):
                found.append(_alike((na + nb - apart(x, y)) // 2, na, nb, over, under))
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return met.mapInArrow(each, "a bigint, b bigint").distinct()


def _verify(pairs: DataFrame, node_texts: DataFrame, words: int, over: int, under: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough; pairs of one a follow each other, so its set is made once."""
    side = lambda c: node_texts.select(F.col("node").alias(c), F.col("text").alias("t" + c))

    def each(batches):
        hashes, last, own = WordHashes(), None, None
        for batch in batches:
            found = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb").to_pylist()):
                if a != last:
                    last, own = a, _set_of(x.as_py(), hashes, words)
                other = _set_of(y, hashes, words)
                found.append(_alike(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other), over, under))
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(each, "a bigint, b bigint").distinct()


def _differences(members: DataFrame, words: int, over: int, under: int) -> DataFrame:
    """(lead, id, root, n, d, w, far, extra) for members(lead, id, root, text, lead_text): n members, d of them or of the lead's in one of the two alone (extra), far if the two are not alike.

    Sets a and b of a lead are alike where their extras have at least (w of a + w of b) / (2 (over + under)) in common.
    """

    def each(batches):
        hashes, last, own = WordHashes(), None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, rows = batch.slice(at, 200), []
                for lead, text, lead_text in zip(part.column("lead").to_pylist(), part.column("text").to_pylist(), part.column("lead_text")):
                    if lead != last:
                        last, own = lead, _set_of(lead_text.as_py(), hashes, words)
                    other = _set_of(text, hashes, words)
                    extra = np.setxor1d(own, other, assume_unique=True)
                    n, d = len(other), len(extra)
                    rows.append((n, d, (over + under) * (d - n) + 2 * over * n, not _alike((n + len(own) - d) // 2, n, len(own), over, under), extra.view(np.int64)))
                made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([*map(part.column, ("lead", "id", "root")), *made], ["lead", "id", "root", "n", "d", "w", "far", "extra"])

    return members.mapInArrow(each, "lead bigint, id bigint, root bigint, n bigint, d bigint, w bigint, far boolean, extra array<bigint>")


def _met_in_differences(held: DataFrame, over: int, under: int) -> DataFrame:
    """Pairs (a, b) of held (as `_differences` gives it) that may be alike; lost are none but those of two sets that are both alike to their lead.

    Alike sets a and b, a not alike to the lead, share so many members of their extras that with these in one order, the rarest first, they share one of
    the first d - o + 1 of either, o being the least overlap with any partner. Overlaps are at least 1: differences are a metric.
    """
    scale = 2 * (over + under)
    up = lambda x: F.greatest(F.lit(1), F.ceil(x / scale))
    least = held.filter("d > 0").groupBy("lead").agg(F.min("w").alias("w_any"), F.min(F.when(F.col("far"), F.col("w"))).alias("w_far")).filter("w_far is not null")
    reach = held.drop("extra").join(least, "lead").select("lead", "id", "root", "n", "d", "w", (F.col("d") - up(F.col("w") + F.col("w_far")) + 1).alias("kept"), F.when(F.col("far"), F.col("d") - up(F.col("w") + F.col("w_any")) + 1).alias("asked"))
    each = held.join(least.select("lead"), "lead", "left_semi").select("lead", "id", "d", F.explode("extra").alias("member"))
    often = each.groupBy("lead", "member").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    met = each.join(often, ["lead", "member"])
    # Members that one set alone has are the rarest; they need no row, as they meet nothing.
    whole = Window.partitionBy("lead", "id")
    placed = met.select("lead", "id", "member", (F.col("d") - F.count(F.lit(1)).over(whole) + F.row_number().over(whole.orderBy("often", "member"))).alias("place"))
    placed = materialize(placed.join(reach, ["lead", "id"]).filter("place <= kept or place <= asked"))
    side = lambda c: placed.select("lead", "member", F.col("id").alias(c), *(F.col(x).alias(x + c) for x in ("root", "n", "d", "w", "place", "kept", "asked")))
    room = F.least(F.col("da") - F.col("placea"), F.col("db") - F.col("placeb")) + 1
    fits = (F.least("na", "nb") * under >= F.greatest("na", "nb") * over) & (room * scale >= F.col("wa") + F.col("wb"))
    pairs = side("a").filter("placea <= askeda").join(side("b").filter("placeb <= keptb"), ["lead", "member"]).filter("a <> b and roota <> rootb").filter(fits)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bound(over: int, under: int) -> Column:
    """Whether sizes na, nb and folded parities qa0..., qb0... leave it open that two sets are alike."""
    differ = sum((F.bit_count(F.col(f"qa{i}").bitwiseXOR(F.col(f"qb{i}"))) for i in range(FOLDED)), F.lit(0))
    both = F.floor((F.col("na") + F.col("nb") - differ) / 2)
    return (F.least("na", "nb") * under >= F.greatest("na", "nb") * over) & (both * under >= (F.col("na") + F.col("nb") - both) * over)


def _classes(texts: DataFrame, seen: DataFrame, over: int, under: int, words: int) -> DataFrame:
    """(n, h1, h2, class_id, root, component_id) for each set in seen(id, n, h1, h2, par) of texts(id, text); sets of a component share a root."""
    spark = texts.sparkSession
    named = seen.filter("n > 0 and id is not null")
    classes = materialize(named.groupBy("n", "h1", "h2").agg(F.min("id").alias("class_id"), F.first("par").alias("par"), *(F.first(q).alias(q) for q in _QS)))
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = F.array(*map(F.lit, bands(over, under)))
    sizes = classes.groupBy(F.size(F.filter(edges, lambda e: e <= F.col("n"))).alias("band")).count()
    held = {r["band"] - 1: r["count"] for r in sizes.collect()}  # as many rows as bands
    keys = materialize(_shared(_packed(texts.filter("id is not null"), words, over, under, buckets, held), buckets).distinct())

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, text) for nodes(h1)."""
        wanted = classes.join(nodes, "h1", "left_semi").select(F.col("class_id").alias("id")).distinct()
        node_texts = _node_texts(texts.join(wanted, "id", "left_semi"), words)
        return materialize(node_texts.join(nodes.withColumnRenamed("h1", "node"), "node", "left_semi"))

    def check(pairs: DataFrame, one_each: bool) -> DataFrame:
        pairs = _possible(pairs, classes, over, under)
        pairs = materialize(pairs.groupBy("b").agg(F.min("a").alias("a")) if one_each else pairs)
        return materialize(_verify(pairs, texts_of(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct()), words, over, under))

    def crowded(rows: DataFrame) -> DataFrame:
        """Pairs (a, b) among the sets of each signature in rows(sig, id, root). A signature's lead here is the root that most of its sets have, so a group's signatures share few leads."""
        most = rows.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("sets")).groupBy("sig").agg(F.max_by("root", F.struct("sets", "root")).alias("lead"))
        members = materialize(rows.select("sig", "id", "root").join(most, "sig").select("lead", "id", "root").distinct())
        read = texts_of(members.select(F.explode(F.array("lead", "id")).alias("h1")).distinct()).dropDuplicates(["node"])  # an id may have equal rows
        met = members.join(read.withColumnRenamed("node", "id"), "id").join(read.select(F.col("node").alias("lead"), F.col("text").alias("lead_text")), "lead")
        held = materialize(_differences(met.select("lead", "id", "root", "text", "lead_text"), words, over, under))
        near = held.filter("not far and root <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
        return _met_in_differences(held, over, under).unionByName(near)

    links = check(keys.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), True)
    for last in (False, True):
        roots = components(links).withColumnRenamed("node", "id")
        placed = keys.select("sig", "id").join(roots, "id", "left").select("sig", "id", F.coalesce("root", "id").alias("root"))
        split = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by(F.struct("id", "root"), F.xxhash64("id", "root")).alias("lead"), F.count(F.lit(1)).alias("sets")).filter("lo <> hi")
        left = materialize(placed.join(split.select("sig", F.col("lead.id").alias("lead"), F.col("lead.root").alias("lead_root"), "sets"), "sig"))
        if last:
            sized = left.filter(F.col("sets") <= CROWD).select("sig", "id", "root").join(classes.select(F.col("h1").alias("id"), "n", *_QS), "id")
            side = lambda c: sized.select("sig", F.col("id").alias(c), F.col("root").alias("r" + c), F.col("n").alias("n" + c), *(F.col(q).alias(f"q{c}{q[1:]}") for q in _QS))
            pairs = side("a").join(side("b"), "sig").filter("a < b and ra <> rb").filter(_bound(over, under)).select("a", "b")
            pairs = pairs.unionByName(crowded(left.filter(F.col("sets") > CROWD))).distinct()
        else:
            pairs = left.filter("root <> lead_root").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
        links = links.unionByName(check(pairs, False)).distinct()
    roots = components(links).withColumnRenamed("node", "h1")
    joined = classes.join(roots, "h1", "left").withColumn("root", F.coalesce("root", "h1"))
    smallest = joined.groupBy("root").agg(F.min("class_id").alias("component_id"))
    return joined.join(smallest, "root").select("n", "h1", "h2", "class_id", "root", "component_id")


def join(docs: DataFrame, over: int = OVER, under: int = UNDER, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, class_id, component_id) for every row of docs: links are 100 * |A and B| >= 90 * |A or B| on sets of shingles.

    class_id is the smallest id with an equal set. A null or empty text has an empty set and stands alone, as does a row with a null id
    (both ids null then). Rows that share an id but not a set are apart. An empty table gives no rows; other columns are left alone.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    seen = materialize(_named(texts, words))
    named = seen.filter("n > 0 and id is not null")
    joined = _classes(texts, seen, over, under, words).drop("root")
    out = named.join(joined, ["n", "h1", "h2"]).select("id", "n", "class_id", "component_id")
    alone = seen.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id")


def deduplicate(docs: DataFrame, over: int = 80, under: int = 100, words: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs with the smallest id of each component, one row each; rows without words or without an id stay.

    Rows that share an id but not a set are in components of their own. Of a component's rows with the smallest id the same one stays in any order.
    """
    own, key = F.col(id_col).cast("bigint"), F.xxhash64(*docs.columns)
    texts = docs.select(own.alias("id"), "text")
    seen = materialize(_named(docs.select(own.alias("id"), "text", key.alias("key")), words))
    firsts = seen.filter("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min(F.struct("id", "key")).alias("first"))
    met = _classes(texts, seen, over, under, words).select("n", "h1", "h2", "root").join(firsts, ["n", "h1", "h2"])
    keep = met.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("__keep_id"), F.col("first.key").alias("__keep_key"))
    judged = own.isNotNull() & (F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES))) > 0)
    kept = docs.filter(judged).join(keep, (own == F.col("__keep_id")) & (key == F.col("__keep_key")), "left_semi")
    once = kept.withColumn("__key", key).dropDuplicates([id_col, "__key"]).drop("__key")
    return once.unionByName(docs.filter(~judged))
