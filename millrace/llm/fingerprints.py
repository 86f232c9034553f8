"""Document fingerprints: every shingle hash below a fixed share of the hash range (a threshold-scaled sketch).

The threshold does not depend on the text, so sketches of texts of any lengths can be compared and merged: the hashes of a union are the union of
the hashes. Shingles are runs of CHARS code points; of fewer, the whole text is one. A fingerprint is `shingles:checksum:hashes`: 32-bit hashes in
ascending order, base64. Texts too short to hold a kept hash are alike only if their checksums are equal.

Each text is compared with its successor by id. Rows are dealt into ranges of ids and read in order there; the first row of the next range, one
for each range, closes the gap. Texts are shuffled once, and no range grows with a key: ties are in one range, null ids in the first.
"""

from __future__ import annotations

import base64
import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.text import mix

CHARS, SHARE = 10, 8
#: Code points that are hashed at once, and bytes of rows that are gathered before they are handed on.
BLOCK, HANDED = 1 << 18, 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def sketch(text: str, chars: int = CHARS, share: int = SHARE) -> tuple[int, int, np.ndarray]:
    """(number of shingles, checksum, kept 32-bit hashes ascending)."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    check = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little")
    if not len(points):
        return 0, check, np.zeros(0, dtype=np.uint32)
    k = min(chars, len(points))
    n = len(points) - k + 1
    kept = []
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        h = np.full(size, np.uint64(k))
        for i in range(k):
            h = h * _BASE + points[at + i : at + i + size]
        h = (mix(h) >> np.uint64(32)).astype(np.uint32)
        kept.append(np.unique(h[h < np.uint32((1 << 32) // share)]))
    return n, check, kept[0] if len(kept) == 1 else merge(*kept)


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of several texts' shingles together."""
    return reduce(np.union1d, sketches)


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """The larger of both containments, estimated on the kept hashes: 1 for equal texts."""
    if a[1] == b[1]:
        return 1.0
    least = min(len(a[2]), len(b[2]))
    return len(np.intersect1d(a[2], b[2], assume_unique=True)) / least if least else 0.0


def as_string(s: tuple[int, int, np.ndarray]) -> str:
    return f"{s[0]}:{s[1]:016x}:{base64.b64encode(s[2].astype('<u4').tobytes()).decode()}"


def with_next(docs: DataFrame, ranges: int, id_col: str, text_col: str) -> DataFrame:
    """(part, tail, id, tie, text), sorted within partitions: rows of each range of ids in order, then with tail 1 the row that follows."""
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = sorted(set(base.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("id"))), F.lit(0)) if cuts else F.lit(0)
    base = base.select(F.when(F.col("id").isNull(), 0).otherwise(part).alias("part"), F.lit(0).alias("tail"), "id", F.xxhash64("text").alias("tie"), "text")
    order = F.struct(F.col("id").isNotNull(), "id", "tie")
    heads = base.groupBy("part").agg(F.min_by(F.struct("id", "tie", "text"), order).alias("h"))
    # As many rows as ranges.
    by = W.orderBy("part")
    first = F.first("h").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    tails = heads.select("part", F.coalesce(F.lead("h").over(by), first).alias("h")).select("part", F.lit(1).alias("tail"), "h.id", "h.tie", "h.text")
    return base.unionByName(tails).repartition(ranges, "part").sortWithinPartitions("part", "tail", F.col("id").asc_nulls_first(), "tie")


def fingerprint(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs.

    A null text is an empty one. The next document is that of the next id, after the last the first; null ids come first, ties are in order
    of a hash of the text, repeated rows follow each other, a lone document follows itself. Other columns are left alone.
    """
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def each(batches):
        last, out, held = None, [], 0

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            tails, keys, texts = (batch.column(c) for c in ("tail", "id", "text"))
            for at in range(batch.num_rows):  # a text at a time: a batch may hold ten thousand long ones
                tail, key, text = tails[at].as_py(), keys[at].as_py(), texts[at].as_py()
                own = sketch(text)
                if last is not None:
                    k, t, s = last
                    half = len(t) // 2
                    edited = t[: len(t) - half] + text[:half]
                    e = sketch(edited)
                    out.append((k, len(t), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), as_string(s), as_string(e), likeness(s, e), likeness(s, own)))
                    held += len(out[-1][3]) + len(out[-1][4])
                last = None if tail else (key, text, own)
                if held > HANDED:
                    yield handed()
                    out, held = [], 0
        if out:
            yield handed()

    rows = with_next(docs, ranges, id_col, text_col).mapInArrow(each, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return rows.withColumnRenamed("id", id_col)
