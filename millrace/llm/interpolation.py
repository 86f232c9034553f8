"""Language-model scores by deleted interpolation.

The chance of a word after two others mixes four estimates: of the three words, of the pair, of the word alone (all by maximum likelihood), and the
uniform one. How they are mixed depends on how often training holds the two words before, or, where it never does, the one before (buckets by
powers of two). The weights come from expectation-maximisation on deleted counts: each training token in turn is held out of all the counts that
predict it, its bucket's too. All tokens of the training texts take part: they are summed into a grid of estimates (half decades), whose size does not
grow with the corpus, and only that grid reaches the driver. Counts come to the texts by one exchange (see exchange.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.exchange import counted, spread
from millrace.llm.storage import materialize

HELD_OUT = "pmod(crc32(coalesce(cast(doc_id as string), '')), 7) = 2"
#: Buckets of contexts of one word come first, those of two words after them.
BUCKETS, PAIRS = 128, 64
#: Steps of the grid in a decade, and how many of them there are; the last is a chance of 0.
STEPS, CELLS = 2, 256


def weights(grid: list, uniform: float, rounds: int = 60) -> np.ndarray:
    """A row of weights (three words, pair, word, uniform) for each bucket, from rows (b, w, p3, p2, p1), or without p3; buckets without rows lean on the word."""
    names = [n for n in ("p3", "p2", "p1") if not grid or n in grid[0]]
    out = np.tile([0.0] * (len(names) - 1) + [0.9, 0.1], (BUCKETS, 1))
    if not grid:
        return out
    b, w, *ps = (np.array([r[k] for r in grid], dtype=float) for k in ("b", "w", *names))
    b = b.astype(int)
    p = np.stack([*ps, np.full_like(ps[0], uniform)], 1)
    seen = np.bincount(b, weights=w, minlength=BUCKETS) > 0
    out[seen] = 1 / p.shape[1]
    for _ in range(rounds):
        part = out[b] * p
        part = part / part.sum(1, keepdims=True) * w[:, None]
        total = np.stack([np.bincount(b, weights=part[:, i], minlength=BUCKETS) for i in range(p.shape[1])], 1) + 1e-3
        out[seen] = (total / total.sum(1, keepdims=True))[seen]
    return out


def proper(mix: np.ndarray) -> np.ndarray:
    """Weights that give nothing to estimates that a bucket's contexts cannot have, so chances of all words sum to 1."""
    out = mix.copy()
    out[:PAIRS, 0] = 0
    out[0, 1] = 0
    return out / out.sum(1, keepdims=True)


def estimates(one: np.ndarray, two: np.ndarray, three: np.ndarray, first: np.ndarray, texts: int, total: int, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, [p3, p2, p1]) of each token, from counts without `less` of it; contexts at the start of a text are seen as often as there are training texts."""
    before, pair = np.roll(one, 1), np.roll(two, 1)
    before[first] = pair[first] = texts
    c = [np.maximum(x - less, 0) for x in (three, two, one)]
    of = [np.maximum(pair - less, 0), np.maximum(before - less, 0), np.full(len(one), max(total - less, 0))]
    p = np.stack([np.where(n > 0, k / np.maximum(n, 1), 0.0) for k, n in zip(c, of)], 1) if len(one) else np.zeros((0, 3))
    level = lambda n: np.minimum(np.log2(n + 1).astype(np.int64), PAIRS - 1)
    return np.where(of[0] > 0, PAIRS + level(of[0]), level(of[1])), p


#: Tokens that are worked on at once, or one text.
SLICE = 200_000


def _rows(batches) -> Iterator[tuple]:
    """(ids, held, sizes, first, one, two, three) of some texts of a block at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            held, sizes = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("held", "sizes"))
            counts = [spread(batch.column(c)[i].as_py()) for c in ("one", "two", "three")]
            ids, ends, at = batch.column("ids")[i].values, np.cumsum(sizes, dtype=np.int64), 0
            while at < len(sizes):
                begin = int(ends[at] - sizes[at])
                to = max(at + 1, int(np.searchsorted(ends, begin + SLICE, side="right")))
                own = sizes[at:to].astype(np.int64)
                yield ids[at:to], held[at:to].astype(bool), own, np.cumsum(own) - own, *(c[begin : ends[to - 1]] for c in counts)
                at = to


def _grid(blocks: DataFrame, texts: int, total: int) -> list:
    """Cells (b, w, p3, p2, p1) of all training tokens: weight and mean estimates."""

    def each(batches):
        for _, held, sizes, first, one, two, three in _rows(batches):
            train = np.repeat(~held, sizes)
            if not train.any():
                continue
            b, p = estimates(one, two, three, first, texts, total, 1)
            b, p = b[train], p[train]
            with np.errstate(divide="ignore"):
                q = np.where(p > 0, np.clip(-np.round(np.log10(p) * STEPS), 0, CELLS - 2), CELLS - 1).astype(np.int64)
            code, at = np.unique(((b * CELLS + q[:, 0]) * CELLS + q[:, 1]) * CELLS + q[:, 2], return_inverse=True)
            sums = [np.bincount(at, weights=x, minlength=len(code)) for x in (np.ones(len(b)), *p.T)]
            yield pa.RecordBatch.from_arrays([pa.array(code), *map(pa.array, sums)], ["code", "w", "s3", "s2", "s1"])

    cells = blocks.select("ids", "held", "sizes", "one", "two", "three").mapInArrow(each, "code bigint, w double, s3 double, s2 double, s1 double")
    cells = cells.groupBy("code").agg(*(F.sum(c).alias(c) for c in ("w", "s3", "s2", "s1")))
    mean = lambda c: (F.col(f"s{c}") / F.col("w")).alias(f"p{c}")
    # Sorted, as sums of floats depend on their order.
    return cells.select("code", F.floor(F.col("code") / CELLS**3).alias("b"), "w", mean(3), mean(2), mean(1)).orderBy("code").collect()


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text).

    A null or empty text is its end alone; texts of any length are read whole. Repeated rows count as often as they occur, and each gets a row;
    ties have no effect. Without a training text, counts are 0 and all chances uniform. An empty table gives no rows; other columns are left alone.
    """
    base = docs.select(F.col("doc_id").alias("id"), F.expr(HELD_OUT).alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = materialize(counted(base))
    known = blocks.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v"), F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)).alias("texts")).first()
    n, v, texts = known["n"], known["v"], known["texts"]
    uniform = 1 / (v + 1)
    mix = proper(weights([r.asDict() for r in _grid(blocks, texts, n)], uniform)) if n else np.tile([0.0, 0.0, 0.0, 1.0], (BUCKETS, 1))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def each(batches):
        for ids, held, sizes, first, one, two, three in _rows(batches):
            b, p = estimates(one, two, three, first, texts, n)
            own = mix[b]
            chance = np.log10((own[:, :3] * p).sum(1) + own[:, 3] * uniform)
            plain = np.log10((one + 1) / (n + v + 1))
            add = lambda x: np.add.reduceat(x, first) if len(first) else x
            columns = [ids, pa.array(held), pa.array(sizes), pa.array(add((one > 0).astype(np.int64))), pa.array(np.full(len(sizes), n, np.int64)), pa.array(add(plain)), pa.array(add(chance))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.select("ids", "held", "sizes", "one", "two", "three").mapInArrow(each, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
