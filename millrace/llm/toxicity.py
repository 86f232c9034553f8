"""Toxic spans by a linear-chain conditional random field.

Token labels come from labelled documents: words that stand out in toxic ones (likelihood ratio of document counts) are tagged there. The
field is fitted to those tags on a bounded sample of labelled rows (SAMPLE of each class, smallest hashes first), and so are the
weights that turn a text's forward-backward marginals into its score. Both are small, bounded by the sample, and travel with the tasks.

Texts of a batch form one chain: at the start of a text the step's matrix has equal rows and so forgets what came before. The chain is
cut into as many pieces as a piece has words, and products run over all pieces at once; whole texts of any length are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import LOWER, MARKS, UPPER

SAMPLE = 1200
HELD_OUT = "pmod(crc32(coalesce(cast({0} as string), '')), 3) = 1"
_FOLD = bytes.maketrans((UPPER + MARKS).encode(), (LOWER + " " * len(MARKS)).encode())
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BATCH_WORDS = 150_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def marginals(e: np.ndarray, first: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(p, pairs): the chance of tag 1 at every place, and summed chances of tag pairs at all places but first ones.

    e is tag 1's score less tag 0's, first marks starts of texts, a the scores of tag pairs.
    """
    n = len(e)
    if not n:
        return e, np.zeros((2, 2))
    width = max(1, int(np.sqrt(n)))
    pieces = -(-n // width)
    top = np.maximum(e, 0)
    m = np.zeros((pieces * width, 2, 2))
    m[:n, :, 0] = np.exp(a[:, 0] - a.max()) * np.exp(-top)[:, None]
    m[:n, :, 1] = np.exp(a[:, 1] - a.max()) * np.exp(e - top)[:, None]
    at = np.flatnonzero(first)
    m[at, :, 0], m[at, :, 1] = np.exp(-top[at])[:, None], np.exp(e[at] - top[at])[:, None]
    m[n:] = np.eye(2)
    m = np.ascontiguousarray(m.reshape(pieces, width, 2, 2).transpose(1, 2, 3, 0))  # width, 2, 2, pieces
    ahead, behind = np.empty_like(m), np.empty_like(m)
    times = lambda x, y: np.stack([np.stack([x[i, 0] * y[0, j] + x[i, 1] * y[1, j] for j in (0, 1)]) for i in (0, 1)])
    run = m[0]
    for j in range(width):
        run = run if j == 0 else times(run, m[j])
        run = run / run.sum((0, 1))
        ahead[j] = run
    run = np.repeat(np.eye(2)[:, :, None], pieces, 2)
    for j in range(width - 1, -1, -1):
        behind[j] = run
        run = times(m[j], run)
        run = run / run.sum((0, 1))
    left, right = np.empty((2, pieces)), np.empty((2, pieces))
    x = np.array([0.5, 0.5])
    for c in range(pieces):
        left[:, c] = x
        x = x @ ahead[-1, :, :, c]
        x = x / x.sum()
    x = np.array([0.5, 0.5])
    for c in range(pieces - 1, -1, -1):
        right[:, c] = x
        x = ahead[-1, :, :, c] @ x
        x = x / x.sum()
    flat = lambda v: v.transpose(2, 0, 1).reshape(-1, 2)[:n]
    alpha = flat(left[0] * ahead[:, 0] + left[1] * ahead[:, 1])
    beta = flat(behind[:, :, 0] * right[0] + behind[:, :, 1] * right[1])
    both = alpha * beta
    p = both[:, 1] / both.sum(1)
    later = np.flatnonzero(~first[1:]) + 1
    step = m.transpose(3, 0, 1, 2).reshape(-1, 2, 2)[later]
    pair = alpha[later - 1][:, :, None] * step * beta[later][:, None, :]
    return p, (pair / pair.sum((1, 2), keepdims=True)).sum(0)


def _starts(sizes: list[int]) -> np.ndarray:
    first = np.zeros(sum(sizes), dtype=bool)
    at = np.cumsum([0, *sizes])[:-1]
    first[at[np.asarray(sizes) > 0]] = True
    return first


def _in_blocks(e: np.ndarray, first: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """marginals() of a block of whole texts at a time, so that memory is a block's."""
    at = np.flatnonzero(first)
    cuts = [0, *at[np.flatnonzero(np.diff(at // _BATCH_WORDS)) + 1], len(e)]
    parts = [marginals(e[x:y], first[x:y], a) for x, y in zip(cuts, cuts[1:]) if y > x]
    return np.concatenate([np.zeros(0), *(p for p, _ in parts)]), sum((q for _, q in parts), np.zeros((2, 2)))


def _features(p: np.ndarray, sizes: list[int]) -> np.ndarray:
    """For each text: 1, the log of 1 plus the expected number of toxic words, and the largest marginal."""
    out = np.zeros((len(sizes), 3))
    out[:, 0] = 1
    at = 0
    for i, n in enumerate(sizes):
        if n:
            out[i, 1], out[i, 2] = np.log1p(p[at : at + n].sum()), p[at : at + n].max()
        at += n
    return out


class Tagger:
    """words: score of tag 1 for words by themselves; other: for all others; a: scores of tag pairs; doc: weights of _features."""

    def __init__(self, words: dict[bytes, float], other: float, a: np.ndarray, doc: np.ndarray):
        self.words, self.other, self.a, self.doc = words, other, a, doc

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """A score for each text and the marginals of its words."""
        found = [words_of(t) for t in texts]
        sizes = [len(x) for x in found]
        get, other = self.words.get, self.other
        e = np.fromiter((get(w, other) for x in found for w in x), dtype=float, count=sum(sizes))
        p, _ = marginals(e, _starts(sizes), self.a)
        score = 1 / (1 + np.exp(-np.clip(_features(p, sizes) @ self.doc, -500, 500)))
        return score, np.split(p, np.cumsum(sizes)[:-1])


def lexicon(docs: list[list[bytes]], toxic: np.ndarray, false: float = 0.05) -> set[bytes]:
    """Words over twice as frequent in toxic documents whose likelihood ratio is significant: of those returned, a share `false` is expected to be there by chance.

    The k smallest chances are taken for the largest k whose k-th is at most false * k / words (Benjamini and Hochberg), so strong words never
    shut out weak ones, such as those of a language with few rows.
    """
    inside, outside = Counter(), Counter()
    for words, y in zip(docs, toxic):
        (inside if y else outside).update(set(words))
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    ratio = {}
    for w, k1 in inside.items():
        k0 = outside[w]
        if k1 / n1 > 2 * k0 / n0:
            q = (k1 + k0) / (n1 + n0)
            term = lambda k, n: (k * np.log(k / n / q) if k else 0) + ((n - k) * np.log((1 - k / n) / (1 - q)) if k < n else 0)
            ratio[w] = 2 * (term(k1, n1) + term(k0, n0)) if q < 1 else 0
    tested = len(inside.keys() | outside.keys())
    ranked = sorted(ratio.values(), reverse=True)
    bounds = (NormalDist().inv_cdf(false * k / tested / 2) ** 2 for k in range(1, len(ranked) + 1))
    least = min((x for x, bound in zip(ranked, bounds) if x >= bound), default=np.inf)
    return {w for w, x in ratio.items() if x >= least}


def fit(texts: list[str | None], toxic: np.ndarray, weight: np.ndarray, rounds: int = 30) -> Tagger:
    """A field and document weights from labelled texts; without labels of both kinds all scores are the share of toxic ones (0.5 without any)."""
    one: dict[bytes, bytes] = {}
    docs = [[one.setdefault(w, w) for w in words_of(t)] for t in texts]  # each word is held once
    sizes = [len(x) for x in docs]
    stand_out = lexicon(docs, toxic)
    df = Counter(w for x in docs for w in set(x))
    known = {w: i + 1 for i, w in enumerate(sorted(w for w, k in df.items() if k >= 3 or w in stand_out))}
    ids = np.fromiter((known.get(w, 0) for x in docs for w in x), dtype=np.int64, count=sum(sizes))
    tags = np.fromiter((bool(y) and w in stand_out for x, y in zip(docs, toxic) for w in x), dtype=bool, count=sum(sizes))
    del docs
    first = _starts(sizes)
    later = np.flatnonzero(~first[1:]) + 1 if len(first) else np.zeros(0, dtype=int)
    seen = np.bincount(ids, weights=tags, minlength=len(known) + 1)
    pairs = np.array([[np.sum((tags[later - 1] == i) & (tags[later] == j)) for j in (0, 1)] for i in (0, 1)], dtype=float)
    w, a = np.full(len(known) + 1, -2.0), np.zeros((2, 2))
    past_w, past_a = np.full_like(w, 1e-3), np.full_like(a, 1e-3)
    for _ in range(rounds if stand_out else 0):
        p, expected = _in_blocks(w[ids], first, a)
        gw = seen - np.bincount(ids, weights=p, minlength=len(w)) - 0.01 * w
        ga = pairs - expected - 0.01 * a
        past_w += gw**2
        past_a += ga**2
        w += gw / np.sqrt(past_w)
        a += ga / np.sqrt(past_a)
    p, _ = _in_blocks(w[ids], first, a)
    x, doc = _features(p, sizes), np.zeros(3)
    for _ in range(25 if len(texts) else 0):
        q = 1 / (1 + np.exp(-np.clip(x @ doc, -500, 500)))
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 0.05, 0.05])
        move = np.linalg.solve(curve, x.T @ (weight * (toxic - q)) - np.array([1e-3, 0.05, 0.05]) * doc)
        doc = doc + np.clip(move, -2, 2)
    return Tagger({k: float(w[i]) for k, i in known.items() if abs(w[i] - w[0]) > 1e-9}, float(w[0]), a, doc)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Fits on labelled rows that are not held out: at most `sample` of each class, by smallest hash of the id."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & ~F.expr(HELD_OUT.format("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    texts, toxic, weight = [], [], []
    for kind, n in sorted(count.items()):
        some = marked.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
        texts += [r["text"] for r in rows]
        toxic += [kind] * len(rows)
        weight += [n / min(n, sample)] * len(rows)
    weight = np.asarray(weight, dtype=float)
    return fit(texts, np.asarray(toxic, dtype=float), weight / weight.mean() if len(weight) else weight)


def tag(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("score", "spans")) -> DataFrame:
    """Adds score and spans, under the given names, (start, end: UTF-8 offsets of words tagged toxic) to the id and the columns of keep.

    A null or empty text has no words and gets the score of no toxic words. Every row, repeated ones too, is scored by itself, and texts of any
    length are read whole. An empty table gives no rows; other columns are left alone.
    """
    source = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{names[0]}` double, `{names[1]}` array<struct<start:int,end:int>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def each(batches):
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            at = 0
            while at < len(texts):  # a group of texts of about _BATCH_WORDS words, one at least
                end, room = at, _BATCH_WORDS * 6
                while end < len(texts) and (end == at or room > 0):
                    room -= len(texts[end] or "")
                    end += 1
                score, places = tagger.score(texts[at:end])
                spans = []
                for t, p in zip(texts[at:end], places):
                    hot = set(np.flatnonzero(p >= 0.5))
                    spans.append([{"start": m.start(), "end": m.end()} for i, m in enumerate(_WORD.finditer(t.encode("utf-8", "replace"))) if i in hot] if hot else [])
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(score, pa.float64()), pa.array(spans, span)], [*(f.name for f in fields), *names])
                at = end

    return source.mapInArrow(each, schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every row of docs."""
    out = tag(docs, train(docs, labels))
    return out.select("doc_id", F.expr(HELD_OUT.format("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
