"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Trusted are documents labelled of good quality. Counts, continuation counts and discounts come from all of them by grouped counts. Texts meet the
model by a sharded join of counts (see lookup.py), as the logarithm of a text's chance is a sum of values of its words and pairs. A document is kept if its perplexity is at most its language's threshold.

Thresholds come from labelled documents that the counts leave out (HELD_OUT): a language's is where trusted and poor ones part best. Without
both kinds, the limit of all languages holds; without any, the quantile of the language's documents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.lookup import least_often, sums
from millrace.llm.ngrams import pairs
from millrace.llm.storage import materialize

#: Used only where no held-out labels of both kinds are.
QUANTILE = 0.97
#: A third of the labelled documents.
HELD_OUT = "pmod(crc32(coalesce(cast({0} as string), '')), 3) = 1"
#: Discounts are this at least, so every context leaves something to words it was not seen with.
LEAST = 0.01
#: Steps of log perplexity in which held-out documents are counted.
STEPS = 100


def discounts(n: list[int]) -> tuple[float, float, float]:
    """For counts of 1, 2, and 3 or more, from the numbers of pairs that occur 1, 2, 3 and 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    each = lambda k, a, b: min(float(k), max(0.0, k - (k + 1) * y * b / a)) if a else y
    return each(1, n[0], n[1]), each(2, n[1], n[2]), each(3, n[2], n[3])


def parting(counts: dict[int, tuple[int, int]]) -> int | None:
    """The step up to which documents are kept, from counts of (poor, trusted) ones by step: the largest sum of the shares of poor ones above and trusted ones up to it.

    Of equal ones the middle. None without both kinds.
    """
    poor, good = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not poor or not good:
        return None
    best, found, p, g, order = -1.0, [], 0, 0, sorted(counts)
    for k, step in enumerate(order):
        p, g = p + counts[step][0], g + counts[step][1]
        value = g * poor - p * good
        if value > best:
            best, found = value, [step, order[k + 1] - 1 if k + 1 < len(order) else step]
    return sum(found) // 2 if found else order[-1]


def model(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float, int]:
    """The model of training pairs found(ctx, word, n), as values to be added: (words(word, value, top), pairs(ctx, word, value), the most frequent of these, unseen, rows of both).

    A pair's chance is its discounted share of its context plus what the discounts freed there, spread by the words' own chances; these are discounted
    shares of the kinds of pairs that end in a word, and what is freed goes to all words and an unseen one alike. Discounts of both come from their own
    counts of counts. The logarithm of a text's chance is then, for each token, `unseen`, the value of the word before it and its own, and the pair's.
    """
    train = materialize(found.groupBy("ctx", "word").agg(F.sum("n").alias("c")))
    fronts = materialize(train.groupBy("word").agg(F.count(F.lit(1)).alias("a"), F.sum("c").alias("often")))

    def rates(counts: DataFrame, name: str) -> tuple[list[float], int, int]:
        times = (F.coalesce(F.count_if(F.col(name) == i), F.lit(0)).alias(f"n{i}") for i in (1, 2, 3, 4))
        r = counts.agg(*times, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(name), F.lit(0)).alias("all")).first()
        return [max(LEAST, d) for d in discounts([r[f"n{i}"] for i in (1, 2, 3, 4)])], r["rows"], r["all"]

    cut = lambda d, c: F.when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])
    high, rows, _ = rates(train, "c")
    low, kinds, ends = rates(fronts, "a")
    after = materialize(train.groupBy("ctx").agg(F.sum("c").alias("all"), (F.sum(cut(high, "c")) / F.sum("c")).alias("freed")).withColumnRenamed("ctx", "before"))
    freed = (fronts.agg(F.sum(cut(low, "a")).alias("freed")).first()["freed"] / ends if ends else 1.0) / (kinds + 1)
    chance = (F.col("a") - cut(low, "a")) / max(1, ends) + freed
    unseen = math.log(freed)
    words = fronts.join(after, F.col("word") == F.col("before"), "full").select(
        F.coalesce("word", "before").alias("word"),
        (F.coalesce(F.ln(chance) - unseen, F.lit(0.0)) + F.coalesce(F.ln("freed"), F.lit(0.0))).alias("value"),
        (F.coalesce("often", F.lit(0)) >= least_often(fronts, "often")).alias("top"),
    )
    share = (F.col("c") - cut(high, "c")) / F.col("all")

    def valued(some: DataFrame) -> DataFrame:
        met = some.join(after, F.col("ctx") == F.col("before")).join(fronts.select(F.col("word").alias("w"), chance.alias("alone")), F.col("word") == F.col("w"))
        return met.select("ctx", "word", F.ln(1 + share / (F.col("freed") * F.col("alone"))).alias("value"))

    return words, valued(train), valued(train.filter(F.col("c") >= least_often(train, "c"))), unseen, rows + kinds + 1


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, threshold, keep) for every row of docs(doc_id, text, lang).

    A null or empty text is its end alone. Null languages form one language. Without trusted text all words are alike. Repeated rows each give a
    row; other columns are left alone.
    """
    base = docs.select("doc_id", "lang", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))
    marked = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    trusted = marked.filter("quality = 1").filter(~F.expr(HELD_OUT.format("doc_id"))).select("doc_id")
    words, values, top, unseen, known = model(pairs(base.join(trusted, "doc_id", "left_semi")))
    out = sums(docs, words, values, top, known).withColumn("total", F.col("total") + F.col("n_tokens") * F.lit(unseen))
    out = materialize(out.select("doc_id", "lang", "n_tokens", F.exp(-F.col("total") / F.col("n_tokens")).alias("perplexity")))
    step = F.floor(F.ln("perplexity") * STEPS).cast("int")
    tested = out.join(marked.filter(HELD_OUT.format("doc_id")), "doc_id").groupBy("lang", step.alias("step")).agg(F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("quality") == 1).alias("good"))
    by_lang: dict[str | None, dict[int, tuple[int, int]]] = {}
    whole: dict[int, tuple[int, int]] = {}
    for r in tested.collect():  # languages by steps at most
        by_lang.setdefault(r["lang"], {})[r["step"]] = (r["poor"], r["good"])
        p, g = whole.get(r["step"], (0, 0))
        whole[r["step"]] = (p + r["poor"], g + r["good"])
    known, common = {lang: parting(c) for lang, c in by_lang.items()}, parting(whole)
    above = lambda at: float(np.exp((at + 1) / STEPS))
    limits = out.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("quantile")).withColumnRenamed("lang", "l")
    rows = [(lang, above(at)) for lang, at in known.items() if at is not None]
    given = docs.sparkSession.createDataFrame(rows, "g string, given double")
    other = F.lit(None if common is None else above(common)).cast("double")
    limits = limits.join(F.broadcast(given), F.col("l").eqNullSafe(F.col("g")), "left").select("l", F.coalesce("given", other, "quantile").alias("threshold"))
    return out.join(limits, F.col("lang").eqNullSafe(F.col("l"))).select("doc_id", "lang", "n_tokens", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("keep"))
