"""Benchmark decontamination by winnowing.

Of every six consecutive hashes of five-word grams the smallest is kept as a fingerprint, in documents and in benchmark windows alike. Two
equal windows of ten words hold the same six hashes and keep the same smallest one, so every shared window shares a fingerprint at the same
place: joining fingerprints and comparing the ten words around each hit loses nothing and finds nothing false. Items shorter than a
window are one window of their own; for each such length, grams of that whole length are kept.

Documents carry their fingerprints through a bitmap of the benchmark's (a parameter bounds its size) before any row is made of them: positions
that no fingerprint of the benchmark can meet are dropped where they stand, and the texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.storage import materialize
from millrace.llm.text import mark_words

WINDOW, GRAM = 10, 5
BITS = 1 << 22
#: Benchmark windows up to which their table is broadcast; beyond, the join shuffles both sides.
BROADCAST_WINDOWS = 200_000


def gram_hashes(words: Column, k: int) -> Column:
    """Hashes of all runs of k words; fewer words have none."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, grams).otherwise(F.array().cast("array<bigint>"))


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Distinct windows of all items: (n, wkey, k, h, offset, items). wkey joins the n words; h is the fingerprint, at that offset; k its words."""
    words = items.select(F.col(id_col).cast("string").alias("item"), mark_words(F.col(text_col)).alias("w")).withColumn("size", F.size("w")).filter("size > 0")
    n = F.least(F.col("size"), F.lit(window))
    cut = words.select("item", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.slice("w", i, n))).alias("w"))
    cut = cut.groupBy("n", F.array_join("w", " ").alias("wkey")).agg(F.first("w").alias("w"), F.collect_set("item").alias("items"))
    grams = cut.withColumn("g", F.when(F.col("n") == window, gram_hashes(F.col("w"), gram)).otherwise(F.array(F.xxhash64("wkey"))))
    return grams.select("n", "wkey", F.when(F.col("n") == window, gram).otherwise(F.col("n")).alias("k"), F.array_min("g").alias("h"), (F.array_position("g", F.array_min("g")) - 1).cast("int").alias("offset"), "items")


def bit_words(windows: DataFrame, bits: int = BITS) -> str:
    """The bitmap of all fingerprints as 64-bit words, in JSON."""
    at = F.pmod("h", F.lit(bits))
    rows = windows.groupBy(F.shiftright(at, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) & 63 as int))")).alias("b")).collect()  # bits / 64 rows at most
    out = [0] * (bits >> 6)
    for r in rows:
        out[r["i"]] = r["b"]
    return "[" + ",".join(map(str, out)) + "]"


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hits(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """(id, text_hash, n_words, copies, spans, items) for every distinct pair of id and text: spans are (start, n) of matched windows."""
    bitmap = F.from_json(F.lit(bit_words(windows, bits)), "array<bigint>")
    short = sorted(r["n"] for r in windows.filter(F.col("n") < window).select("n").distinct().collect())  # lengths below the window
    few = windows.count() <= BROADCAST_WINDOWS

    def possible(h: Column) -> Column:
        at = F.pmod(h, F.lit(bits))
        return F.getbit(F.get(bitmap, F.shiftright(at, 6).cast("int")), (at.bitwiseAND(F.lit(63))).cast("int")) == 1

    base = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("text_hash"), mark_words(F.col(text_col)).alias("w"))
    base = base.withColumn("g", gram_hashes(F.col("w"), gram))
    per = window - gram + 1

    def smallest(i: Column) -> Column:
        """Whether the hash at i is the smallest of some run of `per` hashes that holds it."""
        return F.exists(F.sequence(F.greatest(i - per + 1, F.lit(0)), F.least(i, F.size("g") - per)), lambda j: F.array_min(F.slice("g", j + 1, F.lit(per))) == F.get("g", i))

    def around(i: Column, k: int) -> Column:
        return F.struct(i.alias("p"), F.get("g", i).alias("h"), F.lit(k).alias("k"))

    long_enough = F.when(F.size("g") >= per, F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: possible(F.get("g", i))))
    base = base.withColumn("c", F.coalesce(long_enough, F.array().cast("array<int>")))
    kept = F.transform(F.filter("c", smallest), lambda i: around(i, gram))
    header = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("k")))
    parts = [header, kept]
    for n in short:
        grams = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i, n=n: F.struct(i.alias("p"), F.xxhash64(F.array_join(F.slice("w", i + 1, F.lit(n)), " ")).alias("h"), F.lit(n).alias("k")))
        parts.append(F.coalesce(F.when(F.size("w") >= n, F.filter(grams, lambda x: possible(x["h"]))), F.array().cast("array<struct<p:int,h:bigint,k:int>>")))
    # The words around a kept position go along; nothing else of the text does.
    rows = base.select("id", "text_hash", F.size("w").alias("n_words"), "w", F.explode(F.concat(*parts)).alias("f"))
    left = F.greatest(F.col("f.p") - (window - gram), F.lit(0))
    rows = rows.select("id", "text_hash", "n_words", F.col("f.p").alias("p"), F.col("f.h").alias("h"), F.col("f.k").alias("k"), left.alias("from"), F.when(F.col("f.p") >= 0, F.slice("w", left + 1, F.lit(2 * window - gram))).alias("around"))
    small = F.broadcast(windows) if few else windows
    met = rows.join(small.select("h", "k", F.col("offset"), "n", "wkey", "items"), ["h", "k"], "left")
    start = F.col("p") - F.col("offset")
    same = F.when((start >= F.col("from")) & (F.array_join(F.slice("around", start - F.col("from") + 1, F.col("n")), " ") == F.col("wkey")), F.struct(start.alias("start"), F.col("n")))
    met = met.withColumn("span", same)
    return met.groupBy("id", "text_hash", "n_words").agg(F.count_if(F.col("p") < 0).alias("copies"), F.collect_set("span").alias("spans"), F.collect_set(F.when(F.col("span").isNotNull(), F.col("items"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    A null or empty text has no words and is clean. An item without words has no window. An item with a null id marks words but is not
    listed. Repeated rows each give a row; rows that share an id but not a text are judged apart. Empty tables give no rows, or only
    clean ones. Other columns are left alone.
    """
    windows = materialize(windows_of(benchmark, item_id, item_text, window, gram))
    found = hits(docs, windows, id_col, text_col, window, gram)
    words = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    items = F.array_sort(F.array_distinct(F.flatten("items")))
    out = found.withColumn("items", items).select(
        F.col("id").alias(id_col), F.col("n_words").cast("bigint").alias("n_words"), F.size(F.array_distinct(words)).cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select(id_col, "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and more) that hold no window of the benchmark; rows that share an id, or a null id, are kept or dropped by their own text."""
    windows = materialize(windows_of(benchmark, "item_id", "text"))
    bad = hits(docs, windows, "doc_id", "text").filter(F.size("spans") > 0).select(F.col("id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (text_hash(F.col("text")) == F.col("__bad_hash")), "left_anti")
