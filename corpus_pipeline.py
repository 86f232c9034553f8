"""The corpus pipeline: toxicity, near duplicates, benchmark passages, source weights, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, jaccard, mixing, sharding, toxicity
from millrace.llm.storage import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.7 or more. The field learns from the labelled documents of the whole table.

    Null and empty texts stay, as do repeated rows; an empty table stays empty; extra columns go along.
    """
    tagger = toxicity.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    others = tuple(c for c in docs.columns if c != "doc_id")
    return toxicity.tag(docs, tagger, keep=others, names=("__score", "__spans")).filter("__score < 0.7").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a likeness of 0.8. Rows without words or ids stay; rows that share an id are judged by their own texts."""
    return jaccard.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark. Rows are judged by id and text; null and empty texts stay."""
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number; what the mix hardly reaches goes.

    Rows are told apart by all their columns, so shared and null ids are documents of their own; equal rows are drawn as often as all of them together.
    Rows without words go; an empty table stays empty.
    """
    keyed = docs.withColumn("__row", F.xxhash64(*docs.columns))
    drawn = mixing.mix(keyed.select("__row", "text", "source"), id_col="__row").groupBy(F.col("__row").alias("__drawn"), "size").agg(F.sum("taken").alias("taken"))
    times = drawn.filter("taken > 0").select("__drawn", F.round(F.col("taken") / F.col("size")).cast("int").alias("__times")).filter("__times > 0")
    once = keyed.repartition("__row").dropDuplicates()
    met = once.join(times, F.col("__row") == F.col("__drawn"))
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row, repeated ones too; an empty table gives none."""
    return sharding.shard(docs).drop("vslot")


STAGES = [
    ("toxicity", clean_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("mix_sources", mix_sources),
    ("sharding", into_shards),
]
#: Scores of a field, links of near copies and slots by hash are beyond SQL; tests/llm holds the stages against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
