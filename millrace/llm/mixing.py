"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the schedule stands at the point frac(k * golden ratio); cumulative target shares map points to sources, so every stretch
of the schedule holds each source in proportion. Ranks of a source's slots are block numbers: the source's documents, shuffled by a
hash, form one stream of words that is cut into blocks of equal words, and a slot takes the next block, from the start again when the stream ends.
The last block of a source is cut at its target. What the schedule does not reach by its end (sources below its grain) follows it.

Running sums never gather a source in one task: streams are shuffled into buckets, sums of buckets are added up, and only rows of one
bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.storage import materialize
from millrace.llm.text import space_words

GOLDEN = 0.6180339887498949
SLOTS = 65536
CHUNK = 1024
#: Words of a stream for each bucket, on average.
BUCKET_HEX = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, weight, source_size, target) from sources(source, source_size).

    Sources in code-point order, null last, take the weights in turn. A target stops at `most` times the source's size; the excess goes to
    the others by weight until none is above. Filling in order of size over weight reaches that end in one pass.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint"))
    cap = F.lit(most) * F.col("source_size")
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("total") * share - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("ratio", cap / F.col("weight")).withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    )
    return filled.select("source", "weight", "source_size", F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double"))).alias("target"))


def schedule(spark, shares: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(k, nth, rank) for each slot: nth is its source's number, rank its place among that source's slots.

    shares has nth, lo, hi: intervals of 0..1. Points meet intervals through cells of a grid, by equality; slots of a source are ranked
    within chunks of the schedule, from the counts of earlier chunks.
    """
    cells = 4096
    point = F.col("id") * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("k"), (point - F.floor(point)).alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    covers = shares.filter("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1).cast("bigint")))))
    drawn = points.join(covers, "cell").filter("u >= lo and u < hi").select("k", "nth", F.floor(F.col("k") / CHUNK).alias("chunk"))
    before = W.partitionBy("nth").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = drawn.groupBy("nth", "chunk").count().withColumn("earlier", F.coalesce(F.sum("count").over(before), F.lit(0))).select("nth", "chunk", "earlier")
    inside = F.row_number().over(W.partitionBy("nth", "chunk").orderBy("k")) - 1
    return drawn.withColumn("inside", inside).join(counts, ["nth", "chunk"]).select("k", "nth", (F.col("inside") + F.col("earlier")).alias("rank"))


def shuffle_key(id_col: Column) -> Column:
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def mix(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, source, first_slot) for every row of docs; taken counts repeats, first_slot is null where nothing is taken.

    A null or empty text has size 0 and is never taken; a null source is one source; repeated rows are documents of their own; an empty
    table gives no row; other columns are left alone. The same rows give the same result in any order.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(space_words(F.col(text_col))).cast("bigint").alias("size"))
    sized = sized.withColumn("hash", shuffle_key(F.col("id"))).withColumn("bucket", F.substring("hash", 1, BUCKET_HEX))
    sized = materialize(sized)  # texts are read once; this has a few dozen bytes a row
    # One row for each source and bucket: the streams' skeleton.
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    prior = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(prior), F.lit(0)))
    plan = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    by_order = W.orderBy(F.col("source").asc_nulls_last())
    upto = by_order.rowsBetween(W.unboundedPreceding, 0)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    plan = (
        plan.withColumn("nth", F.row_number().over(by_order)).withColumn("all", F.sum("target").over(every)).withColumn("hi", F.sum("target").over(upto))
        .withColumn("block", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("all") / slots)))
        .withColumn("goal", F.floor("target")).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")))
    )
    shares = plan.filter("all > 0").select("nth", ((F.col("hi") - F.col("target")) / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi"))
    # Every block that a source needs, with its slot of the schedule if it has one.
    wanted = plan.filter("goal > 0").select("nth", "goal", "block", "n_blocks", "source_size", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.floor(F.col("goal") / F.col("source_size")) + 1) * F.col("n_blocks") - 1)).alias("rank"))
    at = F.floor(F.col("rank") / F.col("n_blocks")) * F.col("source_size") + (F.col("rank") % F.col("n_blocks")) * F.col("block")
    wanted = wanted.withColumn("nr", F.col("rank") % F.col("n_blocks")).withColumn("at", at).filter("at < goal")
    full = F.least(F.col("block"), F.col("source_size") - F.col("nr") * F.col("block"))
    draws = wanted.withColumn("words", F.least(full, F.col("goal") - F.col("at"))).join(schedule(spark, shares, slots), ["nth", "rank"], "left")
    draws = draws.groupBy("nth", "nr").agg(F.collect_list("words").alias("draws"), F.min(F.coalesce("k", F.lit(slots) + F.col("rank"))).alias("slot"))
    # Documents on their source's stream; nth and target come with the skeleton's rows.
    rank = W.partitionBy("source", "bucket").orderBy("hash", "id", "size")
    running = F.sum("size").over(rank.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    skeleton = buckets.join(plan.select(F.col("source").alias("p"), "nth", "source_size", "target", "block"), F.col("source").eqNullSafe(F.col("p"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_start", "nth", "source_size", "target", "block")
    placed = sized.withColumn("running", running).withColumn("row", F.row_number().over(rank)).withColumnRenamed("bucket", "own").join(skeleton, F.col("source").eqNullSafe(F.col("s")) & (F.col("own") == F.col("b")))
    placed = placed.withColumn("start", F.col("bucket_start") + F.col("running"))
    spread = placed.withColumn("nr", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))))))
    overlap = lambda w: F.greatest(F.lit(0).cast("bigint"), F.least(F.col("start") + F.col("size"), F.col("nr") * F.col("block") + w) - F.greatest(F.col("start"), F.col("nr") * F.col("block")))
    met = spread.join(draws, ["nth", "nr"], "left").withColumn("got", F.coalesce(F.aggregate(F.transform("draws", overlap), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")))
    return (
        met.groupBy("nth", "own", "row", "id", "size", "source_size", "target", "source")
        .agg(F.sum("got").alias("taken"), F.min(F.when(F.col("got") > 0, F.col("slot"))).alias("first_slot"))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", F.col("source").alias(source_col), "first_slot")
    )
