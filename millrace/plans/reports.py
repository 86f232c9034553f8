"""Reports on command tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.frames import FULL_PACKET, STOP, SYNC_TICK, playback


def _seen() -> Column:
    """The tick where it is not negative."""
    return F.when(F.col("tick") >= 0, F.col("tick"))


#: The largest number of bytes saved that a report holds.
_MOST_SAVED = (1 << 63) - 1


def command_counts(commands: DataFrame) -> DataFrame:
    """Commands and bytes by number; order by cmd where order matters."""
    return commands.groupBy("cmd").agg(F.count(F.lit(1)).alias("c"), F.sum("body_size").alias("bytes"))


def summary(commands: DataFrame) -> DataFrame:
    return commands.agg(
        F.count(F.lit(1)).alias("commands"), F.min(_seen()).alias("first_tick"), F.max(_seen()).alias("last_tick"), F.count_distinct(_seen()).alias("distinct_ticks"),
        F.min(F.when(F.col("cmd") == STOP, F.col("idx"))).alias("first_stop"), F.sum((F.col("cmd") == SYNC_TICK).cast("bigint")).alias("syncs"),
    )


def tick_range(commands: DataFrame) -> DataFrame:
    """First, last and number of ticks; negative ones do not count."""
    return commands.agg(F.min(_seen()).alias("f"), F.max(_seen()).alias("l"), F.count_distinct(_seen()).alias("n"))


def tick_changes(commands: DataFrame, slot: str, kinds: tuple[int, ...]) -> DataFrame:
    return commands.filter(F.col("cmd").isin(*kinds)).groupBy("tick").agg(F.count(F.lit(1)).alias("updates"), F.count_distinct(slot).alias("ents"))


def compression(commands: DataFrame) -> DataFrame:
    """Sizes of all commands and of compressed ones; ratios are null where nothing was decoded."""
    squeezed = lambda c: F.coalesce(F.sum(F.when(F.col("compressed"), F.col(c))), F.lit(0))
    sums = commands.agg(
        F.coalesce(F.sum("header_size"), F.lit(0)).alias("command_header_bytes"), F.coalesce(F.sum("encoded_size"), F.lit(0)).alias("total_encoded_bytes"), F.coalesce(F.sum("decoded_size"), F.lit(0)).alias("total_decoded_bytes"),
        F.count_if("compressed").alias("compressed_commands"), squeezed("encoded_size").alias("compressed_encoded_bytes"), squeezed("decoded_size").alias("compressed_decoded_bytes"),
    )
    wide = F.col("compressed_decoded_bytes").cast("decimal(38,0)") - F.col("compressed_encoded_bytes")
    saved = F.greatest(F.least(wide, F.lit(_MOST_SAVED)), F.lit(-_MOST_SAVED - 1)).cast("bigint")
    return sums.withColumns({"compressed_bytes_saved": saved, "compressed_ratio": F.try_divide("compressed_encoded_bytes", "compressed_decoded_bytes")})


def inspection(commands: DataFrame) -> DataFrame:
    """One row for each demo: numbers of commands, tick ranges of the file and of playback, first stop, what follows it, unknown commands."""
    first_stop = commands.groupBy("demo_id").agg(F.min(F.when(F.col("cmd") == STOP, F.col("idx"))).alias("first_stop_command"))
    seen = _seen()
    whole = commands.join(first_stop, "demo_id").groupBy("demo_id", "first_stop_command").agg(
        F.count(F.lit(1)).alias("commands"), F.min(seen).alias("first_tick"), F.max(seen).alias("last_tick"), F.count_distinct(seen).alias("distinct_ticks"),
        F.count_if(F.col("cmd") == SYNC_TICK).alias("sync_points"), F.coalesce(F.count_if(F.col("idx") > F.col("first_stop_command")), F.lit(0)).alias("commands_after_stop"),
        F.count_if(~F.col("cmd").between(0, 18)).alias("unknown_commands"),
    )
    played = playback(commands)
    ranges = played.groupBy("demo_id").agg(F.min(_seen()).alias("playback_first"), F.max(_seen()).alias("playback_last"), F.count_distinct(_seen()).alias("playback_ticks"), F.count_if(F.col("cmd") == FULL_PACKET).alias("seek_points"))
    return whole.join(ranges, "demo_id", "left")


def sync_points(commands: DataFrame) -> DataFrame:
    """All sync ticks and where reading goes on after each."""
    return commands.filter(F.col("cmd") == SYNC_TICK).select("demo_id", "idx", "tick", "offset", F.col("end_offset").alias("resume_offset"))


def index_view(commands: DataFrame) -> DataFrame:
    """One row for each demo: playback's ticks, sync points and keyframes, in the order of the file."""
    points = lambda rows, name, *extra: rows.groupBy("demo_id").agg(F.array_sort(F.collect_list(F.struct("idx", "offset", "tick", *extra))).alias(name))
    played = playback(commands)
    ranges = played.groupBy("demo_id").agg(F.min(_seen()).alias("first"), F.max(_seen()).alias("last"), F.count_distinct(_seen()).alias("distinct"))
    base = commands.select("demo_id").distinct()
    out = base.join(ranges.select("demo_id", F.when(F.col("first").isNotNull(), F.struct("first", "last", "distinct")).alias("playback_tick_range")), "demo_id", "left")
    for rows, name, extra in ((sync_points(commands), "sync_points", ("resume_offset",)), (played.filter(F.col("cmd") == FULL_PACKET), "full_packet_seek_points", ())):
        out = out.join(points(rows, name, *extra), "demo_id", "left")
    return out


def full_summary(headers: DataFrame, commands: DataFrame) -> DataFrame:
    """inspection() with the file's size and offsets and its sums of bytes: all that is known of a recording without its state, one row each."""
    sums = commands.groupBy("demo_id").agg(
        F.sum("header_size").alias("command_header_bytes"), F.sum("encoded_size").alias("total_encoded_bytes"), F.sum("decoded_size").alias("total_decoded_bytes"), F.count_if("compressed").alias("compressed_commands"),
        F.coalesce(F.sum(F.when(F.col("compressed"), F.col("encoded_size"))), F.lit(0)).alias("compressed_encoded_bytes"), F.coalesce(F.sum(F.when(F.col("compressed"), F.col("decoded_size"))), F.lit(0)).alias("compressed_decoded_bytes"),
    )
    sums = sums.withColumn("compressed_ratio", F.try_divide("compressed_encoded_bytes", "compressed_decoded_bytes"))
    return headers.filter("error is null").drop("error").join(inspection(commands), "demo_id", "left").join(sums, "demo_id", "left")


def validation(headers: DataFrame, commands: DataFrame) -> DataFrame:
    """(demo_id, valid, file_size, commands, file_info_offset, spawn_groups_offset, error) from headers() and commands(bodies=True, failfast=False): every body has been decoded."""
    found = commands.groupBy("demo_id").agg(F.count_if(F.col("error").isNull()).alias("commands"), F.first("error", ignorenulls=True).alias("why"))
    why = F.coalesce("error", "why")
    said = F.when(why.isNotNull(), F.concat(F.lit("failed to inspect "), F.col("demo_id"), F.lit(": "), why))
    joined = headers.join(found, "demo_id", "left")
    return joined.select("demo_id", why.isNull().alias("valid"), "file_size", F.coalesce("commands", F.lit(0)).alias("commands"), "file_info_offset", "spawn_groups_offset", said.alias("error"))


def as_json(report: DataFrame) -> DataFrame:
    """Each row of a report as one JSON text."""
    return report.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))
