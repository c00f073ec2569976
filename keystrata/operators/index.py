"""The sparse index of a segment and the block that a key belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.functions.codec import entry_size
from keystrata.plans.shared import ranged
from keystrata.schema import INDEX_INTERVAL


def sparse_index(entries: DataFrame, interval: int = INDEX_INTERVAL) -> DataFrame:
    """(segment_id, key, offset) of every ``interval``-th entry, with its byte offset in the segment's file.

    Entries are counted and summed by ranges of keys, and a row per range tells what is before it.
    """
    rows = ranged(entries.select("segment_id", "key", entry_size().cast("long").alias("_size")), "segment_id", "key")
    whole = Window.partitionBy("segment_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("segment_id", "_part").agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes"))
    before = sums.select("segment_id", "_part", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_rows_before"), F.coalesce(F.sum("_bytes").over(whole), F.lit(0)).alias("_bytes_before"))
    run = Window.partitionBy("segment_id", "_part").orderBy("key")
    rows = rows.withColumn("_i", F.row_number().over(run) - 1).withColumn("_at", F.sum("_size").over(run) - F.col("_size")).join(before, ["segment_id", "_part"])
    return rows.where((F.col("_i") + F.col("_rows_before")) % interval == 0).select("segment_id", "key", (F.col("_at") + F.col("_bytes_before")).alias("offset"))


def block_ranges(index: DataFrame, data_end: DataFrame | None = None) -> DataFrame:
    """(segment_id, block_id, first_key, next_key, start, end): an index's blocks; the last one's end is
    the data's end where ``data_end`` (segment_id, bytes) tells it, else null."""
    run = Window.partitionBy("segment_id").orderBy("key")
    rows = index.select("segment_id", (F.row_number().over(run) - 1).alias("block_id"), F.col("key").alias("first_key"), F.lead("key").over(run).alias("next_key"), F.col("offset").alias("start"), F.lead("offset").over(run).alias("end"))
    if data_end is None:
        return rows
    return rows.join(data_end.select("segment_id", F.col("bytes").alias("_end")), "segment_id").withColumn("end", F.coalesce("end", "_end")).drop("_end")


def block_lookup(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(segment_id, key, start, end): the block that holds each probe (segment_id, key), if any does.

    Keys before the first indexed one belong to the first block; a segment without an index is one
    block from 0. Index entries and probes are merged in one sorted pass per range of keys, so no
    probe meets more than its own block; a row per range has the marks next to it.
    """
    marks = index.select("segment_id", "key", F.lit(0).alias("_kind"), F.col("offset").alias("_offset"))
    asked = probes.select("segment_id", "key", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_offset"))
    both = ranged(marks.unionByName(asked), "segment_id", "key")
    # offsets ascend with the keys, so the least and greatest of a range are its first and last mark
    ends = both.groupBy("segment_id", "_part").agg(F.min("_offset").alias("_low"), F.max("_offset").alias("_high"))
    parts = Window.partitionBy("segment_id").orderBy("_part")
    earlier = F.max("_high").over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("_before")
    later = F.min("_low").over(parts.rowsBetween(1, Window.unboundedFollowing)).alias("_behind")
    ends = ends.select("segment_id", "_part", earlier, later)
    order = Window.partitionBy("segment_id", "_part").orderBy("key", "_kind")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    rows = both.withColumn("_start", F.last("_offset", ignorenulls=True).over(back)).withColumn("_end", F.first("_offset", ignorenulls=True).over(ahead)).where("_kind = 1")
    rows = rows.join(ends, ["segment_id", "_part"]).withColumn("_start", F.coalesce("_start", "_before")).withColumn("_end", F.coalesce("_end", "_behind"))
    # before the first indexed key the next mark is the first block's own start: its end is the mark after
    firsts = index.groupBy("segment_id").agg(F.min("offset").alias("_first"))
    seconds = index.join(firsts, "segment_id").where(F.col("offset") > F.col("_first")).groupBy("segment_id").agg(F.min("offset").alias("_second"))
    rows = rows.join(firsts, "segment_id", "left").join(seconds, "segment_id", "left")
    early = F.col("_start").isNull()
    return rows.select("segment_id", "key", F.coalesce("_start", "_first", F.lit(0)).alias("start"), F.when(early, F.col("_second")).otherwise(F.col("_end")).alias("end"))


def floor_offset(index: DataFrame, segment_id: int, key: str) -> DataFrame:
    """(offset): of the greatest indexed key up to ``key``; 0 if there is none."""
    hit = index.where((F.col("segment_id") == segment_id) & (F.col("key") <= key))
    return hit.agg(F.coalesce(F.max_by("offset", "key"), F.lit(0)).cast("long").alias("offset"))
