"""Segment planning: where a stream of writes is cut into segments, and what a segment holds."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.codec import accounted_size, entry_size
from keystrata.operators.resolve import latest
from keystrata.plans.fold import STEP_ROWS, fold_in_order
from keystrata.plans.shared import ranged
from keystrata.schema import FLUSH_BYTES


def plan_flush(changelog: DataFrame, threshold_bytes: int = FLUSH_BYTES, shards: int = 1, step_rows: int = STEP_ROWS) -> DataFrame:
    """(shard, flush_id, seq_num, key, net_bytes): the segment of every write.

    In the order of sequence numbers a buffer holds one entry per key; its size is net of overwritten
    entries, and when it reaches the threshold the buffer is a segment and a new one begins. Where a
    buffer is cut depends on all cuts before, so that fold is one sequence; it goes a range of numbers at
    a time and hands one buffer on, never a whole shard. With several shards each key belongs to one by
    its hash, with its own buffers.
    """
    rows = changelog.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "seq_num", "key", accounted_size().cast("long").alias("size"))
    return fold_in_order(rows, "shard", ["seq_num"], partial(_Buffer, threshold_bytes), "shard int, flush_id long, seq_num long, key string, net_bytes long", step_rows)


class _Buffer:
    """The buffer that is open: its number, net size and the size of each key's entry."""

    def __init__(self, threshold_bytes: int):
        self.threshold, self.flush, self.net, self.sizes = threshold_bytes, 0, 0, {}

    def take(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        flush, net, sizes, ids, nets = self.flush, self.net, self.sizes, [], []
        for key, size in zip(batch["key"].to_pylist(), batch["size"].to_pylist(), strict=True):
            net += size - sizes.get(key, 0)
            sizes[key] = size
            ids.append(flush)
            nets.append(net)
            if net >= self.threshold:
                flush, net, sizes = flush + 1, 0, {}
        self.flush, self.net, self.sizes = flush, net, sizes
        return pa.RecordBatch.from_arrays([batch["shard"], pa.array(ids, pa.int64()), batch["seq_num"], batch["key"], pa.array(nets, pa.int64())], names=["shard", "flush_id", "seq_num", "key", "net_bytes"])


def flush_summary(plan: DataFrame, threshold_bytes: int = FLUSH_BYTES) -> DataFrame:
    """(shard, flush_id, writes, keys, bytes, full): what every buffer held at its end."""
    return plan.groupBy("shard", "flush_id").agg(F.count("*").alias("writes"), F.countDistinct("key").alias("keys"), F.max_by("net_bytes", "seq_num").alias("bytes")).withColumn("full", F.col("bytes") >= threshold_bytes)


def segment_entries(changelog: DataFrame) -> DataFrame:
    """What each segment stores: one version per key, tombstones and expired ones too."""
    return latest(changelog, ("segment_id", "key"), ("seq_num",))


def segment_sizes(entries: DataFrame) -> DataFrame:
    """(segment_id, entries, bytes) of segments' stored entries."""
    return entries.groupBy("segment_id").agg(F.count("*").alias("entries"), F.sum(entry_size()).cast("long").alias("bytes"))


def running_size(changelog: DataFrame) -> DataFrame:
    """Net size of each segment's buffer after every write: an entry counts less the one it replaces.
    Sums go by ranges of sequence numbers, and a row per range has what is before it."""
    from pyspark.sql.window import Window

    before = F.lag(accounted_size()).over(Window.partitionBy("segment_id", "key").orderBy("seq_num"))
    rows = ranged(changelog.withColumn("_delta", (accounted_size() - F.coalesce(before, F.lit(0))).cast("long")), "segment_id", "seq_num")
    parts = Window.partitionBy("segment_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("segment_id", "_part").agg(F.sum("_delta").alias("_sum"))
    sums = sums.select("segment_id", "_part", F.coalesce(F.sum("_sum").over(parts), F.lit(0)).alias("_before"))
    own = F.sum("_delta").over(Window.partitionBy("segment_id", "_part").orderBy("seq_num"))
    rows = rows.withColumn("_own", own).join(sums, ["segment_id", "_part"])
    return rows.withColumn("net_bytes", (F.col("_own") + F.col("_before")).cast("long")).drop("_delta", "_part", "_own", "_before")
