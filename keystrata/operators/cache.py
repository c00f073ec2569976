"""A simulated LRU block cache over a trace of accesses."""

from __future__ import annotations

from collections import OrderedDict
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.plans.fold import STEP_ROWS, fold_in_order
from keystrata.plans.shared import ranged
from keystrata.schema import CACHE_BLOCKS


class LRU:
    """Least recently used out first, beyond ``capacity`` blocks."""

    def __init__(self, capacity: int = CACHE_BLOCKS):
        self.capacity, self.blocks, self.disk_reads = capacity, OrderedDict(), 0

    def access(self, block) -> bool:
        """Touch a block; True if it was there. A miss is a disk read and may evict."""
        if block in self.blocks:
            self.blocks.move_to_end(block)
            return True
        self.disk_reads += 1
        if self.capacity > 0:
            self.blocks[block] = None
            if len(self.blocks) > self.capacity:
                self.blocks.popitem(last=False)
        return False

    def contains(self, block) -> bool:
        return block in self.blocks

    def invalidate(self, block) -> None:
        self.blocks.pop(block, None)

    def __len__(self) -> int:
        return len(self.blocks)


def cache_trace(accesses: DataFrame, capacity: int = CACHE_BLOCKS, cache_col: str | None = None, step_rows: int = STEP_ROWS) -> DataFrame:
    """(cache, at, block, hit) for accesses (at, block), each cache by itself and in the order of ``at``.

    The fold goes a range of ``at`` at a time and hands ``capacity`` blocks on; capacity 0 caches nothing.
    A cache with room for all accesses evicts nothing and needs no fold.
    """
    cache = F.col(cache_col).cast("string") if cache_col else F.lit("")
    rows = accesses.select(cache.alias("cache"), F.col("at").cast("long").alias("at"), F.col("block").cast("string").alias("block"))
    if rows.count() <= capacity:
        return _without_evictions(rows)
    return fold_in_order(rows, "cache", ["at", "block"], partial(_Trace, capacity), "cache string, at long, block string, hit boolean", step_rows)


def _without_evictions(rows: DataFrame) -> DataFrame:
    """The trace of accesses where only a block's first misses. The first in each range of ``at`` are found
    in their ranges, and the first of those over all, so no task has all accesses to a block."""
    rows = ranged(rows, "at", "block", "cache").withColumn("_first", F.row_number().over(Window.partitionBy("cache", "block", "_part").orderBy("at")) == 1)
    again = rows.where("NOT _first").withColumn("hit", F.lit(True))
    first = rows.where("_first").withColumn("hit", F.row_number().over(Window.partitionBy("cache", "block").orderBy("_part")) > 1)
    return again.unionByName(first).select("cache", "at", "block", "hit")


class _Trace:
    """A cache that notes what it hits."""

    def __init__(self, capacity: int):
        self.lru = LRU(capacity)

    def take(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = pa.array(map(self.lru.access, batch["block"].to_pylist()), pa.bool_())
        return pa.RecordBatch.from_arrays([batch["cache"], batch["at"], batch["block"], hits], names=["cache", "at", "block", "hit"])


def cache_stats(trace: DataFrame) -> DataFrame:
    """(cache, accesses, hits, disk_reads)."""
    return trace.groupBy("cache").agg(F.count("*").alias("accesses"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("disk_reads"))
