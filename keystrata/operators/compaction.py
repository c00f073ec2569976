"""Size-tiered compaction: choosing segments, merging them, and collecting what is dead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.codec import size_tier
from keystrata.operators.resolve import is_expired, is_live, is_tombstone, latest
from keystrata.schema import TIER_MIN_FILES

#: A policy maps (segment_id, bytes) to (segment_id, group_id) of the segments to merge.
Strategy = Callable[[DataFrame], DataFrame]


def size_tiers(sizes: DataFrame) -> DataFrame:
    """(segment_id, bytes, tier)."""
    return sizes.select("segment_id", "bytes", size_tier(F.col("bytes")).alias("tier"))


def select_merge_groups(sizes: DataFrame, min_files: int = TIER_MIN_FILES) -> DataFrame:
    """(segment_id, group_id): every tier with at least ``min_files`` segments is one group, whole."""
    tiers = size_tiers(sizes)
    full = tiers.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= min_files).select("tier")
    return tiers.join(full, "tier").select("segment_id", F.col("tier").cast("long").alias("group_id"))


def merge(segments: DataFrame, is_final: bool, as_of_ms: int) -> DataFrame:
    """One version per key. Tombstones and expired versions go only if the merge covers all segments:
    otherwise they still hide older versions elsewhere."""
    newest = latest(segments)
    return newest.where(is_live(as_of_ms)) if is_final else newest


def compaction_stats(segments: DataFrame, is_final: bool, as_of_ms: int) -> DataFrame:
    """One row: rows in and out, superseded versions, and tombstones and expired versions dropped."""
    # one pass: versions per key are counted as the newest is found
    newest = F.max_by(F.struct("type", "expires_at"), F.struct("seq_num", "segment_id")).alias("_v")
    rows = segments.groupBy("key").agg(newest, F.count("*").alias("_n")).select("_v.*", "_n")
    dead, old = F.count_if(is_tombstone()), F.count_if(~is_tombstone() & is_expired(as_of_ms))
    out = rows.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_in"), F.count("*").alias("keys"), dead.alias("tombstones"), old.alias("expired"))
    drop = (lambda c: F.col(c)) if is_final else (lambda c: F.lit(0).cast("long"))
    return out.select("rows_in", (F.col("keys") - drop("tombstones") - drop("expired")).alias("rows_out"), (F.col("rows_in") - F.col("keys")).alias("superseded"), drop("tombstones").alias("tombstones_dropped"), drop("expired").alias("expired_dropped"))
