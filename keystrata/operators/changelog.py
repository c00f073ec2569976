"""Changelog rows from writes: puts with and without TTL, deletes, sequence numbers, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.functions.codec import absolute_expiry, type_code
from keystrata.plans.shared import shared_folder
from keystrata.schema import CHANGELOG, DELETE, PUT


def conform(df: DataFrame) -> DataFrame:
    """The changelog's columns and types. Null values become empty; null or empty keys and unknown types raise."""
    key = F.when(F.length("key") > 0, F.col("key")).otherwise(F.raise_error(F.lit("empty or null key")).cast("string"))
    casts = {"key": key, "value": F.coalesce(F.col("value").cast("binary"), F.lit(b"")), "type": type_code(F.col("type"))}
    return df.select(*(casts.get(f.name, F.col(f.name).cast(f.dataType)).alias(f.name) for f in CHANGELOG))


def puts(df: DataFrame, key: Column, value: Column, seq: Column, ttl_seconds: Column | None = None, now_ms: Column | None = None, segment: Column | None = None) -> DataFrame:
    """Upserts; ``ttl_seconds`` is counted from ``now_ms``, and null, 0 or less means no expiry."""
    if ttl_seconds is not None and now_ms is None:
        raise ValueError("a TTL needs now_ms")
    expires = absolute_expiry(ttl_seconds, now_ms) if ttl_seconds is not None else F.lit(0)
    return conform(df.select(key.alias("key"), value.alias("value"), seq.alias("seq_num"), F.lit(PUT).alias("type"), expires.alias("expires_at"), (segment if segment is not None else F.lit(0)).alias("segment_id")))


def deletes(df: DataFrame, key: Column, seq: Column, segment: Column | None = None) -> DataFrame:
    """Tombstones, whether the key exists or not; they never expire."""
    return conform(df.select(key.alias("key"), F.lit(b"").alias("value"), seq.alias("seq_num"), F.lit(DELETE).alias("type"), F.lit(0).alias("expires_at"), (segment if segment is not None else F.lit(0)).alias("segment_id")))


def assign_sequence(df: DataFrame, order: list[Column], last: int = 0) -> DataFrame:
    """``seq_num`` = last + 1, last + 2, ... in the order given, without a single-task sort.

    Rows are range-partitioned and sorted; partition sizes, one row each, give every partition's
    first number. The dealt rows are written to the shared folder: numbers that were handed out
    stay the same if an executor is lost and its ranges would be sampled anew.
    """
    # the last field of the order breaks ties, so two evaluations deal the rows alike
    dealt = df.withColumn("_order", F.struct(*order)).repartitionByRange("_order").sortWithinPartitions("_order")
    dealt = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    path = f"{shared_folder(df.sparkSession)}/sequence"
    dealt.write.parquet(path)
    dealt = df.sparkSession.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).select("_part", "_before")
    return dealt.join(before, "_part").withColumn("seq_num", F.lit(last + 1) + F.col("_before") + F.col("_at")).drop("_order", "_part", "_at", "_before")


def next_sequence(changelog: DataFrame) -> int:
    """1 + the greatest sequence number of all segments; 1 for an empty store."""
    return (changelog.agg(F.max("seq_num")).head()[0] or 0) + 1
