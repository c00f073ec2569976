"""Changelogs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of all fixed queries: 2024-01-31T00:00:00Z.
AS_OF_MS = 1706659200000
TTL_MS = 7 * 86_400_000
SEGMENT_ROWS = 1000


def kv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a changelog: a key per user and slot, errors delete, views expire after 7 days."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    error, view = F.col("event_type") == "error", F.col("event_type") == "view"
    slot = F.get_json_object("props", "$.k").cast("long") % 10
    millis = F.unix_millis(F.col("ts").cast("timestamp_ntz").cast("timestamp"))
    return events.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(":"), slot.cast("string")).alias("key"),
        F.encode(F.when(error, "").otherwise(F.col("props")), "UTF-8").alias("value"),
        (F.col("event_id") + 1).alias("seq_num"),
        F.when(error, 1).otherwise(0).cast("byte").alias("type"),
        F.when(view, millis + TTL_MS).otherwise(0).cast("long").alias("expires_at"),
        F.floor(F.col("event_id") / SEGMENT_ROWS).cast("long").alias("segment_id"),
    )


def kv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` by customer; a version is an order date and, as dates repeat, an order key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_custkey").alias("key"), "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
