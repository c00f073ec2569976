"""Workload generators: writes in sequence and at random, and hot, cold, missing and mixed reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE_BYTES = 100


def _value(seed: int) -> F.Column:
    """100 bytes that depend on the row and a seed alone."""
    return F.unhex(F.concat(*(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(i), F.col("id")), 256) for i in range(4)))).substr(1, VALUE_BYTES)


def sequential_writes(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Puts of ``key-0``, ``key-1``, ... in order."""
    return _changelog(spark.range(n), F.concat(F.lit("key-"), F.col("id")), seed)


def random_writes(spark: SparkSession, n: int, key_space: int = 1_000_000, seed: int = 0) -> DataFrame:
    """Puts of keys drawn evenly from a key space; the draw depends on the row number and the seed."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(key_space))
    return _changelog(spark.range(n), F.concat(F.lit("key-"), drawn), seed)


def _changelog(rows: DataFrame, key: F.Column, seed: int) -> DataFrame:
    return rows.select(key.alias("key"), _value(seed).alias("value"), (F.col("id") + 1).alias("seq_num"), F.lit(0).cast("byte").alias("type"), F.lit(0).cast("long").alias("expires_at"), F.floor(F.col("id") / 40_000).alias("segment_id"))


def _probes(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last).select(F.concat(F.lit("key-"), F.col("id")).alias("key"))


def hot_reads(spark: SparkSession) -> DataFrame:
    return _probes(spark, 0, 1_000)


def cold_reads(spark: SparkSession) -> DataFrame:
    return _probes(spark, 0, 100_000)


def misses(spark: SparkSession) -> DataFrame:
    return _probes(spark, 100_000, 1_100_000)


def mixed(spark: SparkSession, reads: int, writes: int, keys: int = 10_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Probes and puts over the same keys, four reads for a write in the usual setting."""
    drawn = F.concat(F.lit("key-"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(keys)))
    return spark.range(reads).select(drawn.alias("key")), random_writes(spark, writes, keys, seed + 1)
