"""Stores and folders of files in the shared folder, for queries that write and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.plans.shared import shared_folder
from keystrata.sources.store import Store


def fresh(spark: SparkSession) -> Store:
    """An empty store."""
    return Store(spark, shared_folder(spark))


def appended(spark: SparkSession, changelog: DataFrame, parts: int) -> Store:
    """A store with a changelog in so many appends of neighbouring sequence numbers, opened again."""
    store = fresh(spark)
    last = changelog.agg(F.max("seq_num")).head()[0] or 0
    edges = [last * i // parts for i in range(parts + 1)]
    for a, b in zip(edges, edges[1:]):
        store.append(changelog.where((F.col("seq_num") > a) & (F.col("seq_num") <= b)))
    return Store(spark, store.path)


def all_segments(sizes: DataFrame) -> DataFrame:
    """A policy that merges all segments."""
    return sizes.select("segment_id", F.lit(0).cast("long").alias("group_id"))
