"""Changelog streams: micro-batches as segments, scheduled compaction, and a stateful live view."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrata.operators.compaction import Strategy, select_merge_groups
from keystrata.schema import CHANGELOG, COMPACTION_DELAY_S
from keystrata.sources.store import Store


def changelog_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a landing folder, in the changelog's schema."""
    reader = spark.readStream.schema(CHANGELOG)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest(stream: DataFrame, store: Store, checkpoint: str, compact_every: int = 0, strategy: Strategy = select_merge_groups, **trigger) -> StreamingQuery:
    """Append each micro-batch as one segment; the stream's checkpoint is its recovery log.

    A batch that is run again after a failure writes versions that are there already: the greatest
    sequence number still wins, so the result is the same. Every ``compact_every`` batches, if not
    0, the store is compacted between two appends.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        store.append(rows)
        if compact_every and (batch_id + 1) % compact_every == 0:
            store.compact(strategy)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def compaction_schedule(spark: SparkSession, store: Store, checkpoint: str, delay_s: int = COMPACTION_DELAY_S) -> StreamingQuery:
    """Compact the store on a processing-time trigger."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: store.compact()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{delay_s} seconds").start()


def live_updates(stream: DataFrame) -> DataFrame:
    """(key, value, seq_num, type, expires_at) whenever a key's newest version changes.

    The state is a key's greatest sequence number with its entry; a late row with a lower number
    changes nothing, in whatever order the rows come. Each entry keeps its own expiry, which a
    reader compares with its clock.
    """
    out = "key string, value binary, seq_num long, type byte, expires_at long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        newest, best = state.get[0] if state.exists else -1, None
        for frame in frames:
            row = frame.loc[frame["seq_num"].idxmax()]
            if row["seq_num"] > newest:
                newest, best = int(row["seq_num"]), row
        if best is not None:
            state.update((newest,))
            yield pd.DataFrame([{"key": key[0], "value": best["value"], "seq_num": newest, "type": best["type"], "expires_at": best["expires_at"]}])

    return stream.select("key", "value", "seq_num", "type", "expires_at").groupBy("key").applyInPandasWithState(step, out, "seq long", "update", "NoTimeout")


def latest_of(updates: DataFrame) -> DataFrame:
    """The newest of the updates that a sink has gathered."""
    return updates.groupBy("key").agg(F.max_by(F.struct("value", "seq_num", "type", "expires_at"), "seq_num").alias("v")).select("key", "v.*")
