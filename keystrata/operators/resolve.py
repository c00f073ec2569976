"""Reading a changelog: the newest version of a key first, tombstones and expiry after that.

A tombstone or an expired newest version hides all older ones, so filters on type and expiry are
only right above the dedup; filters on the key are right below it and reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.text import json_pair
from keystrata.schema import DELETE, PUT


def latest(changelog: DataFrame, keys: tuple[str, ...] = ("key",), order: tuple[str, ...] = ("seq_num", "segment_id")) -> DataFrame:
    """One row per key, the greatest by ``order``; versions are combined before the shuffle."""
    rest = [c for c in changelog.columns if c not in keys]
    return changelog.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*keys, "_v.*").select(*changelog.columns)


def is_tombstone() -> Column:
    return F.col("type") == DELETE


def has_ttl() -> Column:
    return F.col("expires_at") > 0


def is_expired(as_of_ms: int) -> Column:
    """Past its expiry; at the very millisecond it still lives."""
    return has_ttl() & (F.lit(as_of_ms) > F.col("expires_at"))


def is_live(as_of_ms: int) -> Column:
    return (F.col("type") == PUT) & ~is_expired(as_of_ms)


def live(changelog: DataFrame, as_of_ms: int, as_of_seq: int | None = None) -> DataFrame:
    """The newest versions that are neither deleted nor expired, as of a clock and a log position."""
    if as_of_seq is not None:
        changelog = changelog.where(F.col("seq_num") <= as_of_seq)
    return latest(changelog).where(is_live(as_of_ms))


def get(changelog: DataFrame, key: str, as_of_ms: int) -> DataFrame:
    """(key, value): one row, or none if the key is absent, deleted or expired."""
    return live(changelog.where(F.col("key") == key), as_of_ms).select("key", "value")


def multi_get(changelog: DataFrame, probes: DataFrame, as_of_ms: int) -> DataFrame:
    """(key, found, value) for every row of ``probes`` (key); the changelog is cut to those keys before the dedup."""
    wanted = probes.select("key").distinct()
    found = live(changelog.join(wanted, "key", "left_semi"), as_of_ms).select("key", "value", F.lit(True).alias("_hit"))
    return probes.select("key").join(found, "key", "left").select("key", F.coalesce("_hit", F.lit(False)).alias("found"), "value")


def missing(changelog: DataFrame, probes: DataFrame, as_of_ms: int) -> DataFrame:
    """Probes without a live value; the changelog is cut to their keys before the dedup."""
    wanted = probes.select("key").distinct()
    found = live(changelog.join(wanted, "key", "left_semi"), as_of_ms).select("key")
    return probes.select("key").join(found, "key", "left_anti")


def scan(changelog: DataFrame, from_key: str, to_key: str, as_of_ms: int, ordered: bool = True) -> DataFrame:
    """Live entries with from_key <= key <= to_key, by key. Keys are ordered by their UTF-8 bytes."""
    if from_key > to_key:
        raise ValueError(f"empty range: {from_key!r} > {to_key!r}")
    found = live(changelog.where(F.col("key").between(from_key, to_key)), as_of_ms)
    return found.orderBy("key") if ordered else found


def scan_json(changelog: DataFrame, from_key: str, to_key: str, as_of_ms: int) -> DataFrame:
    """(key, json): a range read rendered as JSON objects of key and value."""
    return scan(changelog, from_key, to_key, as_of_ms).select("key", json_pair(F.col("key"), F.decode("value", "UTF-8")).alias("json"))


def utf16_order(key: str = "key") -> Column:
    """A sort key that puts keys in the order of UTF-16 code units instead."""
    return F.encode(F.col(key), "UTF-16BE")


def history(changelog: DataFrame, key: str | None = None) -> DataFrame:
    """All versions with ``version`` 1 for the newest of each key."""
    from pyspark.sql.window import Window

    rows = changelog if key is None else changelog.where(F.col("key") == key)
    return rows.withColumn("version", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq_num"), F.desc("segment_id"))))
