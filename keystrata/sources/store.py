"""A store: immutable key-sorted Parquet segments under numbered manifests in one folder.

Every write reads one manifest, makes new segment folders, and then publishes manifest N+1 by moving
a finished file to its place, which fails if another writer was first; the write is then made again
on the newer manifest. A reader takes one manifest and is not disturbed by later ones. Segments that
a compaction replaced are removed by ``vacuum``, not while a reader may have them.
"""

from __future__ import annotations

import json
import os
import random
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.codec import entry_size
from keystrata.operators import resolve
from keystrata.operators.changelog import assign_sequence, conform
from keystrata.operators.compaction import Strategy, merge, select_merge_groups
from keystrata.operators.flush import segment_entries
from keystrata.operators.metrics import Observed
from keystrata.schema import CHANGELOG, COMPACTION_BUCKETS_MS, DELETE, PUT
from keystrata.sources.wal import hadoop, read_wal, recovery_stats, wal_replay

#: Rows that one file of a segment holds, about.
ROWS_PER_FILE = 5_000_000


#: Times that a write is made again after other writers, and the age at which an unlisted folder is no writer's.
ATTEMPTS, ORPHAN_MS = 100, 86_400_000
#: Writers of one process take turns; those of others are seen as the manifest is published.
_turns: dict[str, threading.Lock] = defaultdict(threading.Lock)


class ConcurrentWrite(RuntimeError):
    """Another writer published first; nothing of this write is visible."""


class Store:
    """put, get, delete and scan over a folder; see the module for how it is kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self._path = hadoop(spark, path)
        self.fs.mkdirs(self._path(f"{self.path}/manifests"))
        self.counters = {"memtable_flushes_total": 0}
        self.compactions = Observed("compaction_duration_ms", COMPACTION_BUCKETS_MS)

    # Manifests

    def _versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path(f"{self.path}/manifests"))]
        return [int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()]

    def version(self) -> int:
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"segments": [{"id", "path", "bytes", "rows"}], "next_seq", "next_segment"} of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "segments": [], "next_seq": 1, "next_segment": 0}
        stream = self.fs.open(self._path(f"{self.path}/manifests/{version:020d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) | {"version": version}

    def _publish(self, manifest: dict, base: int) -> None:
        """Manifest base + 1, whole or not at all; raises if it is there."""
        name, target = f"{self.path}/manifests/.{uuid.uuid4().hex}.tmp", f"{self.path}/manifests/{base + 1:020d}.json"
        body = json.dumps({k: v for k, v in manifest.items() if k != "version"}).encode()
        stream = self.fs.create(self._path(name), True)
        try:
            stream.write(bytearray(body))
            stream.hsync()
        finally:
            stream.close()
        try:
            self._move(name, target)
        except Exception as e:
            if self.fs.exists(self._path(target)):
                raise ConcurrentWrite(f"version {base + 1} is taken") from e
            raise
        finally:
            self.fs.delete(self._path(name), False)

    def _move(self, name: str, target: str) -> None:
        """Give a file another name, unless that is taken. A local file system would replace what is
        there, so its file gets a second name by a link instead."""
        if self.fs.getUri().getScheme() == "file":
            os.link(*(unquote(urlparse(str(self.fs.makeQualified(self._path(x)))).path) for x in (name, target)))
            return
        jvm = self.spark.sparkContext._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._path(name), self._path(target), none)

    # Writing

    def _write_segment(self, entries: DataFrame, segment_id: int) -> dict | None:
        """A segment folder: files ranged and sorted by key, with a Parquet Bloom filter on it."""
        name = f"segments/{segment_id:020d}-{uuid.uuid4().hex}"
        rows = entries.withColumn("segment_id", F.lit(segment_id).cast("long")).repartitionByRange("key").sortWithinPartitions("key")
        rows.write.option("parquet.bloom.filter.enabled#key", "true").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(CHANGELOG).parquet(f"{self.path}/{name}")
        size = written.agg(F.count("*").alias("rows"), F.sum(entry_size()).cast("long").alias("bytes"), F.max("seq_num").alias("last")).head()
        if not size["rows"]:
            self._drop(name)
            return None
        return {"id": segment_id, "path": name, "rows": size["rows"], "bytes": size["bytes"], "last": size["last"]}

    def _drop(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.path}/{name}"), True)

    def _append(self, make: Callable[[dict], DataFrame]) -> int:
        """Publish ``make(manifest)`` as one segment on that same manifest; if another writer was
        first, make it again on the newer one. The segment's id."""
        for attempt in range(ATTEMPTS):
            with _turns[self.path]:
                m = self.manifest()
                rows = segment_entries(conform(make(m).withColumn("segment_id", F.lit(m["next_segment"]))))
                segment = self._write_segment(rows, m["next_segment"])
                if not segment:
                    return m["next_segment"] - 1
                m["next_seq"], m["next_segment"] = max(m["next_seq"], segment.pop("last") + 1), m["next_segment"] + 1
                m["segments"].append(segment)
                try:
                    self._publish(m, m["version"])
                    self.counters["memtable_flushes_total"] += 1
                    return segment["id"]
                except ConcurrentWrite:
                    self._drop(segment["path"])
                    if attempt == ATTEMPTS - 1:
                        raise
            time.sleep(random.uniform(0, 0.05 * min(attempt + 1, 20)))
        raise AssertionError

    def append(self, changelog: DataFrame) -> int:
        """Publish rows that carry their own sequence numbers as one segment, one version per key; its id.

        A segment that holds nothing is not published.
        """
        return self._append(lambda m: changelog)

    def write(self, operations: DataFrame, order: list, now_ms: int) -> int:
        """Apply operations (op 'put' or 'delete', key, value, ttl_seconds) in an order, as one segment."""
        ttl = F.when((F.col("op") == "put") & (F.col("ttl_seconds") > 0), F.lit(now_ms) + F.col("ttl_seconds") * 1000).otherwise(0)
        kind = F.when(F.col("op") == "put", PUT).when(F.col("op") == "delete", DELETE)
        value = F.when(F.col("op") == "put", F.col("value").cast("binary")).alias("value")

        def numbered(m: dict) -> DataFrame:
            rows = assign_sequence(operations, order, m["next_seq"] - 1)
            return rows.select("key", value, "seq_num", kind.alias("type"), ttl.alias("expires_at"), F.lit(0).alias("segment_id"))

        return self._append(numbered)

    def _one(self, key: str, value: bytes, kind: int, ttl_seconds: int) -> None:
        if not key:
            raise ValueError("empty key")
        expires = int(time.time() * 1000) + ttl_seconds * 1000 if ttl_seconds > 0 else 0
        self._append(lambda m: self.spark.createDataFrame([(key, bytearray(value), m["next_seq"], kind, expires, 0)], CHANGELOG))

    def put(self, key: str, value: bytes | None, ttl_seconds: int = 0) -> None:
        self._one(key, value or b"", PUT, ttl_seconds)

    def delete(self, key: str) -> None:
        """A tombstone, whether the key exists or not."""
        self._one(key, b"", DELETE, 0)

    def recover(self, logs: str) -> dict:
        """Replay the log files of a folder as one segment: {"segments", "entries", "keys", "next_seq"} of
        what was read. A key's newest record counts; a record older than what the store has stays hidden
        behind it, so a second replay changes nothing that reads see."""
        records = read_wal(self.spark, logs)
        stats = recovery_stats(records).head().asDict()
        if stats["entries"]:
            self.append(wal_replay(records))
        return stats

    # Reading

    def changelog(self, version: int | None = None) -> DataFrame:
        """All segments of one version; key filters reach the Parquet files."""
        paths = [f"{self.path}/{s['path']}" for s in self.manifest(version)["segments"]]
        return self.spark.read.schema(CHANGELOG).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGELOG)

    def segments(self) -> DataFrame:
        """(segment_id, path, entries, bytes)."""
        return self._listed(self.manifest())

    def _listed(self, manifest: dict) -> DataFrame:
        rows = [(s["id"], s["path"], s["rows"], s["bytes"]) for s in manifest["segments"]]
        return self.spark.createDataFrame(rows, "segment_id long, path string, entries long, bytes long")

    def get(self, key: str, as_of_ms: int | None = None) -> bytes | None:
        row = resolve.get(self.changelog(), key, _now(as_of_ms)).head()
        return bytes(row["value"]) if row else None

    def multi_get(self, probes: DataFrame, as_of_ms: int | None = None) -> DataFrame:
        return resolve.multi_get(self.changelog(), probes, _now(as_of_ms))

    def scan(self, from_key: str, to_key: str, as_of_ms: int | None = None) -> DataFrame:
        return resolve.scan(self.changelog(), from_key, to_key, _now(as_of_ms))

    # Maintenance

    def compact(self, strategy: Strategy = select_merge_groups, as_of_ms: int | None = None) -> int:
        """Merge the groups that a strategy picks; the number of groups. A group of all segments drops
        tombstones and expired entries, any other keeps them. All merges are published at once; if
        another writer publishes first, nothing is, and :class:`ConcurrentWrite` is raised."""
        began, m = time.perf_counter(), self.manifest()
        groups: dict[int, list[int]] = {}
        # a row per segment: as many as the manifest lists
        for row in strategy(self._listed(m).select("segment_id", "bytes")).collect():
            groups.setdefault(row["group_id"], []).append(row["segment_id"])
        if not groups:
            return 0
        listed = {s["id"]: s for s in m["segments"]}
        out, gone = [], set()
        for _, ids in sorted(groups.items()):
            rows = self.spark.read.schema(CHANGELOG).parquet(*(f"{self.path}/{listed[i]['path']}" for i in ids))
            merged = merge(rows, len(ids) == len(listed), _now(as_of_ms))
            segment = self._write_segment(merged, m["next_segment"])
            gone |= set(ids)
            if segment:
                del segment["last"]
                out.append(segment)
                m["next_segment"] += 1
        m["segments"] = [s for s in m["segments"] if s["id"] not in gone] + out
        try:
            self._publish(m, m["version"])
        except ConcurrentWrite:
            for segment in out:
                self._drop(segment["path"])
            raise
        self.compactions.add((time.perf_counter() - began) * 1000)
        return len(groups)

    def vacuum(self, orphan_ms: int = ORPHAN_MS) -> int:
        """Delete segment folders that an older manifest lists and the newest does not; how many.

        A folder that no manifest lists may belong to a writer at work: it goes once it is ``orphan_ms`` old.
        """
        newest = self.version()
        kept = {s["path"] for s in self.manifest(newest)["segments"]}
        known = {s["path"] for v in self._versions() if v < newest for s in self.manifest(v)["segments"]}
        root = self._path(f"{self.path}/segments")
        folders = self.fs.listStatus(root) if self.fs.exists(root) else []
        old = {f"segments/{f.getPath().getName()}" for f in folders if f.getModificationTime() <= time.time() * 1000 - orphan_ms}
        there = {f"segments/{f.getPath().getName()}" for f in folders}
        gone = (there & (known | old)) - kept
        for name in gone:
            self._drop(name)
        return len(gone)


def _now(as_of_ms: int | None) -> int:
    return int(time.time() * 1000) if as_of_ms is None else as_of_ms
