"""Table files: sorted entries, sparse index, Bloom filter and footer, as bytes and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.murmur import probe_positions
from keystrata.operators.flush import segment_entries
from keystrata.schema import BLOOM_BITS_PER_KEY, BLOOM_MIN_BITS, BLOOM_MIN_KEYS, CHANGELOG, FOOTER_BYTES, INDEX_INTERVAL
from keystrata.sources.wal import put_files


def table_bytes(entries: list[tuple[str, bytes, int, int, int]], interval: int = INDEX_INTERVAL) -> bytes:
    """A table file of entries (key, value, type, seq_num, expires_at) in key order."""
    data, index, keys = bytearray(), bytearray(), []
    for i, (key, value, kind, seq, expires) in enumerate(entries):
        k = key.encode()
        keys.append(k)
        if i % interval == 0:
            index += struct.pack(f">i{len(k)}sq", len(k), k, len(data))
        data += struct.pack(f">i{len(k)}si{len(value)}sbqq", len(k), k, len(value), bytes(value), kind, seq, expires)
    bits = max(BLOOM_BITS_PER_KEY * max(len(keys), BLOOM_MIN_KEYS), BLOOM_MIN_BITS)
    words = np.zeros(-(-bits // 64), np.uint64)
    if keys:
        at = probe_positions(keys, np.full(len(keys), bits)).ravel()
        np.bitwise_or.at(words, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
    used = np.trim_zeros(words, "b")
    bloom = struct.pack(">i", bits) + used.astype(">u8").tobytes()
    footer = struct.pack(">qqi", len(data), len(data) + len(index), -(-len(entries) // interval))
    return bytes(data + index + bloom + footer)


def parse_table(content: bytes) -> dict:
    """Entries, sparse index, Bloom bits and words of a table file; a damaged file raises."""
    index_at, bloom_at, count = struct.unpack(">qqi", content[-FOOTER_BYTES:])
    entries, at = [], 0
    while at < index_at:
        (n,) = struct.unpack_from(">i", content, at)
        key = content[at + 4 : at + 4 + n]
        (m,) = struct.unpack_from(">i", content, at + 4 + n)
        value = content[at + 8 + n : at + 8 + n + m]
        kind, seq, expires = struct.unpack_from(">bqq", content, at + 8 + n + m)
        if n <= 0 or kind not in (0, 1):
            raise ValueError(f"damaged entry at byte {at}")
        entries.append((key.decode(), value, kind, seq, expires))
        at += 25 + n + m
    index = []
    while at < bloom_at:
        (n,) = struct.unpack_from(">i", content, at)
        index.append((content[at + 4 : at + 4 + n].decode(), struct.unpack_from(">q", content, at + 4 + n)[0]))
        at += 12 + n
    if len(index) != count:
        raise ValueError(f"{len(index)} index entries, the footer has {count}")
    (bits,) = struct.unpack_from(">i", content, bloom_at)
    words = np.frombuffer(content[bloom_at + 4 : -FOOTER_BYTES], ">u8").astype(np.uint64)
    return {"entries": entries, "index": index, "bloom_bits": bits, "bloom_words": words}


def table_files(changelog: DataFrame) -> DataFrame:
    """(segment_id, content): each segment's stored entries as a table file. A segment is one buffer's
    worth of entries, so a file is bounded by the flush threshold or by what a merge was given."""
    kinds = pa.schema([("segment_id", pa.int64()), ("content", pa.binary())])

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        entries = list(zip(*(rows[c].to_pylist() for c in ("key", "value", "type", "seq_num", "expires_at")), strict=True))
        return pa.table([pa.array([rows["segment_id"][0].as_py()], pa.int64()), pa.array([table_bytes(entries)], pa.binary())], schema=kinds)

    return segment_entries(changelog).groupBy("segment_id").applyInArrow(build, "segment_id long, content binary")


def decode_tables(files: DataFrame) -> DataFrame:
    """Changelog rows of table files (segment_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [dict(zip(("key", "value", "type", "seq_num", "expires_at"), e, strict=True), segment_id=segment) for e in parse_table(content)["entries"]]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("value", pa.binary()), ("seq_num", pa.int64()), ("type", pa.int8()), ("expires_at", pa.int64()), ("segment_id", pa.int64())]))

    return files.select("segment_id", "content").mapInArrow(run, CHANGELOG)


def write_tables(changelog: DataFrame, path: str) -> None:
    """Table files named by segment in a folder that Spark can write to."""
    name = F.concat(F.lit("sstable-"), F.lpad(F.col("segment_id").cast("string"), 20, "0"), F.lit(".sst"))
    put_files(table_files(changelog).select(name.alias("name"), "content"), path)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Changelog rows of all table files in a folder; an unreadable one is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path)
    return decode_tables(files.select(F.regexp_extract("path", r"sstable-(\d+)\.sst$", 1).cast("long").alias("segment_id"), "content"))
