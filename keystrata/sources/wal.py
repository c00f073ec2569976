"""Log files: records from changelog rows, files from records, and recovery from files.

A file's records are read up to the first that is cut off or fails its checksum; later files are
read on. A record that is sound but has an unknown type is an error.
"""

from __future__ import annotations

import contextlib
import os
import struct
import uuid
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.codec import log_name, log_record
from keystrata.operators.resolve import latest
from keystrata.schema import CHANGELOG, DELETE, PUT


def wal_encode(changelog: DataFrame) -> DataFrame:
    """(segment_id, seq_num, record): every row as a log record."""
    return changelog.select("segment_id", "seq_num", log_record().alias("record"))


def wal_files(changelog: DataFrame) -> DataFrame:
    """(name, content): one log per segment, its records in the order of sequence numbers.

    A log is one buffer's worth of writes, so it has a bounded size by construction.
    """
    # listagg joins once; an aggregate of concat would copy all bytes so far with every record
    logs = wal_encode(changelog).groupBy("segment_id").agg(F.expr("listagg(record, X'') WITHIN GROUP (ORDER BY seq_num)").alias("content"))
    return logs.select(log_name(F.col("segment_id")).alias("name"), "content")


def decode_log(data: bytes) -> Iterator[tuple[str, bytes, int, int, int]]:
    """(key, value, type, seq_num, expires_at) of a log's valid records."""
    at, end = 0, len(data)
    while True:
        start = at
        if end - at < 4:
            return
        (n,) = struct.unpack_from(">i", data, at)
        if n < 0 or end - at - 4 < n + 4:
            return
        key = data[at + 4 : at + 4 + n]
        at += 4 + n
        (m,) = struct.unpack_from(">i", data, at)
        if m < 0 or end - at - 4 < m + 21:
            return
        value = data[at + 4 : at + 4 + m]
        at += 4 + m
        kind, seq, expires, crc = struct.unpack_from(">bqqI", data, at)
        at += 21
        if crc32(data[start : at - 4]) != crc:
            return
        if kind not in (PUT, DELETE):
            raise ValueError(f"unknown entry type: {kind}")
        yield key.decode(), value, kind, seq, expires


def wal_decode(files: DataFrame) -> DataFrame:
    """Changelog rows of log files (name, content); segment_id is the number in the name, or 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digits = "".join(c for c in name.rsplit("/", 1)[-1] if c.isdigit())
                rows = list(decode_log(content))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[3], pa.int64()), pa.array(columns[2], pa.int8()), pa.array(columns[4], pa.int64()), pa.array([int(digits or 0)] * len(rows), pa.int64())],
                    names=CHANGELOG.fieldNames(),
                )

    return files.select("name", "content").mapInArrow(run, CHANGELOG)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """Changelog rows of all logs in a folder, a file to a task at least."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "wal-*.log").load(path)
    return wal_decode(files.select(F.col("path").alias("name"), "content"))


def write_wal(changelog: DataFrame, path: str) -> None:
    """Log files in a folder that Spark can write to; a file appears whole or not at all."""
    put_files(wal_files(changelog), path)


def put_files(files: DataFrame, path: str) -> None:
    """Files (name, content) in a folder, each written by the executor that has its content, and whole or
    not at all. Only of a file system that pyarrow does not know files go through the driver, one at a time."""
    fs, Path = hadoop(files.sparkSession, path)
    fs.mkdirs(Path(path))
    uri = fs.makeQualified(Path(path)).toUri()
    if uri.getScheme() == "file":
        put = partial(_put_local, uri.getPath())
    else:
        uri = uri.toString()
        try:
            pa.fs.FileSystem.from_uri(uri)
        except (pa.ArrowException, OSError):
            return _put_from_driver(files, path)
        put = partial(_put_remote, uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                put(name.as_py(), content.as_buffer())
            yield batch.select(["name"])

    files.select("name", "content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def _put_local(folder: str, name: str, content: pa.Buffer) -> None:
    tmp = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "xb") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    # Hadoop's checksum of a file that was there before
    with contextlib.suppress(FileNotFoundError):
        os.remove(f"{folder}/.{name}.crc")
    os.replace(tmp, f"{folder}/{name}")


def _put_remote(uri: str, name: str, content: pa.Buffer) -> None:
    fs, folder = pa.fs.FileSystem.from_uri(uri)
    tmp = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        f.write(content)
    if fs.get_file_info(f"{folder}/{name}").type == pa.fs.FileType.File:
        fs.delete_file(f"{folder}/{name}")
    fs.move(tmp, f"{folder}/{name}")


def _put_from_driver(files: DataFrame, path: str) -> None:
    fs, Path = hadoop(files.sparkSession, path)
    for row in files.toLocalIterator():
        tmp, out = Path(f"{path}/.{row['name']}.tmp"), Path(f"{path}/{row['name']}")
        stream = fs.create(tmp, True)
        try:
            stream.write(bytearray(row["content"]))
            stream.hsync()
        finally:
            stream.close()
        fs.delete(out, False)
        fs.rename(tmp, out)


class LogWriter:
    """An open log that records are appended to, each on disk before ``append`` returns."""

    def __init__(self, spark: SparkSession, path: str, segment_id: int):
        fs, Path = hadoop(spark, path)
        self.name = f"{path}/{log_file_name(segment_id)}"
        self._stream = fs.append(Path(self.name)) if fs.exists(Path(self.name)) else fs.create(Path(self.name), False)

    def append(self, key: str, value: bytes, kind: int, seq: int, expires_at: int = 0) -> None:
        self._stream.write(bytearray(encode_record(key, value, kind, seq, expires_at)))
        self._stream.hsync()

    def close(self) -> None:
        self._stream.close()


def log_file_name(segment_id: int) -> str:
    return f"wal-{segment_id:020d}.log"


def encode_record(key: str, value: bytes, kind: int, seq: int, expires_at: int) -> bytes:
    """One record: lengths before key and value, type, sequence number, expiry, checksum of all that."""
    k = key.encode()
    body = struct.pack(">i", len(k)) + k + struct.pack(">i", len(value)) + value + struct.pack(">bqq", kind, seq, expires_at)
    return body + struct.pack(">I", crc32(body))


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and Hadoop's Path class."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), Path


def wal_replay(records: DataFrame) -> DataFrame:
    """The newest version of every key of decoded records, tombstones included."""
    return latest(records)


def recovery_stats(records: DataFrame) -> DataFrame:
    """One row: segments and entries read, duplicates included, distinct keys, next sequence number."""
    return records.agg(F.countDistinct("segment_id").alias("segments"), F.count("*").alias("entries"), F.countDistinct("key").alias("keys"), (F.coalesce(F.max("seq_num"), F.lit(0)) + 1).alias("next_seq"))
