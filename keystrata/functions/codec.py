"""Byte-level encodings as column expressions: big-endian integers, records, checksums, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.schema import DELETE, PUT, TIER_BASE


def be_int(n: Column) -> Column:
    """4 bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(n.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))


def be_long(n: Column) -> Column:
    """8 bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def read_int(data: Column, at: Column) -> Column:
    """The unsigned 4-byte integer at a byte position counted from 0."""
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(4))), 16, 10).cast("long")


def read_long(data: Column, at: Column) -> Column:
    """The signed 8-byte integer at a byte position counted from 0."""
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(8))), 16, -10).cast("long")


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def entry_bytes() -> Column:
    """A table entry: key and value with their lengths, type, sequence number, expiry."""
    key, value = utf8(F.col("key")), F.col("value")
    return F.concat(be_int(F.octet_length(key)), key, be_int(F.octet_length(value)), value, F.unhex(F.lpad(F.hex(F.col("type").cast("long")), 2, "0")), be_long(F.col("seq_num")), be_long(F.col("expires_at")))


def log_record() -> Column:
    """A log record: the entry and the CRC-32 of its bytes."""
    return F.concat(entry_bytes(), be_int(F.crc32(entry_bytes())))


def entry_size() -> Column:
    """Bytes that an entry takes in a table file."""
    return F.lit(25) + F.octet_length("key") + F.octet_length("value")


def accounted_size() -> Column:
    """Bytes that an entry counts for in memory: characters of the key and bytes of the value."""
    return F.length("key") + F.octet_length("value")


def absolute_expiry(ttl_seconds: Column, now_ms: Column) -> Column:
    """Milliseconds at which an entry expires; a TTL that is null, 0 or negative never does. Overflow raises."""
    return F.when(ttl_seconds > 0, now_ms + ttl_seconds.cast("long") * F.lit(1000).cast("long")).otherwise(F.lit(0).cast("long"))


def log_name(log_id: Column) -> Column:
    return F.format_string("wal-%020d.log", log_id)


def type_code(code: Column) -> Column:
    """A type code as it is; anything but 0 and 1 raises."""
    return F.when(code.isin(PUT, DELETE), code.cast("tinyint")).otherwise(F.raise_error(F.concat(F.lit("unknown entry type: "), F.coalesce(code.cast("string"), F.lit("null")))).cast("tinyint"))


def size_tier(size: Column) -> Column:
    """The whole part of the logarithm to base 4; 0 for sizes up to 0."""
    return F.when(size <= 0, F.lit(0)).otherwise(F.floor(F.ln(size) / F.ln(F.lit(float(TIER_BASE))))).cast("int")
