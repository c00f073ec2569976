"""The changelog's schema and the constants of its storage format."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, ByteType, LongType, StringType, StructField, StructType

PUT, DELETE = 0, 1

# The storage format and its defaults.
FLUSH_BYTES = 4 * 1024 * 1024
CACHE_BLOCKS = 1024
INDEX_INTERVAL = 16
BLOOM_PROBES = 7
BLOOM_BITS_PER_KEY = 14
BLOOM_MIN_BITS = 64
BLOOM_MIN_KEYS = 16
HASH_SEED = 42
TIER_MIN_FILES = 4
TIER_BASE = 4
LOG_OVERHEAD = 29
ENTRY_OVERHEAD = 25
FOOTER_BYTES = 20
LATENCY_BUCKETS_MS = (0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0)
COMPACTION_BUCKETS_MS = (10.0, 50.0, 100.0, 500.0, 1000.0, 5000.0)
COMPACTION_DELAY_S = 10
DEFAULT_PORT = 8080
DEFAULT_DATA_DIR = "keystrata-data"

CHANGELOG = StructType(
    [
        StructField("key", StringType(), False),
        StructField("value", BinaryType(), False),
        StructField("seq_num", LongType(), False),
        StructField("type", ByteType(), False),
        StructField("expires_at", LongType(), False),
        StructField("segment_id", LongType(), False),
    ]
)


def changelog_schema() -> StructType:
    return CHANGELOG
