"""The queries over the changelog operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata import workload
from keystrata.functions.codec import absolute_expiry, be_int, be_long, entry_bytes, log_name, read_int, read_long, type_code
from keystrata.functions.text import query_params
from keystrata.operators import bloom, cache, compaction, flush, index, metrics, resolve
from keystrata.operators.changelog import assign_sequence, deletes, puts
from keystrata.plans import hash_sql, stored
from keystrata.plans.fixtures import AS_OF_MS, kv_events, kv_orders
from keystrata.plans.shared import shared_folder
from keystrata.schema import COMPACTION_BUCKETS_MS, LATENCY_BUCKETS_MS
from keystrata.sources import sst, wal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_EVENTS = """
WITH kv AS (
  SELECT 'user:' || lpad(user_id::VARCHAR, 6, '0') || ':' || (regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT % 10)::VARCHAR AS key,
         CASE WHEN event_type = 'error' THEN '' ELSE props END AS value, event_id + 1 AS seq_num,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS type,
         CASE WHEN event_type = 'view' THEN epoch_us(ts) // 1000 + 604800000 ELSE 0 END AS expires_at, event_id // 1000 AS segment_id
  FROM events),
latest AS (SELECT * FROM kv QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq_num DESC, segment_id DESC) = 1),
live AS (SELECT * FROM latest WHERE type = 0 AND (expires_at <= 0 OR 1706659200000 <= expires_at)),
entries AS (SELECT * FROM kv QUALIFY row_number() OVER (PARTITION BY segment_id, key ORDER BY seq_num DESC) = 1),
sized AS (SELECT *, 25 + strlen(key) + strlen(value) AS entry_size FROM entries)
"""
_ROW = "key, value, seq_num, type::INTEGER AS type, expires_at"


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name; its SQL goes behind the common tables over events."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = (_EVENTS.replace("WITH kv", "WITH RECURSIVE kv") if "WITH own" not in sql else "") + sql
        return f

    return register


def shown(df: DataFrame) -> DataFrame:
    """Values as text and types as int, for results that other engines compare."""
    casts = {"value": F.decode("value", "UTF-8").alias("value"), "type": F.col("type").cast("int").alias("type")}
    return df.select(*(casts.get(c, F.col(c)) for c in df.columns))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve.scan(kv_events(spark, sf_dir), "user:000000:0", "user:999999:9", AS_OF_MS))


def _entry(df: DataFrame) -> DataFrame:
    return shown(df.select("key", "value", "seq_num", "type", "expires_at"))


# Reading


@query(f"SELECT {_ROW} FROM latest")
def kv_latest(spark, sf_dir):
    return _entry(resolve.latest(kv_events(spark, sf_dir)))


@query(f"SELECT {_ROW} FROM live")
def kv_live(spark, sf_dir):
    return _entry(resolve.live(kv_events(spark, sf_dir), AS_OF_MS))


@query(f"SELECT {_ROW} FROM live WHERE key BETWEEN 'user:000010:0' AND 'user:000020:9'")
def kv_scan(spark, sf_dir):
    return _entry(resolve.scan(kv_events(spark, sf_dir), "user:000010:0", "user:000020:9", AS_OF_MS))


@query(f"SELECT {_ROW} FROM live WHERE key = 'user:000000:6'")
def kv_scan_single_key(spark, sf_dir):
    return _entry(resolve.scan(kv_events(spark, sf_dir), "user:000000:6", "user:000000:6", AS_OF_MS))


@query("SELECT key, replace(replace('{\"key\":\"' || key || '\",\"value\":\"' || replace(value, '\"', '\\\"') || '\"}', chr(10), '\\n'), chr(13), '\\r') AS json FROM live WHERE key BETWEEN 'user:000010:0' AND 'user:000020:9'")
def kv_scan_json(spark, sf_dir):
    return resolve.scan_json(kv_events(spark, sf_dir), "user:000010:0", "user:000020:9", AS_OF_MS)


def _register_get(name: str, key: str) -> None:
    @query(f"SELECT key, value FROM live WHERE key = '{key}'", name)
    def _get(spark, sf_dir):
        return shown(resolve.get(kv_events(spark, sf_dir), key, AS_OF_MS))


# keys by their state at sf0.01
for _name, _key in {"kv_get": "user:000000:0", "kv_get_ttl": "user:000000:6", "kv_get_deleted": "user:000000:2", "kv_get_expired": "user:000004:3", "kv_get_missing": "user:999999:0"}.items():
    _register_get(_name, _key)


def _probe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots 0 to 9 of every customer: some are keys of events, most are not."""
    custkey = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return custkey.select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(":"), (F.col("c_custkey") % 10).cast("string")).alias("key"))


_PROBES = ", probes AS (SELECT 'user:' || lpad(c_custkey::VARCHAR, 6, '0') || ':' || (c_custkey % 10)::VARCHAR AS key FROM customer)"


@query(_PROBES + " SELECT p.key, l.key IS NOT NULL AS found, l.value FROM probes p LEFT JOIN live l USING (key)")
def kv_multi_get(spark, sf_dir):
    return shown(resolve.multi_get(kv_events(spark, sf_dir), _probe_keys(spark, sf_dir), AS_OF_MS))


@query(_PROBES + " SELECT key FROM probes WHERE key NOT IN (SELECT key FROM live)")
def kv_miss(spark, sf_dir):
    return resolve.missing(kv_events(spark, sf_dir), _probe_keys(spark, sf_dir), AS_OF_MS)


@query("SELECT key, seq_num FROM latest WHERE type = 1")
def kv_tombstones(spark, sf_dir):
    return resolve.latest(kv_events(spark, sf_dir)).where(resolve.is_tombstone()).select("key", "seq_num")


@query("SELECT key, seq_num, expires_at FROM latest WHERE expires_at > 0 AND 1706659200000 > expires_at")
def kv_expired(spark, sf_dir):
    return resolve.latest(kv_events(spark, sf_dir)).where(resolve.is_expired(AS_OF_MS)).select("key", "seq_num", "expires_at")


@query("SELECT key, seq_num, expires_at FROM latest WHERE expires_at > 0")
def kv_with_ttl(spark, sf_dir):
    return resolve.latest(kv_events(spark, sf_dir)).where(resolve.has_ttl()).select("key", "seq_num", "expires_at")


@query(f"SELECT {_ROW}, row_number() OVER (PARTITION BY key ORDER BY seq_num DESC, segment_id DESC)::INTEGER AS version FROM kv")
def kv_history(spark, sf_dir):
    return shown(resolve.history(kv_events(spark, sf_dir)).select("key", "value", "seq_num", "type", "expires_at", "version"))


@query(f"SELECT {_ROW} FROM (SELECT * FROM kv WHERE seq_num <= 500 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq_num DESC) = 1) WHERE type = 0 AND (expires_at <= 0 OR 1706659200000 <= expires_at)")
def kv_as_of_seq(spark, sf_dir):
    return _entry(resolve.live(kv_events(spark, sf_dir), AS_OF_MS, as_of_seq=500))


@query(f"SELECT {_ROW} FROM latest WHERE type = 0 AND (expires_at <= 0 OR 1705276800000 <= expires_at)")
def kv_as_of_time(spark, sf_dir):
    return _entry(resolve.live(kv_events(spark, sf_dir), 1705276800000))


@query("WITH own AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT o_custkey AS key, o_orderkey, o_orderstatus, o_totalprice FROM own")
def kv_orders_latest(spark, sf_dir):
    return resolve.latest(kv_orders(spark, sf_dir), ("key",), ("o_orderdate", "o_orderkey")).select("key", "o_orderkey", "o_orderstatus", "o_totalprice")


# Writing


@query("WITH own AS (SELECT o_orderkey, o_custkey - 700 AS ttl, epoch_ms(o_orderdate) AS now_ms FROM orders) SELECT 'order:' || o_orderkey::VARCHAR AS key, CASE WHEN ttl > 0 THEN now_ms + ttl * 1000 ELSE 0 END AS expires_at FROM own")
def kv_put_ttl_stamp(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    now = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return orders.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), absolute_expiry(F.col("o_custkey") - 700, now).alias("expires_at"))


@query("WITH own AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq_num FROM events), w AS (SELECT user_id::VARCHAR AS key, CASE WHEN event_type = 'error' THEN '' ELSE props END AS value, seq_num, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::INTEGER AS type FROM own) SELECT key, value, seq_num, type FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq_num DESC) = 1")
def kv_write_sequence(spark, sf_dir):
    """Puts and deletes numbered in order of arrival, then the newest of each key."""
    events = assign_sequence(spark.read.parquet(f"{sf_dir}/events.parquet"), [F.col("ts"), F.col("event_id")])
    key, error = F.col("user_id").cast("string"), F.col("event_type") == "error"
    rows = puts(events.where(~error), key, F.encode("props", "UTF-8"), F.col("seq_num")).unionByName(deletes(events.where(error), key, F.col("seq_num")))
    return shown(resolve.latest(rows).select("key", "value", "seq_num", "type"))


# Segments and compaction


@query("SELECT segment_id, count(*) AS entries, sum(entry_size)::BIGINT AS bytes FROM sized GROUP BY segment_id")
def kv_segment_sizes(spark, sf_dir):
    return flush.segment_sizes(flush.segment_entries(kv_events(spark, sf_dir)))


@query("SELECT segment_id, sum(entry_size)::BIGINT AS bytes, floor(ln(sum(entry_size)) / ln(4))::INTEGER AS tier FROM sized GROUP BY segment_id")
def kv_size_tiers(spark, sf_dir):
    return compaction.size_tiers(flush.segment_sizes(flush.segment_entries(kv_events(spark, sf_dir))))


@query(", t AS (SELECT segment_id, floor(ln(sum(entry_size)) / ln(4))::BIGINT AS tier FROM sized GROUP BY segment_id) SELECT segment_id, tier AS group_id FROM t WHERE tier IN (SELECT tier FROM t GROUP BY tier HAVING count(*) >= 4)")
def kv_merge_groups(spark, sf_dir):
    return compaction.select_merge_groups(flush.segment_sizes(flush.segment_entries(kv_events(spark, sf_dir))))


@query("SELECT segment_id, key, seq_num, sum(d) OVER (PARTITION BY segment_id ORDER BY seq_num)::BIGINT AS net_bytes FROM (SELECT *, length(key) + strlen(value) - coalesce(lag(length(key) + strlen(value)) OVER (PARTITION BY segment_id, key ORDER BY seq_num), 0) AS d FROM kv)")
def kv_running_size(spark, sf_dir):
    return flush.running_size(kv_events(spark, sf_dir)).select("segment_id", "key", "seq_num", "net_bytes")


@query(""", c AS (SELECT *, length(key) + strlen(value) AS size FROM kv),
b(flush_id, first, cut) AS (
  SELECT 0::BIGINT, 0::BIGINT, (SELECT min(seq_num) FROM (SELECT seq_num, sum(d) OVER (ORDER BY seq_num) AS net FROM (SELECT seq_num, size - coalesce(lag(size) OVER (PARTITION BY key ORDER BY seq_num), 0) AS d FROM c)) WHERE net >= 16384)
  UNION ALL
  SELECT n.flush_id, n.first, m.cut FROM (SELECT flush_id + 1 AS flush_id, cut AS first FROM b WHERE cut IS NOT NULL) n
  LEFT JOIN (SELECT first, min(seq_num) AS cut FROM (SELECT first, seq_num, sum(d) OVER (PARTITION BY first ORDER BY seq_num) AS net
    FROM (SELECT b.cut AS first, c.seq_num, c.size - coalesce(lag(c.size) OVER (PARTITION BY b.cut, c.key ORDER BY c.seq_num), 0) AS d FROM b JOIN c ON c.seq_num > b.cut)) WHERE net >= 16384 GROUP BY first) m ON m.first = n.first),
w AS (SELECT b.flush_id, c.seq_num, c.key, c.size FROM c JOIN b ON c.seq_num > b.first AND (b.cut IS NULL OR c.seq_num <= b.cut)),
l AS (SELECT flush_id, key, arg_max(size, seq_num) AS size, count(*) AS n FROM w GROUP BY flush_id, key)
SELECT 0::INTEGER AS shard, flush_id, sum(n)::BIGINT AS writes, count(*) AS keys, sum(size)::BIGINT AS bytes, sum(size) >= 16384 AS "full" FROM l GROUP BY flush_id""")
def kv_flush_plan(spark, sf_dir):
    """Buffers of 16 KiB, each net of overwritten entries and begun anew at each flush."""
    return flush.flush_summary(flush.plan_flush(kv_events(spark, sf_dir), 16_384), 16_384)


@query(f"SELECT {_ROW} FROM kv WHERE segment_id <= 3 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq_num DESC, segment_id DESC) = 1")
def kv_compact_partial(spark, sf_dir):
    return _entry(compaction.merge(kv_events(spark, sf_dir).where("segment_id <= 3"), False, AS_OF_MS))


@query(f"SELECT {_ROW} FROM live")
def kv_compact_final(spark, sf_dir):
    return _entry(compaction.merge(flush.segment_entries(kv_events(spark, sf_dir)), True, AS_OF_MS))


@query("SELECT (SELECT count(*) FROM entries) AS rows_in, (SELECT count(*) FROM live) AS rows_out, (SELECT count(*) FROM entries) - (SELECT count(*) FROM latest) AS superseded, (SELECT count(*) FROM latest WHERE type = 1) AS tombstones_dropped, (SELECT count(*) FROM latest WHERE type = 0 AND expires_at > 0 AND 1706659200000 > expires_at) AS expired_dropped")
def kv_compaction_stats(spark, sf_dir):
    return compaction.compaction_stats(flush.segment_entries(kv_events(spark, sf_dir)), True, AS_OF_MS)


# Index, Bloom filter, cache

_INDEX = ", numbered AS (SELECT segment_id, key, row_number() OVER w - 1 AS i, (sum(entry_size) OVER w - entry_size)::BIGINT AS off FROM sized WINDOW w AS (PARTITION BY segment_id ORDER BY key)), idx AS (SELECT segment_id, key, off FROM numbered WHERE i % 16 = 0)"


@query(_INDEX + " SELECT segment_id, key, off AS \"offset\" FROM idx")
def kv_sparse_index(spark, sf_dir):
    return index.sparse_index(flush.segment_entries(kv_events(spark, sf_dir)))


def _other_keys(entries: DataFrame) -> DataFrame:
    """Keys of each segment asked of the segment after it: some are there, most are not."""
    return entries.select((F.col("segment_id") + 1).alias("segment_id"), "key")


@query(_INDEX + """, blocks AS (SELECT segment_id, row_number() OVER w AS n, CASE WHEN row_number() OVER w = 1 THEN '' ELSE key END AS low, lead(key) OVER w AS high, off AS s, lead(off) OVER w AS e FROM idx WINDOW w AS (PARTITION BY segment_id ORDER BY key)),
probes AS (SELECT segment_id + 1 AS segment_id, key FROM entries)
SELECT p.segment_id, p.key, coalesce(b.s, 0) AS "start", b.e AS "end" FROM probes p LEFT JOIN blocks b ON b.segment_id = p.segment_id AND p.key >= b.low AND (b.high IS NULL OR p.key < b.high)""")
def kv_block_lookup(spark, sf_dir):
    entries = flush.segment_entries(kv_events(spark, sf_dir))
    return index.block_lookup(index.sparse_index(entries), _other_keys(entries))


_BITS = ", sizes AS (SELECT segment_id, greatest(greatest(count(*), 16) * 14, 64)::BIGINT AS bits FROM entries GROUP BY segment_id), " + hash_sql.murmur_steps("(SELECT DISTINCT key FROM kv)")
_WORDS = _BITS + f", spots AS (SELECT segment_id, {hash_sql.position('i', 'bits')} AS p FROM entries JOIN sizes USING (segment_id) JOIN hashed USING (key), unnest({hash_sql.PROBES}) AS u(i))"
_HITS = _WORDS + f""", asked AS (SELECT DISTINCT e.segment_id + 1 AS segment_id, e.key FROM entries e),
hits AS (SELECT segment_id, key, bool_and(p IS NOT NULL) AS might_contain FROM (SELECT segment_id, key, {hash_sql.position('i', 'bits')} AS q FROM asked JOIN sizes USING (segment_id) JOIN hashed USING (key), unnest({hash_sql.PROBES}) AS u(i)) a
  LEFT JOIN (SELECT DISTINCT segment_id AS s, p FROM spots) b ON b.s = a.segment_id AND b.p = a.q GROUP BY segment_id, key)"""


_WORD_ROWS = "(SELECT segment_id, (p // 64)::INTEGER AS word, bit_or(CASE WHEN p % 64 = 63 THEN (-9223372036854775807 - 1)::BIGINT ELSE 1::BIGINT << (p % 64) END) AS bits FROM spots GROUP BY segment_id, p // 64)"


@query(_WORDS + f" SELECT * FROM {_WORD_ROWS}")
def kv_bloom_bits(spark, sf_dir):
    return bloom.bloom_words(flush.segment_entries(kv_events(spark, sf_dir)).select("segment_id", "key"))


@query(_BITS + " SELECT * FROM sizes")
def kv_bloom_sizes(spark, sf_dir):
    return bloom.filter_sizes(flush.segment_entries(kv_events(spark, sf_dir)))


@query(_WORDS + f" SELECT * FROM {_WORD_ROWS}")
def kv_bloom_restored(spark, sf_dir):
    """Filters as arrays of words and back."""
    entries = flush.segment_entries(kv_events(spark, sf_dir)).select("segment_id", "key")
    return bloom.restored(bloom.serialized(bloom.bloom_words(entries), bloom.filter_sizes(entries)))[0]


@query(_HITS + " SELECT * FROM hits")
def kv_bloom_probe(spark, sf_dir):
    entries = flush.segment_entries(kv_events(spark, sf_dir)).select("segment_id", "key")
    sizes = bloom.filter_sizes(entries)
    return bloom.might_contain(bloom.bloom_words(entries, sizes), sizes, _other_keys(entries))


@query(", sg AS (SELECT DISTINCT segment_id FROM entries), p AS (SELECT DISTINCT e.segment_id + 1 AS segment_id, e.key FROM entries e WHERE e.segment_id + 1 IN (SELECT segment_id FROM sg)) SELECT (SELECT count(*) FROM p) AS probes, (SELECT count(*) FROM p JOIN entries e USING (segment_id, key)) AS present, 0::BIGINT AS false_negatives, true AS within_bound")
def kv_bloom_fpr(spark, sf_dir):
    """Probes, keys that are there, keys missed (none), and whether false positives stay under 1 %."""
    entries = flush.segment_entries(kv_events(spark, sf_dir)).select("segment_id", "key")
    sizes = bloom.filter_sizes(entries)
    rows = bloom.false_positives(bloom.bloom_words(entries, sizes), sizes, _other_keys(entries), entries)
    return rows.select("probes", "present", "false_negatives", (F.col("false_positives") * 100 <= F.col("probes") - F.col("present")).alias("within_bound"))


@query(""", a AS (SELECT key, seq_num, lag(seq_num) OVER (PARTITION BY key ORDER BY seq_num) AS before FROM kv),
d AS (SELECT a.seq_num, count(DISTINCT k.key) AS between FROM a JOIN kv k ON k.seq_num > a.before AND k.seq_num < a.seq_num WHERE a.before IS NOT NULL GROUP BY a.seq_num),
h AS (SELECT count(*) AS hits FROM a LEFT JOIN d USING (seq_num) WHERE a.before IS NOT NULL AND coalesce(d.between, 0) < 64)
SELECT '' AS cache, (SELECT count(*) FROM kv) AS accesses, hits, (SELECT count(*) FROM kv) - hits AS disk_reads FROM h""")
def kv_cache_hits(spark, sf_dir):
    """An LRU cache of 64 blocks over the keys' accesses: a hit has fewer other blocks since the last access."""
    trace = kv_events(spark, sf_dir).select(F.col("seq_num").alias("at"), F.col("key").alias("block"))
    return cache.cache_stats(cache.cache_trace(trace, 64))


@query("SELECT '' AS cache, count(*) AS accesses, count(*) - count(DISTINCT key) AS hits, count(DISTINCT key) AS disk_reads FROM kv")
def kv_cache_unbounded(spark, sf_dir):
    trace = kv_events(spark, sf_dir).select(F.col("seq_num").alias("at"), F.col("key").alias("block"))
    return cache.cache_stats(cache.cache_trace(trace, 1 << 40))


# Files


@query("SELECT segment_id, seq_num, printf('%08x', strlen(key)) || lower(hex(key::BLOB)) || printf('%08x', strlen(value)) || lower(hex(value::BLOB)) || printf('%02x', type) || printf('%016x', seq_num) || printf('%016x', expires_at) AS entry FROM entries")
def kv_entry_encode(spark, sf_dir):
    """Table entries of every segment, as hexadecimal digits."""
    return flush.segment_entries(kv_events(spark, sf_dir)).select("segment_id", "seq_num", F.lower(F.hex(entry_bytes())).alias("entry"))


_HEX = "printf('%08x', strlen(key)) || lower(hex(key::BLOB)) || printf('%08x', strlen(value)) || lower(hex(value::BLOB)) || printf('%02x', type) || printf('%016x', seq_num) || printf('%016x', expires_at)"


@query(f", {hash_sql.CRC_TABLE}, e AS (SELECT segment_id, seq_num, {_HEX} AS e FROM kv) SELECT segment_id, seq_num, e || printf('%08x', {hash_sql.crc32('e')}) AS record FROM e, crc_table")
def kv_wal_encode(spark, sf_dir):
    """Log records, as hexadecimal digits."""
    return wal.wal_encode(kv_events(spark, sf_dir)).select("segment_id", "seq_num", F.lower(F.hex("record")).alias("record"))


@query(f"SELECT {_ROW} FROM latest")
def kv_wal_replay(spark, sf_dir):
    """Changelog to log bytes, decoded and replayed."""
    return _entry(wal.wal_replay(wal.wal_decode(wal.wal_files(kv_events(spark, sf_dir)))))


@query("SELECT count(DISTINCT segment_id) AS segments, count(*) AS entries, count(DISTINCT key) AS keys, max(seq_num) + 1 AS next_seq FROM kv")
def kv_wal_recovery(spark, sf_dir):
    return wal.recovery_stats(wal.wal_decode(wal.wal_files(kv_events(spark, sf_dir))))


@query(f"SELECT segment_id, {_ROW} FROM entries")
def kv_table_files(spark, sf_dir):
    """Segments to table-file bytes and back."""
    rows = sst.decode_tables(sst.table_files(kv_events(spark, sf_dir)))
    return shown(rows.select("segment_id", "key", "value", "seq_num", "type", "expires_at"))


@query("SELECT DISTINCT 'wal-' || lpad(segment_id::VARCHAR, 20, '0') || '.log' AS name FROM kv")
def kv_wal_names(spark, sf_dir):
    return kv_events(spark, sf_dir).select("segment_id").distinct().select(log_name(F.col("segment_id")).alias("name"))


# Metrics


@query("SELECT 'writes_total' AS metric, count(*) FILTER (type = 0) AS value FROM kv UNION ALL SELECT 'deletes_total', count(*) FILTER (type = 1) FROM kv UNION ALL SELECT 'memtable_flushes_total', count(DISTINCT segment_id) FROM kv")
def kv_metrics(spark, sf_dir):
    return metrics.write_metrics(kv_events(spark, sf_dir))


@query(_HITS + """, r AS (SELECT h.*, e.key IS NOT NULL AS present FROM hits h LEFT JOIN entries e USING (segment_id, key))
SELECT 'reads_total' AS metric, count(DISTINCT key) AS value FROM r UNION ALL SELECT 'bloom_skips_total', count(*) FILTER (NOT might_contain) FROM r UNION ALL SELECT 'bloom_false_positives_total', count(*) FILTER (might_contain AND NOT present) FROM r""")
def kv_read_metrics(spark, sf_dir):
    """Reads, filter skips and false positives of looking each segment's keys up in the next."""
    entries = flush.segment_entries(kv_events(spark, sf_dir)).select("segment_id", "key")
    sizes = bloom.filter_sizes(entries)
    hits = bloom.might_contain(bloom.bloom_words(entries, sizes), sizes, _other_keys(entries))
    there = entries.withColumn("present", F.lit(True))
    return metrics.read_metrics(hits.join(there, ["segment_id", "key"], "left").withColumn("present", F.coalesce("present", F.lit(False))))


@query(_HITS.replace("SELECT DISTINCT e.segment_id + 1 AS segment_id, e.key FROM entries e", "SELECT s.segment_id, k.key FROM (SELECT DISTINCT segment_id FROM entries) s, (SELECT DISTINCT key FROM kv) k") + """, r AS (SELECT h.*, e.key IS NOT NULL AS present FROM hits h LEFT JOIN entries e USING (segment_id, key)),
f AS (SELECT key, max(segment_id) AS hit FROM r WHERE present GROUP BY key), w AS (SELECT r.* FROM r LEFT JOIN f USING (key) WHERE hit IS NULL OR segment_id >= hit)
SELECT 'reads_total' AS metric, count(DISTINCT key) AS value FROM w UNION ALL SELECT 'bloom_skips_total', count(*) FILTER (NOT might_contain) FROM w UNION ALL SELECT 'bloom_false_positives_total', count(*) FILTER (might_contain AND NOT present) FROM w""")
def kv_read_path(spark, sf_dir):
    """Skips and false positives of reading every key, table by table from the newest to the first that has it."""
    entries = flush.segment_entries(kv_events(spark, sf_dir)).select("segment_id", "key")
    return metrics.read_rows(bloom.read_counts(entries))


_BUCKETS = ", ".join(f"({b}::DOUBLE)" for b in LATENCY_BUCKETS_MS)


@query(f"WITH own AS (SELECT (value * 100)::BIGINT::DOUBLE AS ms FROM events WHERE value IS NOT NULL), b(le) AS (VALUES {_BUCKETS}) SELECT le, (SELECT count(*) FROM own WHERE ms <= le) AS count, (SELECT sum(ms) FROM own) AS sum FROM b UNION ALL SELECT NULL, count(*), sum(ms) FROM own")
def kv_latency_histogram(spark, sf_dir):
    """Cumulative buckets of a whole-numbered measure, so that its sum is exact in any order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return metrics.histogram(events.select(F.round(F.col("value") * 100).cast("long").cast("double").alias("ms")), "ms")


# Requests


@query("WITH own AS (SELECT event_id, 'key', 'user ' || user_id::VARCHAR FROM events) SELECT event_id AS request_id, 'key' AS name, 'user ' || user_id::VARCHAR AS value FROM events UNION ALL SELECT event_id, 'value', props FROM events")
def kv_query_params(spark, sf_dir):
    """Query strings made of events, with a repeated, a nameless and a bare part, parsed again."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.lit("key=other&=x&bare&key=user+"), F.col("user_id").cast("string"), F.lit("&value="), F.url_encode("props"))
    return query_params(events.select(F.col("event_id").alias("request_id"), text.alias("query"), F.lit(None).cast("string").alias("body")))


# Stores, logs and tables in the shared folder


@query(f"SELECT {_ROW} FROM live")
def kv_store_live(spark, sf_dir):
    """Two appends to a store that is opened again to read."""
    return _entry(resolve.live(stored.appended(spark, kv_events(spark, sf_dir), 2).changelog(), AS_OF_MS))


@query(f"SELECT {_ROW} FROM live")
def kv_store_compacted(spark, sf_dir):
    """Four appends, merged by size tiers as a whole: nothing dead is left in the one segment."""
    store = stored.appended(spark, kv_events(spark, sf_dir), 4)
    store.compact(strategy=stored.all_segments, as_of_ms=AS_OF_MS)
    store.vacuum()
    return _entry(store.changelog())


@query("SELECT 4::BIGINT AS segment_id, count(*) AS entries, (SELECT sum(25 + strlen(key) + strlen(value)) FROM live)::BIGINT AS bytes FROM live")
def kv_store_segments(spark, sf_dir):
    store = stored.appended(spark, kv_events(spark, sf_dir), 4)
    store.compact(strategy=stored.all_segments, as_of_ms=AS_OF_MS)
    return store.segments().select("segment_id", "entries", "bytes")


@query("SELECT key, seq_num, value, type::INTEGER AS type FROM (SELECT key, seq_num, CASE WHEN type = 0 THEN value ELSE '' END AS value, type FROM kv) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq_num DESC) = 1")
def kv_store_written(spark, sf_dir):
    """Puts and deletes in the order of events, numbered by the store."""
    rows = kv_events(spark, sf_dir)
    op = F.when(F.col("type") == 0, "put").otherwise("delete").alias("op")
    store = stored.fresh(spark)
    store.write(rows.select(op, "key", F.col("value").cast("string").alias("value"), F.lit(0).alias("ttl_seconds"), F.col("seq_num").alias("at")), [F.col("at")], 0)
    return shown(store.changelog().select("key", "seq_num", "value", "type"))


@query(f"SELECT {_ROW} FROM live")
def kv_log_recovery(spark, sf_dir):
    """Logs in a folder, from which an empty store is recovered."""
    folder = shared_folder(spark)
    wal.write_wal(kv_events(spark, sf_dir), folder)
    store = stored.fresh(spark)
    store.recover(folder)
    return _entry(resolve.live(store.changelog(), AS_OF_MS))


@query("SELECT count(DISTINCT segment_id) AS segments, count(*) AS entries, count(DISTINCT key) AS keys, max(seq_num) + 1 AS next_seq FROM kv")
def kv_log_files(spark, sf_dir):
    """What is read from logs in a folder."""
    folder = shared_folder(spark)
    wal.write_wal(kv_events(spark, sf_dir), folder)
    return wal.recovery_stats(wal.read_wal(spark, folder))


@query(f"SELECT segment_id, {_ROW} FROM entries")
def kv_table_folder(spark, sf_dir):
    """Table files in a folder, read again."""
    folder = shared_folder(spark)
    sst.write_tables(kv_events(spark, sf_dir), folder)
    return shown(sst.read_tables(spark, folder).select("segment_id", "key", "value", "seq_num", "type", "expires_at"))


# Encodings


@query("WITH own AS (SELECT o_orderkey AS n, o_custkey AS c FROM orders) SELECT n, c FROM own")
def kv_integers(spark, sf_dir):
    """Order keys as 8 bytes and customer keys as 4, read again."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(be_long(F.col("o_orderkey")), be_int(F.col("o_custkey"))).alias("b"))
    return rows.select(read_long(F.col("b"), F.lit(0)).alias("n"), read_int(F.col("b"), F.lit(8)).alias("c"))


@query("SELECT seq_num, type::INTEGER AS code FROM kv")
def kv_type_codes(spark, sf_dir):
    return kv_events(spark, sf_dir).select("seq_num", type_code(F.col("type")).cast("int").alias("code"))


@query(_INDEX + " SELECT coalesce(max(off), 0) AS \"offset\" FROM idx WHERE segment_id = 0 AND key <= 'user:000020:5'")
def kv_floor_offset(spark, sf_dir):
    return index.floor_offset(index.sparse_index(flush.segment_entries(kv_events(spark, sf_dir))), 0, "user:000020:5")


# Exposition

_MS = ", ".join(f"({b}::DOUBLE)" for b in COMPACTION_BUCKETS_MS)


@query(f"WITH own AS (SELECT o_orderkey::DOUBLE AS ms FROM orders), b(le) AS (VALUES {_MS}) SELECT le, (SELECT count(*) FROM own WHERE ms <= le) AS count, (SELECT sum(ms) FROM own) AS sum FROM b UNION ALL SELECT NULL, count(*), sum(ms) FROM own")
def kv_compaction_histogram(spark, sf_dir):
    """The buckets of compaction times, over whole numbers."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return metrics.histogram(orders.select(F.col("o_orderkey").cast("double").alias("ms")), "ms", COMPACTION_BUCKETS_MS)


@query("SELECT unnest(['# TYPE ' || metric || ' counter', metric || ' ' || value::VARCHAR]) AS line FROM (SELECT 'writes_total' AS metric, count(*) FILTER (type = 0) AS value FROM kv UNION ALL SELECT 'deletes_total', count(*) FILTER (type = 1) FROM kv UNION ALL SELECT 'memtable_flushes_total', count(DISTINCT segment_id) FROM kv)")
def kv_exposition(spark, sf_dir):
    return metrics.exposition(metrics.write_metrics(kv_events(spark, sf_dir)))


# Workloads


@query("WITH own AS (SELECT i FROM range(2000) AS r(i)) SELECT 'key-' || i::VARCHAR AS key, substr(sha256('0:0:' || i::VARCHAR) || sha256('0:1:' || i::VARCHAR) || sha256('0:2:' || i::VARCHAR) || sha256('0:3:' || i::VARCHAR), 1, 200) AS value, i + 1 AS seq_num, i // 40000 AS segment_id FROM own")
def kv_sequential_writes(spark, sf_dir):
    rows = workload.sequential_writes(spark, 2000)
    return rows.select("key", F.lower(F.hex("value")).alias("value"), "seq_num", "segment_id")


@query("WITH own AS (SELECT 2000::BIGINT AS writes, true AS in_space, true AS repeats) SELECT * FROM own")
def kv_random_writes(spark, sf_dir):
    """2,000 writes over 500 keys: how many, whether all keys are of the space, and whether some repeat."""
    rows = workload.random_writes(spark, 2000, 500)
    n = F.regexp_extract("key", "^key-([0-9]+)$", 1).cast("long")
    return rows.agg(F.count("*").alias("writes"), F.every((n >= 0) & (n < 500)).alias("in_space"), (F.countDistinct("key") < F.count("*")).alias("repeats"))


def _reads(name: str, make: Callable, first: int, last: int) -> None:
    @query(f"WITH own AS (SELECT i FROM range({first}, {last}) AS r(i)) SELECT 'key-' || i::VARCHAR AS key, i < 2000 AS found FROM own", name)
    def _read(spark, sf_dir):
        """Probes of a workload against 2,000 written keys."""
        return resolve.multi_get(workload.sequential_writes(spark, 2000), make(spark), 0).select("key", "found")


_reads("kv_hot_reads", workload.hot_reads, 0, 1_000)
_reads("kv_cold_reads", workload.cold_reads, 0, 100_000)


@query("WITH own AS (SELECT 1000000::BIGINT AS probes, 0::BIGINT AS found) SELECT * FROM own")
def kv_missing_reads(spark, sf_dir):
    rows = resolve.multi_get(workload.sequential_writes(spark, 2000), workload.misses(spark), 0)
    return rows.agg(F.count("*").alias("probes"), F.count_if("found").alias("found"))


@query("WITH own AS (SELECT 4000::BIGINT AS reads, 1000::BIGINT AS writes, true AS in_space) SELECT * FROM own")
def kv_mixed(spark, sf_dir):
    """Reads and writes of the mixed workload, and whether both draw from the same 10,000 keys."""
    probes, writes = workload.mixed(spark, 4000, 1000)
    both = probes.select("key", F.lit(True).alias("read")).unionByName(writes.select("key", F.lit(False).alias("read")))
    return both.agg(F.count_if("read").alias("reads"), F.count_if(~F.col("read")).alias("writes"), F.every(F.regexp_extract("key", "^key-([0-9]+)$", 1).cast("long") < 10_000).alias("in_space"))
