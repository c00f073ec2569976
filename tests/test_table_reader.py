"""Point reads from table files: blocks, cache, filters, and the walk from newest to oldest."""

import pytest
from pyspark.sql import functions as F

from keystrata import catalogue
from keystrata.operators import bloom, metrics
from keystrata.plans.fixtures import AS_OF_MS, kv_events
from keystrata.schema import CHANGELOG, DELETE, PUT
from keystrata.sources import sst
from keystrata.sources.table_reader import TableSet
from tests.conftest import SF


def folder(spark, path, entries):
    rows = [(k, bytearray(v), n, kind, expires, segment) for k, v, n, kind, expires, segment in entries]
    sst.write_tables(spark.createDataFrame(rows, CHANGELOG), str(path))
    return sorted((str(p) for p in path.glob("*.sst")), reverse=True)


def test_a_block_is_read_once(spark, tmp_path):
    files = folder(spark, tmp_path, [(f"key-{i:02d}", f"val-{i}".encode(), i, PUT, 0, 0) for i in range(20)])
    tables = TableSet(spark, files)
    assert tables.tables[0].offsets == [0, 16 * 31 + 6] or len(tables.tables[0].offsets) == 2
    for _ in range(100):
        assert tables.get("key-00", 0) == b"val-0"
    assert tables.cache.disk_reads == 1
    assert tables.get("key-16", 0) == b"val-16" and tables.cache.disk_reads == 2
    none = TableSet(spark, files, cache_blocks=0)
    assert [none.get("key-03", 0) for _ in range(2)] == [b"val-3"] * 2 and none.cache.disk_reads == 2
    one = TableSet(spark, files, cache_blocks=1)
    assert [one.get(k, 0) for k in ("key-00", "key-16", "key-00")] == [b"val-0", b"val-16", b"val-0"] and one.cache.disk_reads == 3 and len(one.cache.bytes) == 1
    assert tables.entry("a") is None and tables.entry("key-99") is None
    for t in (tables, none, one):
        t.close()


def test_newest_table_answers(spark, tmp_path):
    files = folder(spark, tmp_path, [("a", b"old", 1, PUT, 0, 0), ("b", b"x", 2, PUT, 0, 0), ("a", b"new", 3, PUT, 0, 1), ("b", b"", 4, DELETE, 0, 1), ("c", b"brief", 5, PUT, 10, 1)])
    tables = TableSet(spark, files)
    assert tables.get("a", 0) == b"new" and tables.get("b", 0) is None and tables.entry("b")[2] == DELETE
    assert tables.get("c", 10) == b"brief" and tables.get("c", 11) is None
    before = dict(tables.counters)
    assert tables.get("nothing", 0) is None
    skips = tables.counters["bloom_skips_total"] - before["bloom_skips_total"]
    assert skips + tables.counters["bloom_false_positives_total"] - before["bloom_false_positives_total"] == 2


def test_reads_equal_the_live_view(spark, tmp_path):
    from keystrata.operators import resolve

    rows = kv_events(spark, SF)
    sst.write_tables(rows, str(tmp_path))
    tables = TableSet(spark, sorted((str(p) for p in tmp_path.glob("*.sst")), reverse=True))
    live = {r.key: bytes(r.value) for r in resolve.live(rows, AS_OF_MS).collect()}
    keys = [r.key for r in rows.select("key").distinct().collect()] + [f"user:9{i:05d}:0" for i in range(50)]
    assert {k: v for k in keys if (v := tables.get(k, AS_OF_MS)) is not None} == live
    assert tables.counters["reads_total"] == len(keys)


def test_walk_counts_up_to_the_first_table_that_has_the_key(spark):
    rows = [("a", 3, False, False), ("a", 2, True, False), ("a", 1, True, True), ("a", 0, False, False), ("b", 1, False, False), ("b", 0, False, False)]
    got = {r.metric: r.value for r in metrics.read_path(spark.createDataFrame(rows, "key string, segment_id long, might_contain boolean, present boolean")).collect()}
    assert got == {"reads_total": 2, "bloom_skips_total": 3, "bloom_false_positives_total": 1}


def test_damaged_tables_raise(spark, tmp_path):
    (tmp_path / "x.sst").write_bytes(b"short")
    with pytest.raises(ValueError):
        TableSet(spark, [str(tmp_path / "x.sst")])


@pytest.mark.parametrize("block_bits, parts", [(1, 1), (3_000, 3), (1 << 28, 2)])
def test_read_counts_equal_a_row_for_each_key_and_table(spark, block_bits, parts):
    # segments of unlike sizes, beyond 32 bits of one and far apart ids; some keys are in several
    rows = [(s * 7 - 20, f"k{i * i % 997}-{i % (s + 2)}") for s in range(12) for i in range(s * 9 + 5)]
    entries = spark.createDataFrame(sorted(set(rows)), "segment_id long, key string")
    sizes = bloom.filter_sizes(entries)
    asked = entries.select("key").distinct().crossJoin(sizes.select("segment_id"))
    hits = bloom.might_contain(bloom.bloom_words(entries, sizes), sizes, asked)
    lookups = hits.join(entries.withColumn("present", F.lit(True)), ["segment_id", "key"], "left").withColumn("present", F.coalesce("present", F.lit(False)))
    want = {r.metric: r.value for r in metrics.read_path(lookups).collect()}
    got = {r.metric: r.value for r in metrics.read_rows(bloom.read_counts(entries, block_bits, parts)).collect()}
    assert got == want and want["bloom_skips_total"] > 0


def test_read_counts_of_nothing(spark):
    assert tuple(bloom.read_counts(spark.createDataFrame([], "segment_id long, key string")).head()) == (0, 0, 0)


def test_read_path_of_keys_in_the_oldest_table(spark, tmp_path):
    # 60 segments, all keys in the first and one in the others
    spark.range(60_000).selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts", "CASE WHEN id < 1000 THEN id ELSE 7 END AS user_id", "'view' AS event_type", "1.0D AS value", "'{\"k\": 1}' AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.metric: r.value for r in catalogue.kv_read_path(spark, str(tmp_path)).collect()}
    assert got["reads_total"] == 1000 and got["bloom_skips_total"] + got["bloom_false_positives_total"] == 999 * 59
