"""Semantics of the changelog operators on small inputs: versions, TTL, ranges, files, filters, caches."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keystrata.functions import codec
from keystrata.functions.murmur import murmur3_128, probe_positions
from keystrata.operators import bloom, cache, compaction, flush, index, metrics, resolve
from keystrata.operators.changelog import assign_sequence, conform, deletes, next_sequence, puts
from keystrata.schema import CHANGELOG
from keystrata.sources import sst, wal


def log(spark, *rows):
    """(key, value, seq, type, expires_at, segment) with trailing parts left out."""
    full = [(k, v.encode() if isinstance(v, str) else v, *rest, *(0, 0, 0)[len(rest) - 1 :]) for k, v, *rest in rows]
    return spark.createDataFrame([(k, bytearray(v), s, t, e, g) for k, v, s, t, e, g in full], CHANGELOG)


def values(df):
    return {r["key"]: bytes(r["value"]).decode() for r in df.collect()}


def test_newest_version_decides_before_filters(spark):
    rows = log(spark, ("a", "old", 1), ("a", "", 2, 1), ("b", "old", 3), ("b", "brief", 4, 0, 10), ("c", "x", 5, 1), ("c", "back", 6))
    assert values(resolve.live(rows, 11)) == {"c": "back"}
    assert values(resolve.live(rows, 10)) == {"b": "brief", "c": "back"}
    assert values(resolve.live(rows, 9)) == {"b": "brief", "c": "back"}
    assert values(resolve.live(rows, 11, as_of_seq=1)) == {"a": "old"}


def test_expiry_of_zero_or_less_is_never(spark):
    now = F.lit(1000)
    df = spark.createDataFrame([(2,), (0,), (-5,), (None,)], "ttl long")
    assert [r[0] for r in df.select(codec.absolute_expiry(F.col("ttl"), now)).collect()] == [3000, 0, 0, 0]
    with pytest.raises(PySparkException):
        df.select(codec.absolute_expiry(F.lit(1 << 62), now)).collect()


def test_higher_sequence_wins_whatever_the_segment(spark):
    rows = log(spark, ("k", "new", 9, 0, 0, 1), ("k", "merged later", 5, 0, 0, 7))
    assert values(resolve.get(rows, "k", 0)) == {"k": "new"}
    assert values(resolve.scan(rows, "k", "k", 0)) == {"k": "new"}
    tie = log(spark, ("k", "low", 5, 0, 0, 1), ("k", "high", 5, 0, 0, 2))
    assert values(resolve.latest(tie)) == {"k": "high"}


def test_scan_bounds_and_order(spark):
    rows = log(spark, ("b", "2", 1), ("a", "1", 2), ("c", "3", 3), ("e", "5", 4), ("d", "4", 5), ("f", "6", 6))
    assert [r["key"] for r in resolve.scan(rows, "a", "e", 0).collect()] == list("abcde")
    assert [r["key"] for r in resolve.scan(rows, "c", "c", 0).collect()] == ["c"]
    assert resolve.scan(rows, "x", "y", 0).count() == 0
    with pytest.raises(ValueError):
        resolve.scan(rows, "b", "a", 0)


def test_key_orders(spark):
    rows = log(spark, ("\U0001f600", "", 1), ("", "", 2))
    assert [r["key"] for r in rows.orderBy("key").collect()] == ["", "\U0001f600"]
    assert [r["key"] for r in rows.orderBy(resolve.utf16_order()).collect()] == ["\U0001f600", ""]


def test_multi_get_and_missing(spark):
    rows = log(spark, ("a", "1", 1), ("b", "2", 2), ("b", "", 3, 1))
    probes = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "key string")
    assert sorted((r.key, r.found) for r in resolve.multi_get(rows, probes, 0).collect()) == [("a", True), ("a", True), ("b", False), ("z", False)]
    assert sorted(r.key for r in resolve.missing(rows, probes, 0).collect()) == ["b", "z"]


def test_history_numbers_versions_from_the_newest(spark):
    rows = log(spark, ("a", "1", 1), ("a", "2", 2), ("b", "3", 3))
    assert [(r.seq_num, r.version) for r in resolve.history(rows, "a").orderBy("version").collect()] == [(2, 1), (1, 2)]


def test_writes_are_validated(spark):
    df = spark.createDataFrame([("k", None)], "k string, v string")
    assert values(puts(df, F.col("k"), F.col("v"), F.lit(1))) == {"k": ""}
    row = deletes(df, F.col("k"), F.lit(2)).head()
    assert (row.type, bytes(row.value), row.expires_at) == (1, b"", 0)
    for bad in ("", None):
        with pytest.raises(PySparkException):
            puts(spark.createDataFrame([(bad,)], "k string"), F.col("k"), F.lit("v"), F.lit(1)).collect()
    with pytest.raises(PySparkException):
        conform(spark.createDataFrame([("k", b"", 1, 2, 0, 0)], "key string, value binary, seq_num long, type int, expires_at long, segment_id long")).collect()
    with pytest.raises(ValueError):
        puts(df, F.col("k"), F.col("v"), F.lit(1), ttl_seconds=F.lit(1))


def test_sequence_numbers_follow_the_order(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("at")).repartition(7)
    rows = assign_sequence(df, [F.col("at")], 5).collect()
    assert sorted((r.at, r.seq_num) for r in rows) == [(i, i + 6) for i in range(1000)]
    assert next_sequence(log(spark, ("a", "", 41))) == 42
    assert next_sequence(spark.createDataFrame([], CHANGELOG)) == 1


def test_known_bytes(spark):
    rows = log(spark, ("k", "v", 1), ("k", "", 2, 1))
    got = [(r.e.hex(), r.r.hex()) for r in rows.select("seq_num", codec.entry_bytes().alias("e"), codec.log_record().alias("r")).orderBy("seq_num").collect()]
    assert got == [
        ("000000016b00000001760000000000000000010000000000000000", "000000016b00000001760000000000000000010000000000000000eda1e4f1"),
        ("000000016b000000000100000000000000020000000000000000", "000000016b000000000100000000000000020000000000000000" + "5f258d67"),
    ]
    back = rows.select(codec.entry_bytes().alias("e")).select(codec.read_int(F.col("e"), F.lit(0)).alias("n")).collect()
    assert {r.n for r in back} == {1}


def test_known_hashes_and_positions():
    assert [hex(int(h[0])) for h in murmur3_128([b"hello"], seed=0)] == ["0xcbd8a7b341bd9b02", "0x5b1e906a48ae1d19"]
    at = probe_positions([b"alpha", b"key-0", b"existing-12345678"], np.full(3, 1400))
    assert at.tolist() == [[353, 1337, 929, 513, 97, 1089, 673], [841, 625, 409, 193, 1377, 1161, 945], [1099, 1220, 1349, 70, 199, 320, 449]]


def test_hash_of_keys_of_all_lengths_is_the_same_alone_and_together():
    keys = [bytes(range(n)) for n in range(70)]
    together = np.stack(murmur3_128(keys), 1)
    assert all((together[i] == np.stack(murmur3_128([k]), 1)[0]).all() for i, k in enumerate(keys))


def test_bloom_round_trip_and_rate(spark):
    keys = spark.range(20_000).select((F.col("id") % 2).alias("segment_id"), F.concat(F.lit("existing-"), F.col("id")).alias("key"))
    sizes = bloom.filter_sizes(keys)
    words, sizes = bloom.restored(bloom.serialized(bloom.bloom_words(keys, sizes), sizes))
    probes = keys.unionByName(spark.range(20_000).select((F.col("id") % 2).alias("segment_id"), F.concat(F.lit("nonexistent-"), F.col("id")).alias("key")))
    r = bloom.false_positives(words, sizes, probes, keys).head()
    assert (r.probes, r.present, r.false_negatives) == (40_000, 20_000, 0) and r.false_positives < 200


def test_tiers_and_groups(spark):
    sizes = spark.createDataFrame([(i, s) for i, s in enumerate([0, 1, 3, 64, 100, 255, 65, 4 << 20])], "segment_id long, bytes long")
    assert [r.tier for r in compaction.size_tiers(sizes).orderBy("segment_id").collect()] == [0, 0, 0, 3, 3, 3, 3, 11]
    assert sorted((r.segment_id, r.group_id) for r in compaction.select_merge_groups(sizes).collect()) == [(3, 3), (4, 3), (5, 3), (6, 3)]


def test_partial_merge_keeps_what_still_hides(spark):
    old, new = log(spark, ("a", "old", 1), ("e", "old", 2)), log(spark, ("a", "", 3, 1, 0, 1), ("e", "x", 4, 0, 5, 1))
    assert compaction.merge(new, False, 100).count() == 2
    assert resolve.live(old.unionByName(compaction.merge(new, False, 100)), 100).count() == 0
    assert compaction.merge(old.unionByName(new), True, 100).count() == 0
    r = compaction.compaction_stats(old.unionByName(new), True, 100).head()
    assert tuple(r) == (4, 0, 2, 1, 1)
    r = compaction.compaction_stats(old.unionByName(new), False, 100).head()
    assert tuple(r) == (4, 2, 2, 0, 0)


def test_final_merge_leaves_the_live_view(spark):
    from keystrata.plans.fixtures import AS_OF_MS, kv_events

    rows = kv_events(spark, "/root/testdata/sf0.001")
    before = values(resolve.live(rows, AS_OF_MS))
    assert values(resolve.live(compaction.merge(rows, True, AS_OF_MS), AS_OF_MS)) == before
    split = rows.withColumn("segment_id", F.col("seq_num") % 13)
    assert values(resolve.live(flush.segment_entries(split), AS_OF_MS)) == before


def test_index_blocks(spark):
    rows = log(spark, *((f"key-{i:02d}", f"val-{i}", i + 1) for i in range(20)))
    idx = index.sparse_index(rows)
    assert [r.key for r in idx.orderBy("key").collect()] == ["key-00", "key-16"]
    second = sum(25 + 6 + len(f"val-{i}") for i in range(16))
    probes = spark.createDataFrame([(0, "a"), (0, "key-03"), (0, "key-16"), (0, "zzz"), (9, "q")], "segment_id long, key string")
    got = {r.key: (r.start, r.end) for r in index.block_lookup(idx, probes).collect()}
    assert got == {"a": (0, second), "key-03": (0, second), "key-16": (second, None), "zzz": (second, None), "q": (0, None)}
    assert index.floor_offset(idx, 0, "key-17").head()[0] == second and index.floor_offset(idx, 0, "a").head()[0] == 0
    ends = index.block_ranges(idx, spark.createDataFrame([(0, 999)], "segment_id long, bytes long")).orderBy("block_id").collect()
    assert [(r.start, r.end) for r in ends] == [(0, second), (second, 999)]


def test_cache_counts_disk_reads(spark):
    trace = spark.createDataFrame([(i, "b0") for i in range(100)] + [(100, "b1")], "at long, block string")
    assert cache.cache_stats(cache.cache_trace(trace)).head()["disk_reads"] == 2
    assert cache.cache_stats(cache.cache_trace(trace, 0)).head()["disk_reads"] == 101
    thrash = spark.createDataFrame([(i, f"b{i % 3}") for i in range(30)], "at long, block string")
    assert cache.cache_stats(cache.cache_trace(thrash, 2)).head()["disk_reads"] == 30
    assert cache.cache_stats(cache.cache_trace(thrash, 3)).head()["disk_reads"] == 3
    lru = cache.LRU(2)
    for b in "abac":
        lru.access(b)
    assert lru.contains("a") and not lru.contains("b") and len(lru) == 2
    lru.invalidate("a")
    assert not lru.contains("a")


def test_log_recovery_rules(spark, tmp_path):
    rows = log(spark, *((f"key-{i}", f"original-{i}", i, 0, 0, i // 50) for i in range(100)), *((f"key-{i}", f"updated-{i}", 100 + i, 0, 0, 2) for i in range(50)))
    wal.write_wal(rows, str(tmp_path))
    back = wal.read_wal(spark, str(tmp_path))
    got = values(wal.wal_replay(back))
    assert len(got) == 100 and all(got[f"key-{i}"] == (f"updated-{i}" if i < 50 else f"original-{i}") for i in range(100))
    assert tuple(wal.recovery_stats(back).head()) == (3, 150, 100, 150)
    names = sorted(p.name for p in tmp_path.glob("wal-*"))
    assert names == [f"wal-{i:020d}.log" for i in range(3)]
    files = {p.name: p.read_bytes() for p in tmp_path.glob("wal-*.log")}
    whole = len(list(wal.decode_log(files[names[0]])))
    assert whole == 50 and len(list(wal.decode_log(files[names[0]][:-3]))) == 49
    broken = bytearray(files[names[0]])
    broken[len(broken) // 2] ^= 1
    assert 0 < len(list(wal.decode_log(bytes(broken)))) < 50
    # a damaged log ends at the damage; the logs after it are read
    damaged = spark.createDataFrame([(names[0], broken), (names[1], bytearray(files[names[1]]))], "name string, content binary")
    kept = wal.wal_decode(damaged).groupBy("segment_id").count().collect()
    assert {r.segment_id: r["count"] for r in kept}[1] == 50
    assert list(wal.decode_log(b"")) == []


def test_unknown_type_in_a_sound_record_is_an_error():
    import struct
    from zlib import crc32

    body = struct.pack(">i1si0sbqq", 1, b"k", 0, b"", 7, 1, 0)
    with pytest.raises(ValueError):
        list(wal.decode_log(body + struct.pack(">I", crc32(body))))


def test_table_files_round_trip(spark, tmp_path):
    rows = log(spark, *((f"k{i:03d}", "v" * (i % 7), i + 1, i % 2, 0, i % 3) for i in range(100)))
    sst.write_tables(rows, str(tmp_path))
    back = sst.read_tables(spark, str(tmp_path))
    as_set = lambda df: {(r.key, bytes(r.value), r.seq_num, r.type, r.expires_at, r.segment_id) for r in df.collect()}
    assert as_set(back) == as_set(rows)
    parsed = sst.parse_table(next(tmp_path.glob("*.sst")).read_bytes())
    assert parsed["bloom_bits"] == max(14 * len(parsed["entries"]), 64) and len(parsed["index"]) == -(-len(parsed["entries"]) // 16)


def test_metrics_and_text(spark):
    rows = log(spark, ("a", "", 1), ("a", "", 2, 1), ("b", "", 3, 0, 0, 1))
    got = {r.metric: r.value for r in metrics.write_metrics(rows).collect()}
    assert got == {"writes_total": 2, "deletes_total": 1, "memtable_flushes_total": 2}
    h = metrics.histogram(spark.createDataFrame([(0.1,), (0.7,), (200.0,), (None,)], "ms double"), "ms")
    assert [r["count"] for r in h.orderBy(F.col("le").asc_nulls_last()).collect()] == [1, 1, 2, 2, 2, 2, 2, 3]
    lines = [r.line for r in metrics.histogram_exposition(h, "read_latency_ms").collect()]
    assert 'read_latency_ms_bucket{le="+Inf"} 3' in lines and "read_latency_ms_count 3" in lines
    assert "writes_total 2" in [r.line for r in metrics.exposition(metrics.write_metrics(rows)).collect()]


@pytest.mark.parametrize("shards", [1, 3])
def test_flush_plan_in_steps(spark, shards):
    # buffers of a few writes, of many, and one that never fills: cuts lie before, in and behind steps' edges
    rows = log(spark, *((f"key-{i * i % 23}", "x" * (i * 7 % 31), 3 * i, 0, 0, 0) for i in range(400)))
    for threshold in (40, 150, 450, 1 << 20):
        want = sorted(map(tuple, flush.plan_flush(rows, threshold, shards).collect()))
        assert sorted(map(tuple, flush.plan_flush(rows, threshold, shards, step_rows=37).collect())) == want and len(want) == 400
    by_hand, net, sizes, n = [], 0, {}, 0
    for r in sorted(rows.collect(), key=lambda r: r.seq_num):
        size = len(r.key) + len(r.value)
        net, sizes = net + size - sizes.get(r.key, 0), sizes | {r.key: size}
        by_hand.append((n, r.seq_num, net))
        if net >= 150:
            net, sizes, n = 0, {}, n + 1
    if shards == 1:
        assert [(r.flush_id, r.seq_num, r.net_bytes) for r in flush.plan_flush(rows, 150, step_rows=50).orderBy("seq_num").collect()] == by_hand


def test_logs_are_not_sent_to_the_driver(spark, tmp_path, monkeypatch):
    rows = log(spark, *((f"key-{i}", "v" * (i % 50), i, 0, 0, i // 50) for i in range(300)))
    want = {r["name"]: bytes(r["content"]) for r in wal.wal_files(rows).collect()}
    writer = wal.LogWriter(spark, f"{tmp_path}/a b", 2)  # its file has a checksum beside it
    writer.append("old", b"", 0, 1)
    writer.close()

    def refuse(*_):
        raise AssertionError("rows go to the driver")

    for name in ("collect", "toLocalIterator", "toArrow", "toPandas"):
        monkeypatch.setattr(type(rows), name, refuse)
    for path in (f"{tmp_path}/a b", f"file://{tmp_path}/c"):
        wal.write_wal(rows, path)
    wal.write_wal(rows.where("false"), f"{tmp_path}/none")
    monkeypatch.undo()
    for folder in ("a b", "c"):
        assert {p.name: p.read_bytes() for p in (tmp_path / folder).iterdir()} == want and len(want) == 6
        assert wal.read_wal(spark, f"{tmp_path}/{folder}").count() == 300
    assert wal.read_wal(spark, f"{tmp_path}/none").count() == 0


def test_tables_are_not_sent_to_the_driver(spark, tmp_path, monkeypatch):
    rows = log(spark, *((f"key-{i % 70}", "v" * (i % 50), i, i % 2, 0, i // 50) for i in range(300)))
    want = {f"sstable-{r['segment_id']:020d}.sst": bytes(r["content"]) for r in sst.table_files(rows).collect()}

    def refuse(*_):
        raise AssertionError("rows go to the driver")

    for name in ("collect", "toLocalIterator", "toArrow", "toPandas"):
        monkeypatch.setattr(type(rows), name, refuse)
    sst.write_tables(rows, f"{tmp_path}/t")
    sst.write_tables(rows, f"{tmp_path}/t")
    monkeypatch.undo()
    assert {p.name: p.read_bytes() for p in (tmp_path / "t").iterdir()} == want and len(want) == 6


def _traced(rows, capacity):
    out, caches = [], {}
    for name, at, block in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        lru = caches.setdefault(name, cache.LRU(capacity))
        out.append((name, at, block, lru.access(block)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("capacity", [0, 1, 3, 9])
def test_cache_trace_in_steps(spark, capacity):
    # caches with all, few and no accesses in a step, one without a name, and equal accesses
    rows = [(("a", "b", None)[i % 3 if i < 90 else 0], i * i % 150, f"b{i * 7 % 11}") for i in range(200)] + [("a", 20, "b1")] * 3
    df = spark.createDataFrame(rows, "cache string, at long, block string")
    got = cache.cache_trace(df, capacity, "cache", step_rows=23).collect()
    assert sorted(map(tuple, got), key=repr) == _traced(rows, capacity)


def test_cache_with_room_for_all_keeps_nothing_in_a_task(spark, monkeypatch):
    rows = [(("a", "b", None)[i % 3], i * i % 150, f"b{i * 7 % 11}") for i in range(200)] + [("a", 20, "b1")] * 3
    df = spark.createDataFrame(rows, "cache string, at long, block string").repartition(7)

    def refuse(*_):
        raise AssertionError("a fold over all accesses")

    monkeypatch.setattr(cache, "fold_in_order", refuse)
    for capacity in (203, 1 << 40):
        assert sorted(map(tuple, cache.cache_trace(df, capacity, "cache").collect()), key=repr) == _traced(rows, capacity)
    monkeypatch.undo()
    assert sorted(map(tuple, cache.cache_trace(df, 202, "cache").collect()), key=repr) == _traced(rows, 202)
