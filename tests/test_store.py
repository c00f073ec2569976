"""The store end to end, streams into it, the workloads and the HTTP front end."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from keystrata import workload
from keystrata.operators import resolve
from keystrata.schema import CHANGELOG
from keystrata.server import Auth, parameters, serve
from keystrata.sources.store import ConcurrentWrite, Store
from keystrata.streaming import ingest


def test_put_get_delete_reopen(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.get("hello") is None and store.scan("a", "z").count() == 0
    store.put("hello", b"world")
    store.put("key", b"original")
    store.put("key", b"updated")
    store.put("gone", None)
    store.delete("gone")
    store.put("brief", b"x", ttl_seconds=1)
    again = Store(spark, str(tmp_path))
    assert (again.get("hello"), again.get("key"), again.get("gone")) == (b"world", b"updated", None)
    assert again.get("brief", as_of_ms=1) == b"x" and again.get("brief", as_of_ms=1 << 60) is None
    with pytest.raises(ValueError):
        store.put("", b"")


def test_batches_compaction_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for v in range(5):
        ops = spark.range(200).select(F.lit("put").alias("op"), F.concat(F.lit("filler-"), F.col("id")).alias("key"), F.lit(f"v{v}").alias("value"), F.lit(0).alias("ttl_seconds"), "id")
        ops = ops.unionByName(spark.createDataFrame([("delete" if v == 4 else "put", "key-A", f"version-{v}", 0, 1000)], "op string, key string, value string, ttl_seconds int, id long"))
        store.write(ops, [F.col("id")], now_ms=0)
    before = {r["key"]: bytes(r["value"]) for r in store.scan("a", "z").collect()}
    assert len(before) == 200 and before["filler-7"] == b"v4" and store.get("key-A") is None
    assert store.segments().count() == 5 and store.manifest()["next_seq"] == 5 * 201 + 1
    older = store.manifest()["version"]
    assert store.compact(lambda s: s.where("segment_id in (0, 1)").select("segment_id", F.lit(1).alias("group_id"))) == 1
    assert {r["key"]: bytes(r["value"]) for r in store.scan("a", "z").collect()} == before
    assert store.compact(lambda s: s.select("segment_id", F.lit(1).alias("group_id"))) == 1
    assert {r["key"]: bytes(r["value"]) for r in store.scan("a", "z").collect()} == before
    assert store.changelog().where("key = 'key-A'").count() == 0  # a merge of all drops the tombstone
    assert store.changelog(older).where("key = 'key-A'").count() == 5  # an older version still reads
    assert store.vacuum() > 0 and store.get("filler-7") == b"v4" and store.compact() == 0
    assert "EqualTo(key" in store.changelog().where("key = 'x'")._jdf.queryExecution().toString()


def test_only_one_writer_publishes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.put("a", b"1")
    m = store.manifest()
    store.put("b", b"2")
    with pytest.raises(ConcurrentWrite):
        store._publish(m, m["version"])


def test_stream_ingest_and_stateful_view(spark, tmp_path):
    land = str(tmp_path / "land")
    for n, rows in enumerate([[("a", b"1", 1, 0, 0, 0), ("b", b"2", 2, 0, 0, 0)], [("a", b"3", 4, 0, 0, 0)], [("a", b"late", 3, 0, 0, 0), ("b", b"", 5, 1, 0, 0)]]):
        spark.createDataFrame([(k, bytearray(v), *r) for k, v, *r in rows], CHANGELOG).coalesce(1).write.mode("append").parquet(land)
    store = Store(spark, str(tmp_path / "store"))
    ingest.ingest(ingest.changelog_stream(spark, land, 1), store, str(tmp_path / "cp"), compact_every=2).awaitTermination(120)
    assert store.get("a") == b"3" and store.get("b") is None and store.segments().count() == 3
    updates = ingest.live_updates(ingest.changelog_stream(spark, land, 1)).writeStream.outputMode("update").format("memory").queryName("updates").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    updates.awaitTermination(120)
    got = {r.key: (r.seq_num, r.type) for r in ingest.latest_of(spark.table("updates")).collect()}
    assert got == {"a": (4, 0), "b": (5, 1)}


def test_workloads(spark):
    writes = workload.sequential_writes(spark, 2000)
    row = writes.where("key = 'key-7'").head()
    assert len(row.value) == 100 and row.seq_num == 8 and writes.schema.fieldNames() == CHANGELOG.fieldNames()
    assert workload.random_writes(spark, 500, 50).select("key").distinct().count() <= 50
    assert resolve.multi_get(writes, workload.hot_reads(spark), 0).where("found").count() == 1000
    assert resolve.missing(writes, workload.cold_reads(spark), 0).count() == 98_000
    assert workload.misses(spark).count() == 1_000_000
    probes, more = workload.mixed(spark, 400, 100)
    assert probes.count() == 400 and more.count() == 100


def test_http(spark, tmp_path):
    auth = Auth(str(tmp_path))
    server = serve(Store(spark, str(tmp_path / "data")), auth, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, key=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", headers={"Authorization": f"Bearer {key or auth.key}"})
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert call("/put?key=a&value=x%09y")[0] == 200
    assert json.loads(call("/get?key=a")[1]) == {"key": "a", "value": "x\ty"}
    assert json.loads(call("/put?key=b&value=2&ttl=100")[1]) == {"status": "ok", "key": "b", "ttl_seconds": 100}
    assert [x["key"] for x in json.loads(call("/scan?from=a&to=z")[1])] == ["a", "b"]
    assert call("/delete?key=a")[0] == 200 and call("/get?key=a")[0] == 404
    assert call("/put?key=&value=1")[0] == 400 and call("/put?key=a&value=1&ttl=x")[0] == 400 and call("/scan?from=z&to=a")[0] == 400
    assert call("/get?key=b", "wrong")[0] == 401
    text = call("/metrics", "none")[1]
    assert 'read_latency_ms_bucket{le="+Inf"} 2' in text and "compaction_duration_ms_count 0" in text and "memtable_flushes_total 3" in text
    assert "writes_total 2" in text and call("/stats")[0] == 200 and "<form" in call("/ui")[1] and "endpoints" in call("/other")[1]
    old = auth.key
    new = json.loads(call("/auth/rotate")[1])["key"]
    assert len(new) == 64 and call("/stats", old)[0] == 401 and call("/stats", new)[0] == 200
    server.shutdown()


def test_parameters():
    assert parameters("a=1&b&=x&a=2+3&c=%26") == {"a": "2 3", "c": "&"}


def test_recovery_sends_no_log_to_the_driver(spark, tmp_path, monkeypatch):
    from keystrata.plans.fixtures import kv_events
    from keystrata.sources import wal
    from tests.conftest import SF

    rows = kv_events(spark, SF)

    def refuse(*_):
        raise AssertionError("rows go to the driver")

    monkeypatch.setattr(type(rows), "toLocalIterator", refuse)
    wal.write_wal(rows, f"{tmp_path}/logs")
    stats = Store(spark, f"{tmp_path}/store").recover(f"{tmp_path}/logs")
    monkeypatch.undo()
    keys = rows.select("key").distinct().count()
    assert (stats["entries"], stats["keys"]) == (1000, keys) and Store(spark, f"{tmp_path}/store").changelog().count() == keys
