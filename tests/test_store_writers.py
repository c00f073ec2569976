"""Writers side by side, publishing, vacuum, and recovery from logs."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from keystrata.functions.codec import log_name
from keystrata.schema import CHANGELOG, DELETE, PUT
from keystrata.sources import wal
from keystrata.sources.store import ConcurrentWrite, Store


def rows(spark, *entries):
    return spark.createDataFrame([(k, bytearray(v), n, kind, 0, 0) for k, v, n, kind in entries], CHANGELOG)


def test_writers_side_by_side_all_succeed(spark, tmp_path):
    errors = []

    def write(t):
        try:
            store = Store(spark, str(tmp_path))
            for i in range(3):
                store.put(f"thread-{t}-key-{i}", f"val-{i}".encode())
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(t,)) for t in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = Store(spark, str(tmp_path))
    got = store.changelog().collect()
    assert not errors and len(got) == 12 and sorted(r.seq_num for r in got) == list(range(1, 13))
    assert store.manifest()["next_seq"] == 13 and {bytes(r.value) for r in got} == {b"val-0", b"val-1", b"val-2"}


def test_a_write_is_made_again_after_another_process(spark, tmp_path, monkeypatch):
    """A writer that publishes between another's read of the manifest and its publishing hides nothing."""
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    publish, turns = Store._publish, []

    def late(self, manifest, base):
        if self is store and not turns:
            turns.append(1)
            m = other.manifest()
            segment = other._write_segment(rows(spark, ("k", b"first", m["next_seq"], PUT)), m["next_segment"])
            del segment["last"]
            publish(other, m | {"segments": [*m["segments"], segment], "next_seq": m["next_seq"] + 1, "next_segment": m["next_segment"] + 1}, base)
        return publish(self, manifest, base)

    monkeypatch.setattr(Store, "_publish", late)
    store.put("k", b"second")
    assert turns and store.get("k") == b"second" and sorted(r.seq_num for r in store.changelog().collect()) == [1, 2]
    # the segment of the first attempt is gone
    assert store.vacuum(0) == 0


def test_a_manifest_is_published_once_and_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.put("a", b"1")
    m = store.manifest()
    with pytest.raises(ConcurrentWrite):
        store._publish(m | {"next_seq": 99}, 0)
    assert store.manifest()["next_seq"] == 2
    # what a writer left behind as it died is no version
    (tmp_path / "manifests" / ".left.tmp").write_text("")
    assert store.version() == 1 and Store(spark, str(tmp_path)).get("a") == b"1"
    names = sorted(p.name for p in (tmp_path / "manifests").iterdir() if not p.name.endswith(".crc"))
    assert names == [".left.tmp", "00000000000000000001.json"]


def test_vacuum_spares_writers_at_work(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for v in (b"1", b"2", b"3", b"4"):
        store.put("a", v)
    segment = store._write_segment(rows(spark, ("b", b"x", 9, PUT)), 9)  # not published yet
    assert store.compact() == 1
    assert store.vacuum() == 4 and (tmp_path / segment["path"]).exists() and store.get("a") == b"4"
    time.sleep(0.01)
    assert store.vacuum(orphan_ms=0) == 1 and not (tmp_path / segment["path"]).exists()


def test_recovery_from_logs(spark, tmp_path):
    logs = str(tmp_path / "logs")
    log = wal.LogWriter(spark, logs, 0)
    for i in range(50):
        log.append(f"key-{i}", f"value-{i}".encode(), PUT, i + 1)
    for i in range(25):
        log.append(f"key-{i}", b"", DELETE, 51 + i)
    log.close()
    second = wal.LogWriter(spark, logs, 1)
    second.append("brief", b"x", PUT, 76, expires_at=1)
    second.append("torn", b"y" * 100, PUT, 77)
    second.close()
    torn = tmp_path / "logs" / "wal-00000000000000000001.log"
    torn.write_bytes(torn.read_bytes()[:-30])
    for p in (tmp_path / "logs").glob(".*.crc"):
        p.unlink()
    store = Store(spark, str(tmp_path / "store"))
    stats = store.recover(logs)
    assert stats == {"segments": 2, "entries": 76, "keys": 51, "next_seq": 77} and store.manifest()["next_seq"] == 77
    assert store.get("key-30") == b"value-30" and store.get("key-3") is None and store.get("brief", as_of_ms=2) is None
    store.put("key-30", b"newer")
    store.recover(logs)  # once more: what is newer stays in front
    assert store.get("key-30") == b"newer" and store.scan("a", "z").count() == 25


def test_appended_records_equal_the_encoded_ones(spark, tmp_path):
    data = rows(spark, ("k", b"v", 1, PUT), ("k", b"", 2, DELETE), ("é🙂", b"\x00\xff", 3, PUT))
    want = {r.seq_num: bytes(r.record) for r in wal.wal_encode(data).collect()}
    assert {n: wal.encode_record(k, v, kind, n, 0) for k, v, n, kind in (("k", b"v", 1, PUT), ("k", b"", 2, DELETE), ("é🙂", b"\x00\xff", 3, PUT))} == want
    [file] = wal.wal_files(data).collect()
    assert bytes(file.content) == want[1] + want[2] + want[3] and file["name"] == wal.log_file_name(0) == spark.range(1).select(log_name(F.col("id"))).head()[0]
