"""Every changelog query equals its SQL over the same tables; the counts that are known are met."""

import pytest

from keystrata import catalogue
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, oracle, name):
    same_rows(catalogue.QUERIES[name](spark, SF), oracle.sql(catalogue.SQL[name]))


@pytest.mark.parametrize("sf, live, full, keys, size", [("sf0.001", 110, 0, 149, 3018), ("sf0.01", 1147, 8, 488, 9899), ("sf0.1", 11403, 119, 436, 8784)])
def test_known_counts(spark, sf, live, full, keys, size):
    assert catalogue.flagship(spark, f"/root/testdata/{sf}").count() == live
    rows = catalogue.kv_flush_plan(spark, f"/root/testdata/{sf}").collect()
    last = max(rows, key=lambda r: r.flush_id)
    assert (sum(r.full for r in rows), last["keys"], last["bytes"]) == (full, keys, size)


def test_scan_keeps_only_the_range(spark):
    assert catalogue.kv_scan(spark, "/root/testdata/sf0.01").count() == 84


def test_bloom_has_no_false_negatives(spark):
    r = catalogue.kv_bloom_fpr(spark, "/root/testdata/sf0.01").head()
    assert r.false_negatives == 0 and r.within_bound


def test_log_bytes_decode_to_the_rows(spark):
    from keystrata.plans.fixtures import kv_events

    rows = catalogue.kv_wal_encode(spark, SF).collect()
    assert len(rows) == 1000 and len({r.record for r in rows}) == kv_events(spark, SF).count()


def test_entry_point_lists_every_query(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 110
