"""Operational counters and histograms, and their text exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.schema import DELETE, LATENCY_BUCKETS_MS, PUT


def write_metrics(changelog: DataFrame) -> DataFrame:
    """(metric, value): puts, deletes and segments of a changelog, in one pass."""
    one = changelog.agg(F.count_if(F.col("type") == PUT).alias("writes_total"), F.count_if(F.col("type") == DELETE).alias("deletes_total"), F.countDistinct("segment_id").alias("memtable_flushes_total"))
    return one.select(F.expr("stack(3, 'writes_total', writes_total, 'deletes_total', deletes_total, 'memtable_flushes_total', memtable_flushes_total) AS (metric, value)"))


def read_metrics(lookups: DataFrame) -> DataFrame:
    """(metric, value) of lookups (key, segment_id, might_contain, present), a row per table asked.

    Reads are distinct keys; a skip is a table ruled out by its filter; a false positive is a table
    that the filter let through without the key.
    """
    return read_rows(lookups.agg(F.countDistinct("key").alias("reads"), F.count_if(~F.col("might_contain")).alias("skips"), F.count_if(F.col("might_contain") & ~F.col("present")).alias("false_positives")))


def read_rows(one: DataFrame) -> DataFrame:
    """(metric, value) of one row (reads, skips, false_positives)."""
    return one.select(F.expr("stack(3, 'reads_total', reads, 'bloom_skips_total', skips, 'bloom_false_positives_total', false_positives) AS (metric, value)"))


def read_path(lookups: DataFrame) -> DataFrame:
    """(metric, value) of lookups (key, segment_id, might_contain, present) of keys in all tables, as
    reads go: from the newest table on, up to the first that has the key."""
    hit = lookups.where("might_contain AND present").groupBy("key").agg(F.max("segment_id").alias("_hit"))
    asked = lookups.join(hit, "key", "left").where(F.col("_hit").isNull() | (F.col("segment_id") >= F.col("_hit")))
    return read_metrics(asked.select("key", "segment_id", "might_contain", "present"))


def histogram(df: DataFrame, value_col: str, buckets: tuple[float, ...] = LATENCY_BUCKETS_MS) -> DataFrame:
    """(le, count, sum): cumulative buckets; le is null for the bucket of all. Nulls are not observed."""
    v = F.col(value_col)
    one = df.where(v.isNotNull()).agg(*(F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(buckets)), F.count("*").alias("n"), F.coalesce(F.sum(v.cast("double")), F.lit(0.0)).alias("total"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(buckets)), F.struct(F.lit(None).cast("double").alias("le"), F.col("n").alias("count")))
    return one.select(F.explode(rows).alias("x"), "total").select("x.le", "x.count", F.col("total").alias("sum"))


def exposition(counters: DataFrame) -> DataFrame:
    """(line): counters (metric, value) as text lines, each under its type line."""
    return counters.select(F.explode(F.array(F.concat(F.lit("# TYPE "), "metric", F.lit(" counter")), F.concat_ws(" ", "metric", F.col("value").cast("string")))).alias("line"))


def histogram_exposition(rows: DataFrame, name: str) -> DataFrame:
    """(line): a histogram of :func:`histogram` as text lines."""
    le = F.coalesce(F.col("le").cast("string"), F.lit("+Inf"))
    bucket = F.concat(F.lit(f'{name}_bucket{{le="'), le, F.lit('"} '), F.col("count").cast("string"))
    ends = F.when(F.col("le").isNull(), F.array(bucket, F.concat(F.lit(f"{name}_sum "), F.col("sum").cast("string")), F.concat(F.lit(f"{name}_count "), F.col("count").cast("string")))).otherwise(F.array(bucket))
    return rows.select(F.explode(ends).alias("line"))


class Observed:
    """A histogram with cumulative buckets, kept as requests are served."""

    def __init__(self, name: str, buckets: tuple[float, ...]):
        self.name, self.buckets = name, buckets
        self.counts, self.total, self.n = [0] * len(buckets), 0.0, 0

    def add(self, value: float) -> None:
        self.counts = [c + (value <= b) for c, b in zip(self.counts, self.buckets, strict=True)]
        self.total, self.n = self.total + value, self.n + 1

    def text(self) -> str:
        rows = [f'{self.name}_bucket{{le="{b}"}} {c}' for b, c in zip((*self.buckets, "+Inf"), (*self.counts, self.n), strict=True)]
        return "\n".join([f"# TYPE {self.name} histogram", *rows, f"{self.name}_sum {self.total}", f"{self.name}_count {self.n}", ""])
