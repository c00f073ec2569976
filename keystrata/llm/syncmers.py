"""Document fingerprints from closed syncmers, and the likeness of two fingerprints.

A closed syncmer is a k-mer of code points whose smallest s-mer is its first or its last. Whether a
k-mer is one depends on the k-mer alone, so an edit moves no anchor outside its own k-mers. A
fingerprint has all anchors with their positions, in text order; two fingerprints are matched along
the longest chain of common anchors in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import table

K, S = 20, 8
#: Texts of fewer code points have k-mers of SHORT_K by s-mers of SHORT_S. From K + K - S - 1 on, any
#: text holds a closed syncmer.
SHORT, SHORT_K, SHORT_S = 64, 5, 2
#: Anchors of a sketch, for callers of :func:`fingerprint` that ask for one. A likeness of sketches is an
#: estimate from about as many: at one half its standard deviation is 0.06, and a passage shared by texts
#: with many more anchors may have none kept. The query has none of it.
KEEP = 64
#: Characters of rows in a batch, from which on it is passed on.
BATCH = 1 << 22
_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = {1: _B}
with np.errstate(over="ignore"):
    for _n in (2, 4, 8):
        _powers[_n] = _powers[_n // 2] * _powers[_n // 2]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _powers_of(n: int) -> np.ndarray:
    return np.array([pow(int(_B), n - 1 - i, 1 << 64) for i in range(n)], np.uint64)


def short_anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closed syncmers of a text of few code points, else its least k-mer."""
    windows = lambda n: (np.lib.stride_tricks.sliding_window_view(codes + np.uint64(1), n) * _powers_of(n)).sum(1, dtype=np.uint64)
    k = min(SHORT_K, len(codes))
    whole = _mix(windows(k))
    if len(codes) < SHORT_K:
        return whole ^ np.uint64(len(codes)), np.zeros(1, np.int64)
    parts = np.lib.stride_tricks.sliding_window_view(_mix(windows(SHORT_S)), k - SHORT_S + 1)
    low = parts.min(1)
    at = np.nonzero((low == parts[:, 0]) | (low == parts[:, -1]))[0]
    if not len(at):
        at = np.array([whole.argmin()])
    return whole[at], at


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a text's closed syncmers; the empty text has none, any other one at least."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(codes) < SHORT:
        return short_anchors(codes)
    h = codes + np.uint64(1)
    for n in (1, 2, 4):  # a polynomial over 1, 2, 4, then S = 8 code points
        h = h[:-n] * _powers[n] + h[n:]
    h = _mix(h)
    w = K - S + 1
    low = h
    for n in (1, 2, 4):
        low = np.minimum(low[:-n], low[n:])
    low = np.minimum(low[: len(h) - w + 1], low[w - 8 : w - 8 + len(h) - w + 1])
    at = np.nonzero((low == h[: len(low)]) | (low == h[w - 1 :]))[0]
    # s-mers at 0, 8 and 12 cover all 20 code points
    return _mix(h[at] * _powers[2] + h[at + 8] * _powers[1] + h[at + 12]), at


def ordered(text: str, keep: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first positions of a text's distinct anchors in text order, or of the ``keep`` least."""
    hashes, at = anchors(text)
    hashes, first = np.unique(hashes, return_index=True)
    hashes, at = hashes[:keep], at[first[:keep]]
    order = np.argsort(at)
    return hashes[order], at[order]


def written(hashes: np.ndarray, at: np.ndarray) -> str:
    return " ".join([f"{h:016x}:{p}" for h, p in zip(hashes.tolist(), at.tolist(), strict=True)])


def fingerprint(text: str, keep: int | None = None) -> str:
    """``hash:position`` of the anchors in text order; the empty text has the empty fingerprint."""
    return written(*ordered(text, keep))


def parse(fp: str) -> tuple[np.ndarray, np.ndarray]:
    both = [(int(a[:16], 16), int(a[17:])) for a in fp.split()]
    return np.array([h for h, _ in both], np.uint64), np.array([p for _, p in both], np.int64)


def alike(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], keep: int | None = None) -> float:
    """:func:`likeness` of anchors as :func:`ordered` gives them."""
    if np.array_equal(x[0], y[0]) and np.array_equal(x[1], y[1]):
        return 1.0
    if not len(x[0]) or not len(y[0]):
        return 0.0
    common, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    size = len(x[0]) + len(y[0]) - len(common)
    if keep is not None and size > keep:
        i, j = (w[common <= np.union1d(x[0], y[0])[keep - 1]] for w in (i, j))
        size = keep
    chain: list[int] = []
    for p in j[np.argsort(i)].tolist():  # both are in text order
        at = bisect_left(chain, p)
        chain[at : at + 1] = [p]
    return len(chain) / size


def likeness(a: str, b: str, keep: int | None = None) -> float:
    """Share of the union's anchors, or of its ``keep`` least, that both have, in one order; 1 for equal fingerprints."""
    return 1.0 if a == b else alike(parse(a), parse(b), keep)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t or "") for t in b.column(1).to_pylist()], pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, fingerprint string")


def with_next(docs: DataFrame, derive, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows in ascending order of id, each derived with the next one (after the last: the first).

    ``derive`` is a function of an iterator of (id, text) in order, the last of which only serves as
    the next of the one before; it yields the output rows. Nulls come first, equal ids by a hash of
    the text; null texts are empty. The ids are cut into ranges by percentiles of the ids alone,
    each range is one sorted partition, and a range's first row is also sent to the range before:
    the texts are shuffled once, and no task sees more than a range. Rows with equal ids, and rows
    without one, are one range. Repeated rows are each derived, the copy next. An empty table gives
    no rows. Only the two named columns are read, so others may have any names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)] or [0.5], F.lit(20 * n))).head()[0]
    splits = np.unique(np.array(cuts or [], np.int64)) if n > 1 else np.empty(0, np.int64)
    n_ranges = len(splits) + 1

    def range_of(ids: pd.Series) -> np.ndarray:
        return np.where(ids.isna(), 0, np.searchsorted(splits, ids.fillna(0).astype("int64").to_numpy(), side="right"))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(range_of(ids.astype("Int64")))

    # one row per range: its first row's order
    heads = {r["b"]: (r["m"]["null"], r["m"]["id"], r["m"]["tie"]) for r in rows.withColumn("b", bucket("id")).groupBy("b").agg(F.min(F.struct((F.col("id").isNotNull()).alias("null"), "id", "tie")).alias("m")).collect()}
    order = sorted(heads)
    before = np.zeros(n_ranges, np.int64)
    head = np.zeros((n_ranges, 3), np.int64)  # whether the first row has an id, the id, and its tie
    for i, b in enumerate(order):
        before[b] = order[i - 1] + n_ranges
        head[b] = int(heads[b][0]), heads[b][1] or 0, heads[b][2]

    @F.pandas_udf("place int, ahead int")
    def places(ids: pd.Series, ties: pd.Series) -> pd.DataFrame:
        ids = ids.astype("Int64")
        b = range_of(ids)
        first = ((~ids.isna()).to_numpy() == head[b, 0]) & (ids.fillna(0).astype("int64").to_numpy() == head[b, 1]) & (ties.to_numpy() == head[b, 2])
        return pd.DataFrame({"place": b, "ahead": pd.array(np.where(first, before[b], -1), "Int64").astype("Int32")})

    both = rows.withColumn("at", places("id", "tie"))
    placed = both.withColumn("place", F.explode(F.when(F.col("at.ahead") >= 0, F.array("at.place", "at.ahead")).otherwise(F.array("at.place")))).drop("at")
    # rows that only look ahead come after a range's own; copies of one row need to look ahead once
    placed = placed.withColumn("ahead", F.col("place") >= n_ranges).withColumn("place", F.col("place") % n_ranges)
    dealt = placed.repartitionById(n_ranges, "place").sortWithinPartitions(F.col("ahead"), F.col("id").asc_nulls_first(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def in_order():
            for b in batches:
                for i, t, a in zip(*(b.column(c).to_pylist() for c in (0, 1, 2)), strict=True):
                    yield i, t
                    if a:
                        return

        part, size = [], 0
        for row in derive(in_order()):
            part.append(row)
            size += sum(len(x) for x in row.values() if isinstance(x, str))
            if len(part) == 1000 or size >= BATCH:
                yield pa.RecordBatch.from_pylist(part, schema=out_schema)
                part, size = [], 0
        if part:
            yield pa.RecordBatch.from_pylist(part, schema=out_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out_schema = to_arrow_schema(StructType.fromDDL(schema))
    return dealt.select("id", "text", "ahead").mapInArrow(run, schema)


def edited_fingerprints(rows: Iterator[tuple[int | None, str]]) -> Iterator[dict]:
    """Each text, its edited text (the last quarter from the next text's beginning), and likenesses."""
    last = None
    for doc_id, text in rows:
        own = ordered(text)
        if last is not None:
            i, t, f = last
            quarter = len(t) // 4
            edited = t[: len(t) - quarter] + text[:quarter]
            g = ordered(edited)
            yield {"doc_id": i, "n_chars": len(t), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": written(*f), "edited_fingerprint": written(*g), "near_edited": alike(f, g), "near_next": alike(f, own)}
        last = doc_id, text, own


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text, and how near they are."""
    return with_next(table(spark, sf_dir, "documents"), edited_fingerprints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
