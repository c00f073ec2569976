"""Substring dedup by level-wise doubling over word windows.

For windows of W words the levels are the lengths W/4, W/2 and W, rounded up, each twice the one
before. A W-window has W/2+1 inner starts; the least hash of a W/4-window among them names its
anchor, from the window's words alone, so equal W-windows have equal anchors at equal places. Only
anchors stand for the short levels: those whose W/4-window occurs in a second document are extended
to W/2, those repeated again let the W-windows that they anchor live, and these are compared in
full. A level that leaves no candidates ends the search. Documents with the same words are searched
once, as the one with the smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from keystrata.llm.common import find_words, materialize, release, table

WINDOW = 50
#: Rows with a null id stand behind all others.
LAST = (1 << 63) - 1
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_NOTHING = hashlib.sha256(b"").hexdigest()


class WordHashes(dict):
    """Hashes of words by a seed, remembered up to a bound."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, lane: int) -> np.ndarray:
    """Hashes of windows of n_a + n_b words from those of n_a and of the n_b words behind them."""
    n = max(0, min(len(a), len(b) - n_a))
    return a[:n] * np.uint64(pow(_ODD[lane], n_b, 1 << 64)) + b[n_a : n_a + n]


def window_hashes(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Polynomial hashes of all windows of ``length`` words, put together from doubled lengths."""
    power, n, out, have = words, 1, None, 0
    while True:
        if length & n:
            out, have = (power, n) if out is None else (joined(out, have, power, n, lane), have + n)
        n *= 2
        if n > length:
            return out
        power = joined(power, n // 2, power, n // 2, lane)


class Levels:
    """The three window lengths and what a document holds of them."""

    def __init__(self, window: int = WINDOW):
        if window < 4:
            raise ValueError("a window has at least 4 words")
        self.full, self.half = window, -(-window // 2)
        self.quarter = -(-self.half // 2)

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchor of every full window, and the hashes of all quarter and half windows."""
        quarter = window_hashes(words, self.quarter)
        rest = self.half - self.quarter
        half = joined(quarter, self.quarter, window_hashes(words, rest), rest, 0)
        starts = len(words) - self.full + 1
        inner = self.full - self.half + 1
        seen = np.lib.stride_tricks.sliding_window_view(mix(quarter)[: starts + inner - 1], inner)
        return np.arange(starts) + seen.argmin(1), quarter, half

    def full_hashes(self, words: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of every full window: two halves joined, in two lanes, from two hashes of each word."""
        rest = self.full - self.half
        out = []
        for lane, w in enumerate((words, again)):
            half = window_hashes(w, self.half, lane)
            out.append(mix(joined(half, self.half, half if rest == self.half else window_hashes(w, rest, lane), rest, lane)))
        return out[0], out[1]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(values) if kind == pa.int64() else pa.array(values.astype(np.int32)))


def _digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def survivors(rows: DataFrame, keys: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key occurs under two different ids, and the table of those keys, to be released.

    Counts are combined before the shuffle; the keys are written, so that a hot one of the join can
    be split.
    """
    twice = rows.groupBy(*keys).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select(*keys)
    twice = materialize(twice, tag)
    return rows.join(twice, keys, "left_semi"), twice


def removed_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of ``docs``.

    A word goes if a window of ``window`` words covers it whose word sequence also starts in a
    document with a smaller id. Null texts have no words. Rows with a null id count as behind all
    ids, and equal ids are no smaller than each other. Only the two named columns are read.
    """
    spark = docs.sparkSession
    levels = Levels(window)
    # an id and a hash of the text name a text: rows without an id share the last place, not their texts
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("th"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, info, found = batch.slice(at, 500), [], []
                for text in part.column(3).to_pylist():
                    words = find_words(text or "")
                    info.append((len(words), _digest(words)))
                    if len(words) < levels.full:
                        found.append((np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, np.uint64)))
                        continue
                    place, quarter, half = levels.anchors(memo.of(words))
                    place = np.unique(place)
                    found.append((place, quarter[place], half[place]))
                lists = [_lists([f[i] for f in found], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array([x[i] for x in info], k) for i, k in enumerate((pa.int64(), pa.string()))), *lists], names=["doc_id", "ord", "th", "n_words", "sha", "pos", "q", "h"])

    scanned = materialize(named.mapInArrow(scan, "doc_id long, ord long, th long, n_words long, sha string, pos array<int>, q array<long>, h array<long>"), "sub-scan")
    rows = scanned.select("doc_id", "ord", "th", "n_words", "sha")
    # documents with the same words: the smallest id stands for all
    least = rows.groupBy("sha").agg(F.min("ord").alias("least"))
    rows = materialize(rows.join(least, "sha"), "sub-rows")
    alone = rows.where(F.col("ord") == F.col("least")).select("ord", "th").distinct()
    level = scanned.where(F.size("pos") > 0).select("ord", "th", "pos", "q", "h").join(alone, ["ord", "th"], "left_semi")
    level = level.select("ord", "th", F.explode(F.arrays_zip("pos", "q", "h")).alias("x")).select("ord", "th", "x.*")
    alive, quarters = survivors(level, ["q"], "sub-quarters")
    level = materialize(alive.select("ord", "th", "pos", "h"), "sub-quarter")
    alive, halves = survivors(level, ["h"], "sub-halves")
    found = materialize(alive.groupBy("ord", "th").agg(F.collect_set("pos").alias("pos")), "sub-half")
    release(scanned, level, quarters, halves)
    result = rows.select("doc_id", "n_words", "sha", "ord", "th", "least")
    if found.isEmpty():
        gone = spark.createDataFrame([], "ord long, th long, n_removed long, kept string")
    else:
        gone = _full_level(named, found, levels)
    copy = (F.col("ord") > F.col("least")) & (F.col("n_words") >= window)
    result = result.join(gone, ["ord", "th"], "left")
    return result.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_NOTHING)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def _full_level(named: DataFrame, found: DataFrame, levels: Levels) -> DataFrame:
    """(ord, th, n_removed, kept) of the documents that lose words, from the anchors left."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, second = WordHashes(), WordHashes(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for o, th, text, pos in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    words = find_words(text or "")
                    hashes = memo.of(words)
                    place, _, _ = levels.anchors(hashes)
                    alive = np.nonzero(np.isin(place, np.array(pos)))[0]
                    a, b = levels.full_hashes(hashes, second.of(words))
                    out.append((o, th, alive, a[alive], b[alive]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), *(_lists([x[i] for x in out], k) for i, k in ((2, pa.int32()), (3, pa.int64()), (4, pa.int64())))], names=["ord", "th", "start", "a", "b"])

    texts = named.select("ord", "th", "text").where("text IS NOT NULL")
    full = texts.join(found, ["ord", "th"]).select("ord", "th", "text", "pos").mapInArrow(extend, "ord long, th long, start array<int>, a array<long>, b array<long>")
    full = materialize(full, "sub-full")
    full_rows = full.select("ord", "th", F.explode(F.arrays_zip("start", "a", "b")).alias("x")).select("ord", "th", "x.*")
    # repeated windows alone, and written: from a table, a hot window of the join can be split
    first = materialize(full_rows.groupBy("a", "b").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("a", "b", "lo"), "sub-first")
    later = full_rows.join(first, ["a", "b"]).where("lo < ord").groupBy("ord", "th").agg(F.collect_set("start").alias("start"))
    later = materialize(later, "sub-later")
    release(found, full, first)

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for o, th, text, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = find_words(text or "")
                edge = np.zeros(len(words) + 1, np.int64)
                start = np.array(start)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + levels.full, -1)
                kept = (np.cumsum(edge[:-1]) == 0).tolist()
                out.append({"ord": o, "th": th, "n_removed": len(words) - sum(kept), "kept": _digest([w for w, k in zip(words, kept, strict=True) if k])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("ord", pa.int64()), ("th", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    struck = texts.join(later, ["ord", "th"]).select("ord", "th", "text", "start").mapInArrow(strike, "ord long, th long, n_removed long, kept string")
    return struck.dropDuplicates(["ord", "th"])  # a repeated row is struck once


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the 50-word windows that an earlier document has."""
    return removed_words(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS ord,
                  coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, ord, p, array_to_string(w[p : p + 49], ' ') AS s FROM (SELECT r, ord, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT s, min(ord) AS first FROM s GROUP BY s),
g AS (SELECT DISTINCT r, p + i AS k FROM (SELECT s.r, s.p, unnest(range(50)) AS i FROM s JOIN f USING (s) WHERE f.first < s.ord)),
x AS (SELECT r, k, w[k] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
k AS (SELECT x.r, count(g.k) AS n_removed, string_agg(x.word, ' ' ORDER BY x.k) FILTER (g.k IS NULL) AS kept FROM x LEFT JOIN g ON g.r = x.r AND g.k = x.k GROUP BY x.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
"""
