"""Bloom filters of segments as tables of 64-bit words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.murmur import bloom_positions, probe_hashes
from keystrata.schema import BLOOM_BITS_PER_KEY, BLOOM_MIN_BITS, BLOOM_MIN_KEYS

#: Bits of the filters that one task asks at a time, and tasks that share the keys asked of them.
BLOCK_BITS, PARTS = 1 << 28, 16
#: Bytes of answers that are worked on at once.
ANSWER_BYTES = 1 << 24


def filter_bits(n_keys: Column) -> Column:
    """Bits of a filter that is built for so many keys."""
    return F.greatest(F.greatest(n_keys, F.lit(BLOOM_MIN_KEYS)) * BLOOM_BITS_PER_KEY, F.lit(BLOOM_MIN_BITS)).cast("long")


def filter_sizes(entries: DataFrame) -> DataFrame:
    """(segment_id, bits) for segments' entries (segment_id, key)."""
    return entries.groupBy("segment_id").agg(filter_bits(F.count("*")).alias("bits"))


def positions(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(segment_id, key, position): the bits of each (segment_id, key) in that segment's filter."""
    rows = pairs.select("segment_id", "key").join(sizes, "segment_id")
    return rows.select("segment_id", "key", F.explode(bloom_positions("key", "bits")).alias("position"))


def bloom_words(entries: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(segment_id, word, bits): the set bits, 64 to a word, lowest first; words without a bit are left out."""
    sizes = filter_sizes(entries) if sizes is None else sizes
    at = positions(entries, sizes)
    # 1 << 63 is the sign bit, so the words are signed longs
    one = F.when(F.col("position") % 64 == 63, F.lit(-(1 << 63))).otherwise(F.pow(F.lit(2.0), F.col("position") % 64).cast("long"))
    return at.groupBy("segment_id", F.floor(F.col("position") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))


def serialized(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """(segment_id, bits, words): each filter as the array of its words up to the last that has a bit."""
    last = words.groupBy("segment_id").agg(F.max("word").alias("last"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    array = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long")))
    return last.join(sizes, "segment_id").select("segment_id", F.col("bits"), array.alias("words"))


def restored(filters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words and sizes from :func:`serialized`."""
    rows = filters.select("segment_id", F.posexplode("words").alias("word", "bits")).where("bits != 0")
    return rows, filters.select("segment_id", "bits")


def might_contain(words: DataFrame, sizes: DataFrame, probes: DataFrame) -> DataFrame:
    """(segment_id, key, might_contain): whether all bits of a probe (segment_id, key) are set."""
    at = positions(probes.select("segment_id", "key").distinct(), sizes)
    rows = at.withColumn("word", F.floor(F.col("position") / 64).cast("int")).join(words, ["segment_id", "word"], "left")
    is_set = F.coalesce(F.getbit(F.col("bits"), (F.col("position") % 64).cast("int")) == 1, F.lit(False))
    hits = rows.groupBy("segment_id", "key").agg(F.every(is_set).alias("might_contain"))
    return hits


def false_positives(words: DataFrame, sizes: DataFrame, probes: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: probes, hits, keys that are there, false positives and false negatives."""
    there = entries.select("segment_id", "key").distinct().withColumn("present", F.lit(True))
    rows = might_contain(words, sizes, probes).join(there, ["segment_id", "key"], "left").withColumn("present", F.coalesce("present", F.lit(False)))
    hit, present = F.col("might_contain"), F.col("present")
    return rows.agg(F.count("*").alias("probes"), F.count_if(hit).alias("hits"), F.count_if(present).alias("present"), F.count_if(hit & ~present).alias("false_positives"), F.count_if(~hit & present).alias("false_negatives"))


def read_counts(entries: DataFrame, block_bits: int = BLOCK_BITS, parts: int = PARTS) -> DataFrame:
    """One row (reads, skips, false_positives) of reading every key of segments' entries (segment_id, key),
    from the newest segment to the first that has it, which its filter lets through.

    Every key meets every newer filter, but no row is made of that. Filters are dealt to blocks of so
    many bits in the order of segments, and a key goes to its newest segment's block and those behind. A
    task holds one block, by places (see :class:`_Filters`), and streams over its share of the keys.
    """
    sizes = filter_sizes(entries)
    block = F.floor((F.sum("bits").over(Window.orderBy("segment_id")) - F.col("bits")) / F.lit(block_bits)).cast("int")
    blocks = sizes.select("segment_id", "bits", block.alias("block")).withColumn("last", F.max("block").over(Window.partitionBy()))
    words = bloom_words(entries, sizes).groupBy("segment_id").agg(F.collect_list(F.struct("word", "bits")).alias("words"))
    filters = blocks.join(words, "segment_id").select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("string").alias("key"), "segment_id", "bits", "words")
    newest = entries.where("key IS NOT NULL").groupBy("key").agg(F.max("segment_id").alias("segment_id")).join(blocks, "segment_id")
    # of a key's rows the first, in the block of its newest segment, has its bits
    asked = newest.select("key", "segment_id", "bits", F.posexplode(F.sequence("block", "last")).alias("at", "block"))
    asked = asked.select("block", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "key", "segment_id", F.when(F.col("at") == 0, F.col("bits")).alias("bits"), F.lit(None).cast(words.schema["words"].dataType).alias("words"))
    rows = filters.unionByName(asked).repartition(4 * parts, "block", "part").sortWithinPartitions("block", "part", F.col("key").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, filters, reads, skips, passed = None, _Filters(), 0, 0, 0
        for batch in batches:
            where = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("block", "part")])
            is_key = batch["key"].is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0) | (is_key[1:] != is_key[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if own != tuple(where[:, a]):
                    own, filters = tuple(where[:, a]), _Filters()
                run = batch.slice(a, b - a)
                if is_key[a]:
                    asked, hits = filters.newer([k.encode() for k in run["key"].to_pylist()], run["segment_id"].to_numpy())
                    reads, skips, passed = reads + len(run) - run["bits"].null_count, skips + asked - hits, passed + hits
                else:
                    for segment, bits, words in zip(run["segment_id"].to_pylist(), run["bits"].to_pylist(), run["words"], strict=True):
                        word, own_bits = words.values.flatten()
                        filters.add(segment, bits, word.to_numpy(), own_bits.to_numpy())
        yield pa.RecordBatch.from_pydict({"reads": [reads], "skips": [skips], "false_positives": [passed]})

    counts = rows.mapInArrow(count, "reads long, skips long, false_positives long")
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns))


class _Filters:
    """Filters of one number of bits turned about: for each place the filters that have its bit, eight to
    a byte, so that a key asks all of them at the same seven places."""

    def __init__(self):
        self._added: dict[int, list] = {}
        self._turned: list | None = None

    def add(self, segment: int, bits: int, word: np.ndarray, own: np.ndarray) -> None:
        self._added.setdefault(bits, []).append((segment, word, own))

    def _turn(self) -> list:
        out = []
        for bits, filters in self._added.items():
            filters.sort(key=lambda f: f[0])
            places = np.zeros((bits, -(-len(filters) // 8)), np.uint8)
            for i, (_, word, own) in enumerate(filters):
                is_set = np.unpackbits(np.ascontiguousarray(own).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, bit = np.nonzero(is_set)
                places[word[row].astype(np.int64) * 64 + bit, i // 8] |= np.uint8(1 << i % 8)
            out.append((bits, np.array([f[0] for f in filters], np.int64), places))
        self._added = {}
        return out

    def newer(self, keys: list[bytes], newest: np.ndarray) -> tuple[int, int]:
        """Filters of later segments than each key's newest, and how many of them let the key through."""
        if self._turned is None:
            self._turned = self._turn()
        hashes, asked, hits = probe_hashes(keys), 0, 0
        for bits, segments, places in self._turned:
            first = np.searchsorted(segments, newest, "right")
            asked += int((len(segments) - first).sum())
            step = max(1, ANSWER_BYTES // places.shape[1])
            for a in range(0, len(keys), step):
                at = (hashes[a : a + step] % np.uint64(bits)).astype(np.int64)
                answer = places[at[:, 0]]
                for i in range(1, at.shape[1]):
                    answer &= places[at[:, i]]
                row, byte = np.nonzero(answer)
                older = np.clip(first[a : a + step][row] - 8 * byte, 0, 8)
                hits += int(np.bitwise_count(answer[row, byte].astype(np.uint16) >> older.astype(np.uint16)).sum())
        return asked, hits
