"""Near-duplicate documents by b-bit MinHash.

Documents with equal shingle sets form one class. Every class has a MinHash signature; bands of it
give candidates, and the low ``BITS`` bits of the minima, packed into words, estimate a pair's
similarity from counts of equal groups of bits, corrected for chance collisions. Only pairs far
below the threshold go on that estimate; all others are confirmed on their full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.llm.common import find_words, forget_shuffles, materialize, release, table
from keystrata.llm.substrings import WordHashes, mix

#: A pair at similarity 0.8 shares no band with probability (1 - 0.8**ROWS)**BANDS = 1.2e-7.
BANDS, ROWS, BITS = 40, 5, 4
#: Estimates have a standard deviation of 0.03 at 0.8; a pair this far below is no candidate.
MARGIN = 0.2
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, width: int, memo: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; A-Z lower-cased, fewer words are one shingle."""
    words = find_words((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    if not words:
        return np.empty(0, np.uint64)
    h = memo.of(words)
    out = mix(h[: max(1, len(h) - width + 1)])
    for i in range(1, min(width, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


def minima(sets: np.ndarray) -> np.ndarray:
    """The signature: the least of each hash function over the set, 32 bits each."""
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(sets), 4096):
        part = sets[at : at + 4096]
        out = np.minimum(out, ((part[None, :] * _MUL[:, None] + _ADD[:, None]) >> np.uint64(32)).min(1))
    return out.astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, the band's number included."""
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in range(ROWS):
        key = mix(key ^ rows[:, i]) + np.uint64(i + 1)
    return key


def pack(signature: np.ndarray) -> bytes:
    """The low BITS bits of every minimum, 64 / BITS to a word."""
    low = (signature & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    per = 64 // BITS
    low = np.concatenate([low, np.zeros(-len(low) % per, np.uint64)]).reshape(-1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).tobytes()


_ONES = np.uint64(sum(1 << (i * BITS) for i in range(64 // BITS)))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of packed signatures (rows of words), by counting the groups of bits that differ.

    Minima that differ agree in their low bits with probability 2**-BITS, which is corrected for.
    """
    x = a ^ b
    some = x
    for i in range(1, BITS):
        some = some | (x >> np.uint64(i))
    differ = np.bitwise_count(some & _ONES).sum(-1)
    chance = 2.0**-BITS
    return (1 - differ / (BANDS * ROWS) - chance) / (1 - chance)


def _fingerprint(sets: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(sets.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _long_lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


BLOCK = 1024


def compare(index: DataFrame, queries: DataFrame, percent: int) -> DataFrame:
    """(src, dst): links of queries (g, i, j, v, label, set, sig) to index rows of the same (g, i, j).

    A query gets one link to each label other than its own. Estimates rule out the pairs far below
    the threshold; the others' intersections are counted in full, by postings when there are many.
    """
    low = percent / 100 - MARGIN

    def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
        return [x.values.to_numpy().view(np.uint64) for x in column]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        src, dst = [], []
        if left.num_rows and right.num_rows:
            v, label, sets = left["v"].to_numpy(), left["label"].to_numpy(), lists(left["set"])
            sigs = np.stack([np.frombuffer(x, np.uint64) for x in left["sig"].to_pylist()])
            sizes, postings = np.array([len(s) for s in sets]), None
            for q, q_label, q_set, q_sig in zip(right["v"].to_pylist(), right["label"].to_pylist(), lists(right["set"]), right["sig"].to_pylist(), strict=True):
                near = np.nonzero((label != q_label) & (estimate(sigs, np.frombuffer(q_sig, np.uint64)[None, :]) >= low))[0]
                if not len(near):
                    continue
                if len(near) <= 8:
                    shared = np.array([len(np.intersect1d(q_set, sets[n], assume_unique=True)) for n in near])
                else:
                    if postings is None:
                        values = np.concatenate(sets)
                        order = np.argsort(values, kind="stable")
                        postings = values[order], np.repeat(np.arange(len(sets)), sizes)[order]
                    a, b = (np.searchsorted(postings[0], q_set, side) for side in ("left", "right"))
                    spans = b - a
                    at = np.repeat(a - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
                    shared = np.bincount(postings[1][at], minlength=len(sets))[near]
                linked = near[100 * shared >= percent * (sizes[near] + len(q_set) - shared)]
                some = linked[np.unique(label[linked], return_index=True)[1]]
                src += [q] * len(some)
                dst += v[some].tolist()
        return pa.table([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    index, queries = (x.select(*(F.col(c).alias(c) for c in ("g", "i", "j", "v", "label", "set", "sig"))) for x in (index, queries))
    return index.groupBy("g", "i", "j").cogroup(queries.groupBy("g", "i", "j")).applyInArrow(run, "src long, dst long")


def components(links: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex of each linked vertex's connected component.

    Large-star and small-star steps in turn, each a minimum per vertex (combined before the shuffle)
    and a join, until the edges stay the same; every step is written to the shared folder.
    """
    edges = materialize(links.where("src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "cc")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = materialize(small.where("a != b").distinct(), "cc")
        release(edges)
        edges = new
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct())


def blocks(count) -> F.Column:
    return F.ceil(count / F.lit(float(BLOCK))).cast("int")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", same_id: bool = True) -> DataFrame:
    """(doc_id, th, n_shingles, row, component, component_id): each row's group of linked documents.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; percent is
    at least 80, for which the bands are laid out. Texts without words, null ones too, are linked
    with nothing. Rows that share an id are linked too, unless ``same_id`` is false. ``row`` numbers
    the rows, ``component`` is the group's least number and ``component_id`` its least id, null if
    all ids in it are null; ``th`` is a hash of the text. Ids may be any whole numbers. Only the two
    named columns are read, so others may have any names; an empty table gives no rows.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be in 80..100")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows, bands = batch.slice(at, 500), [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text, width, memo)
                    signature = minima(s)
                    rows.append((len(s), *_fingerprint(s), pack(signature)))
                    bands.append(band_keys(signature) if len(s) else np.empty(0, np.uint64))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), _long_lists(bands)], names=["doc_id", "th", "n", "k1", "k2", "sig", "bands"])

    # the number of a row is written with it, so it stays the same from here on
    scanned = named.mapInArrow(scan, "doc_id long, th long, n long, k1 long, k2 long, sig binary, bands array<long>")
    scanned = materialize(scanned.withColumn("v", F.monotonically_increasing_id()), "mh-scan")
    rows = scanned.select("doc_id", "th", "v", "n", "k1", "k2")
    # equal sets are one class, which its first row stands for
    least = materialize(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("v").alias("rep")), "mh-classes")
    members = materialize(rows.join(least, ["k1", "k2"], "left").select("doc_id", "th", "v", "n", F.coalesce("rep", "v").alias("rep")), "mh-members")
    bands = scanned.join(least.select("rep"), F.col("v") == F.col("rep"), "left_semi").select("v", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("v").alias("pivot"), F.max("v").alias("last")).where("pivot < last").select("band", "pivot")
    buckets = materialize(bands.join(shared, "band").select("band", "pivot", "v"), "mh-buckets")
    forget_shuffles(docs.sparkSession)
    found, old = _links(named.select("doc_id", "text"), scanned, buckets, width, percent)
    if same_id:
        several = members.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("dst"), F.max("rep").alias("hi")).where("dst < hi").select("doc_id", "dst")
        found = found.unionByName(members.join(several, "doc_id").select(F.col("rep").alias("src"), "dst"))
    labels = components(found)
    out = members.join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("v").alias("row"), F.coalesce("label", "rep").alias("component"))
    out = materialize(out, "mh-rows")
    release(scanned, least, members, buckets, labels, *old)
    forget_shuffles(docs.sparkSession)
    ids = materialize(out.groupBy("component").agg(F.min("doc_id").alias("component_id")), "mh-ids")
    return out.join(ids, "component").select("doc_id", "th", "n_shingles", "row", "component", "component_id")


def _links(named: DataFrame, scanned: DataFrame, buckets: DataFrame, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links between class representatives that connect all that are linked, and the tables to release.

    First every bucket's members are compared with its smallest. What stays unconnected inside a
    bucket is compared in full: its members go to the group of the bucket's largest component, and
    those outside that component are queries against all of the group, in blocks.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [s for s in (shingles(t, width, memo) for t in batch.slice(at, 500).column(0).to_pylist()) if len(s)]
                keys = [_fingerprint(s) for s in found]
                yield pa.RecordBatch.from_arrays([*(pa.array([k[n] for k in keys], pa.int64()) for n in (0, 1)), _long_lists(found)], names=["k1", "k2", "set"])

    taking = scanned.select("v", "doc_id", "k1", "k2", "sig").join(buckets.select("v").distinct(), "v", "left_semi")
    taking = materialize(taking, "mh-taking")
    # texts of the documents in buckets alone; rows without an id are few and found by their sets
    texts = named.join(taking.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").unionByName(named.where("doc_id IS NULL"))
    full = texts.select("text").mapInArrow(sets, "k1 long, k2 long, set array<long>")
    # a class has one row in taking, so the sets are where duplicates of them are dropped already
    full = materialize(full.join(taking.select("v", "k1", "k2", "sig"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("v", "set", "sig"), "mh-sets")

    pairs = buckets.where("pivot < v").select(F.col("pivot").alias("g"), "v").distinct()
    count = pairs.groupBy("g").agg(blocks(F.count("*")).alias("n"))
    index = count.select(F.col("g"), F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"), F.col("g").alias("v"), F.col("g").alias("label"))
    queries = pairs.join(count, "g").select("g", F.lit(0).alias("i"), F.pmod(F.xxhash64("v"), F.col("n")).cast("int").alias("j"), "v", F.col("v").alias("label"))
    first = materialize(compare(index.join(full, "v"), queries.join(full, "v"), percent), "mh-links")
    forget_shuffles(named.sparkSession)

    cc = components(first)
    larger = cc.groupBy("label").agg(F.count("*").alias("size"))
    labels = cc.join(larger, "label").select("v", "label", "size")
    marked = buckets.join(labels, "v", "left").select("band", "v", F.coalesce("label", "v").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))
    # a bucket of two has been compared already
    open_ones = marked.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.min_by("label", F.struct(-F.col("size"), F.col("label"))).alias("g")).where("lo < hi AND n > 2").select("band", "g")
    group = materialize(marked.join(open_ones, "band").select("g", "v", "label").distinct(), "mh-open")
    count = group.groupBy("g").agg(blocks(F.count("*")).alias("n"), blocks(F.count_if(F.col("label") != F.col("g"))).alias("m"))
    placed = group.join(count, "g")
    index = placed.select("g", F.pmod(F.xxhash64("v"), F.col("n")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"), "v", "label")
    queries = placed.where("label != g").select("g", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), F.pmod(F.xxhash64("v", F.lit(1)), F.col("m")).cast("int").alias("j"), "v", "label")
    second = materialize(compare(index.join(full, "v"), queries.join(full, "v"), percent), "mh-links")
    release(taking, full, group, cc)
    forget_shuffles(named.sparkSession)
    return first.unionByName(second), [first, second]


def one_per_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every group of near copies: the one with the smallest id, null ids last.

    Texts without words stay, all of them. Of equal rows in a group one stays. Rows that share an id
    are a group only if their texts are near copies.
    """
    found = near_duplicates(docs, width, percent, same_id=False)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    leader = found.where("n_shingles > 0").groupBy("component").agg(first).select(F.col("first.row").alias("row"))
    # (id, text) of the rows that stay: all without words, one of each group
    stay = found.where("n_shingles > 0").join(leader, "row", "left_semi").select("doc_id", "th", F.lit(1).alias("most"))
    stay = stay.unionByName(found.where("n_shingles = 0").select("doc_id", "th", F.lit(0).alias("most")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("hash"))
    rows = rows.join(stay, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("th")))
    nth = F.row_number().over(Window.partitionBy("own", "hash").orderBy("most"))
    rows = rows.withColumn("nth", nth).where("most = 0 OR nth = 1")
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies by two-word shingles at 0.8."""
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("row") == F.col("component")))
    return rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


OP5_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
v AS (SELECT r, doc_id, coalesce(doc_id, 4611686018427387904 + r) AS v, w FROM d),
s AS (SELECT DISTINCT r, v, s FROM (SELECT r, v, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM v)),
n AS (SELECT r, v, count(*) AS n FROM s GROUP BY r, v),
c AS (SELECT a.r AS ra, b.r AS rb, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x.v AS a, y.v AS b FROM c JOIN n x ON x.r = ra JOIN n y ON y.r = rb WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT DISTINCT v AS a, v AS b FROM v UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a AS v, min(b) AS c FROM reach GROUP BY a)
SELECT v.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN m.c < 4611686018427387904 THEN m.c END AS component_id, v.v = m.c AS kept
FROM v JOIN m ON m.v = v.v LEFT JOIN n ON n.r = v.r
"""
