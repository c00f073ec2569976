"""Exact top-k inner-product search, term at a time, over blocks of queries and candidates.

Every pair (query block, candidate block) is one group: the candidates' components are held as
postings by term, each query's non-zero terms scatter ``weight * posting`` into a dense score
array, a partition selection takes the block's best k, and a second step merges the blocks' lists.
A group has at most about ``block`` queries and ``block`` candidates, at every input size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.llm.common import table

#: Query blocks are so many times as wide as candidate blocks: a query costs a group its vector alone,
#: and every candidate is shuffled once per query block.
WIDER = 16


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): vectors that take part, each component as floor(scale * x), a whole number in a double.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    An empty vector takes part and scores 0 against everything.
    """
    x = F.col(vec_col)
    fine = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    # a double from 2**52 on is a whole number
    whole = lambda a: F.when(F.abs(a) < F.lit(float(1 << 52)), F.floor(a).cast("double")).otherwise(a)
    scaled = F.transform(x, lambda a: whole(a.cast("double") * scale))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


def _rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the offsets of its rows."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def whole(values: np.ndarray) -> np.ndarray:
    """Whole numbers in doubles as exact integers of any size."""
    if not np.isfinite(values).all():
        raise OverflowError("a scaled component exceeds the largest double: its scores fit no long")
    return np.array([int(x) for x in values.tolist()], object)


def postings(values: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term (dimension), the candidates with a non-zero weight and the weights.

    None instead of the candidates if all of them have one: the scatter is then a plain addition.
    """
    n, lengths = len(offsets) - 1, np.diff(offsets)
    out = []
    for t in range(int(lengths.max(initial=0))):
        has = np.nonzero(lengths > t)[0]
        w = values[offsets[has] + t]
        has, w = has[w != 0], w[w != 0]
        out.append((None if len(has) == n else has, w))
    return out


def accumulate(query: np.ndarray, lists: list, n: int) -> np.ndarray:
    """Scores of all n candidates against one sparse query row; missing terms count as 0."""
    scores = np.zeros(n, query.dtype)
    for t in np.nonzero(query[: len(lists)])[0]:
        at, w = lists[t]
        if at is None:
            scores += query[t] * w
        else:
            scores[at] += query[t] * w  # a term holds a candidate once
    return scores


class Block:
    """Candidates as postings: in longs those whose sums of products cannot overflow one, the others
    in integers of any size. What a row is held in depends on its components alone."""

    #: Components up to this and rows up to 2**15 of them make sums that fit a long.
    FIT, TERMS = float(1 << 23), 1 << 15

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        lengths = np.diff(offsets)
        row = np.repeat(np.arange(self.n), lengths)
        self.large = np.bincount(row[~(np.abs(values) <= self.FIT)], minlength=self.n) + (lengths > self.TERMS) > 0
        self.at = [np.nonzero(~self.large)[0], np.nonzero(self.large)[0]]
        picked = [values[~self.large[row]], values[self.large[row]]]
        starts = [np.concatenate([[0], np.cumsum(lengths[at])]) for at in self.at]
        self.small = postings(picked[0].astype(np.int64), starts[0])
        self.wide = postings(whole(picked[1]), starts[1])
        self._exact: list | None = None

    def exact(self) -> list:
        """The small candidates' postings in integers of any size, for a large query."""
        if self._exact is None:
            self._exact = [(at, w.astype(object)) for at, w in self.small]
        return self._exact

    def scores(self, query: np.ndarray) -> np.ndarray:
        fits = len(query) <= self.TERMS and bool((np.abs(query) <= self.FIT).all())
        small, wide = self.at
        part = accumulate(query.astype(np.int64), self.small, len(small)) if fits else accumulate(whole(query), self.exact(), len(small))
        if not len(wide):
            return part
        out = np.empty(self.n, object)
        out[small], out[wide] = part, accumulate(whole(query), self.wide, len(wide))
        return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, by partition selection."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.nonzero(scores >= least)[0]
    else:
        at = np.arange(len(scores))
    if scores.dtype == object:  # lexsort takes no objects
        return np.array(sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def top_k(vectors: DataFrame, k: int = 10, query_filter=None, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by integer inner product.

    ``query_filter`` (a condition on ``id``) names the queries; the candidates are all rows with
    another id. Repeated rows are candidates each; a repeated query row with the same vector is one
    query, and one id with several vectors gives a ranking for each. Vectors of unlike lengths are
    compared over the terms that both have. Scores are exact whatever the size of the components; a
    kept score that fits no long raises an error. An empty table gives no rows. Only ``id_col`` and
    ``vec_col`` are read, so other columns may have any names.
    """
    rows = usable(vectors, id_col, vec_col, scale)
    queries = rows.where(query_filter if query_filter is not None else F.lit(True)).dropDuplicates(["id", "v"])
    n = vectors.count()
    c_blocks = max(1, -(-n // block))
    # a third of all rows may be queries or not: blocks follow the count of either side
    q_blocks = max(1, -(-queries.count() // (WIDER * block)))
    spread = lambda blocks, salt: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(blocks)).cast("int")
    # repeated ids spread over the blocks, as the hash also takes the row's place in its partition
    cand = rows.withColumn("cb", F.pmod(F.xxhash64(F.col("id"), F.monotonically_increasing_id()), F.lit(c_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    quer = queries.withColumn("qb", spread(q_blocks, 1)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["id"].to_numpy()
        block = Block(*_rows(left["v"]))
        q_ids, q_keys, (q_values, q_at) = right["id"].to_numpy(), right["query_key"].to_numpy(), _rows(right["v"])
        found: list[list[np.ndarray]] = [[], [], [], []]
        for i, q in enumerate(q_ids):
            scores = block.scores(q_values[q_at[i] : q_at[i + 1]])
            others = np.nonzero(ids != q)[0] if (ids == q).any() else slice(None)
            at = best(scores[others], ids[others], k)
            kept = scores[others][at]
            if kept.dtype == object and any(not -(1 << 63) <= x < 1 << 63 for x in kept):
                raise OverflowError(f"a score of query {q} fits no long")
            for c, part in zip(found, (np.full(len(at), q), np.full(len(at), q_keys[i]), ids[others][at], kept.astype(np.int64)), strict=True):
                c.append(part)
        return pa.table([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in found], schema=schema)

    quer = quer.withColumn("query_key", F.xxhash64("v"))
    near = cand.groupBy("cb", "qb").cogroup(quer.groupBy("cb", "qb")).applyInArrow(search, "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best rows for every row whose vec_id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), k=10, query_filter=F.col("id") % 100 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, rk::INTEGER AS rank, vec_id, score FROM r WHERE rk <= 10
"""
