"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; the bucket in which a source's running sum crosses its
budget is refined, and only that one, by the next bits of the hash, until it holds a single hash
value. Which rows are taken is then a comparison of a row's hash with its source's threshold: rows
are never sorted, and a larger budget takes a superset of a smaller one's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.llm.common import WORD_CLASS, materialize, release, table

HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text) -> F.Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def row_hash(id_col, text_col) -> F.Column:
    """60 bits that depend on nothing but a row's id and text, so reruns agree."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text_col, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source in and out.

    Weights repeat over the sources by code point, null last. A target stops at ``max_repeat``
    times its source's size; the excess goes to the others by weight. In the order of cap/weight
    the capped sources come first, so one pass of running sums finds them all. Sources are sorted
    in one task, a row of some 40 bytes each: meant for up to some millions of them.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_repeat)
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")
    rest_w = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("capped", F.col("cap").cast("double") * rest_w <= (F.col("total") - before).cast("double") * F.col("w"))
    capped = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    free_w = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("total") - capped).cast("double") * F.col("w") / F.nullif(free_w, F.lit(0)))
    return rows.select("source", "source_size", target.alias("target"))


def same_source(a: DataFrame, b: DataFrame) -> F.Column:
    return a["source"].eqNullSafe(b["source"])


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, threshold): rows with hash <= threshold make up each source's ``rest`` most nearly.

    A level sums the sizes of ``2**LEVEL_BITS`` buckets per source, of the boundary bucket alone
    from the second level on. Rows with equal hashes (same id and text) are taken or left together.
    """
    state = plan.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    done, old = [], []
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = sized.join(state, same_source(sized, state)).where(F.shiftright(sized["h"], shift + LEVEL_BITS) == state["prefix"])
        bucket = inside.groupBy(sized["source"], F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("rest").alias("rest"), F.first("below").alias("below"))
        run = Window.partitionBy("source").orderBy("bucket")
        reach = bucket.withColumn("reach", F.col("below") + F.sum("size").over(run))
        # the first bucket that reaches the budget, else the last one there is
        mark = F.when(F.col("reach") >= F.col("rest"), F.struct(F.lit(0).alias("o"), F.col("bucket").alias("b"))).otherwise(F.struct(F.lit(1).alias("o"), (-F.col("bucket")).alias("b")))
        found = reach.groupBy("source").agg(F.min_by(F.struct("bucket", "size", "low", "high", "rest", "reach"), mark).alias("x")).select("source", "x.*")
        found = materialize(found, "mix-level")
        old.append(found)
        one = F.col("low") == F.col("high")
        take = F.col("reach") - F.col("rest") <= F.col("rest") - (F.col("reach") - F.col("size"))
        done.append(found.where(one).select("source", F.when(take, F.col("high")).otherwise(F.col("low") - 1).alias("threshold")))
        state = found.where(~one).select("source", "rest", F.col("bucket").alias("prefix"), (F.col("reach") - F.col("size")).alias("below"))
        if state.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = materialize(out, "mix-threshold")
    release(*old)
    return out


def mix_plan(docs: DataFrame, weights: tuple[int, ...], max_repeat: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of all rows, and one row per source: (s, source_size, target, base, threshold)."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("h"))
    sized = materialize(sized, "mix-sizes")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = materialize(plan.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")), "mix-plan")
    limit = thresholds(sized, plan)
    return sized, plan.join(limit, same_source(plan, limit)).select(plan["source"].alias("s"), "source_size", "target", "base", "threshold")


def _copies(h, max_repeat: int) -> F.Column:
    return F.least(F.lit(max_repeat).cast("long"), F.col("base") + (h <= F.col("threshold")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, copies): how often the mix takes each row.

    The sources share 100 % of all words by weight. A source's rows are all taken
    floor(target / source_size) times, and the rows under its threshold once more. Null texts and
    texts without words have size 0; a null source is a source of its own; null ids are allowed.
    An empty table gives no rows. Only the three named columns are read.
    """
    sized, plan = mix_plan(docs, weights, max_repeat, id_col, text_col, source_col)
    return sized.join(plan, sized["source"].eqNullSafe(plan["s"])).select("doc_id", "size", "source", "source_size", "target", _copies(F.col("h"), max_repeat).alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as :func:`mix` takes it.

    A row's hash is compared with its source's threshold; rows are neither sorted nor joined to rows.
    """
    sized, plan = mix_plan(docs.select("doc_id", "text", "source"), weights, max_repeat, "doc_id", "text", "source")
    release(sized)
    # the row is one column, so its own names clash with none
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("own"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    rows = rows.join(plan, F.col("own").eqNullSafe(F.col("s"))).withColumn("copies", _copies(F.col("h"), max_repeat))
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix by weights 5, 2, 1 takes."""
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w,
             (3 * source_size)::BIGINT AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s),
c AS (SELECT *, cap::DOUBLE * (sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT
        <= (total - (sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))::BIGINT::DOUBLE * w AS capped FROM w),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
        (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT::DOUBLE * w
        / nullif((sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::BIGINT, 0) END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS base FROM t),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.base, p.target - p.base * p.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS cum,
             sum(d.size) OVER (PARTITION BY d.source, h) AS own
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * least(3, base + CASE WHEN cum - rest <= rest - (cum - own) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
