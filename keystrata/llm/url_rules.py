"""URL filters: listed host/path rules, and association rules mined from labels for the rest.

Spark's FP-growth mines token combinations of labelled URLs together with their label. A rule
"tokens -> label" stays if its confidence and support reach the minimum. Rules are posted under the
rarest of their tokens; a URL meets the rules posted under its own tokens and keeps those whose
tokens it has all. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import materialize, release, table

#: (verdict, host, path): a rule fits its host and all subdomains and all paths that start with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.6
#: Rules are broadcast up to this many (a rule is some 200 bytes); more are joined by their token.
BROADCAST_RULES = 20_000
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _AZ, _AZ.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def listed_rule(host, path, rules=RULES) -> F.Column:
    """(rule, verdict) of the longest listed rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url) -> F.Column:
    """Distinct tokens: scheme, labels of the host, path segments (digits as #), file type, query keys, fragment."""
    host, path = host_and_path(url)
    parts = lambda kind, array: F.transform(F.filter(array, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    plain = F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    every = F.concat(
        parts("scheme:", F.array(F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        parts("host:", F.split(host, r"\.")),
        parts("path:", F.split(F.regexp_replace(plain, "[0-9]+", "#"), "/")),
        parts("type:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
        parts("query:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))),
        parts("fragment:", F.array(F.regexp_extract(url, r"(?s)#(.*)$", 1))),
    )
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(anchor, items, verdict, confidence, support) from (url, verdict); no labels give no rules.

    The anchor is the rule's rarest token among the labelled URLs. Only support and confidence bound
    the rules: k tokens that occur together often enough give up to 2**k of them.
    """
    spark = labelled.sparkSession
    rows = materialize(labelled.where("url IS NOT NULL AND verdict IS NOT NULL").select(tokens(F.col("url")).alias("items"), F.concat(F.lit("="), "verdict").alias("label")).withColumn("id", F.monotonically_increasing_id()), "url-labelled")
    n = rows.count()
    schema = "anchor string, items array<string>, verdict string, confidence double, support double"
    if not n:
        return spark.createDataFrame([], schema)
    counts = materialize(rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")), "url-counts")
    some = counts.where(F.col("n") >= min_support * n)
    # at most 1 / min_support tokens per place in a url are frequent, so this side is small whatever the input
    kept = rows.select("id", F.explode("items").alias("item")).join(some.select("item"), "item", "left_semi").groupBy("id").agg(F.collect_list("item").alias("items"))
    basket = materialize(rows.select("id", "label").join(kept, "id").select(F.concat("items", F.array("label")).alias("items")), "url-baskets")
    if basket.isEmpty():
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(basket)
    found = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("="))).select(F.monotonically_increasing_id().alias("r"), F.array_sort("antecedent").alias("items"), F.expr("substring(consequent[0], 2)").alias("verdict"), "confidence", "support")
    found = materialize(found.where(~F.exists("items", lambda x: F.startswith(x, F.lit("=")))), "url-found")
    anchors = found.select("r", F.explode("items").alias("item")).join(counts, "item").groupBy("r").agg(F.min_by("item", F.struct("n", "item")).alias("anchor"))
    out = materialize(found.join(anchors, "r").select("anchor", "items", "verdict", "confidence", "support"), "url-rules")
    release(rows, counts, basket, found)
    return out


def undominated(rules: DataFrame) -> DataFrame:
    """The rules that can be the best of some URL. A rule is left out if it has a token more than
    another that ranks before it by confidence, then support: wherever it fits, so does that one."""
    key = lambda c: F.array_join(F.array_sort(c), " ")
    own = rules.withColumn("own", key("items"))
    shorter = own.select("own", "confidence", "support", "items", F.explode("items").alias("item")).select("own", "confidence", "support", key(F.expr("array_remove(items, item)")).alias("part"))
    parts = rules.select(key("items").alias("part"), F.col("confidence").alias("c"), F.col("support").alias("s"))
    better = (F.col("c") > F.col("confidence")) | ((F.col("c") == F.col("confidence")) & (F.col("s") > F.col("support")))
    worse = shorter.join(parts, "part").where(better).select("own", "confidence", "support").distinct()
    return own.join(worse, ["own", "confidence", "support"], "left_anti").select(*rules.columns)


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict, items, confidence): the best rule of each of the distinct ``urls`` that has one.

    Best is the highest confidence, then support, then the most tokens, then the least by order.
    """
    posted = materialize(undominated(rules), "url-posted").select("anchor", "items", "verdict", "confidence", "support")
    posted = F.broadcast(posted) if posted.count() <= BROADCAST_RULES else posted
    own = urls.select("url", tokens(F.col("url")).alias("own"))
    met = own.select("url", "own", F.explode("own").alias("anchor")).join(posted, "anchor")
    met = met.where(F.size(F.array_except("items", "own")) == 0)
    order = F.struct(-F.col("confidence"), -F.col("support"), -F.size("items"), F.array_join("items", " "), F.col("verdict"))
    return met.groupBy("url").agg(F.min_by(F.struct("verdict", "items", "confidence"), order).alias("x")).select("url", "x.*")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, learned): a verdict for every row of ``pages``.

    A listed rule decides if one fits, else the best mined rule, else ``default``. ``learned`` holds
    the mined rule's tokens where it decided. A null url has no host, path or tokens and gets
    the default; repeated rows are judged alike. Only the two named columns are read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
    left = rows.where("listed IS NULL AND url IS NOT NULL").select("url").distinct()
    mined = match(left, mine(labelled)).select(F.col("url").alias("u"), F.col("verdict").alias("v"), F.col("items"))
    out = rows.join(mined, F.col("url") == F.col("u"), "left")
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", "v", F.lit(default)).alias("verdict"), F.when(F.col("listed").isNull(), F.col("items")).alias("learned"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, verdict): block for low quality or toxic, by the label of the page's id; null labels are none."""
    verdict = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), "allow")
    return pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", verdict.alias("verdict"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rows = judge(pages, labelled_urls(pages, table(spark, sf_dir, "labels")))
    return rows.withColumn("learned", F.array_join("learned", " "))


OP2_SQL = """
WITH u AS (
  SELECT url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM (SELECT DISTINCT url FROM pages)),
t AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
         list_sort(list_distinct(list_filter(list_concat(
           ['scheme:' || regexp_extract(url, '(?s)^(.*?)://', 1)], list_transform(string_split(host, '.'), lambda x: 'host:' || x),
           list_transform(string_split(regexp_replace(regexp_replace(path, '\\.[A-Za-z0-9]+$', ''), '[0-9]+', '#', 'g'), '/'), lambda x: 'path:' || x),
           ['type:' || regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)],
           list_transform(string_split(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda x: 'query:' || regexp_extract(x, '^([^=]*)', 1)),
           ['fragment:' || regexp_extract(url, '(?s)#(.*)$', 1)]), lambda x: NOT ends_with(x, ':') OR length(x) - length(replace(x, ':', '')) > 1))) AS own
  FROM u),
l AS (
  SELECT row_number() OVER () AS r, own, label FROM (
    SELECT t.own, CASE WHEN quality = 0 OR toxic = 1 THEN 'block' WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 'allow' END AS label
    FROM pages p JOIN labels ON p.page_id = labels.doc_id JOIN t ON t.url = p.url) WHERE label IS NOT NULL),
c AS (SELECT item, count(*) AS n FROM (SELECT unnest(own) AS item FROM l) GROUP BY item),
k AS (SELECT item FROM c WHERE n >= 0.005 * (SELECT count(*) FROM l)),
b AS (SELECT r, label, list(item ORDER BY item) AS items FROM (SELECT r, label, unnest(own) AS item FROM l) WHERE item IN (SELECT item FROM k) GROUP BY r, label),
s AS (SELECT label, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items FROM (SELECT label, items, unnest(range(1, 1 << len(items))) AS m FROM b)),
f AS (SELECT items, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY items) AS every FROM s GROUP BY items, label),
rules AS (SELECT items, label, n / every::DOUBLE AS confidence, n / (SELECT count(*) FROM b)::DOUBLE AS support FROM f
          WHERE n >= ceil(0.005::DOUBLE * (SELECT count(*) FROM b)) AND n / every::DOUBLE >= 0.6),
m AS (SELECT t.url, rules.label, array_to_string(rules.items, ' ') AS learned FROM t JOIN rules ON list_has_all(t.own, rules.items) WHERE t.rule IS NULL
      QUALIFY row_number() OVER (PARTITION BY t.url ORDER BY confidence DESC, support DESC, len(rules.items) DESC, learned, rules.label) = 1)
SELECT p.page_id, coalesce(t.host, '') AS host, coalesce(t.path, '') AS path, t.rule,
       CASE WHEN t.rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN t.rule IS NOT NULL THEN 'block' ELSE coalesce(m.label, 'allow') END AS verdict, m.learned
FROM pages p LEFT JOIN t ON t.url = p.url LEFT JOIN m ON m.url = p.url
"""
