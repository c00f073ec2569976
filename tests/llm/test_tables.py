"""URL rules, exact search and the pipeline."""

import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keystrata.llm import quality, registry, topk, url_rules
from tests.conftest import SF, same_rows

# URLs


def split_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def listed(host, path):
    fits = [(h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


URLS = [
    (1, "http://a.example.com/en/x"), (2, "http://www.example.com/en/"), (3, "http://EXAMPLE.com/en"), (4, "https://x.net/fr/1?q=1#f"), (5, "https://x.net"),
    (6, None), (7, ""), (8, "no scheme/en/"), (9, "http://"), (10, "ftp://notcom/en/"), (11, "http://x.com:80/en/"), (12, "http://a.net/es/"), (12, "http://a.net/es/"), (None, "http://éa.org/a//b.HTML?a=1&b&a=2#é"),
    (13, "x://y://com/"), (14, "http://h.com?x=/en/"),
]


def test_hosts_paths_and_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in URLS], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([], "url string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, labels).collect()), key=repr)
    want = []
    for i, u in URLS:
        host, path = split_url(u)
        rule, verdict = listed(host, path)
        want.append((i, host, path, rule, verdict or "allow"))
    assert got == sorted(want, key=repr)
    assert url_rules.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_by_brute_force(spark):
    rows = [(f"http://s{i % 4}.org/{'ads' if i % 3 == 0 else 'news'}/{i}", "block" if i % 3 == 0 and i % 4 != 1 else "allow") for i in range(120)] + [(None, "block"), ("http://x.org/", None)]
    mined = url_rules.mine(spark.createDataFrame(rows, "url string, verdict string"), 0.05, 0.8).collect()
    common = {"scheme:http", "host:org", "path:#"}
    data = [({f"host:s{i % 4}", f"path:{'ads' if i % 3 == 0 else 'news'}"} | common, v) for i, (u, v) in enumerate(rows[:120])]
    want = set()
    for some in {frozenset(c) for d, _ in data for n in range(1, 6) for c in combinations(sorted(d), n)}:
        cover = [v for d, v in data if some <= d]
        for v in ("block", "allow"):
            k = cover.count(v)
            if k >= 0.05 * 120 and k >= 0.8 * len(cover):
                want.add((tuple(sorted(some)), v, round(k / len(cover), 9)))
    assert want and {(tuple(r["items"]), r.verdict, round(r.confidence, 9)) for r in mined} == want
    assert all(r.anchor in r["items"] for r in mined)
    urls = spark.createDataFrame([("http://s0.org/ads/7",), ("http://s1.org/ads/7",), ("http://none.org/",)], "url string")
    rules = [(set(r["items"]), r.verdict, r.confidence, r.support) for r in mined]
    got = {r.url: r.verdict for r in url_rules.match(urls, url_rules.mine(spark.createDataFrame(rows, "url string, verdict string"), 0.05, 0.8)).collect()}
    for u, own in (("http://s0.org/ads/7", {"host:s0", "path:ads"} | common), ("http://s1.org/ads/7", {"host:s1", "path:ads"} | common)):
        fits = [(-c, -s, -len(t), " ".join(sorted(t)), v) for t, v, c, s in rules if t <= own]
        assert got.get(u) == (min(fits)[4] if fits else None)


def test_dominated_rules_are_never_the_best(spark):
    rng = np.random.default_rng(8)
    rows = [(f"http://h{rng.integers(3)}.org/p{'abc'[rng.integers(3)]}/?q{'xyz'[rng.integers(3)]}=1", "block" if rng.random() < 0.6 else "allow") for _ in range(300)]
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, verdict string"), 0.02, 0.5)
    every, some = ([(set(r["items"]), r.verdict, r.confidence, r.support) for r in x.collect()] for x in (rules, url_rules.undominated(rules)))
    assert 0 < len(some) < len(every) and all(r in every for r in some)
    best = lambda rules, own: min((-c, -s, -len(t), " ".join(sorted(t)), v) for t, v, c, s in rules if t <= own)
    for a in "012":
        for b in "abc":
            for c in "xyz":
                own = {"scheme:http", f"host:h{a}", "host:org", f"path:p{b}", f"query:q{c}"}
                assert best(every, own) == best(some, own)


def test_every_page_is_judged_as_sql_does(spark, oracle):
    same_rows(registry.QUERIES["op2_url_rules"](spark, SF), oracle.sql(registry.SQL["op2_url_rules"]))
    rows = registry.QUERIES["op2_url_rules"](spark, SF).collect()
    assert len(rows) == 50 and {r.verdict for r in rows} <= {"allow", "block"}


# Search


def test_search_equals_sql(spark, oracle):
    same_rows(registry.QUERIES["op10_top_k"](spark, SF), oracle.sql(registry.SQL["op10_top_k"]))


def test_search_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(300)]
    rows += [(100, rows[7][1]), (5, rows[5][1]), (None, [1.0]), (301, None), (302, [1.0, None]), (303, [float("nan")]), (304, [float("inf"), 1.0]), (400, []), (500, [2.0]), (501, [3e6, -1e8]), (502, [1.0] * 6), (503, [1e30])]
    rows = [r for r in rows if r[0] != 503]  # its scores fit no long, see below
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, 10, F.col("id") % 100 == 0, block=64).collect())
    use = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, qv in {(i, tuple(v)) for i, v in use if i % 100 == 0}:
        near = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in use if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), 10, F.col("id") % 100 == 0).count() == 0
    assert topk.top_k(df.where("vec_id < 3"), 10, F.col("id") == 0).count() == 2
    huge = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="no long"):
        topk.top_k(huge, 10, F.col("id") == 0).collect()


def test_search_of_large_components_equals_sql(spark):
    import duckdb

    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 1e6 if i % 3 else 1, 5)).astype(np.float32).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    exact = {(i, j): sum(int(np.floor(1024 * float(np.float32(a)))) * int(np.floor(1024 * float(np.float32(b)))) for a, b in zip(v, w)) for i, v in rows if i % 100 == 0 for j, w in rows}
    got = sorted(map(tuple, topk.top_k(df, 10, F.col("id") % 100 == 0, block=64).collect()))
    assert all(exact[q, v] == s for q, _, v, s in got) and len(got) == 40
    sql = con.sql(registry.SQL["op10_top_k"]).fetchall()
    assert {(q, k, v) for q, k, v, _ in got} == {(q, k, v) for q, k, v, _ in sql}


# Pipeline


def test_stages_in_turn(spark, oracle):
    from tests.llm.test_documents import brute_components, brute_lines, sha, words, xxh

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(90)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.id for r in quality.score_documents(docs, model).collect() if r.score >= quality.THRESHOLD}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near copies", "mix", "tokens"]
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    a = spark.createDataFrame(stages["quality"](spark, docs, SF).collect(), docs.schema)
    assert set(rows(a)) == good and a.columns == docs.columns
    b = spark.createDataFrame(stages["lines"](spark, a, SF).collect(), docs.schema)
    texts, gone = {i: r.text for i, r in rows(a).items()}, brute_lines([(i, r.text) for i, r in sorted(rows(a).items())])
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, xxh(t, True)]) for i, t in texts.items()}
    want = {i: t for i, t in want.items() if words(t) or not words(texts[i])}
    assert {i: r.text for i, r in rows(b).items()} == want and all(r.n_chars == len(r.text) for r in rows(b).values())
    c = spark.createDataFrame(stages["near copies"](spark, b, SF).collect(), docs.schema)
    assert set(rows(c)) == {i for i, _, k in brute_components(sorted(want.items()), 5) if i == k}
    d = spark.createDataFrame(stages["mix"](spark, c, SF).collect(), docs.schema)
    taken, size = defaultdict(int), defaultdict(int)
    for r in d.collect():
        taken[r.source] += len(words(r.text))
    for r in c.collect():
        size[r.source] += len(words(r.text))
    assert set(rows(d)) <= set(rows(c)) and all(v <= 3 * size[s] for s, v in taken.items()) and abs(sum(taken.values()) - sum(size.values())) < 0.2 * sum(size.values())
    e = stages["tokens"](spark, d, SF).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in e) == sorted((r.doc_id, sha(r.text)) for r in d.collect())


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
