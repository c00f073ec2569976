"""Operators over documents against brute force: on the small tables and on rows made to be awkward."""

import hashlib
import pathlib
import random
import re
import tracemalloc
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from keystrata.llm import fuzzy_lines, minhash, mixing, quality, rank_bpe, registry, substrings, syncmers, token_counts
from tests.conftest import SF, same_rows

P = pytest.importorskip("public_tokenizers")
WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, label int"
A60 = " ".join(f"w{i}" for i in range(60))
AWKWARD = [
    (1, A60, "en", "b", 300),
    (2, A60 + " tail", "en", "b", 300),
    (3, A60, "en", "b", 300),
    (3, A60, "en", "b", 300),  # a repeated row
    (4, "", None, None, 0),
    (5, None, None, None, None),
    (6, " \n\t\n ", "en", "a", 5),
    (7, "one", "en", "a", 3),
    (8, "One", "en", "a", 3),
    (9, "short line 12\nshort line 99\nother", "en", "a", 30),
    (10, "x" * 30_000 + " " + "long " * 9000, "en", "a", 75_000),
    (None, "no id " + A60, "en", "c", 9),
    (None, None, None, None, None),
    (11, "Ünï cödé 🙂 ́x ﬁn\n\n\nÜnï cödé 🙂", "de", "c", 20),
    (12, "a<|endoftext|>b 's 've  \u3000 end", "en", "", 20),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "s", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(oracle):
    return oracle.sql("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


def words(text):
    return WORDS.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Quality


def test_quality_is_learned(spark, oracle):
    rows = registry.QUERIES["op1_quality"](spark, SF).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    from zlib import crc32

    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_quality_on_held_out_documents(spark, oracle):
    sf = "/root/testdata/sf0.1"
    scored = quality.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")))
    held = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), F.col("id") == F.col("doc_id")).where(quality.fold(F.col("id")) == 0).select("score", "quality").toPandas()
    good = held.score >= quality.THRESHOLD
    assert (good == (held.quality == 1)).mean() > 0.98 and good[held.quality == 1].mean() > 0.99


def test_quality_of_awkward_rows(spark):
    rows = frame(spark, AWKWARD)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (7, None, 0), (None, 1, 0), (9, 5, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(rows, labels)
    scores = quality.score_documents(rows, model).collect()
    assert len(scores) == len(AWKWARD) and all(0 <= r.score <= 1 for r in scores)
    assert quality.keep_good(rows, model, 0.0).schema == rows.schema and quality.keep_good(rows, model, 0.0).count() == len(AWKWARD)
    empty = quality.train(rows, labels.limit(0))
    assert {r.score for r in quality.score_documents(rows, empty).collect()} == {0.5}
    assert quality.score_documents(rows.limit(0), model).count() == 0


def test_quality_holds_few_texts(spark):
    """The pipeline's stage on a batch of 64 texts of a megabyte, of which a few are Python strings at a time."""
    texts = [f"text {i} " + "x" * 1_000_000 for i in range(64)] + ["", None]
    batch, scored = pa.RecordBatch.from_pydict({"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}), []
    model = SimpleNamespace(score=lambda i, v: scored.append(len(i)) or len(scored) % 2)
    found = SimpleNamespace(columns=["text", "n_chars"], schema=None, mapInArrow=lambda f, schema: f)
    found.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
    run = quality.keep_good(found, model)
    del texts
    tracemalloc.start()
    try:
        out = list(run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches([batch]).take(list(range(0, 66, 2)))) and len(scored) == 66
    assert most < 40e6
    assert [t for t, _ in quality.rows_of(batch.columns)] == batch.column(0).to_pylist() and not list(quality.rows_of(batch.slice(0, 0).columns))


def test_pairwise_part_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(0.1, rng.normal(size=50), rng.normal(size=(50, 4)))
    i, x = np.array([3, 7, 9, 20]), rng.normal(size=4)
    z = 0.1 + m.linear[i] @ x + sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert abs(m.score(i, x) - 1 / (1 + np.exp(-z))) < 1e-12


# Mixing


def test_mix_equals_sql(spark, oracle):
    same_rows(registry.QUERIES["op3_mix"](spark, SF), oracle.sql(registry.SQL["op3_mix"]))


def test_mix_of_awkward_rows(spark, oracle):
    import duckdb

    rows = frame(spark, AWKWARD)
    got = mixing.mix(rows)
    con = duckdb.connect()
    con.register("documents", rows.select("doc_id", "text", "source").toArrow())
    same_rows(got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")), con.sql(registry.SQL["op3_mix"]))
    taken = {r.source: r.n for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n")).collect()}
    copies = mixing.mixed_documents(rows)
    assert copies.columns == rows.columns
    assert {r.source: r.n for r in copies.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect() if r.n} == {k: v for k, v in taken.items() if v}
    assert mixing.mix(rows.limit(0)).count() == 0 and mixing.mixed_documents(rows.limit(0)).count() == 0


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, (5, 2, 1), 3).collect()}
    assert got["a"] == 30 and got["c"] == 0 and got[None] == 150 and abs(got["b"] - 880) < 1e-9


# Substrings


def brute_substrings(rows):
    first, out = {}, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w, o = words(t), float("inf") if i is None else i
        for p in range(len(w) - 49):
            first.setdefault(" ".join(w[p : p + 50]), o)
        out.append((i, w, o))
    for i, w, o in out:
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first[" ".join(w[p : p + 50])] < o:
                gone[p : p + 50] = [True] * 50
        yield i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))


def key(x):
    return repr(x)


@pytest.mark.parametrize("kind", ["table", "awkward"])
def test_substrings(spark, docs, kind):
    rows = docs if kind == "table" else AWKWARD + [(20, "new " + A60 + " end " + " ".join(f"w{i}" for i in range(5, 58))), (0, " ".join(f"w{i}" for i in range(3, 55)))]
    df = spark.read.parquet(f"{SF}/documents.parquet") if kind == "table" else frame(spark, [(*r, "en", "a", 1)[:5] if len(r) == 2 else r for r in rows])
    got = sorted((tuple(r) for r in substrings.removed_words(df).collect()), key=key)
    assert got == sorted(brute_substrings(rows), key=key)


def test_sql_of_substrings_and_near_copies(oracle, docs):
    assert sorted(oracle.sql(registry.SQL["op4_substrings"]).fetchall()) == sorted(brute_substrings(docs))
    got = oracle.sql(registry.SQL["op5_minhash"]).fetchall()
    assert sorted(r[:3] for r in got) == sorted(brute_components(docs, 2)) and all(kept == (i == c) for i, _, c, kept in got)


def test_substrings_edges(spark):
    assert substrings.removed_words(frame(spark, AWKWARD).limit(0)).count() == 0
    rows = [(1, "a b c d e f"), (2, "x a b c d y b c d e")]
    got = {r.doc_id: r.n_removed for r in substrings.removed_words(spark.createDataFrame(rows, "doc_id long, text string"), window=4).collect()}
    assert got == {1: 0, 2: 8}
    with pytest.raises(ValueError):
        substrings.Levels(3)


def test_window_hashes_compose():
    h = substrings.WordHashes().of([f"w{i}" for i in range(40)])
    lv = substrings.Levels(50)
    direct = [sum(int(h[p + i]) * pow(0x9E3779B97F4A7C15, 24 - i, 1 << 64) for i in range(25)) % (1 << 64) for p in range(16)]
    assert substrings.window_hashes(h, 25).tolist() == direct and (lv.quarter, lv.half, lv.full) == (13, 25, 50)


# Near copies


def brute_components(rows, width):
    sets = []
    for _, t, *_ in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[p : p + width]) for p in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            same = rows[a][0] is not None and rows[a][0] == rows[b][0]
            if same or k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for a in range(len(rows)):
        groups[find(a)].append(rows[a][0])
    return [(rows[a][0], len(sets[a]), min((i for i in groups[find(a)] if i is not None), default=None)) for a in range(len(rows))]


NEAR = AWKWARD + [(30 + i, " ".join(f"w{j}" if j % 20 != i else f"y{i}" for j in range(60)), "en", "a", 1) for i in range(8)] + [(50 + i, " ".join(f"v{j + i * 2}" for j in range(40)), "en", "a", 1) for i in range(12)]


@pytest.mark.parametrize("kind", ["table", "awkward"])
def test_near_copies(spark, docs, kind):
    if kind == "table":
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in registry.QUERIES["op5_minhash"](spark, SF).collect()]
        rows = docs
    else:
        rows = NEAR
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows, 2), key=key)


def test_one_of_each_group_stays(spark):
    # one id with unlike texts, rows without words, and clashing names
    more = [(70, "alone " + " ".join(f"u{j}" for j in range(30)), "en", "a", 1), (70, "other " + " ".join(f"t{j}" for j in range(30)), "en", "a", 1), (None, "", "en", "a", 0), (None, "", "en", "a", 0)]
    rows = frame(spark, NEAR + more).withColumns({"row": F.lit(1), "most": F.lit("m"), "th": F.lit(2), "own": F.lit(3)})
    kept = minhash.one_per_group(rows, width=5)
    assert kept.schema.fieldNames() == rows.schema.fieldNames()
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=key)
    # each row under an id of its own, in the order of ids, null ids last
    every = sorted(((i, t) for i, t, *_ in NEAR + more), key=lambda r: (r[0] is None, r[0] or 0))
    want = [every[i] for i, n, c in brute_components([(n, t) for n, (_, t) in enumerate(every)], 5) if i == c or not n]
    assert got == sorted(want, key=key)
    assert minhash.near_duplicates(rows.limit(0)).count() == 0 and minhash.one_per_group(rows.limit(0)).count() == 0


def test_ids_of_any_size(spark):
    text = " ".join(f"q{i}" for i in range(30))
    rows = [((1 << 62) + 5, text), ((1 << 63) - 1, text + " more"), (-4, "other words"), (None, text), (None, "nobody else")]
    got = sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=key)
    big = (1 << 62) + 5
    assert got == sorted([(big, big), ((1 << 63) - 1, big), (-4, -4), (None, big), (None, None)], key=key)


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 1200, dtype=np.uint64))
    b = np.concatenate([a[:1000], np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))])
    sig = [np.frombuffer(minhash.pack(minhash.minima(x)), np.uint64) for x in (a, b)]
    true = 1000 / (len(a) + len(b) - 1000)
    assert abs(minhash.estimate(sig[0], sig[1]) - true) < 0.12 and minhash.estimate(sig[0], sig[0]) == 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)], "src long, dst long")
    got = {r.v: r.label for r in minhash.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# Token counts


def test_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = frame(spark, AWKWARD)
    got = sorted(((r.id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(rows, P.path("word_bpe_49k.json"), chunk=2000, overlap=64).collect()), key=key)
    assert got == sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in AWKWARD), key=key)
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in registry.QUERIES["op6_token_counts"](spark, SF).collect()}
    assert got == {i: (n, n > 2048) for i, n in ((i, len(t.encode(x, add_special_tokens=False).ids)) for i, x, _ in docs)}
    assert token_counts.token_counts(rows.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_tokenizers_that_keep_blanks(spark):
    import json

    from tokenizers import Tokenizer

    specs = {}
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        with open(P.path(name), "rb") as f:
            specs[name] = json.load(f)
    assert token_counts.drops_space(specs["word_bpe_49k.json"]) and not token_counts.drops_space(specs["byte_bpe_50k.json"])
    word = specs["word_bpe_49k.json"]
    assert not token_counts.drops_space(word | {"normalizer": {"type": "Prepend", "prepend": "_"}}) and not token_counts.drops_space(word | {"pre_tokenizer": None})
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = False
    texts = [(i, x) for i, x in enumerate(["", "  two  blanks \n\n and  lines ", "a b" * 400, " x" * 900, "word " * 700, "\u00e9\u4e2d " * 300])]
    got = {r.id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(texts, "doc_id long, text string"), P.path("byte_bpe_50k.json"), chunk=200, overlap=32).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts}


def test_splices_of_random_texts():
    import random

    from tokenizers import Tokenizer

    random.seed(4)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        c = token_counts.ChunkedTokenizer(f.read(), 64, 8)
    bits = ["a", "b", " ", "  ", "É", "'s", "Σ", "é", "\n", "1", "<|endoftext|>", "!?", "́", "\xa0", "ﬁ", "the", "\x1c", "\x85", "İ"]
    for n in [3, 50, 400] * 60:
        x = "".join(random.choice(bits) for _ in range(n))
        want = t.encode(x, add_special_tokens=False).ids
        assert c.encode(x) == want and c.counts([x]) == [len(want)]
    assert c.encode("x" * 5000) == t.encode("x" * 5000, add_special_tokens=False).ids


# Lines


def normal_form(line):
    return re.sub("[\x20\t\x0b\f\r]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")


def distance(a, b):
    """Edit distance, a column of the table at a time as bits of one number."""
    if not a:
        return len(b)
    at, mask = defaultdict(int), (1 << len(a)) - 1
    for i, x in enumerate(a):
        at[x] |= 1 << i
    up, down, n = mask, 0, len(a)
    for x in b:
        same = at[x]
        flat = (((same & up) + up) ^ up) | same | down
        more, less = down | ~(flat | up), up & flat
        n += bool(more >> len(a) - 1 & 1) - bool(less >> len(a) - 1 & 1)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(flat | more)) & mask, more & flat & mask
    return n


def alike_pairs(lines):
    """Pairs of places of lines by edit distance alone: at most a tenth of the longer one. How often
    letters occur bounds the distance from below and rules most pairs out."""
    size = np.array([len(x) for x in lines])
    letters = np.zeros((len(lines), 64), np.int32)
    for i, x in enumerate(lines):
        np.add.at(letters[i], np.frombuffer(x.encode("utf-32-le"), np.uint32) % 64, 1)
    for i in range(len(lines)):
        most = np.maximum(size[:i], size[i]) // 10
        near = np.nonzero(np.abs(size[:i] - size[i]) <= most)[0]
        differ = np.abs(letters[near] - letters[i]).sum(1)
        for j in near[differ <= 2 * most[near]]:
            if distance(lines[i], lines[j]) <= most[j]:
                yield int(j), i


def brute_lines(rows):
    """Removed line numbers of rows (id, text), by comparing every pair of normal forms."""
    occ, first = [], {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n") if t is not None else []):
            line = normal_form(line)
            if line:
                occ.append(((1 << 63) - 1 if i is None else i, xxh(t, True), n, line))
    for *_, line in occ:
        first.setdefault(line, len(first))
    parent = list(range(len(first)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in alike_pairs(list(first)):
        parent[find(a)] = find(b)
    seen, gone = set(), defaultdict(set)
    for o, h, n, line in sorted(set(occ)):
        g = find(first[line])
        if g in seen:
            gone[o, h].add(n)
        seen.add(g)
    return gone


def xxh(text, signed=False):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if signed and h >> 63 else h


def test_distance():
    assert [distance(a, b) for a, b in (("", "ab"), ("ab", ""), ("kitten", "sitting"), ("abc", "abc"), ("flaw", "lawn"))] == [2, 2, 3, 0, 2]


LINES = [r for r in AWKWARD if r[0] != 10] + [(40 + i, " ".join(f"word{j}{'abcdefgh'[i] if j == i * 3 else ''}" for j in range(60)) + f"\nown line {'xyzuvwrs'[i]}", "en", "a", 1) for i in range(8)]
LINES += [(60, " ".join("abcd"[(i * i) % 4] + "e" for i in range(600)), "en", "a", 1), (61, "\n\n", "en", "a", 2), (62, "\u4e2d\u6587" * 60 + "\u5b57", "zh", "a", 1), (63, "\u4e2d\u6587" * 60 + "\u56fd", "zh", "a", 1), ((1 << 63) - 1, "the last id there is", "en", "a", 1)]
LINES += [(None, f"one of many rows without an id {i % 3}", "en", "a", 1) for i in range(6)]


@pytest.mark.parametrize("kind", ["table", "awkward"])
def test_lines(spark, docs, kind):
    rows = [(i, t) for i, t, _ in docs] if kind == "table" else [r[:2] for r in LINES]
    df = spark.createDataFrame(rows, "doc_id long, text string") if kind == "table" else frame(spark, LINES)
    got = {(r.ord, r.th): set(r.gone) for r in fuzzy_lines.removed_lines(df).collect()}
    assert got == dict(brute_lines(rows))


def test_fuzzy_lines_query(spark, docs):
    """The whole query against the comparison of all pairs of lines by edit distance alone."""
    gone, want = brute_lines([(i, t) for i, t, _ in docs]), []
    for i, t, _ in docs:
        lines = t.split("\n")
        kept = [x for n, x in enumerate(lines) if n not in gone[i, xxh(t, True)]]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    got = registry.QUERIES["op7_fuzzy_lines"](spark, SF)
    assert got.columns == ["doc_id", "n_lines", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(r[2] for r in want) > 0


@pytest.mark.parametrize("n_pairs", [1, 40])
def test_all_of_a_key_is_compared(spark, n_pairs):
    """Pairs of lines with one beginning and an edit in most other words, which leaves them few words in common."""
    import random

    rng = random.Random(n_pairs)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    same, n = ([word(7) for _ in range(6)], 7) if n_pairs == 1 else ([word(10) for _ in range(4)], 10)
    rows = []
    for i in range(n_pairs):
        own = [word(n) for _ in range(8 if n_pairs == 1 else 5)]
        rows += [(2 * i, " ".join(same + own)), (2 * i + 1, " ".join(same + [w[:3] + "#" + w[4:] for w in own]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.ord, r.th): set(r.gone) for r in fuzzy_lines.removed_lines(df).collect()}
    assert got == dict(brute_lines(rows)) and len(got) == n_pairs


def test_lines_stage_compares_all_of_a_key(spark):
    """The pipeline's stage on lines of one beginning, each with a copy of which most other words are edited."""
    import corpus_pipeline

    made = lambda i, j: sha(f"{i} {j}").translate(str.maketrans("0123456789", "ghijklmnop"))[:10]
    same, rows = [made(-1, j) for j in range(4)], []
    for i in range(30):
        own = [made(i, j) for j in range(5)]
        rows += [(2 * i, " ".join(same + own)), (2 * i + 1, " ".join(same + [w[:3] + "#" + w[4:] for w in own]))]
    out = corpus_pipeline.fresh_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(map(tuple, out.collect())) == rows[::2]


def test_very_long_lines(spark):
    a, b = (" ".join(f"{x}{i * 7919 % 1000:03d}x" for i in range(4000)).translate(str.maketrans("0123456789", "abcdefghij")) for x in "kq")
    rows = [(1, a), (2, a[:9000] + "edit" + a[9000:]), (3, b), (4, a + "\n" + "z" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.ord, *r.gone) for r in fuzzy_lines.removed_lines(df).collect()} == {(2, 0), (4, 0)}


def test_deduplicated_lines(spark):
    rows = frame(spark, LINES)
    out = fuzzy_lines.deduplicate_lines(rows)
    assert out.columns == rows.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[9].text == "short line 12\nother" and got[9].n_chars == len(got[9].text)
    assert 1 in got and 3 not in got and got[4].text == "" and got[5].text is None and got[6].text == " \n\t\n "
    assert fuzzy_lines.removed_lines(rows.limit(0)).count() == 0 and fuzzy_lines.deduplicate_lines(rows.limit(0)).count() == 0


def test_lines_beside_clashing_columns(spark):
    named = "doc_id long, text string, row string, lines string, kept int, ord int, th int, gone string, k1 string, key string"
    df = spark.createDataFrame([(i, "the same line here\n" + "abc"[i] * 9, "r", "l", i, 1, 2, "g", "k", "y") for i in range(3)], named)
    got = sorted(fuzzy_lines.deduplicate_lines(df).collect())
    assert [tuple(r) for r in got] == [(i, ("the same line here\n" if not i else "") + "abc"[i] * 9, "r", "l", i, 1, 2, "g", "k", "y") for i in range(3)]


def test_unlike_lines_of_a_key_make_no_rows(spark, monkeypatch):
    """Lines that have a run in common and nothing else are compared without a row for each two of them; one has a copy."""
    import random

    rng, write, made = random.Random(5), fuzzy_lines.materialize, []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 8)))
    rows = [(i, " ".join([word() for _ in range(12)] + ["common", "run", "of", "several", "words"] + [word() for _ in range(12)])) for i in range(80)]
    rows.append((99, "".join("#" if n % 11 == 5 and "common" not in rows[40][1][n - 5 : n + 30] else c for n, c in enumerate(rows[40][1]))))

    def counted(df, tag, *a):
        out = write(df, tag, *a)
        if tag == "line-unlike":
            made.append(out.count())
        return out

    monkeypatch.setattr(fuzzy_lines, "materialize", counted)
    got = {(r.ord, r.th): set(r.gone) for r in fuzzy_lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(brute_lines(rows)) and len(got) == 1
    assert made and sum(made) <= 80  # 80 * 79 / 2 pairs have the key


def test_missing_pieces_bound_the_distance(spark):
    """What sketches count is never more than the edits, at lengths where their sizes change and in lines that repeat words."""
    import random

    rng, rows = random.Random(6), []
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    for i in range(240):
        n = [3, 4, 5, 30, 99, 104, 200, 409, 415, 820, 1640][i % 11]
        line = " ".join(word() for _ in range(n)) if i % 3 else " ".join([word()] * (n // 3 + 1) + [word() for _ in range(3)])
        a = b = line[:n].strip() or "x"
        for _ in range(rng.randint(0, 2 + n // 10)):
            at = rng.randint(0, len(b))
            b = b[:at] + rng.choice(["", "#", " ab"]) + b[at + rng.randint(0, 1) :]
        rows.append((i, a, b or "y"))
    df = spark.createDataFrame(rows, "id long, a string, b string")
    for counted in (False, True):
        a, b = (fuzzy_lines.sketches(df.select("id", F.col(x).alias("text")), counted).toDF("id", f"{x}_pieces", f"{x}_grams") for x in "ab")
        got = df.join(a, "id").join(b, "id").select(F.levenshtein("a", "b").alias("d"), fuzzy_lines.missing(F.col("a_pieces"), F.col("b_grams")).alias("x"), fuzzy_lines.missing(F.col("b_pieces"), F.col("a_grams")).alias("y")).collect()
        assert len(got) == len(rows) and all(max(r.x, r.y) <= r.d for r in got) and sum(r.x + r.y for r in got) > sum(r.d for r in got) / 4


def test_disk_of_lines(spark, monkeypatch, tmp_path):
    """What the first steps of line dedup, up to the keys of blocks, have on disk at most, a step's shuffles and the tables there are, beside the size of the input."""
    import random

    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    text = lambda: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60))) for _ in range(10))
    spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    df, write, steps = spark.read.parquet(str(tmp_path / "in")), fuzzy_lines.materialize, []
    folder = fuzzy_lines.materialize.__globals__["shared_dir"](spark).removeprefix("file:")
    there = lambda top: sum(f.stat().st_size for f in pathlib.Path(top).rglob("*.parquet"))

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    def measured(df, tag, *a):
        before = shuffled()
        out = write(df, tag, *a)
        steps.append((shuffled() - before + there(folder) - floor, tag))
        if tag == "line-keys":
            raise InterruptedError
        return out

    monkeypatch.setattr(fuzzy_lines, "materialize", measured)
    floor = there(folder)
    with pytest.raises(InterruptedError):
        fuzzy_lines.removed_lines(df)
    assert max(steps)[0] < 2.8 * there(tmp_path / "in"), [(round(n / there(tmp_path / "in"), 2), tag) for n, tag in steps]


def brute_block(words):
    """The SimHash of a block's words, a bit at a time."""
    h, out = [xxh(w) for w in words], 0
    for j in range(fuzzy_lines.LONGS):
        for i in range(6):
            b = fuzzy_lines.STRIDE * i + j
            out |= (2 * sum(x >> 4 + b & 1 for x in h) > len(h)) << b
    return out


def test_block_simhashes(spark):
    for n in (1, 2, 3, 8, 200, 511):
        words = [f"w{i}" for i in range(n)]
        df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("h", F.xxhash64("w"))
        sums = df.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"c{j}") for j, c in enumerate(fuzzy_lines.counters(F.col("h")))))
        got = sums.select(fuzzy_lines.majority(F.col("n"), [F.col(f"c{j}") for j in range(fuzzy_lines.LONGS)]).alias("x")).head().x
        assert got == brute_block(words)


@pytest.mark.parametrize("n_words", [2, 5, 10, 20, 40])
def test_recall_of_edited_lines(spark, n_words):
    """Lines of made-up words and copies with one edited character, or one other word where that is within a tenth."""
    import random

    rng = random.Random(n_words)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, near = [], []
    for i in range(150):
        words = [word(rng.randint(4, 7)) for _ in range(n_words)]
        line = " ".join(words)
        if i % 2 and n_words >= 10:  # 1 to 3 other words in place of some, as long as them
            for k in rng.sample(range(n_words), rng.randint(1, 1 + n_words // 20)):
                words[k] = word(len(words[k]))
            other = " ".join(words)
        else:  # characters changed, left out or added
            other = list(line)
            for at in rng.sample(range(len(line)), rng.randint(1, 1 + n_words // 20)):
                other[at : at + 1] = [["#"], [], [other[at], "#"]][i % 3]
            other = normal_form("".join(other))
        rows += [(2 * i, line), (2 * i + 1, other)]
        if distance(line, other) <= max(len(line), len(other)) // 10:
            near.append(2 * i + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.ord for r in fuzzy_lines.removed_lines(df).collect()}
    assert len(near) > 100 and got <= set(near) and len(got) >= 0.95 * len(near)
    # lines that share most words but are no near copies stay
    words = rows[0][1].split(" ")
    far = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[: n_words * 2 // 3] + [word(6) for _ in range(n_words - n_words * 2 // 3)]))], df.schema)
    assert fuzzy_lines.removed_lines(far).count() == 0


@pytest.mark.parametrize("n_words", [5, 9, 40, 90])
def test_recall_of_spread_edits(spark, n_words):
    """Lines with as many edited characters, spread over all of them, as still make a near copy, or just fewer;
    in every tenth line most words are repeated."""
    import random

    rng = random.Random(n_words)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 7)))
    rows, near = [], []
    for i in range(100):
        line = " ".join([word() for _ in range(n_words)] if i % 10 else [word() for _ in range(4)] + [word(), word()] * (n_words // 2 - 1))
        most = len(line) // 10
        other = list(line)
        for at in rng.sample(range(len(line)), max(1, most * (7 + i % 3) // 9)):
            other[at] = rng.choice(["#", "", other[at] + "#"])
        other = normal_form("".join(other))
        rows += [(2 * i, line), (2 * i + 1, other)]
        if distance(line, other) <= max(len(line), len(other)) // 10:
            near.append(2 * i + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.ord for r in fuzzy_lines.removed_lines(df).collect()}
    assert len(near) > 60 and got <= set(near) and len(got) >= 0.95 * len(near)


# Byte-level BPE


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = rank_bpe.read_ranks(f.read())
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, docs, reference):
    _, t = reference

    def row(i, x):
        ids = t.encode_ordinary(x or "")
        return i, len(ids), sha(",".join(map(str, ids))), sha(x or "")

    assert sorted((tuple(r) for r in rank_bpe.digest_documents(frame(spark, AWKWARD)).collect()), key=key) == sorted((row(i, x) for i, x, *_ in AWKWARD), key=key)
    assert sorted(tuple(r) for r in registry.QUERIES["op8_rank_bpe"](spark, SF).collect()) == sorted(row(i, x) for i, x, _ in docs)


def test_bpe_round_trip(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoded = rank_bpe.encode_documents(frame(spark, AWKWARD), path, P.PATTERN)
    back = rank_bpe.decode_documents(encoded, path)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=key) == sorted(((i, x or "") for i, x, *_ in AWKWARD), key=key)
    assert rank_bpe.encode_documents(frame(spark, AWKWARD).limit(0), path, P.PATTERN).count() == 0


def test_rank_queue_on_long_and_random_pieces(reference):
    import random

    ranks, t = reference
    codec = rank_bpe.RankBPE(ranks, P.PATTERN)
    random.seed(2)
    for piece in ["a" * 3000, "é" * 999, "!" * 777, *("".join(random.choice("abetionsé") for _ in range(n)) for n in [1, 2, 3, 10, 50, 2000] * 5)]:
        assert codec.encode(piece) == t.encode_ordinary(piece) and codec.decode(codec.encode(piece)).decode() == piece
    assert not any(codec.words)  # the queue is empty again


def test_splitter_agrees_on_all_code_points(reference):
    ranks, t = reference
    codec = rank_bpe.RankBPE(ranks, P.PATTERN)
    for c in list(range(0, 0x3100)) + list(range(0x3100, 0xD800, 37)) + list(range(0xE000, 0x110000, 997)):
        x = f"a {chr(c)} {chr(c)}b1"
        assert codec.encode(x) == t.encode_ordinary(x), hex(c)


# Fingerprints


@pytest.mark.parametrize("kind", ["table", "awkward"])
def test_edited_texts(spark, docs, kind):
    rows = [(i, t) for i, t, _ in docs] if kind == "table" else [r[:2] for r in AWKWARD]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = syncmers.with_next(df, syncmers.edited_fingerprints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").collect()
    tie = lambda t: xxh(t or "", True)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        f, g, h = map(syncmers.fingerprint, (t, edited, nxt))
        want.append((i, len(t), sha(edited), f, g, syncmers.likeness(f, g), syncmers.likeness(f, h)))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_likeness():
    a = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    f = syncmers.fingerprint
    assert syncmers.likeness(f(a), f(a)) == 1 and f("") == "" and syncmers.likeness("", f("x")) == 0
    assert syncmers.likeness(f(a), f("prefix " + a)) > 0.9 and syncmers.likeness(f(a), f(a[::-1])) < 0.1
    half = a[: len(a) // 2]
    assert 0.3 < syncmers.likeness(f(a), f(half)) < 0.7


def brute_anchors(text, k, s):
    """{k-mer: its first place} of closed syncmers, from strings alone but for the order of s-mers."""
    power = 0x9E3779B97F4A7C15
    mixed = lambda x: int(syncmers._mix(np.array([sum((ord(c) + 1) * pow(power, len(x) - 1 - i, 1 << 64) for i, c in enumerate(x)) % (1 << 64)], np.uint64))[0])
    kmers = [text[p : p + k] for p in range(len(text) - k + 1)]
    least = lambda x: min(mixed(x[i : i + s]) for i in range(k - s + 1))
    own = [p for p, x in enumerate(kmers) if least(x) in (mixed(x[:s]), mixed(x[-s:]))]
    own = own or [min(range(len(kmers)), key=lambda p: mixed(kmers[p]))]
    out = {}
    for p in own:
        out.setdefault(kmers[p], p)
    return out


def brute_likeness(a, b, k, s):
    """Of texts with fewer anchors than a fingerprint keeps: common ones in one order, of all."""
    x, y = brute_anchors(a, k, s), brute_anchors(b, k, s)
    pairs = sorted((x[w], y[w]) for w in x if w in y)
    best = [0] * (len(pairs) + 1)
    for i in range(len(pairs)):
        best[i] = 1 + max((best[j] for j in range(i) if pairs[j][1] < pairs[i][1]), default=0)
    return max(best, default=0) / len(x.keys() | y.keys())


def test_likeness_of_short_texts_by_definition():
    import random

    rng = random.Random(3)
    made = lambda n: "".join(rng.choice("abcdefghij é\u4e2d") for _ in range(n))
    for n in range(1, syncmers.SHORT):
        for _ in range(12):
            a, other = made(n), made(rng.randint(1, 40))
            for b in (a[: n - n // 4] + other[: n // 4], other, a):
                got = syncmers.likeness(*map(syncmers.fingerprint, (a, b)))
                assert 0 <= got <= 1 and (got == 1) >= (a == b)
                if min(len(a), len(b)) >= syncmers.SHORT_K:
                    assert got == pytest.approx(brute_likeness(a, b, syncmers.SHORT_K, syncmers.SHORT_S))
                elif a != b:
                    assert got < 1
            assert syncmers.fingerprint(a) and syncmers.likeness(syncmers.fingerprint(a), "") == 0
    far = [made(n) for n in range(20, 31) for _ in range(40)]
    assert max(syncmers.likeness(*map(syncmers.fingerprint, p)) for p in zip(far, far[1:])) < 0.5


def test_likeness_of_longer_texts_by_definition():
    import random

    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    for n in (64, 100, 150, 250):
        a, other = made(n), made(n)
        for b in (a[: n - n // 4] + other[: n // 4], "x" + a, other):
            assert len(syncmers.anchors(b)[0]) <= syncmers.KEEP
            assert syncmers.likeness(*map(syncmers.fingerprint, (a, b))) == pytest.approx(brute_likeness(a, b, syncmers.K, syncmers.S))


def test_likeness_of_long_texts_by_definition():
    """Texts of many anchors: all count, and a passage that two have in common is seen."""
    import random

    rng = random.Random(6)
    made = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    a, b, passage = made(6000), made(6000), made(150)
    for x, y in ((a, a[:4500] + b[:1500]), (a[:2000] + passage + a[2000:], b[:5000] + passage + b[5000:]), (a, b)):
        own = brute_anchors(x, syncmers.K, syncmers.S)
        assert syncmers.fingerprint(x).count(":") == len(own) > 10 * syncmers.KEEP
        assert syncmers.likeness(*map(syncmers.fingerprint, (x, y))) == pytest.approx(brute_likeness(x, y, syncmers.K, syncmers.S))
    assert syncmers.likeness(*(syncmers.fingerprint(z[:3000] + passage + z[3000:]) for z in (a, b))) > 0


def test_next_beside_clashing_columns(spark):
    rows = [(i, f"text {i} " * 20, 1, 2, "a", "t", "b") for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int, ahead int, at string, tie string, id string")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    assert sorted(r.doc_id for r in syncmers.with_next(df, syncmers.edited_fingerprints, schema).collect()) == [1, 2, 3]


def test_syncmers_by_definition():
    text = "".join(chr(97 + i * i % 23) for i in range(120))
    codes = np.array([ord(c) + 1 for c in text], object)
    power = 0x9E3779B97F4A7C15
    h = syncmers._mix(np.array([sum(int(codes[p + i]) * pow(power, 7 - i, 1 << 64) for i in range(8)) % (1 << 64) for p in range(len(text) - 7)], np.uint64))
    want = [p for p in range(len(text) - 19) if h[p : p + 13].min() in (h[p], h[p + 12])]
    assert syncmers.anchors(text)[1].tolist() == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert syncmers.with_next(df, syncmers.edited_fingerprints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").count() == 0


def test_folded_sketches_bound_no_sharper_than_whole_ones(spark):
    # lines of one to four times the least longs; where there is no more than the least, the bounds are equal
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    forms = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.choice([4, 30, 60, 120])))) for i in range(40)], "id long, text string")
    few = range(fuzzy_lines.GRAM_LONGS[0])
    a = fuzzy_lines.folded_sketches(forms)
    b = a.toDF(*(f"b_{c}" for c in a.columns))
    folded = sum(F.bit_count(F.col(f"p{k}").bitwiseAND(F.bitwise_not(F.col(f"b_g{k}")))) for k in few)
    rows = a.crossJoin(b).where("size(pieces) <= 2 * size(b_grams) AND size(b_grams) <= 2 * size(pieces)")
    rows = rows.select("id", "b_id", F.size("pieces").alias("n"), F.size("b_grams").alias("m"), folded.alias("folded"), fuzzy_lines.missing(F.col("pieces"), F.col("b_grams")).alias("whole")).collect()
    assert all(r.folded <= r.whole and (r.n > len(few) or r.folded == r.whole) for r in rows)
    assert {r.n for r in rows} > {16, 32} and all(r.whole == 0 for r in rows if r.id == r.b_id) and any(r.folded > 0 for r in rows)
