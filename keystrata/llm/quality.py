"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise part is taken
in linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import find_words, table

#: Most labelled documents that a model is fitted on, the first by a hash of their ids.
SAMPLE_BOUND = 6000
THRESHOLD = 0.3
_MEMO_WORDS = 300_000
#: Bytes of texts that are made Python strings at once; a longer text is by itself.
_HELD_BYTES = 1 << 20
_shape = [(re.compile(a), b) for a, b in (("[a-zà-öø-ÿ]+", "a"), ("[A-ZÀ-ÖØ-Þ]+", "A"), ("[0-9]+", "0"), (r"(\W)\1+", r"\1+"), ("[^\x00-\x7f]", "u"))]
#: Bytes as classes: other, lower, upper, digit, white space, punctuation, above ASCII.
_CLASS = np.array([6 if b > 127 else 1 if chr(b).islower() else 2 if chr(b).isupper() else 3 if chr(b).isdigit() else 4 if b in b" \t\n\r\v\f" else 5 if 32 < b < 127 else 0 for b in range(256)], np.uint8)


class Features:
    """Sparse features of a document, in three blocks of unit length: words, shapes, statistics."""

    def __init__(self, bits: int = 16):
        self.size = 1 << bits
        self.memo: dict[str, tuple[int, int]] = {}

    def hashed(self, name: str) -> int:
        return crc32(name.encode("utf-8", "surrogatepass")) * 0x9E3779B1 % (1 << 32) % self.size

    def word(self, w: str) -> tuple[int, int]:
        shape = w
        for find, put in _shape:
            shape = find.sub(put, shape)
        if len(self.memo) >= _MEMO_WORDS:
            self.memo.clear()
        out = self.memo[w] = self.hashed("w:" + w.lower()), self.hashed("s:" + shape)
        return out

    def __call__(self, text: str | None, metadata: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values; an empty or null text has its statistics and metadata alone."""
        text = text or ""
        counts = Counter(find_words(text))
        n = sum(counts.values())
        memo, word = self.memo, self.word
        both = [memo.get(w) or word(w) for w in counts]
        number = np.fromiter(counts.values(), np.float64, len(counts))
        words = np.fromiter((a for a, _ in both), np.int64, len(both))
        shapes, at = np.unique(np.fromiter((b for _, b in both), np.int64, len(both)), return_inverse=True)
        shaped = np.bincount(at, weights=number, minlength=len(shapes)) / max(n, 1)
        stats = np.fromiter(map(self.hashed, self.statistics(text, counts, n, metadata)), np.int64)
        parts = [(words, np.log1p(number)), (shapes, np.sqrt(shaped)), (stats, np.ones(len(stats)))]
        values = [v / (np.sqrt(v @ v) or 1) * scale for (_, v), scale in zip(parts, (1.0, 2.0, 2.0), strict=True)]
        return np.concatenate([i for i, _ in parts]).astype(np.int32), np.concatenate(values).astype(np.float32)

    def statistics(self, text: str, counts: Counter, n: int, metadata: tuple) -> list[str]:
        """Names of the buckets that the text's statistics and the metadata fall in."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        kinds = np.bincount(_CLASS[data], minlength=7)
        lines = text.split("\n")
        share = lambda a, b: round(12 * a / b) if b else -1
        letters = kinds[1] + kinds[2] + kinds[6]
        out = [f"u:{share(kinds[2], letters)}", f"p:{share(2 * kinds[5], len(data))}", f"d:{share(kinds[3], len(data))}", f"x:{share(kinds[0], len(data))}"]
        out += [f"r:{share(len(counts), n)}", f"t:{share(max(counts.values(), default=0), n)}", f"l:{share(len(set(lines)), len(lines))}"]
        out += [f"n:{int(2 * math.log2(n + 1))}", f"m:{min(30, round(len(text) / (n + 1)))}", f"k:{int(2 * math.log2(n / len(lines) + 1))}"]
        return out + [f"meta{i}:" + ("none" if v is None else str(int(2 * math.log2(abs(v) + 1))) if isinstance(v, (int, float)) and math.isfinite(v) else str(v)) for i, v in enumerate(metadata)]


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        """Probability of label 1, in time linear in the number of features."""
        own = self.factors[index] * value[:, None]
        total = own.sum(0)
        z = self.bias + float(self.linear[index] @ value) + 0.5 * float(total @ total - (own * own).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[float, np.ndarray, np.ndarray]], size: int, rank: int = 6, epochs: int = 25, batch: int = 512, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """Logistic loss by Adam over mini-batches. Without rows the score is 0.5 for everything."""
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(size), rng.normal(0, 0.02, (size, rank))
    if not rows:
        return FactorisationMachine(0.0, linear.astype(np.float32), np.zeros((size, rank), np.float32))
    mean = min(0.99, max(0.01, sum(y for y, _, _ in rows) / len(rows)))
    params = [np.array([math.log(mean / (1 - mean))]), linear, factors]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            some = [rows[i] for i in order[at : at + batch]]
            y = np.array([r[0] for r in some])
            index, value = np.concatenate([r[1] for r in some]), np.concatenate([r[2] for r in some]).astype(np.float64)
            doc = np.repeat(np.arange(len(some)), [len(r[1]) for r in some])
            own = factors[index] * value[:, None]
            total = np.stack([np.bincount(doc, own[:, f], len(some)) for f in range(rank)], 1)
            z = params[0][0] + np.bincount(doc, linear[index] * value, len(some)) + 0.5 * ((total**2).sum(1) - np.bincount(doc, (own * own).sum(1), len(some)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(some)
            gv = g[doc] * value
            grads = [np.array([g.sum()]), np.bincount(index, gv, size) + decay * linear, np.stack([np.bincount(index, gv * (total[doc, f] - own[:, f]), size) for f in range(rank)], 1) + decay * factors]
            step += 1
            for p, d, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return FactorisationMachine(float(params[0][0]), linear.astype(np.float32), factors.astype(np.float32))


def fold(id_col) -> F.Column:
    """crc32 of the id as text, modulo 5; a null id is in no held-out fold."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def rows_of(columns: list[pa.Array]) -> Iterator[tuple]:
    """The rows of a text column and others, made Python objects a few texts at a time: a whole batch
    of 10,000 texts would be held twice."""
    at, n = 0, len(columns[0])
    ends = np.cumsum(pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _HELD_BYTES, "right")))
        yield from zip(*(c.slice(at, to - at).to_pylist() for c in columns), strict=True)
        at = to


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", metadata: tuple[str, ...] = ("n_chars",), bound: int = SAMPLE_BOUND) -> FactorisationMachine:
    """Fit on at most ``bound`` labelled documents outside fold 0, features made on the executors.

    Labels other than 0 and 1 and null ids are left out; a document with several labels takes their
    mean, an id with several texts the first of them by order. Empty tables, or no label in common
    with a document, give a model that scores 0.5 everywhere. Other columns may have any names but
    those read. What comes to the driver is ``bound`` documents' features: a feature per distinct word.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.avg(label_col).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # bound * 16 bytes: may be broadcast
    picked = docs.select("doc_id", F.struct(F.col("text").alias("t"), *(F.col(m).alias(f"m{i}") for i, m in enumerate(metadata))).alias("x")).join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id").agg(F.min("x").alias("x"), F.first("_label").alias("y")).select("y", F.col("x.t").alias("t"), *(F.col(f"x.m{i}") for i in range(len(metadata))))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            rows = [features(t, m) for t, *m in rows_of(b.columns[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i for i, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float32()))], names=["y", "i", "v"])

    got = picked.mapInArrow(featurise, "y double, i array<int>, v array<float>").toArrow()
    rows = [(y.as_py(), i.values.to_numpy(), v.values.to_numpy()) for y, i, v in zip(got["y"], got["i"], got["v"], strict=True)]
    rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))  # the same model whatever the order of the tasks
    return fit(rows, Features().size)


def score_documents(docs: DataFrame, model: FactorisationMachine, metadata: tuple[str, ...] = ("n_chars",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 for every whole text, null and empty ones too.

    A null or empty text is scored by its statistics and metadata. Null ids and repeated rows are
    scored like any others, equal rows alike; an empty table gives no rows. Only the named columns
    are read. A text is held whole, whatever its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: 2**16 * (rank + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, score = Features(), shared.value.score
        for b in batches:
            scores = [score(*features(t, m)) for t, *m in rows_of(b.columns[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(m).alias(f"m{i}") for i, m in enumerate(metadata)))
    return named.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, score double")


def keep_good(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD, metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns; see
    :func:`score_documents` for null and empty texts, repeated rows and empty tables."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [docs.columns.index(c) for c in ("text", *metadata)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, score = Features(), shared.value.score
        for b in batches:
            yield b.filter(pa.array([score(*features(t, m)) >= threshold for t, *m in rows_of([b.column(i) for i in at])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from labels.quality outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    held_out = F.coalesce(fold(F.col("id")) == 0, F.lit(False))
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
