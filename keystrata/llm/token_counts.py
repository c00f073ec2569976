"""Token counts by a tokenizer file; huge documents by overlapping chunks that are spliced.

If the tokenizer's file says that it drops white space and no token spans it, a text's tokens are its
words' tokens, and texts up to ``chunk`` characters are encoded word by word, each distinct word once.
By any other file they are encoded as a whole. Longer texts go through the library in overlapping chunks with offsets. Two neighbouring encodings are spliced
where a word starts after white space and both give the same ids at the same places for the word
before and the word after; if they agree nowhere, the overlap widens, at last over the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import find_words, table
from keystrata.llm.rank_bpe import WHITE_SPACE, load_file

CHUNK, OVERLAP = 16_384, 512
MEMO_WORDS = 1_000_000
_starts = re.compile("(?<=[\x20\x09-\x0d])[^\x20\x09-\x0d]").finditer


def drops_space(spec: dict) -> bool:
    """Whether a tokenizer's file says that white space parts words and leaves no token, so that a
    text's tokens are its words' tokens: the first pre-tokenizer removes all that its pattern does not
    match, and that has no white space; what is before and behind neither adds blanks nor spans words."""

    def steps(part: dict | None, name: str) -> list[dict]:
        return [] if not part else [y for x in part[name] for y in steps(x, name)] if part["type"] == "Sequence" else [part]

    before, split = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
    plain = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
    blanks = lambda x: x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " "
    if not split or not all(x["type"] in plain or blanks(x) for x in before):
        return False
    first, rest = split[0], split[1:]
    if first["type"] != "Split" or first["behavior"] != "Removed" or not first["invert"] or "Regex" not in first["pattern"]:
        return False
    try:
        spans = any(regex.search(first["pattern"]["Regex"], c) for c in WHITE_SPACE)
    except regex.error:
        return False
    tokens = spec.get("added_tokens") or []
    return not spans and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in rest) and not any(t["lstrip"] or t["rstrip"] or regex.search(r"\s", t["content"]) for t in tokens)


class ChunkedTokenizer:
    """Counts and ids of whole texts, whatever their length, as the library gives them."""

    def __init__(self, data: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.by_words = drops_space(json.loads(data))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.memo: dict[str, int] = {}

    def encode_at(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a chunk, and where in the whole text each begins and ends."""
        e = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2) + start
        return np.array(e.ids, np.int64), offsets[:, 0], offsets[:, 1]

    @staticmethod
    def common_cut(text: str, begin: int, end: int, left: tuple, right: tuple) -> int | None:
        """A word start in (begin, end) around which two encodings agree, nearest the middle."""
        starts = [m.start() for m in _starts(text, begin, end)]
        for i in sorted(range(1, len(starts) - 1), key=lambda i: abs(2 * starts[i] - begin - end)):
            lo, hi = starts[i - 1], starts[i + 1]
            a, b = (slice(*np.searchsorted(x[1], (lo, hi))) for x in (left, right))
            if all(np.array_equal(x[a], y[b]) for x, y in zip(left, right, strict=True)):
                return starts[i]
        return None

    def spliced(self, text: str) -> list[np.ndarray]:
        """Ids of a long text, as pieces to be joined."""
        out, cut, size, n = [], 0, self.chunk, len(text)
        end = min(size, n)
        left = self.encode_at(text, 0, end)
        while end < n:
            overlap = self.overlap
            while True:
                begin = max(cut, end - overlap)
                until = min(n, begin + max(size, 2 * overlap))
                right = self.encode_at(text, begin, until)
                at = self.common_cut(text, begin, end, left, right)
                if at is not None or begin == cut:
                    break
                overlap *= 4
            if at is None:  # no two words in all of the chunk: take a longer one from the last cut on
                end = min(n, cut + 4 * (end - cut))
                left = self.encode_at(text, cut, end)
                continue
            a, b = np.searchsorted(left[1], (cut, at))
            out.append(left[0][a:b])
            cut, left, end = at, right, until
        out.append(left[0][np.searchsorted(left[1], cut) :])
        return out

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.chunk:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.concatenate(self.spliced(text)).tolist()

    def counts(self, texts: list[str]) -> list[int]:
        memo = self.memo
        if not self.by_words:
            return [sum(map(len, self.spliced(t))) for t in texts]
        words = [find_words(t) if len(t) <= self.chunk else None for t in texts]
        new = list({w for ws in words if ws for w in ws if w not in memo})
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = list({w for ws in words if ws for w in ws})
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            memo.update(zip(some, (len(e.ids) for e in self.tokenizer.encode_batch(some, add_special_tokens=False)), strict=True))
        return [sum(map(memo.__getitem__, ws)) if ws is not None else sum(map(len, self.spliced(t))) for t, ws in zip(texts, words, strict=True)]


_tokenizers: dict[tuple, ChunkedTokenizer] = {}


def tokenizer_for(data: bytes, chunk: int, overlap: int) -> ChunkedTokenizer:
    """This worker's tokenizer; it stays with the words it remembers while the worker lives."""
    key = hashlib.sha256(data).digest(), chunk, overlap
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = ChunkedTokenizer(data, chunk, overlap)
    return _tokenizers[key]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens) for every whole text.

    A null text is an empty one, with no bytes and no tokens. Only the two named columns are read;
    null ids and repeated rows are counted like any others; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_for(shared.value, chunk, overlap)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(tokenizer.counts(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, and whether they exceed 2048."""
    import public_tokenizers

    rows = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
