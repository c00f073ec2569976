"""Byte-level BPE by rank files, with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every adjacent pair that the vocabulary can merge is queued
in the bucket of its merge's rank. A bitmap with a bit per rank, under coarser bitmaps with a bit
per 64 below, finds the lowest rank that has a bucket by a find-first-set per level; no comparison
sort of all pairs is needed, so very long pre-tokens cost time in proportion to their merges.
Entries whose pair has changed meanwhile are stale and are skipped when met.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from keystrata.llm.common import table

#: A rank file is sent to the executors; larger ones are refused.
MAX_RANK_BYTES = 64 << 20
#: Encoded pre-tokens that a worker remembers, of up to so many characters; then it starts anew.
MEMO_ENTRIES, MEMO_CHARS, MEMO_PAIRS = 1_000_000, 48, 1_000_000
#: The patterns mean Unicode's White_Space by \s; spelled out so that no library's own view matters.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


@lru_cache(maxsize=None)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of a splitting pattern.

    Texts of code points below 256 are split by the plain matcher, with every class of the pattern
    spelled out for those code points; it runs faster. All others take the full matcher.
    """
    classes = {r"\p{L}": None, r"\p{N}": None, r"\s": WHITE_SPACE, r"\S": WHITE_SPACE}

    def spelled(low: bool) -> str:
        out, inside = "", False
        for part in regex.split("(" + "|".join(map(regex.escape, [*classes, "[", "]"])) + ")", pattern):
            if part in ("[", "]"):
                inside = part == "["
            elif part in classes:
                chars = classes[part] or (part if not low else "".join(regex.escape(chr(c)) for c in range(256) if regex.match(part, chr(c))))
                part = chars if inside else f"[{'^' * part.endswith('S')}{chars}]" if classes[part] or low else part
            out += part
        return out

    full, low = regex.compile(spelled(False)).findall, re.compile(spelled(True)).findall

    def split(text: str) -> list[str]:
        return low(text) if text.isascii() or not above_latin(text) else full(text)

    return split


above_latin = re.compile(r"[^\x00-\xff]").search


class RankBPE:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} of the 256 single bytes, {missing[0]} first: texts with them have no ids")
        self.ranks = ranks
        self.n_ranks = max(ranks.values(), default=0) + 1
        self.token_bytes = [b""] * self.n_ranks
        for b, r in ranks.items():
            self.token_bytes[r] = b
        self.id_of = list(range(self.n_ranks))  # one int object per id, for all remembered lists
        self.token_text = [str(r) for r in range(self.n_ranks)]
        self.split = splitter(pattern)
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.byte_pair = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        # The queue: a bit per rank in words of 2**shift bits, a bit per word in the summary above them.
        self.shift = max(6, (self.n_ranks.bit_length() + 1) // 2)
        self.words = [0] * ((self.n_ranks >> self.shift) + 1)
        self.bits = [1 << i for i in range(max(1 << self.shift, len(self.words)))]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest-ranked merge next, the leftmost of equals first.

        ``wants[i]`` is the rank of the pair that starts at list position i, so an entry of bucket r
        is stale unless wants[i] is r. All buckets are empty again at the end.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, ranks, pairs, byte_pair, token_bytes = len(piece), self.ranks, self.pairs, self.byte_pair, self.token_bytes
        words, bits, shift = self.words, self.bits, self.shift
        mask, summary, buckets = (1 << shift) - 1, 0, {}
        byte_id = self.byte_id
        ids = [byte_id[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        wants = [byte_pair[a << 8 | b] for a, b in zip(piece, piece[1:])]
        wants.append(-1)
        for i, r in enumerate(wants):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)  # ascending, so a heap already
                else:
                    buckets[r] = [i]
                    words[r >> shift] |= bits[r & mask]
                    summary |= bits[r >> shift]
        while summary:
            w = (summary & -summary).bit_length() - 1
            word = words[w]
            rank = w << shift | ((word & -word).bit_length() - 1)
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[w] = word = word & (word - 1)
                if not word:
                    summary &= summary - 1
            if wants[i] != rank:  # stale: merged away, or another pair by now
                continue
            gone = after[i]
            ids[i] = rank
            nxt = after[i] = after[gone]
            wants[gone] = -1
            p = before[i]
            if nxt < n:
                before[nxt] = i
                b = ids[nxt]
                key = rank << 32 | b
                r = pairs.get(key)
                if r is None:
                    r = pairs[key] = ranks.get(token_bytes[rank] + token_bytes[b], -1)
                wants[i] = r
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        words[r >> shift] |= bits[r & mask]
                        summary |= bits[r >> shift]
            else:
                wants[i] = -1
            if p >= 0:
                a = ids[p]
                key = a << 32 | rank
                r = pairs.get(key)
                if r is None:
                    r = pairs[key] = ranks.get(token_bytes[a] + token_bytes[rank], -1)
                wants[p] = r
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], p)
                    else:
                        buckets[r] = [p]
                        words[r >> shift] |= bits[r & mask]
                        summary |= bits[r >> shift]
        if len(pairs) > MEMO_PAIRS:
            pairs.clear()
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; each match of the pattern is encoded by itself."""
        out: list[int] = []
        memo, extend, shared = self.memo, out.extend, self.id_of
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    ids = memo[piece] = tuple(map(shared.__getitem__, ids))
            extend(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


_codecs: dict[tuple[bytes, str], RankBPE] = {}


def codec_for(data: bytes, pattern: str) -> RankBPE:
    """This worker's codec for a rank file; it stays with what it remembers while the worker lives."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = RankBPE(read_ranks(data), pattern)
        gc.set_threshold(200_000, 20, 100)  # the memo makes many small objects and no cycles
    return _codecs[key]


def load_file(path: str) -> bytes:
    """A tokenizer file, read on the driver; its size is checked as it goes to every executor."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has more than {MAX_RANK_BYTES} bytes")
    return data


def code_texts(docs: DataFrame, rank_path: str, pattern: str, schema: str, derive: Callable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and derive output columns from the real results.

    ``derive(codec, text, ids)`` returns the values of ``schema``'s columns after the id. A null
    text is an empty one and has no ids. Only the two named columns are read; repeated rows and
    null ids are coded like any others, and an empty table gives no rows. Texts stream through in
    Arrow batches, so no task holds more than a batch; a text is held whole with its ids, whatever
    its length. Ranks without all 256 single bytes are an error.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_file(rank_path))
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared.value, pattern)
        for batch in batches:
            # a few texts at a time leave, as ids take more room than texts
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [derive(codec, text or "", codec.encode(text or "")) for text in part.column(1).to_pylist()]
                columns = [part.column(0), *(pa.array([r[i] for r in rows], arrow_schema[i + 1].type) for i in range(len(names)))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *names])

    full = StructType([docs.schema[id_col], *StructType.fromDDL(schema)])
    arrow_schema = list(to_arrow_schema(full))
    return docs.select(id_col, text_col).mapInArrow(run, full)


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text."""
    return code_texts(docs, rank_path, pattern, "ids array<int>", lambda codec, text, ids: (ids,), id_col, text_col)


def decode_documents(encoded: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of every list of ids; bytes that are no UTF-8 become U+FFFD. Null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_file(rank_path))

    def run(batches):
        codec = codec_for(shared.value, r"\s+")
        for batch in batches:
            texts = [None if x is None else codec.decode(x).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {dict(encoded.dtypes)[id_col]}, text string")


def _digests(codec: RankBPE, text: str, ids: list[int]) -> tuple[int, str, str]:
    decimal = ",".join(map(codec.token_text.__getitem__, ids))
    return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def digest_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by the multilingual byte vocabulary."""
    import public_tokenizers

    return code_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def op8_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded again, as digests."""
    return digest_documents(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
