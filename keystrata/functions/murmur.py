"""MurmurHash3 x64 128 over batches of keys, and the Bloom filter's probe positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from keystrata.schema import BLOOM_PROBES, HASH_SEED

_U = np.uint64
# Fixed values of the hash function.
_C1, _C2 = _U(0x87C37B91114253D5), _U(0x4CF5AD432745937F)
_A1, _A2 = _U(0x52DCE729), _U(0x38495AB5)
_F1, _F2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _F1
    x = (x ^ (x >> _U(33))) * _F2
    return x ^ (x >> _U(33))


def murmur3_128(keys: list[bytes], seed: int = HASH_SEED) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the hash of every key; keys are hashed together, a 16-byte block at a time.

    All keys lie zero-padded in one matrix, so each step is one vector operation over all keys;
    a key takes part in a step only while it has that block.
    """
    n = np.fromiter(map(len, keys), np.int64, len(keys))
    width = int((n.max(initial=0) // 16 + 1) * 16)
    flat = np.zeros((len(keys), width), np.uint8)
    flat[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(keys), np.uint8)
    words = flat.view("<u8").astype(_U)
    h1, h2 = np.full(len(keys), seed, _U), np.full(len(keys), seed, _U)
    with np.errstate(over="ignore"):
        for b in range(width // 16):
            # zero-padded tail words mix to 0, so the same step serves full blocks and tails
            k1, k2 = _rotl(words[:, 2 * b] * _C1, 31) * _C2, _rotl(words[:, 2 * b + 1] * _C2, 33) * _C1
            full, tail = n >= 16 * (b + 1), (n < 16 * (b + 1)) & (n > 16 * b)
            g1 = h1 ^ k1
            f1 = (_rotl(g1, 27) + h2) * _U(5) + _A1
            f2 = (_rotl(h2 ^ k2, 31) + f1) * _U(5) + _A2
            h1, h2 = np.where(full, f1, np.where(tail, g1, h1)), np.where(full, f2, np.where(tail, h2 ^ k2, h2))
        length = n.astype(_U)
        h1, h2 = h1 ^ length, h2 ^ length
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _final(h1), _final(h2)
        h1 = h1 + h2
        h2 = h2 + h1
    return h1, h2


def probe_hashes(keys: list[bytes], probes: int = BLOOM_PROBES) -> np.ndarray:
    """What each key's probes are before they are taken modulo a filter's bits: (h1 + i * h2) without sign."""
    h1, h2 = murmur3_128(keys)
    with np.errstate(over="ignore"):
        mixed = h1[:, None] + np.arange(probes, dtype=_U)[None, :] * h2[:, None]
    return mixed & _U(0x7FFFFFFFFFFFFFFF)


def probe_positions(keys: list[bytes], bits: np.ndarray, probes: int = BLOOM_PROBES) -> np.ndarray:
    """The bits of a filter of ``bits`` bits that each key sets."""
    return (probe_hashes(keys, probes) % bits.astype(_U)[:, None]).astype(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def bloom_positions(key: pd.Series, bits: pd.Series) -> pd.Series:
    """Probe positions of a key in a filter of so many bits."""
    if not len(key):
        return pd.Series([], dtype=object)
    return pd.Series(list(probe_positions([k.encode() for k in key], bits.to_numpy(np.int64))))
