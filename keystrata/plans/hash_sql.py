"""DuckDB SQL for the checksums and hashes of the file formats, put together from single steps."""

from __future__ import annotations

from keystrata.schema import BLOOM_PROBES, HASH_SEED

_WRAP = "18446744073709551616::UHUGEINT"


def crc32(hex_col: str) -> str:
    """CRC-32 of the bytes that a column has as hexadecimal digits; needs ``crc_table`` in scope."""
    byte = f"list_transform(range(0, length({hex_col}) // 2), lambda i: ('0x' || substr({hex_col}, (2 * i + 1)::INTEGER, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


#: One row with the 256 values of the checksum's table, each made by eight steps.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t)"


def _times(a: str, b: str) -> str:
    return f"(({a})::UHUGEINT * ({b})::UHUGEINT % {_WRAP})::UBIGINT"


def _plus(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {_WRAP})::UBIGINT"


def _turned(a: str, n: int) -> str:
    return f"(({a})::UHUGEINT * {1 << n}::UHUGEINT % {_WRAP} + ({a})::UHUGEINT // {1 << 64 - n}::UHUGEINT)::UBIGINT"


def _word(first: int) -> str:
    """Eight bytes of the key from a place on as a number, least significant first; none count as 0."""
    return " + ".join(f"(CASE WHEN length(key) > {first + i} THEN greatest(unicode(substr(key, {first + i + 1}, 1)), 0) ELSE 0 END)::UHUGEINT * {1 << 8 * i}::UHUGEINT" for i in range(8))


# Fixed values of the hash function.
_C1, _C2 = "9782798678568883157", "5545529020109919103"
_F1, _F2 = "18397679294719823053", "14181476777654086739"


def murmur_steps(source: str) -> str:
    """Tables m0, m1, ... that add h1 and h2, both halves of the hash, to the rows of ``source``, which
    has a ``key`` of up to 15 ASCII characters."""
    steps = [
        {"k1": f"({_word(0)})::UBIGINT", "k2": f"({_word(8)})::UBIGINT"},
        {"k1": _times("k1", _C1), "k2": _times("k2", _C2)},
        {"k1": _turned("k1", 31), "k2": _turned("k2", 33)},
        {"k1": _times("k1", _C2), "k2": _times("k2", _C1)},
        {"h1": f"xor(xor({HASH_SEED}::UBIGINT, k1), length(key)::UBIGINT)", "h2": f"xor(xor({HASH_SEED}::UBIGINT, k2), length(key)::UBIGINT)"},
        {"h1": _plus("h1", "h2")},
        {"h2": _plus("h2", "h1")},
        *[{h: f"xor({h}, {h} >> 33)" if not f else _times(h, f) for h in ("h1", "h2")} for f in (None, _F1, None, _F2, None)],
        {"h1": _plus("h1", "h2")},
        {"h2": _plus("h2", "h1")},
    ]
    out, last = [], source
    for i, columns in enumerate(steps):
        known = {c for s in steps[:i] for c in s}
        new = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        kept = f"* EXCLUDE ({', '.join(sorted(known & columns.keys()))})" if known & columns.keys() else "*"
        out.append(f"m{i} AS (SELECT {kept}, {new} FROM {last})")
        last = f"m{i}"
    return ", ".join([*out, f"hashed AS (SELECT * FROM {last})"])


def position(i: str, bits: str) -> str:
    """Probe ``i`` of a hashed key in a filter of so many bits."""
    return f"((((h1::UHUGEINT + {i}::UHUGEINT * h2::UHUGEINT) % {_WRAP}) % 9223372036854775808::UHUGEINT) % ({bits})::UHUGEINT)::BIGINT"


PROBES = f"range({BLOOM_PROBES})"
