"""Vectorised word splitting and hashing over Arrow string columns (numpy, no per-row Python in the hot path).

Words are runs of bytes from a 256-entry class table.  All tables used here treat every byte >= 0x80 alike, so that a
UTF-8 byte run equals a code-point run of the matching character class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20

#: Spans are hashed by two polynomials modulo this prime.  (Modulo a power of two some unequal strings, such as the
#: Thue-Morse word and its complement, would hash alike under every base.)
_PRIME = (1 << 31) - 1
_BASES = (0x3C6EF372, 0x5BE0CD19)
_ODD = 0x9E3779B97F4A7C15

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), applied in place on a uint64 array."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Powers:
    """Powers of the two bases and of their inverses modulo the prime, grown on demand."""

    def __init__(self) -> None:
        self.tables = [np.ones(1, dtype=np.uint64) for _ in range(4)]

    def get(self, n: int) -> list[np.ndarray]:
        """Four arrays of n powers: base and inverse of the first, then of the second polynomial."""
        have = len(self.tables[0])
        if have < n:
            size = max(n, 2 * have, 1 << 16)
            factors = [f for b in _BASES for f in (b, pow(b, -1, _PRIME))]
            self.tables = [_powers(f, size) for f in factors]
        return [t[:n] for t in self.tables]


def _powers(factor: int, n: int) -> np.ndarray:
    """factor**0 .. factor**(n - 1) modulo the prime, each pass doubling what is known."""
    out = np.ones(n, dtype=np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(factor, have, _PRIME)) % np.uint64(_PRIME)
        have += more
    return out


POWERS = Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes, or one row that is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Two rows of polynomial prefix sums: column i covers data[:i]; see ``span_hash``."""
    powers = POWERS.get(len(data) + 1)
    out = np.zeros((2, len(data) + 1), dtype=np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    for row in (0, 1):
        np.cumsum(terms * powers[2 * row][: len(data)] % np.uint64(_PRIME), out=out[row, 1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for arrays of spans; equal bytes hash alike wherever they stand."""
    powers, p = POWERS.get(prefix.shape[1]), np.uint64(_PRIME)
    one, two = ((prefix[row][end] - prefix[row][start]) % p * powers[2 * row + 1][start] % p for row in (0, 1))
    h = (one << np.uint64(31)) | two
    h ^= (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix(h)


@dataclass
class Words:
    """Words of a row range: byte spans relative to the chunk, their hashes, and where each row's words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray  # n_rows + 1 offsets into the words


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Words:
    """Split lower-cased bytes ``data`` (rows at ``bounds``, from 0) into words of the class ``table``."""
    n = len(data)
    inside = table[data]
    start, end = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = np.unique(bounds[(bounds > 0) & (bounds < n)])
        start[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(first, last, span_hash(prefix_hash(data), first, last), np.searchsorted(first, bounds))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, by their first word (len(h) - k + 1 of them; row edges not regarded)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(k):  # each step is a bijection of what came before, combined with the next word
        out = mix(out * np.uint64(_ODD) + h[j : j + m])
    return out
