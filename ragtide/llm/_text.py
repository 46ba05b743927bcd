"""Vectorised words and 64-bit hashes of many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 2 << 20
#: Longer words are hashed by a digest of their bytes: a polynomial modulo 2^64 loses bits on long patterns.
POLYNOMIAL_BYTES = 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_P = U(0x9E3779B97F4A7C15)
_PINV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pows = (np.ones(1, U), np.ones(1, U))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators: space and 9 to 13; and all ASCII but digits and small letters.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NON_WORD = np.zeros(256, bool)
NON_WORD[:128] = True
NON_WORD[48:58] = NON_WORD[97:123] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pows
    if len(_pows[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        up, down = np.full(size, _P, U), np.full(size, _PINV, U)
        up[0] = down[0] = 1
        tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 8 * CHUNK_BYTES:
            return tables
        _pows = tables
    return _pows


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most limit bytes together, or one row."""
    start = size = 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x) + 1
    if start < len(texts):
        yield start, len(texts)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Each text as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Words:
    """Words of a list of texts. start, end: byte places in data; doc: row of each word; hash: of its bytes;
    first: place of each row's first word, and the number of words at the end."""

    def __init__(self, texts: list[bytes], separators: np.ndarray, lower: bool = True):
        joined = b"\n".join([*texts, b""]) or b"\n"
        raw = np.frombuffer(joined, np.uint8)
        self.data = LOWER[raw] if lower else raw
        gap = separators[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.count = np.diff(self.first)
        up, down = _powers(len(raw) + 1)
        sums = np.empty(len(raw) + 1, U)
        sums[0] = 0
        np.cumsum(_BYTE[self.data] * up[: len(raw)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U))
        for i in np.flatnonzero(self.end - self.start > POLYNOMIAL_BYTES).tolist():
            self.hash[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8).digest(), "little")

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


_MUL = _rng.integers(1, 2**64, 64, dtype=np.uint64) | U(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbours, n - 1 fewer than there are hashes."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, U)
    for k in range(n):
        out += hashes[k : k + size] * _MUL[k % 64]
    return mix(out + U(n))
