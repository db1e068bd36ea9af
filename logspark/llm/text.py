"""Shared text kernels: chunked reading of Arrow batches and vectorised word / shingle hashing.

Everything here works on whole texts.  ``chunks`` bounds the memory of a step by cutting a batch *between*
documents (a single longer document forms a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Word separators of the word rule ``[^\x20\x09-\x0D]+``, as UTF-8 bytes.
SPACES = b" \t\n\x0b\x0c\r"
#: A-Z to a-z, nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_IS_WORD = np.array([b not in SPACES for b in range(256)])
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INV = pow(BASE, -1, 2**64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base % 2**64), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Power tables that grow on demand and are kept per process."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(BASE, n * 5 // 4 + 16), powers(INV, n * 5 // 4 + 16)
        return self.up, self.down


POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of values[start:end], for all spans at once."""
    up, down = POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: pa.Array, max_bytes: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have about max_bytes (one row at least)."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield at, to
        at = to


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (rule ``[^\\x20\\x09-\\x0D]+``) of the texts in order; words per text."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    edge = np.diff(np.concatenate(([0], _IS_WORD[raw].astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = span_hashes(_BYTE[raw], starts, ends)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words (of the whole sequence, if it is shorter; none without words)."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + words[i : n - k + 1 + i]
    return mix(out + np.uint64(k))
