"""Array kernels over batches of UTF-8 texts (used inside Arrow tasks).

A batch is one byte buffer with document offsets.  Substring hashes are
polynomial modulo 2**64: with ``s[i]`` the prefix sum of ``(byte + 1) * B**-i``,
the hash of ``[a, b)`` is ``(s[b] - s[a]) * B**a``, which depends only on the
bytes.  ``B`` is odd, so its inverse exists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C55
INVERSE = pow(BASE, -1, 1 << 64)
# The bytes that separate words.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def release() -> None:
    """Give Arrow's free memory back at a task's end; Spark keeps the workers."""
    pa.default_memory_pool().release_unused()


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**n`` modulo 2**64; grown once per process."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            have[done:2 * done] = have[:done] * step
            done *= 2
        _powers[base] = have
    return have[:n + 1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences give substring hashes."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    if len(values):
        terms = values.astype(np.uint64)
        terms += np.uint64(1)
        terms *= powers(INVERSE, len(values) - 1)
        np.cumsum(terms, out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = 1 << 20):
    """Ranges of documents of about ``limit`` bytes; a longer one stands alone."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each document."""
    inside = ~_SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = off[1:][off[:-1] < off[1:]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[buf]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    s = prefix(buf)
    h = (s[ends] - s[starts]) * powers(BASE, len(buf))[starts]
    return mix(h + (ends - starts).astype(np.uint64))
