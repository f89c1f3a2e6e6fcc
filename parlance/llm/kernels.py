"""Vectorised byte, word and shingle hashing over Arrow text columns.

Hashes are 64-bit values that depend on the bytes alone, so they agree on every executor. White
space is the six ASCII characters of ``[\\x20\\x09-\\x0D]``; lower-casing touches A-Z only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
#: One random 64-bit number for each byte value.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_ROOT = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_ROOT, -1, 1 << 64)
#: Weighs the words of a shingle by their place.
_STEP = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        out, size = np.ones(1, U), 1
        step = base
        while size < n:
            out = np.concatenate([out, out * U(step)])
            size, step = size * 2, step * step % (1 << 64)
        _powers[base] = out
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers, sorted; faster than numpy's own function."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


@dataclass
class Words:
    """The words of a batch of texts, in order. Those of text i are first[i] up to first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    n = len(data)
    if lower:
        data = LOWER[data]
    ink = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = ink[:-1]
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = ink[1:]
    start = np.flatnonzero(ink & (~before | cut[:n]))
    end = np.flatnonzero(ink & (~after | cut[1:])) + 1
    return Words(start, end, np.searchsorted(start, offsets), span_hash(data, start, end))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * powers(_ROOT, len(data)), out=total[1:])
    back = powers(_BACK, len(data) + 1)
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(U))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and where each text's begin.

    A text with fewer words, but some, has one: its whole sequence.
    """
    count = np.diff(w.first)
    h, total = w.hash, len(w.hash)
    full = np.zeros(max(total - size + 1, 0), U)
    for j in range(size):
        full += h[j : j + len(full)] * U(pow(_STEP, j, 1 << 64))
    full = mix(full + U(size))
    n = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(first[-1]) - first[text] + w.first[text]
    out = full[np.minimum(at, max(len(full) - 1, 0))] if len(full) else np.zeros(first[-1], U)
    for i in np.flatnonzero((count > 0) & (count < size)):
        run = h[w.first[i] : w.first[i + 1]]
        out[first[i]] = mix((run * powers(_STEP, len(run))).sum(dtype=U, keepdims=True) + U(len(run)))[0]
    return out, first


def code_points(data: np.ndarray) -> np.ndarray:
    """1 for each byte that begins a UTF-8 character."""
    return ((data & 0xC0) != 0x80).astype(np.int64)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offsets])


class Table:
    """A hash table from 64-bit keys to rows of numbers, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, ~U(0))
        self.rows = np.zeros(1 << bits, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == ~U(0)
            first = np.zeros(len(left), bool)
            first[np.unique(at[left], return_index=True)[1]] = True
            put = left[free & first]
            self.keys[at[put]], self.rows[at[put]] = keys[put], put
            left = left[~(free & first)]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self._slot(keys)
        got = self.keys[at]
        hit = got == keys
        out = np.where(hit, self.rows[at], -1)
        left = np.flatnonzero(~hit & (got != ~U(0)))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            got = self.keys[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.rows[at[left[hit]]]
            left = left[~hit & (got != ~U(0))]
        return out
