"""Whole-batch word splitting and hashing with numpy, for use inside Arrow tasks.

A word is a maximal run of characters other than space and U+0009..U+000D. All six separators are single
bytes in UTF-8, so splitting bytes equals splitting characters. A-Z are lower-cased before hashing, unless asked not to.
A word's hash is a polynomial over random 64-bit byte values, mixed; a k-word shingle's hash is a polynomial
over its words' hashes, mixed. Both are 64 bits wide, so in a table of n distinct items about n*n/2^65 pairs
share a hash (one pair expected at six billion items).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are processed in runs of rows of about this many bytes (a longer text is a run by itself).
RUN_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CASED = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, 2 * RUN_BYTES)
        a = np.full(size, base, np.uint64)
        a[0] = 1
        have = _powers[str(base)] = np.cumprod(a, dtype=np.uint64)
        if size > 4 * RUN_BYTES:  # a very long text: do not keep its table for the worker's life
            _powers.pop(str(base))
    return have[:n]


@dataclass
class Run:
    """Consecutive rows of a batch. Words of row i are ``hashes[first[i]:first[i + 1]]``; starts and ends are
    byte positions in ``data``, where row i begins at ``begins[i]``."""

    row: int
    first: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    begins: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def codepoint(self, i: int, byte: np.ndarray | int) -> np.ndarray:
        """Code-point offsets in row i of byte positions in ``data``."""
        a = int(self.begins[i])
        lead = np.concatenate([[0], np.cumsum((self.data[a:int(self.begins[i + 1])] & 0xC0) != 0x80)])
        return lead[np.asarray(byte) - a]


def runs(column: pa.Array, cased: bool = False) -> Iterator[Run]:
    """Split a string column (null: empty) into hashed words, run by run; ``cased`` tells A from a."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    body = column.buffers()[2]
    whole = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, "right")) - 1)
        to = min(to, n)
        begins = offsets[at:to + 1] - offsets[at]
        data = whole[offsets[at]:offsets[to]]
        word = ~_SPACE[data]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        inner = begins[(begins > 0) & (begins < len(data))]  # a row's edge also separates words
        opens[inner] = word[inner]
        closes[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_CASED if cased else _BYTE)[data] * _power(_R, len(data)), out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * _power(_R_INV, len(data) + 1)[starts])
        yield Run(at, np.searchsorted(starts, begins), hashes, starts, ends, data, begins)
        at = to


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of one word sequence (empty when it has fewer words)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    if k & (k - 1) == 0:  # the same sum by doubling
        g, size, power = h, 1, _STEP
        while size < k:
            g = g[:-size] * power + g[size:]
            size, power = 2 * size, np.uint64(int(power) ** 2 % 2**64)
        return mix(g)
    g = h[:len(h) - k + 1].copy()
    for j in range(1, k):
        g = g * _STEP + h[j:len(h) - k + 1 + j]
    return mix(g)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles; a shorter sequence is one shingle as a whole, an empty one has none."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(shingles(h, min(k, len(h))))


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def split_by(part: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(part, row numbers) for each part that has rows."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n + 1))
    return [(p, order[cut[p]:cut[p + 1]]) for p in range(n) if cut[p] < cut[p + 1]]


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def pack(x: np.ndarray, width: int) -> bytes:
    """Sorted numbers below 2**(8 * width) as the byte planes of their differences (the high planes, mostly zero,
    then cost almost nothing in a compressed shuffle)."""
    d = np.diff(x.astype(np.uint64), prepend=np.uint64(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(b: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(width, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :width] = planes.T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)
