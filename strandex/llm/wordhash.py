"""Words of whole Arrow text columns as 64-bit hashes, computed with numpy on the UTF-8 bytes.

A word is a maximal run of bytes that are no separator. Separators are ASCII, so that cutting
bytes and cutting characters give the same words. A-Z count as a-z. Each word gets a polynomial
hash modulo 2**64 over a fixed random byte table, then a finalizer; equal words get equal hashes,
and different words collide with a probability of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
for _upper in range(65, 91):
    _BYTES[_upper] = _BYTES[_upper + 32]
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8: powers differ by small powers of two only
_INVERSE = pow(_BASE, -1, 2**64)
_PLACES = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that one numpy step takes; a longer text is taken alone.
STEP_BYTES = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: all ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        out[0] = 1
        _POWERS[base] = have = np.cumprod(out, dtype=np.uint64)
        if len(have) > 8 * STEP_BYTES:  # an exceptional text; do not keep its table
            del _POWERS[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about STEP_BYTES each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + STEP_BYTES, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (n + 1)."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes; between() hashes any byte range with it."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(len(data), _BASE), out=total[1:])
    return total


def between(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * _powers(len(total), _INVERSE)[starts] + (ends - starts).astype(np.uint64))


def blocks(starts: np.ndarray, ends: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of words that lie within about ``size`` (STEP_BYTES) bytes each, so that a long text is hashed in pieces."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (size or STEP_BYTES), "right")))
        yield i, j
        i = j


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for i, j in blocks(starts, ends):
        base = starts[i]
        out[i:j] = between(sums(data[base : ends[j - 1]]), starts[i:j] - base, ends[i:j] - base)
    return out


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the len(words) - k + 1 runs of k words (none if there are fewer)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, k, np.uint64)
    for j in range(k):
        out += words[j : j + m] * _PLACES[j % 64] * np.uint64(1 + 2 * (j // 64))
    return mix(out)


def documents(column: pa.Array, separator: np.ndarray) -> Iterator[np.ndarray]:
    """For each row the hashes of its words."""
    data, offsets = buffers(column)
    for i, j in steps(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = spans(part, offsets[i : j + 1] - offsets[i], separator)
        words = hashes(part, starts, ends)
        for k in range(j - i):
            yield words[first[k] : first[k + 1]]
