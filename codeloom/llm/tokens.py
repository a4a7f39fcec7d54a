"""Words and word shingles of Arrow text columns as 64-bit hashes, computed with whole-array numpy operations.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of
the lower-cased text. Hashes are Karp-Rabin polynomials modulo 2**64 taken from
one running sum per chunk, then mixed, so a chunk of text costs a few array
passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 19  # bytes of text handled at once; a longer text is a chunk of its own

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 constants)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and the row pointers (row i has words[ptr[i]:ptr[i+1]]). Null counts as empty."""
    text = pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), ""))
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        return np.zeros(0, np.uint64), np.zeros(len(text) + 1, np.int64)
    raw = np.frombuffer(text.buffers()[2], np.uint8)[low:high]
    row_at = offsets - low
    word = np.zeros(len(raw) + 1, bool)
    word[:-1] = _WORD[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0], before[1:] = False, word[:-1]
    first = row_at[1:-1]  # a new row begins a new word
    before[first] = False
    start = np.flatnonzero(word & ~before)
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = word[1:]
    after[first[first > 0] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    power, inverse = _power_tables(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    words = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return words, np.searchsorted(start, row_at)


def hash_stretches(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches words[begin:end], equal for equal words wherever they stand."""
    power, inverse = _power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64), 3)


def chunks(text: pa.Array, size: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64)
    ends, begin = np.cumsum(lengths), 0
    while begin < len(lengths):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + size, "right")))
        yield begin, end
        begin = end


def shingles(words: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of each row, with row pointers. A row of 1 to n-1 words has one, of them all."""
    count = np.diff(ptr)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_ptr = np.concatenate(([0], np.cumsum(size)))
    if not len(words):
        return words, out_ptr
    factor, rolled = np.uint64(0xD6E8FEB86659FD93), np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        rolled *= factor
        rolled += words[i : i + len(rolled)]
    at = np.arange(out_ptr[-1]) + np.repeat(ptr[:-1] - out_ptr[:-1], size)
    out = rolled[np.minimum(at, max(0, len(rolled) - 1))] if len(rolled) else np.zeros(len(at), np.uint64)
    for row in np.flatnonzero((count > 0) & (count < n)):
        value = 0
        for w in words[ptr[row] : ptr[row + 1]].tolist():
            value = (value * int(factor) + w) & 0xFFFFFFFFFFFFFFFF
        out[out_ptr[row]] = value ^ 0x5BD1E995
    return mix(out, n), out_ptr
