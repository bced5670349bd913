"""Vectorised text primitives shared by the corpus operators.

Everything here works on an Arrow string array at a time, without a Python object per word: words are
located as byte ranges of the array's own buffer and hashed with a wrapping polynomial, so that any run of
consecutive words can be hashed from two prefix sums.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes or words that are hashed at a time; bounds the memory of one step, and of the tables of powers that a worker keeps.
BLOCK = 1 << 18

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base & _MASK | 1, pow(base & _MASK | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))

            def run(base: int) -> np.ndarray:
                out = np.full(size, base, _U)
                out[0] = 1
                return np.multiply.accumulate(out)

            self.up, self.down = run(self.base), run(self.inv)
        return self.up, self.down


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_ODD))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII letters in lower case and digits; other ASCII is white space; bytes of longer characters stay.
PLAIN = _LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
_CHARS, _WORDS, _WORDS2 = _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F), _Powers(0xE7037ED1A0B428DB)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string()) if len(texts) else pa.array([], pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def word_ranges(texts: pa.Array, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: (bytes, start, end, first word of each text and one past the last).

    ``letters`` maps each byte first, for instance to leave punctuation out."""
    offsets, data = buffer_of(texts)
    if letters is not None:
        data = letters[data]
    n = len(data)
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~solid[1:]
    inner = offsets[1:][(offsets[1:] > 0)] - 1
    after[inner] = True
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array, lower: bool, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each text and one past the last)."""
    data, starts, ends, firsts = word_ranges(texts, letters)
    return _ranges_hash(data, starts, ends, lower), firsts


def prefix_hashes(texts: pa.Array, sizes: tuple[int, ...], letters: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(hash of each word, per size (which words are longer, hashes of their first so many bytes), first word of each text)."""
    data, starts, ends, firsts = word_ranges(texts, letters)
    out = []
    for size in sizes:
        longer = np.flatnonzero(ends - starts > size)
        out.append((longer, mix(_ranges_hash(data, starts[longer], starts[longer] + size, False) + _U(size))))
    return _ranges_hash(data, starts, ends, False), out, firsts


def _ranges_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        part = data[low : ends[to - 1]]
        if lower:
            part = _LOWER[part]
        up, down = _CHARS.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _U(_ODD))
        at = to
    return out


def run_hashes(words: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of words[i : i + size] for each i that has so many words after it (texts are not told apart)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    powers = _WORDS2 if second else _WORDS
    out = np.empty(n, _U)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + size - 1]
        up, down = powers.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        k = len(part) - size + 1
        out[at : at + k] = mix((sums[size:] - sums[:-size]) * down[:k] + _U(size))
    return out


def trim() -> None:
    """Give memory that is free back to the system, where that is offered: workers idle between tasks beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (one row at least)."""
    trim()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, at = 0, 0
        for i, size in enumerate(sizes):
            if i > at and total + size > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(size)
        if at < len(sizes):
            yield batch.slice(at)
    trim()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
