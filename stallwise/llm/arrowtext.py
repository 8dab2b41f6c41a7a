"""Words and hashes of whole Arrow batches of text, without a loop over rows.

Everything works on the UTF-8 bytes of an Arrow string column.  Rows are handled
in slices of about a megabyte, so memory stays bounded by the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: A longer word is hashed by itself, with BLAKE2.  Sums of powers modulo 2^64 tell shorter ones apart, whatever is
#: chosen for them; from about a thousand bytes on, words can be built that they confuse (Thue-Morse words).
LONG_WORD = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space separates: all but 0x20 and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of digits, a to z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _A)


@dataclass
class Texts:
    """Consecutive rows of a batch: their bytes and where each row begins and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows of a string column in slices of ``limit`` bytes, or of one longer row; NULL is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    _, ends, raw = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        stop = min(max(stop, at + 1), len(column))
        yield Texts(at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


def spelled(data: np.ndarray, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Which of the different words each is, and these in order of first place, told apart by their bytes.

    ``sizes`` are the lengths of all words of ``data``, runs of bytes marked in ``letters``.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    plain = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data[letters[data]])])
    encoded = plain.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


@dataclass
class Words:
    """Words in order: byte spans, the row of each, and the first word of every row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def words(texts: Texts, letters: np.ndarray, data: np.ndarray | None = None) -> Words:
    """Maximal runs of the bytes marked in ``letters``; none crosses rows."""
    inside = letters[texts.data if data is None else data]
    n = len(inside)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, np.zeros(len(texts) + 1, dtype=np.int64))
    edges = texts.offsets
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[edges[:-1][edges[:-1] < n]] = False
    after[edges[1:][edges[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    offsets = np.searchsorted(start, edges)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    return Words(start, end, row, offsets)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_A) | 1
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans come in ascending order of start."""
    out = np.empty(len(start), dtype=np.uint64)
    size = end - start
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(start, start[at] + limit - LONG_WORD, side="right")))
        low, s, e = int(start[at]), start[at:stop], end[at:stop]
        e = np.where(size[at:stop] > LONG_WORD, s, e)
        up, down = _powers(limit + 1)
        part = data[low : int(e.max())]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        out[at:stop] = mix((sums[e - low] - sums[s - low]) * down[s - low] + (e - s).astype(np.uint64) * _C)
        at = stop
    for k in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest()
        out[k] = np.frombuffer(digest, dtype=np.uint64)[0]
    return out


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its two parts."""
    return mix(left * _A + right)


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of ``k`` items, built from runs of powers of two."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    level = mix(hashes ^ np.uint64(seed)) if seed else hashes
    out, taken, width = None, 0, 1
    n = len(hashes) - k + 1
    while True:
        if k & width:
            part = level[taken : taken + n]
            out = part if out is None else join_hashes(out, part)
            taken += width
        if taken == k:
            return out.copy() if out is level else out
        level = join_hashes(level[:-width], level[width:])
        width *= 2


def as_long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def covered(marks_from: np.ndarray, marks_to: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in any of the ranges ``[from, to)``."""
    if not len(marks_from):
        return np.zeros(n, dtype=bool)
    steps = np.bincount(marks_from, minlength=n + 1) - np.bincount(marks_to, minlength=n + 1)
    return np.cumsum(steps[:-1]) > 0
