"""Words of whole texts as numpy arrays, for use inside Arrow tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D in the UTF-8 text.
Texts are hashed in pieces of about ``PIECE`` bytes that end between words, so a very
long text needs no large arrays beyond one number per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            steps = np.full(size, _BASE, np.uint64)
            back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            steps[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(steps), np.multiply.accumulate(back)
        return self.up, self.down


_POWERS = _Powers()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _hash_piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word; a word also ends at each of ``breaks``."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    space = is_space(data)
    begins = ~space
    begins[1:] &= space[:-1]
    if len(breaks):
        cut = breaks[(breaks > 0) & (breaks < n)]
        begins[cut] |= ~space[cut]
    ends = ~space
    ends[:-1] &= space[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _POWERS.get(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[:n], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start] + np.uint64(_BASE))


class TextBlock:
    """Some texts of a batch: ``rows`` are their numbers; words of text j are
    ``offsets[j]`` to ``offsets[j + 1]`` of ``hashes`` (and ``start``, ``end`` into ``data``)."""

    def __init__(self, rows: range, data: np.ndarray, text_offsets: np.ndarray):
        self.rows, self.data = rows, data
        parts, at = [], 0
        while at < len(data) or not parts:
            stop = min(at + PIECE, len(data))
            while stop < len(data) and not is_space(data[stop:stop + 1])[0]:
                stop = _next_space(data, stop)
            start, end, hashes = _hash_piece(data[at:stop], text_offsets - at)
            parts.append((start + at, end + at, hashes))
            at = stop
            if at >= len(data):
                break
        self.start, self.end, self.hashes = (np.concatenate(x) for x in zip(*parts))
        self.offsets = np.searchsorted(self.start, text_offsets)

    def stems(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word."""
        out = np.full(len(self.start), size, np.uint64)
        for i in range(size):
            at = self.start + i
            inside = at < self.end
            code = np.zeros(len(at), np.uint64)
            code[inside] = _BYTE_CODES[self.data[at[inside]]]
            out = out * np.uint64(_BASE) + code
        return mix(out)


def _next_space(data: np.ndarray, at: int) -> int:
    while at < len(data):
        found = np.flatnonzero(is_space(data[at:at + PIECE]))
        if len(found):
            return at + int(found[0])
        at += PIECE
    return len(data)


def text_blocks(texts: pa.Array, lower: bool, limit: int = 2 * PIECE) -> Iterator[TextBlock]:
    """Blocks of about ``limit`` bytes, a null text counting as empty; a longer text is alone."""
    texts = texts.cast(pa.large_binary())
    if len(texts) == 0:
        return
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    first = 0
    while first < len(lengths):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(lengths))
        # A copy of this block only, without the bytes under nulls, so that lengths agree.
        part = np.frombuffer(b"".join(
            x for x in texts.slice(first, last - first).to_pylist() if x is not None), np.uint8)
        part = _LOWER[part] if lower else part
        yield TextBlock(range(first, last), part, offsets[first:last + 1] - offsets[first])
        first = last


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words; fewer words: none."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    return mix(fold([hashes[i:i + count] for i in range(n)]))


def fold(columns: Sequence[np.ndarray]) -> np.ndarray:
    """An order-dependent sum of several hash columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        out = out * np.uint64(0xD6E8FEB86659FD93) + column
    return out


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    """Sums from which ``run_hash`` gives the hash of any run of words."""
    up, _ = _POWERS.get(max(1, len(hashes)))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words ``begin`` to ``end`` (not included), the same wherever they stand."""
    _, down = _POWERS.get(len(sums))
    runs = (sums[end] - sums[begin]) * down[begin]
    return mix(runs + mix((end - begin).astype(np.uint64)))


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingles of ``n`` words; fewer words make one shingle of all."""
    if len(hashes) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(grams(hashes, min(n, len(hashes))))
