"""Words, shingles and windows of whole texts as NumPy arrays, one Arrow batch at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 is the
same as the pattern ``[^\\x20\\x09-\\x0D]+`` over code points.  Hashes are
polynomial (Rabin-Karp) over 64-bit integers with wrap-around and a final mix,
so a window's hash comes from two prefix sums.  Two different sequences share a
64-bit hash with a chance of about 2**-64; the operators treat equal hashes as
equal sequences unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.  It bounds a task's arrays: rows of more are a chunk of their own, whose bytes are hashed in pieces.
CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of unsigned 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least; only tables of a usual chunk's length are kept."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 2 * CHUNK_BYTES + 2)
        up = np.full(size, base, np.uint64)
        down = np.full(size, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down))
        if size == 2 * CHUNK_BYTES + 2:
            _powers[int(base)] = have
    return have


def _prefix(values: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values))[0][: len(values)], out=out[1:])
    return out


def per_row(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks between successive offsets."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(mark, offsets[:-1][full], dtype=np.int64)
    return out


class Chunk:
    """Some rows of a batch with their words.

    ``doc`` is the row of each word within the chunk, ``first`` the first word
    of each row (one entry more than rows), ``hash`` the words' hashes.
    """

    def __init__(self, row: int, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.row, self.rows = row, len(offsets) - 1
        self.data, self.offsets = data, offsets
        space = self.space = _SPACE[data]
        new = np.zeros(len(data) + 1, bool)
        new[offsets] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0] = after[-1] = True
            before[1:], after[:-1] = space[:-1], space[1:]
            before |= new[:-1]
            after |= new[1:]
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(after & ~space) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(self.rows), np.diff(self.first))
        self._lower = lower
        self._sums = self._prefix(0, len(data)) if len(data) <= 2 * CHUNK_BYTES else None
        self.hash = self.hash_of(self.starts, self.ends)

    def _prefix(self, lo: int, hi: int) -> np.ndarray:
        part = self.data[lo:hi]
        return _prefix((_LOWER[part] if self._lower else part).astype(np.uint64) + np.uint64(1), _BASE)

    def hash_of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of stretches of bytes, one for each start (in ascending order) and end."""
        size = (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        if self._sums is not None:
            raw = (self._sums[ends] - self._sums[starts]) * _power(_BASE, len(self.data) + 1)[1][starts]
            return mix(raw ^ size)
        raw = np.empty(len(starts), np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(self.data) + CHUNK_BYTES, CHUNK_BYTES))
        for lo, hi in zip(cuts, cuts[1:], strict=False):  # the stretches that start in one piece; only one that is longer itself needs more
            if hi > lo:
                at, until = int(starts[lo]), int(ends[lo:hi].max())
                sums = self._prefix(at, until)
                raw[lo:hi] = (sums[ends[lo:hi] - at] - sums[starts[lo:hi] - at]) * _power(_BASE, until - at + 1)[1][starts[lo:hi] - at]
        return mix(raw ^ size)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of n words of one row, in order."""
        w = len(self.hash)
        if w < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: w - n + 1] == self.doc[n - 1 :])
        sums = _prefix(self.hash, _WORD_BASE)
        return at, mix((sums[at + n] - sums[at]) * _power(_WORD_BASE, w + 1)[1][at] + np.uint64(n))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and hashes of distinct n-word shingles by row, then hash; a row of fewer words has its whole sequence as one."""
        at, h = self.windows(n)
        row = self.doc[at]
        count = np.diff(self.first)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            sums = _prefix(self.hash, _WORD_BASE)
            lo, hi = self.first[short], self.first[short + 1]
            whole = mix((sums[hi] - sums[lo]) * _power(_WORD_BASE, len(sums))[1][lo] + count[short].astype(np.uint64))
            row, h = np.concatenate([row, short]), np.concatenate([h, whole])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        return row[keep], h[keep]


def chunks(column: pa.Array, lower: bool = False) -> Iterator[Chunk]:
    """The rows of a string column, null as empty, in chunks of about CHUNK_BYTES."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, ends, body = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        lo = offsets[row]
        yield Chunk(row, data[lo : offsets[stop]], offsets[row : stop + 1] - lo, lower)
        row = stop
    pa.default_memory_pool().release_unused()  # an idle worker holds no batch's memory
