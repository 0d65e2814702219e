"""Vectorised byte and word kernels shared by the operators that hash whole texts.

All functions work on one numpy buffer that holds many texts back to back; ``ends`` are the
texts' ends in it. Buffers are cut by the callers, so memory follows the slice, not the batch.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes beyond which a word is hashed by a digest.
LONG_WORD = 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept."""
    table = _powers.get(int(base))
    if table is None or len(table) < n:
        table = np.ones(1, np.uint64)
        while len(table) < n:
            step = np.uint64(pow(int(base), len(table), 1 << 64))
            table = np.concatenate([table, table * step])
        _powers[int(base)] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Hashes of any ranges of one sequence, from prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray):
        # mixing the symbols first keeps the polynomial away from small, structured values
        if values.dtype == np.uint8:
            symbols = _SYMBOLS[values]
        else:
            symbols = mix(values)
        self.n = len(values)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(symbols * _power_table(_BASE, self.n), out=self.sums[1:])
        self.inverse = _power_table(_INVERSE, self.n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, q: int) -> np.ndarray:
        """The hash of the q symbols from every position."""
        if self.n < q:
            return np.zeros(0, np.uint64)
        return mix((self.sums[q:] - self.sums[:self.n + 1 - q]) * self.inverse[:self.n + 1 - q])


_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the index of its leftmost smallest one.

    Only the upper 44 bits of a value decide, so that value and place fit one word; equal upper
    bits count as a tie, which the leftmost wins. The choice depends on the window alone.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    if n >= 1 << 20:
        raise ValueError("cut the sequence into slices of fewer than 2**20 values")
    keyed = (values & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keyed
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(after[:n - width + 1], before[width - 1:n])
    return (best & np.uint64(0xFFFFF)).astype(np.int64)


#: White space between words: space and U+0009 to U+000D.
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_PIECE = 1 << 20


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are no white space; none crosses an offset."""
    inside = _IS_WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts[inner] |= inside[inner]
    ends[inner - 1] |= inside[inner - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash per word. Long words take a digest: the polynomial modulo 2**64 is weak on patterned
    sequences of hundreds of symbols (two Thue-Morse words of 1,024 letters are equal under it)."""
    long = np.flatnonzero(end - start > LONG_WORD)
    if not len(long):
        return RangeHash(data).ranges(start, end)
    # a word of many megabytes takes no room in the table of sums
    short = np.ones(len(data), bool)
    for a, b in zip(start[long].tolist(), end[long].tolist()):
        short[a:b] = False
    place = np.concatenate([[0], np.cumsum(short)])
    found = RangeHash(data[short]).ranges(place[start], place[end])
    for k, a, b in zip(long.tolist(), start[long].tolist(), end[long].tolist()):
        found[k] = int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest(), "little")
    return found


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of the texts that ``offsets`` cut ``data`` into, and word counts' sums."""
    hashes, counts = [], [0]
    n = len(offsets) - 1
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + _PIECE, "right")) - 1
        last = min(n, max(last, first + 1))
        low, high = int(offsets[first]), int(offsets[last])
        if high - low <= 2 * _PIECE:
            part = data[low:high]
            start, end = word_bounds(part, offsets[first:last + 1] - low)
            hashes.append(_hashes(part, start, end))
            below = np.searchsorted(start, offsets[first + 1:last + 1] - low, "left")
            counts.extend((counts[-1] + below).tolist())
        else:                                   # one long text, piece by piece
            at, total = low, 0
            while at < high:
                until = min(high, at + _PIECE)
                while until < high and _IS_WORD[data[until]]:
                    # a piece ends between words, however long they are
                    rest = np.flatnonzero(~_IS_WORD[data[until:min(high, until + _PIECE)]])
                    until = until + int(rest[0]) if len(rest) else min(high, until + _PIECE)
                part = data[at:until]
                start, end = word_bounds(part, np.zeros(0, np.int64))
                hashes.append(_hashes(part, start, end))
                total += len(start)
                at = until
            counts.append(counts[-1] + total)
        first = last
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return flat, np.array(counts, np.int64)
