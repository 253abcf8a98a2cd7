"""Word and shingle hashes over whole Arrow batches, without a Python loop over words.

A polynomial hash modulo 2**64 with an odd base has an inverse base, so the hash of any stretch is a difference of
prefix sums times a power of the inverse. Two bases give 128 bits. Words are mixed before they enter a longer hash. As such
sums can be equal for long patterned byte strings whatever the base, words of over LONG_WORD bytes are hashed by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

MASK = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
#: Words of more bytes are hashed one by one.
LONG_WORD = 48
#: Bytes of text that are hashed at a time; a longer text goes alone.
SLICE_BYTES = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done, step = 1, base & MASK
        while done < size:  # doubling: the second half is the first times base**done
            have[done : 2 * done] = have[:done] * np.uint64(step)
            done, step = 2 * done, step * step & MASK
        _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[starts[i]:ends[i]] for each i."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, len(values)), out=total[1:])
    back = powers(inverse(base), len(values) + 1)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts: byte places, owners and, for text i, first[i]:first[i+1] as its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = LOWER[data]
        self.data, n = data, len(data)
        inside = ~SPACE[data]
        begins, closes = inside.copy(), inside.copy()
        cut = offsets[(offsets > 0) & (offsets < n)]
        if n:
            begins[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            begins[cut] |= inside[cut]
            closes[cut - 1] |= inside[cut - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.owner = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        out = stretches(self.data, self.starts, self.ends, base)
        for i in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), base)
        return out

    def windows(self, size: int) -> np.ndarray:
        """First words of the windows of size words that lie in one text."""
        n = len(self.starts)
        if n < size:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.owner[: n - size + 1] == self.owner[size - 1 :])


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column, in pieces of about SLICE_BYTES; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to, data[offsets[at] : offsets[to]], (offsets[at : to + 1] - offsets[at]).astype(np.int64)
        at = to
