"""Words and their 64-bit hashes for whole batches at once.

A span's bytes are read as 64-bit lanes, the last one filled up with zeros. Each
lane is scrambled together with its place, the lanes' values are added up, and
the length goes in last, so no word is handled by itself. Spans of up to eight
bytes and one length never collide; longer ones do with the chance of random
64-bit values, whatever pattern they follow. Where a collision would give a
wrong result, `equal_spans` compares the bytes.
"""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD1B54A32D192ED03)
#: Lanes that are hashed or compared at once.
_BLOCK = 1 << 19
#: What is kept of a lane that holds so many bytes of a span.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes outside [\x20\x09-\x0D].
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans(flat: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of bytes in `inside`), and n + 1 word offsets by document."""
    m = inside[flat]
    before = np.empty_like(m)
    if len(m):
        before[0] = False
        before[1:] = m[:-1]
        first = offsets[:-1][offsets[:-1] < len(m)]
        before[first] = False
    after = np.empty_like(m)
    if len(m):
        after[-1] = False
        after[:-1] = m[1:]
        last = offsets[1:-1]
        last = last[last > 0] - 1
        after[last] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _lane_view(flat: np.ndarray) -> np.ndarray:
    """The 64-bit value that begins at each byte."""
    padded = np.zeros(len(flat) + 8, dtype=np.uint8)
    padded[: len(flat)] = flat
    return np.ndarray((len(flat) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def _lanes(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(first span, number of spans, offsets of their lanes, lane numbers, lane values) by blocks.

    Spans with more lanes than a block come in several parts.
    """
    count = (lengths + 7) >> 3
    total = np.cumsum(count)
    a = 0
    while a < len(starts):
        if count[a] > _BLOCK:
            for low in range(0, int(count[a]), _BLOCK):
                number = np.arange(low, min(low + _BLOCK, int(count[a])))
                yield a, 1, np.zeros(1, np.int64), number, view[starts[a] + 8 * number] & _KEPT[np.minimum(lengths[a] - 8 * number, 8)]
            a += 1
            continue
        done = int(total[a] - count[a])
        b = max(a + 1, int(np.searchsorted(total, done + _BLOCK, side="right")))
        n = count[a:b]
        first = np.cumsum(n) - n
        number = np.arange(int(n.sum())) - np.repeat(first, n)
        left = np.repeat(lengths[a:b], n) - 8 * number
        yield a, b - a, first, number, view[np.repeat(starts[a:b], n) + 8 * number] & _KEPT[np.minimum(left, 8)]
        a = b


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, in any order; none may be empty."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    view, size = _lane_view(flat), ends - starts
    # most words are one lane
    total = mix((view[starts] & _KEPT[np.minimum(size, 8)]) + _SALT)
    long = np.flatnonzero(size > 8)
    if len(long):
        sums = np.zeros(len(long), dtype=np.uint64)
        for a, n, first, number, value in _lanes(view, starts[long] + 8, size[long] - 8):
            scrambled = mix(mix(value + _SALT) ^ ((number + 1).astype(np.uint64) * _STEP))
            sums[a : a + n] += np.add.reduceat(scrambled, first)
        total[long] += sums
    return mix(total ^ (size.astype(np.uint64) * _STEP))


def equal_spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span of flat has the bytes of the span of other beside it; none may be empty."""
    if not len(starts):
        return np.zeros(0, dtype=bool)
    size = ends - starts
    one, two = _lane_view(flat), _lane_view(other)
    kept = _KEPT[np.minimum(size, 8)]
    same = (size == other_ends - other_starts) & (one[starts] & kept == two[other_starts] & kept)
    long = np.flatnonzero(same & (size > 8))
    for x, y in zip(_lanes(one, starts[long] + 8, size[long] - 8), _lanes(two, other_starts[long] + 8, size[long] - 8)):
        same[long[x[0] : x[0] + x[1]]] &= np.logical_and.reduceat(x[4] == y[4], x[2])
    return same


def one_hash(word: bytes) -> int:
    """The hash that span_hashes gives this word."""
    flat = np.frombuffer(word, dtype=np.uint8)
    return int(span_hashes(flat, np.array([0]), np.array([len(flat)]))[0])


def lowered(flat: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte as it is."""
    return LOWER[flat]
