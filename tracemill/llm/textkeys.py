"""Words and their 64-bit hashes, for whole Arrow batches at a time.

Everything works on the UTF-8 bytes of a column: the white space and the capitals in question are ASCII,
whose bytes occur in no other character, so bytes give the words that characters would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def letters_of(*kept: range) -> np.ndarray:
    """A table of bytes: A-Z to a-z, bytes beyond ASCII and in the given ranges as they are, any other to a blank."""
    table = LOWER.copy()
    table[:128][~np.isin(np.arange(128), [*range(65, 91), *range(97, 123), *(x for r in kept for x in r)])] = 0x20
    return table


#: One random 64-bit odd number per byte value.
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of x moves every bit of the result."""
    x = x + np.uint64((seed * _BASE + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_power[0]) < n:
        size = max(n, (1 << 21) + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _power[i] = np.multiply.accumulate(steps)
    return _power[0][:n], _power[1][:n]


def slices(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of a string column of about `limit` bytes: first row, row after the last, bytes, offsets.

    A null text counts as an empty one. A longer text is a part of its own, never cut.
    """
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and the first word of each text (with an end mark)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    after[-1], after[:-1] = False, solid[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of `size` lower-cased words.

    A text with fewer words has its whole sequence as its only shingle; one without words has none.
    Two shingles count as one when their 64-bit hashes agree.
    """
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    grams = np.zeros(max(0, len(words) - size + 1), np.uint64)  # none where all texts together have fewer words than a shingle
    factor = mix(np.arange(size, dtype=np.uint64), 7) | np.uint64(1)
    for i in range(size):
        grams += words[i : i + len(grams)] * factor[i]
    grams = mix(grams, 1)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield mix((words[a:b] * factor[: b - a]).sum(dtype=np.uint64, keepdims=True), 1 + b - a + size)
        else:
            yield np.zeros(0, np.uint64)
