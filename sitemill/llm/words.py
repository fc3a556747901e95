"""Word and shingle hashes over Arrow text columns, computed array-wise inside Spark tasks.

A word is a maximal run of bytes outside space and \\t..\\r, which is the same on characters, as those
bytes never occur inside a longer UTF-8 character. A-Z fold to a-z. Hashes are 64 bits: two different
words or shingles meet with probability 2**-64 a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_RANDOM = np.random.default_rng(0x5EED)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
# one random number a byte; capitals share that of their small letter, white space counts nothing
_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]
_VALUES[IS_SPACE] = 0
_PLACES = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
BYTES_AT_ONCE = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    values = values ^ (values >> _U(30))
    values = values * _U(0xBF58476D1CE4E5B9)
    values ^= values >> _U(27)
    values = values * _U(0x94D049BB133111EB)
    values ^= values >> _U(31)
    return values


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < size:
        size = max(size, 2 * BYTES_AT_ONCE)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and each text's offsets in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    letter = ~IS_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = letter[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after = np.zeros(len(data), bool)
    after[:-1] = letter[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(letter & ~before)
    return starts, np.flatnonzero(letter & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from running sums over about a megabyte at a time."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + BYTES_AT_ONCE, "right")))
        part = data[low : ends[last - 1]]
        up, down = _power_tables(len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUES[part] * up[: len(part)], out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        first = last
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of size words; windows over a text's end are the caller's to drop."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = words[:count] * _PLACES[0]
    for k in range(1, size):
        total = total + words[k : count + k] * _PLACES[k]
    return mix(total + _U(size))


def sequence_hash(words: np.ndarray) -> int:
    """A hash of one short sequence of words as a whole."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([(words * _PLACES[: len(words)]).sum(dtype=np.uint64) + _U(len(words))], np.uint64))[0])


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; shorter texts give one shingle, empty ones none."""
    for hashes, first in hashed_texts(column):
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a < size:
                yield np.array([sequence_hash(hashes[a:b])] if b > a else [], np.uint64)
            else:
                found = window_hashes(hashes[a:b], size)
                found.sort()
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]


def hashed_texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and first-word indexes of consecutive groups of texts of a few megabytes each."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + 4 * BYTES_AT_ONCE, "right")) - 1)
        part = data[offsets[row] : offsets[end]]
        starts, ends, first = word_spans(part, offsets[row : end + 1] - offsets[row])
        yield word_hashes(part, starts, ends), first
        row = end


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings each bucket's hashes together, the buckets that occur, and where each begins (one more at the end)."""
    place = (hashes >> _U(33)) % _U(buckets)
    order = np.argsort(place, kind="stable")
    found, at = np.unique(place[order], return_index=True)
    return order, found.astype(np.int64), np.append(at, len(hashes))
