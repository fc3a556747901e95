"""Byte spans (words, pieces of text) compared array-wise inside Spark tasks: hashes, and a verified hash table.

Spans are compared by their bytes wherever a hash brings two together, so no result depends on hashes being different."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sitemill.llm.words import mix, text_bytes

_U = np.uint64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Longer spans are hashed and compared one by one.
LONG = 256
GROUP_BYTES = 4 << 20


def text_groups(column: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts of some megabytes together (a longer one alone): the first row, the bytes, each text's offsets in them."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Spans:
    """The spans starts..ends of data."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.lengths = data, starts, ends - starts
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        # the eight bytes from each place on
        self.eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.starts[k] + self.lengths[k]].tobytes()

    def _eight(self, which: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of the spans which, zeros beyond their ends."""
        return self.eights[self.starts[which] + 8 * k] & _MASKS[np.minimum(self.lengths[which] - 8 * k, 8)]

    def hashes(self) -> np.ndarray:
        """64 bits of each span, the same in every task."""
        out = mix(self.lengths.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
        open_ = np.flatnonzero((self.lengths > 0) & (self.lengths <= LONG))
        for k in range(LONG // 8):
            if not len(open_):
                break
            out[open_] = mix(out[open_] ^ self._eight(open_, k))
            open_ = open_[self.lengths[open_] > 8 * (k + 1)]
        for k in np.flatnonzero(self.lengths > LONG):
            out[k] = int.from_bytes(hashlib.blake2b(self.text(k), digest_size=8).digest(), "little")
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a[i] and b[i] have the same bytes."""
        out = self.lengths[a] == self.lengths[b]
        open_ = np.flatnonzero(out & (self.lengths[a] <= LONG) & (a != b))
        k = 0
        while len(open_ := open_[self.lengths[a[open_]] > 8 * k]):
            same = self._eight(a[open_], k) == self._eight(b[open_], k)
            out[open_[~same]] = False
            open_ = open_[same]
            k += 1
        for i in np.flatnonzero(out & (self.lengths[a] > LONG) & (a != b)):
            out[i] = self.text(a[i]) == self.text(b[i])
        return out

    def first_equal(self, hashes: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
        """For each span the first span with the same bytes (and the same group).

        An open-addressing table: all spans try their slot at once, the first at a free slot takes it, spans that equal the
        slot's holder byte by byte are done, and the others go on to the next slot."""
        count = len(self)
        owner = np.empty(count, np.int64)
        if group is not None:
            hashes = mix(hashes + mix(group.astype(np.uint64)))
        size = 1 << max(4, (2 * count).bit_length())
        table = np.full(size, -1, np.int64)
        open_, slot = np.arange(count), (hashes & _U(size - 1)).astype(np.int64)
        while len(open_):
            free = np.flatnonzero(table[slot] < 0)[::-1]
            table[slot[free]] = open_[free]  # of several at one slot the last written, the first in order, stays
            holder = table[slot]
            same = hashes[holder] == hashes[open_]
            if group is not None:
                same &= group[holder] == group[open_]
            met = np.flatnonzero(same)
            same[met] = self.equal(open_[met], holder[met])
            owner[open_[same]] = holder[same]
            open_, slot = open_[~same], (slot[~same] + 1) & (size - 1)
        return owner
