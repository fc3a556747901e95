"""Blocks of unsigned 32-bit integers: patched frame of reference.

A block holds BLOCK values, the last one of a file fewer. Its least value is subtracted; the width is the number of bits that
holds PERCENT per cent of the rest; values that need more are outliers, kept whole in the block's exception list. Bytes of a
block: the low width bits of its values as bit planes (plane k has bit k of every value, eight values a byte, lowest first),
then the outliers' places (16 bits each), then their values less the least one (32 bits each). A table gives each block's
start, so any value is read from one block."""

from __future__ import annotations

import numpy as np

BLOCK, PERCENT = 1024, 90
INDEX = np.dtype([("start", "<u8"), ("least", "<u4"), ("count", "<u2"), ("outliers", "<u2"), ("width", "u1")])


def _bits(values: np.ndarray) -> np.ndarray:
    """The number of bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1]


def encode(values: np.ndarray, at: int = 0) -> tuple[np.ndarray, bytes]:
    """The table and bytes of the blocks of values, the first one starting at byte at."""
    many = -(-len(values) // BLOCK)
    table = np.zeros(many, INDEX)
    if not many:
        return table, b""
    counts = np.full(many, BLOCK)
    counts[-1] = len(values) - BLOCK * (many - 1)
    padded = np.concatenate([values, np.full(BLOCK - counts[-1], values[-1])]).astype(np.uint32).reshape(many, BLOCK)
    least = padded.min(1)
    rest = padded - least[:, None]
    bits = _bits(rest)
    widths = np.partition(bits, PERCENT * BLOCK // 100 - 1, 1)[:, PERCENT * BLOCK // 100 - 1]
    out_block, out_place = np.nonzero(bits > widths[:, None])
    outliers = np.bincount(out_block, minlength=many)
    sizes = widths * (BLOCK // 8) + 6 * outliers
    starts = np.concatenate(([0], np.cumsum(sizes)))
    data = np.zeros(starts[-1], np.uint8)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        planes = np.stack([np.packbits((rest[rows] >> np.uint32(k)).astype(np.uint8) & 1, axis=1, bitorder="little") for k in range(width)], 1) if width else np.empty((len(rows), 0), np.uint8)
        data[starts[rows][:, None] + np.arange(width * (BLOCK // 8))] = planes.reshape(len(rows), -1)
    first = np.concatenate(([0], np.cumsum(outliers)))[out_block]
    nth = np.arange(len(out_block)) - first
    base = starts[out_block] + widths[out_block] * (BLOCK // 8)
    data[(base + 2 * nth)[:, None] + np.arange(2)] = out_place.astype("<u2").view(np.uint8).reshape(-1, 2)
    data[(base + 2 * outliers[out_block] + 4 * nth)[:, None] + np.arange(4)] = rest[out_block, out_place].astype("<u4").view(np.uint8).reshape(-1, 4)
    for name, column in (("start", starts[:-1] + at), ("least", least), ("count", counts), ("outliers", outliers), ("width", widths)):
        table[name] = column
    return table, data.tobytes()


def decode(table: np.ndarray, data: np.ndarray, at: int = 0) -> np.ndarray:
    """The values of the blocks of table, whose bytes are data, which begin at byte at of the file."""
    many = len(table)
    if not many:
        return np.empty(0, np.uint32)
    out = np.zeros((many, BLOCK), np.uint32)
    starts, widths = table["start"].astype(np.int64) - at, table["width"].astype(np.int64)
    outliers = table["outliers"].astype(np.int64)
    for width in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == width)
        planes = data[starts[rows][:, None] + np.arange(width * (BLOCK // 8))].reshape(len(rows), width, -1)
        for k in range(width):
            out[rows] |= np.unpackbits(planes[:, k], axis=1, bitorder="little").astype(np.uint32) << np.uint32(k)
    block = np.repeat(np.arange(many), outliers)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
    base = starts[block] + widths[block] * (BLOCK // 8)
    place = np.ascontiguousarray(data[(base + 2 * nth)[:, None] + np.arange(2)]).view("<u2").ravel()
    out[block, place] = np.ascontiguousarray(data[(base + 2 * outliers[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    out += table["least"][:, None]
    counts = table["count"]
    return out.ravel()[: BLOCK * (many - 1) + int(counts[-1])] if (counts[:-1] == BLOCK).all() else np.concatenate([row[:n] for row, n in zip(out, counts, strict=True)])
