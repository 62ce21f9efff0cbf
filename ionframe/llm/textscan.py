"""Vectorised scanning of Arrow string columns: words, hashes of words, and bounded pieces of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
#: The bytes that separate words.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Which of the eight bytes loaded at a place belong to a span with so many bytes left.
_INSIDE = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total) of the runs of bytes that are not ``blank``; rows bound words."""
    low, high = int(offsets[0]), int(offsets[-1])
    inside = ~blank[data[low:high]]
    size = high - low
    edges = (offsets[1:-1] - low)[(offsets[1:-1] > low) & (offsets[1:-1] < high)]
    opens, closes = inside.copy(), inside.copy()
    if size:
        cut = np.zeros(size + 1, dtype=bool)
        cut[edges] = True
        opens[1:] &= ~inside[:-1] | cut[1:size]
        closes[:-1] &= ~inside[1:] | cut[1:size]
    starts, ends = np.flatnonzero(opens) + low, np.flatnonzero(closes) + low + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, the same wherever a span stands; ``fold`` maps bytes first; each ``seed`` is a hash of its own.

    A span is the sum of its 8-byte groups, each mixed with its place. The mix is no polynomial, so texts of a regular
    build do not collide by it; what must be right beyond that compares the bytes.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    low = int(starts.min())
    held = data[low : int(ends.max())]
    room = np.zeros(len(held) + 8, dtype=np.uint8)
    room[: len(held)] = held if fold is None else fold[held]
    groups = np.ndarray(len(held) + 1, dtype="<u8", buffer=room, strides=(1,))
    at, size = starts - low, ends - starts
    odd = mix64(np.array([seed], dtype=np.uint64) * _ODD + _ODD)[0] | np.uint64(1)
    out = mix64((groups[at] & _INSIDE[np.minimum(size, 8)]) ^ odd)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        place = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        byte = np.repeat(at[long], more) + 8 * place
        left = np.minimum(np.repeat(at[long] + size[long], more) - byte, 8)
        mixed = mix64((groups[byte] & _INSIDE[left]) ^ mix64((place.astype(np.uint64) + np.uint64(1)) * odd))
        out[long] += np.add.reduceat(mixed, np.cumsum(more) - more)
    return mix64(out ^ (size.astype(np.uint64) << np.uint64(40)))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
