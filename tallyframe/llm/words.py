"""Word hashes of whole texts, computed on the bytes of Arrow string columns.

A batch's texts lie one after the other in one buffer, so a few passes of NumPy over the bytes give a
64-bit hash for every word without a Python object per text or word. Words are runs of bytes other than
ASCII white space; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled whole.
CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_R = 0xD1342543DE82EF95
_R_INV = pow(_R, -1, 1 << 64)
_power = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["up"]) < n:
        n = max(n, CHUNK + 1)
        for name, r in (("up", _R), ("down", _R_INV)):
            a = np.full(n, r, np.uint64)
            a[0] = 1
            _power[name] = np.multiply.accumulate(a)
    return _power["up"], _power["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows, one more than rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``most`` bytes."""
    data, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, the row bounds in words (one more than rows), and the words' first bytes."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), np.zeros(0, np.int64)
    gap = _SPACE[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = gap[:-1]
    before[edge] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[edge - 1] = True
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(~gap & after) + 1
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + np.uint64(1))
    return hashes, np.searchsorted(start, offsets), start


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words inside a row, their row bounds, and the index of their first word.

    With ``whole``, a row of 1 to n-1 words gives one hash of all its words.
    """
    counts = np.diff(bounds)
    full = np.maximum(counts - n + 1, 0)
    out_counts = np.where(whole & (counts > 0) & (counts < n), 1, full)
    out = np.concatenate([[0], np.cumsum(out_counts)])
    first = np.arange(out[-1]) - np.repeat(out[:-1], out_counts) + np.repeat(bounds[:-1], out_counts)
    length = np.minimum(np.repeat(counts, out_counts), n)
    grams = mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(n):
        within = length > k
        if within.all():
            grams = mix(grams * np.uint64(0xD6E8FEB86659FD93) + hashes[first + k])
        elif within.any():
            grams[within] = mix(grams[within] * np.uint64(0xD6E8FEB86659FD93) + hashes[first[within] + k])
    return grams, out, first


def sets(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, and their row bounds."""
    rows, n = len(bounds) - 1, len(grams)
    if not n:
        return grams, np.zeros(rows + 1, np.int64)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    # one sort by row and the upper bits of the hash, with the place below, if these tell all hashes of a row apart
    low, high = n.bit_length(), 64 - rows.bit_length()
    key = np.sort((row.astype(np.uint64) << np.uint64(high)) | (grams >> np.uint64(64 - high) >> np.uint64(low) << np.uint64(low)) | np.arange(n, dtype=np.uint64))
    g, upper = grams[(key & np.uint64((1 << low) - 1)).astype(np.int64)], key >> np.uint64(low)
    if ((upper[1:] == upper[:-1]) & (g[1:] != g[:-1])).any():
        order = np.lexsort((grams, row))
        g, r = grams[order], row[order]
    else:
        r = (key >> np.uint64(high)).astype(np.int64)
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[keep], r[keep]
    return g, np.searchsorted(r, np.arange(len(bounds)))


def by_level(level: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of sorted sets by row, level and hash, and the place of each entry of it in its row.

    Levels from 2**24 on count as that.
    """
    sizes = np.diff(bounds)
    row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    level = np.minimum(level, (1 << 24) - 1)
    if len(sizes) >= 1 << 19 or (len(sizes) and sizes.max() >= 1 << 20):
        return np.lexsort((place, level, row)), place
    key = np.sort((row << 44) | (level << 20) | place)
    return bounds[:-1][row] + (key & ((1 << 20) - 1)), place
