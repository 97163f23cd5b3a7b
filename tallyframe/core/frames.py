"""Statistics of many frames of one sequence, for all frames at once.

Order statistics go by the bits of the rank, sums and extremes by blocks of 1, 2, 4, ... rows: n log n for any width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def kth_smallest(values: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The ``k``-th smallest (from 0) of ``values[low:high]``, for each query; a wavelet matrix taken level by level.

    Each level of the ranks' bits is a stable split of the sequence; a frame goes on as a stretch of the half that
    holds its ``k``-th value. So the time is n log n for n queries of any width, and only one level is held.
    """
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    low, high, k, found = low.astype(np.int64), high.astype(np.int64), k.astype(np.int64), np.zeros(len(low), np.int64)
    for bit in range(max(1, (len(values) - 1).bit_length()) - 1, -1, -1):
        zero = (rank >> bit) & 1 == 0
        before = np.concatenate([[0], np.cumsum(zero)])
        a, b = before[low], before[high]
        up = k >= b - a
        found |= up.astype(np.int64) << bit
        k = np.where(up, k - (b - a), k)
        low, high = np.where(up, before[-1] + low - a, a), np.where(up, before[-1] + high - b, b)
        rank = np.concatenate([rank[zero], rank[~zero]])
    return values[order[found]]


def count_below(values: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many of ``values[low:high]`` (whole numbers from 0) are below ``bound``, for each query; as ``kth_smallest``."""
    out, low, high = np.zeros(len(low), np.int64), low.astype(np.int64), high.astype(np.int64)
    most = int(max(values.max(initial=0), bound.max(initial=0)))
    for bit in range(max(1, most.bit_length()) - 1, -1, -1):
        zero = (values >> bit) & 1 == 0
        before = np.concatenate([[0], np.cumsum(zero)])
        a, b = before[low], before[high]
        up = (bound >> bit) & 1 == 1
        out += np.where(up, b - a, 0)
        low, high = np.where(up, before[-1] + low - a, a), np.where(up, before[-1] + high - b, b)
        values = np.concatenate([values[zero], values[~zero]])
    return out


def medians(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The median of each frame, NaN for an empty one."""
    some = np.flatnonzero(high > low)
    out = np.full(len(low), np.nan)
    if len(some):
        a, b = low[some], high[some]
        two = kth_smallest(values, np.tile(a, 2), np.tile(b, 2), np.concatenate([(b - a - 1) // 2, (b - a) // 2]))
        out[some] = (two[: len(some)] + two[len(some) :]) / 2
    return out


def distinct_counts(codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many different codes each frame has: those whose previous occurrence lies before it."""
    order = np.argsort(codes, kind="stable")
    before = np.zeros(len(codes), np.int64)  # place of the previous occurrence, plus 1
    same = codes[order[1:]] == codes[order[:-1]]
    before[order[1:][same]] = order[:-1][same] + 1
    return count_below(before, low, np.maximum(low, high), low + 1)


def pieces(n: int, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, frames, blocks): the blocks of 2**level rows that make up each frame ``low:high``; a frame has two a level at most."""
    at = np.flatnonzero(high > low)
    a, b = low[at].astype(np.int64), high[at].astype(np.int64)
    for level in range(max(1, n).bit_length()):
        if not len(at):
            return
        odd = a & 1 == 1
        if odd.any():
            yield level, at[odd], a[odd]
            a = a + odd
        odd = (b & 1 == 1) & (b > a)
        if odd.any():
            b = b - odd
            yield level, at[odd], b[odd]
        more = b > a
        at, a, b = at[more], a[more] >> 1, b[more] >> 1


def halved(x: np.ndarray, fill: float | int) -> tuple[np.ndarray, np.ndarray]:
    """The left and right halves of the blocks of the next level."""
    if len(x) % 2:
        x = np.append(x, np.array([fill], x.dtype))
    return x[::2], x[1::2]


def extremes(values: np.ndarray, low: np.ndarray, high: np.ndarray, largest: bool) -> np.ndarray:
    """The least or largest value of each frame; 0 for an empty one."""
    take = np.maximum if largest else np.minimum
    out, seen, block, level = np.zeros(len(low), values.dtype), np.zeros(len(low), bool), values, 0
    for up, at, blocks in pieces(len(values), low, high):
        while level < up:
            if len(block) % 2:
                block = np.append(block, block[-1:])
            block, level = take(block[::2], block[1::2]), level + 1
        out[at] = np.where(seen[at], take(out[at], block[blocks]), block[blocks])
        seen[at] = True
    return out


def power_sums(values: np.ndarray, low: np.ndarray, high: np.ndarray, power: int) -> list[np.ndarray]:
    """n, sum, and sums of the powers 2 to ``power`` (3 at most) of the differences from the frame's mean.

    Blocks are added in pairs, so a frame has the digits of its own rows whatever comes before it.
    """

    def joined(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        n = a[0] + b[0]
        out = [n, a[1] + b[1]]
        if power > 1:
            na, nb, some = np.maximum(a[0], 1), np.maximum(b[0], 1), np.maximum(n, 1)
            d = np.where((a[0] > 0) & (b[0] > 0), b[1] / nb - a[1] / na, 0.0)
            out.append(a[2] + b[2] + d * d * (a[0] * b[0] / some))
            if power > 2:
                out.append(a[3] + b[3] + d**3 * (a[0] * b[0] * (a[0] - b[0]) / (some * some)) + 3 * d * (a[0] * b[2] - b[0] * a[2]) / some)
        return out

    block = [np.ones(len(values)), values.astype(float), *[np.zeros(len(values)) for _ in range(power - 1)]]
    out, level = [np.zeros(len(low)) for _ in block], 0
    for up, at, blocks in pieces(len(values), low, high):
        while level < up:
            halves = [halved(x, 0.0) for x in block]
            block, level = joined([a for a, _ in halves], [b for _, b in halves]), level + 1
        for x, y in zip(out, joined([x[at] for x in out], [x[blocks] for x in block]), strict=True):
            x[at] = y
    return out
