"""Code points of whole texts as NumPy arrays, taken from Arrow string columns."""

from __future__ import annotations

import numpy as np


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a run of rows (UTF-8 bytes and offsets), and the row bounds in code points."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(points) == len(data):
        return points, offsets
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, heads[offsets]


def padded(points: np.ndarray, bounds: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values between ``before`` and ``after`` zeros, and the new row bounds."""
    rows = np.arange(len(bounds) - 1)
    out = np.zeros(len(points) + (before + after) * len(rows), points.dtype)
    shift = before + (before + after) * np.repeat(rows, np.diff(bounds))
    out[np.arange(len(points)) + shift] = points
    return out, bounds + (before + after) * np.arange(len(bounds))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of stretches of the first axis; 0 for empty ones."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]
