"""Resampling of short series to a fixed length by their Fourier coefficients."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..core.mapping import quoted


def fourier(x: np.ndarray, n: int) -> np.ndarray:
    """``x``, along its first axis, at ``n`` evenly spaced points of its trigonometric interpolation."""
    m = len(x)
    if not m:
        return np.full((n, *x.shape[1:]), np.nan)
    c, keep = np.fft.rfft(x, axis=0), min(m, n)
    out = np.zeros((n // 2 + 1, *x.shape[1:]), complex)
    out[: keep // 2 + 1] = c[: keep // 2 + 1]
    if keep % 2 == 0 and m != n:  # the middle frequency of the shorter one stands for two
        out[keep // 2] *= 0.5 if n > m else 2
        if n < m:
            out[keep // 2] = out[keep // 2].real
    return np.fft.irfft(out, n, axis=0) * (n / m)


def resample(df: DataFrame, key: str, order: str, cols: list[str], n: int) -> DataFrame:
    """(key, step, cols): each key's series at ``n`` points. A series has to fit a task."""
    src = df.select(quoted(key).alias("key"), quoted(order).alias("at"), *[quoted(c).cast("double").alias(c) for c in cols])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = fourier(pdf.sort_values("at")[cols].to_numpy(), n)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "step": np.arange(n), **{c: values[:, i] for i, c in enumerate(cols)}})

    kind = src.schema["key"].dataType.simpleString()
    return src.groupBy("key").applyInPandas(one, f"key {kind}, step long, " + ", ".join(f"`{c}` double" for c in cols))
