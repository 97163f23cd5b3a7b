"""Correlations and regressions of many columns from their cross products, summed in one pass.

Each task sums the products of its rows batch by batch, as matrices; Spark adds up the tasks' cells. The columns
are first moved by their means, so that the products keep their digits. A pair's figures are over the rows where
both have a value; NaN counts as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.mapping import clean, quoted

#: Columns up to which tasks hold the matrices (four of this squared).
MOST = 2000


def moved(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[float]]:
    """The columns as doubles less their means, and the means."""
    r = df.agg(*[F.avg(clean(df, c).cast("double")).alias(f"{i}") for i, c in enumerate(cols)]).first()
    means = [r[f"{i}"] or 0.0 for i in range(len(cols))]
    return df.select(*[(clean(df, c).cast("double") - m).alias(f"{i}") for i, (c, m) in enumerate(zip(cols, means, strict=True))]), means


def products(df: DataFrame, cols: list[str], complete: bool = False) -> DataFrame:
    """(i, j, n, x, xx, xy): over the rows where columns i and j have values, sums of i, of i squared and of i times j.

    i and j count from 0 in ``cols``. With ``complete``, rows that lack any value are left out.
    """
    if len(cols) > MOST:
        raise ValueError(f"over {MOST} columns")
    rows, _ = moved(df, cols)
    if complete:
        rows = rows.dropna()
    p = len(cols)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, p, p))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = ~np.isnan(x)
            if there.all():  # counts and squares don't depend on the other column then
                xy = x.T @ x
                total += np.stack([np.full((p, p), float(len(x))), x.T @ np.ones_like(x), np.repeat(xy.diagonal()[:, None], p, 1), xy])
                continue
            x, m = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        i, j = np.indices((p, p))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), *[pa.array(t.ravel()) for t in total]], ["i", "j", "n", "x", "xx", "xy"])

    cells = rows.mapInArrow(sums, "i long, j long, n double, x double, xx double, xy double")
    return cells.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx", "xy")])


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r, n) of every two columns, ``a`` before ``b``; r is null without spread."""
    names = F.array(*map(F.lit, cols))
    g = products(df, cols)
    other = g.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("x").alias("y"), F.col("xx").alias("yy"))
    both = g.filter("i < j").join(other, ["i", "j"])
    top = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    spread = (F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y"))
    return both.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.when(spread > 0, top / F.sqrt(spread)).alias("r"), F.col("n").cast("long").alias("n"))


class Regressions:
    """R squared of least squares with any subset of ``cols``, from the cross products of complete rows.

    The matrix of centred products, with the label last, is what is left of the data: one pass, and p squared numbers
    in the driver. Sweeping a column into it gives the regression with that column, and sweeping it back takes it
    out, so each step of a search scores all its candidates from the matrix at hand.
    """

    def __init__(self, df: DataFrame, cols: list[str], label: str, tolerance: float = 1e-10):
        self.cols, self.tolerance = list(cols), tolerance
        p = len(cols) + 1
        g, s, n = np.zeros((p, p)), np.zeros(p), 0.0
        for r in products(df.select(*map(quoted, [*cols, label])), [*cols, label], complete=True).collect():  # p squared rows
            g[r["i"], r["j"]], n = r["xy"], r["n"]
            s[r["i"]] = r["x"]
        self.rows = int(n)
        self.start = g - np.outer(s, s) / n if n else g
        self.total = self.start[-1, -1]

    @staticmethod
    def sweep(a: np.ndarray, k: int, back: bool = False) -> np.ndarray:
        """``a`` with column ``k`` swept into the regression, or back out of it."""
        d, sign = a[k, k], -1 if back else 1
        out = a - np.outer(a[:, k], a[k]) / d
        out[k], out[:, k] = sign * a[k] / d, sign * a[:, k] / d
        out[k, k] = -1 / d
        return out

    def _new(self, a: np.ndarray, k: int) -> bool:
        """Whether column ``k`` isn't told by the ones that are in."""
        return a[k, k] > self.tolerance * self.start[k, k]

    def r2(self, subset: tuple[str, ...] | list[str]) -> float:
        a = self.start
        for c in subset:
            k = self.cols.index(c)
            if self._new(a, k):
                a = self.sweep(a, k)
        return float(1 - a[-1, -1] / self.total) if self.total > 0 else 0.0

    def forward(self, k: int) -> list[tuple[str, float]]:
        """(column, R squared with it) of ``k`` steps that each add the column that explains most; the first of equal ones."""
        a, chosen = self.start, []
        while len(chosen) < min(k, len(self.cols)):
            gain = [a[i, -1] ** 2 / a[i, i] if c not in [x for x, _ in chosen] and self._new(a, i) else -1.0 for i, c in enumerate(self.cols)]
            best = int(np.argmax(gain))
            if gain[best] < 0:
                break
            a = self.sweep(a, best)
            chosen.append((self.cols[best], float(1 - a[-1, -1] / self.total)))
        return chosen

    def backward(self, k: int) -> list[tuple[str, float]]:
        """(column taken out, R squared without it) until ``k`` are left."""
        a, left, out = self.start, [], []
        for i in range(len(self.cols)):
            if self._new(a, i):
                a = self.sweep(a, i)
                left.append(i)
        while len(left) > k:
            lost = [a[i, -1] ** 2 / -a[i, i] for i in left]
            worst = left[int(np.argmin(lost))]
            a = self.sweep(a, worst, back=True)
            left.remove(worst)
            out.append((self.cols[worst], float(1 - a[-1, -1] / self.total)))
        return out

    def exhaustive(self, k: int, most: int = 1_000_000) -> tuple[tuple[str, ...], float]:
        """The ``k`` columns with the largest R squared; neighbours in the search share their swept columns."""
        if comb(len(self.cols), k) > most:
            raise ValueError(f"over {most} subsets")
        best: tuple[tuple[int, ...], float] = ((), -1.0)
        stack: list[tuple[int, np.ndarray]] = []
        for subset in combinations(range(len(self.cols)), k):
            keep = 0
            while keep < len(stack) and stack[keep][0] == subset[keep]:
                keep += 1
            del stack[keep:]
            for i in subset[keep:]:
                a = stack[-1][1] if stack else self.start
                stack.append((i, self.sweep(a, i) if self._new(a, i) else a))
            a = stack[-1][1] if stack else self.start
            r2 = float(1 - a[-1, -1] / self.total) if self.total > 0 else 0.0
            if r2 > best[1] + 1e-15:
                best = (subset, r2)
        return tuple(self.cols[i] for i in best[0]), best[1]
