"""Greedy choice of features around any scoring function, and out-of-fold assembly for stacking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_r2(df: DataFrame, label: str) -> Callable[[tuple[str, ...]], float]:
    """A score of column sets: R squared of a linear regression."""

    def score(cols: tuple[str, ...]) -> float:
        if not cols:
            return 0.0
        ready = VectorAssembler(inputCols=list(cols), outputCol="__x", handleInvalid="skip").transform(df)
        return LinearRegression(featuresCol="__x", labelCol=label).fit(ready).summary.r2

    return score


def forward(cols: list[str], score: Callable[[tuple[str, ...]], float], k: int) -> list[str]:
    """Adds the column that scores best, ``k`` times."""
    chosen: list[str] = []
    while len(chosen) < min(k, len(cols)):
        chosen.append(max((c for c in cols if c not in chosen), key=lambda c: score((*chosen, c))))
    return chosen


def backward(cols: list[str], score: Callable[[tuple[str, ...]], float], k: int) -> list[str]:
    """Takes out the column that is missed least until ``k`` are left."""
    left = list(cols)
    while len(left) > k:
        left.remove(max(left, key=lambda c: score(tuple(x for x in left if x != c))))
    return left


def exhaustive(cols: list[str], score: Callable[[tuple[str, ...]], float], k: int) -> tuple[str, ...]:
    return max(combinations(cols, k), key=score)


def out_of_fold_predictions(df: DataFrame, fold: str, k: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each row predicted by the model that was fitted without its fold; ``fit`` gives a function of tables."""
    parts = [fit(df.filter(F.col(fold) != i))(df.filter(F.col(fold) == i)) for i in range(k)]
    return reduce(DataFrame.unionByName, parts)
