"""Encoders for chosen columns side by side, and as stages of a ``pyspark.ml`` pipeline."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame

from ..core.mapping import quoted


class ColumnEncoders:
    """Steps (name, make, columns): ``make(columns)`` gives an encoder of them; results are named ``<name>__<column>``.

    A column may be in several steps. Columns in none follow as they are, unless ``remainder`` is ``drop``;
    ``keep`` names columns that encoders need, a label say, and that stay.
    """

    def __init__(self, steps: list[tuple[str, Callable[[list[str]], Any], list[str]]], remainder: str = "passthrough", keep: list[str] | None = None):
        if remainder not in ("passthrough", "drop"):
            raise ValueError("the remainder is passthrough or drop")
        self.steps, self.remainder, self.keep = steps, remainder, keep or []

    def _copied(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{name}__{c}": quoted(c) for name, _, cols in self.steps for c in cols})

    def fit(self, df: DataFrame) -> ColumnEncoders:
        wide = self._copied(df)
        self.encoders = [make([f"{name}__{c}" for c in cols]).fit(wide) for name, make, cols in self.steps]
        return self

    def _done(self, df: DataFrame, wide: DataFrame) -> DataFrame:
        used = {c for _, _, cols in self.steps for c in cols} - set(self.keep)
        rest = [c for c in df.columns if c in self.keep or (c not in used and self.remainder == "passthrough")]
        return wide.select(*[quoted(c) for c in wide.columns if c not in df.columns], *map(quoted, rest))

    def transform(self, df: DataFrame, **how: Any) -> DataFrame:
        wide = self._copied(df)
        for e in self.encoders:
            wide = e.transform(wide, **how)
        return self._done(df, wide)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """What training rows get from encoders that tell them from others."""
        wide = self._copied(df)
        self.encoders = []
        for name, make, cols in self.steps:
            e = make([f"{name}__{c}" for c in cols])
            wide = e.fit_transform(wide)
            self.encoders.append(e)
        return self._done(df, wide)


class EncoderModel(Transformer):
    """A fitted encoder as a stage."""

    def __init__(self, encoder: Any):
        super().__init__()
        self.encoder = encoder

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.encoder.transform(dataset)


class EncoderStage(Estimator):
    """``make()`` gives an encoder with ``fit`` and ``transform``; the stage fits it and hands on an ``EncoderModel``."""

    def __init__(self, make: Callable[[], Any]):
        super().__init__()
        self.make = make

    def _fit(self, dataset: DataFrame) -> EncoderModel:
        return EncoderModel(self.make().fit(dataset))
