"""Keyed running features over a stream, and the same in batch.

A row gets the sum, count and mean of its key's earlier labels and how often its (key, item) was seen,
capped; then its own label enters the state. Rows whose label is null get features and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..core.mapping import quoted
from ..operators.features import attempts, running_accuracy

OUT = "key long, item string, seq long, label double, sum double, count long, mean double, attempts int"
#: The state store that keyed state with maps needs; a key's items are entries of their own in it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rows(df: DataFrame, key: str, item: str, order: str, label: str) -> DataFrame:
    return df.select(quoted(key).cast("long").alias("key"), quoted(item).cast("string").alias("item"), quoted(order).cast("long").alias("seq"), quoted(label).cast("double").alias("label"))


class Knowledge(StatefulProcessor):
    """Sum and count of a key's labels, and a map from its items to how often they were seen."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "sum double, count long")
        self.items = handle.getMapState("items", "item string", "seen int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq")
        total, n = self.totals.get() if self.totals.exists() else (0.0, 0)
        # the state is read and written once an item of this batch; null and "" are different items
        names = {i: "n" if pd.isna(i) else f"s{i}" for i in pdf["item"].unique()}
        known = {i: self.items.getValue((k,))[0] if self.items.containsKey((k,)) else 0 for i, k in names.items()}
        out, changed = [], set()
        for r in pdf.itertuples():
            has = known[r.item]
            out.append((r.key, r.item, r.seq, r.label, total, n, total / n if n else None, min(has, self.cap)))
            if not pd.isna(r.label):
                total, n = total + r.label, n + 1
                known[r.item] = min(has + 1, self.cap)
                changed.add(r.item)
        self.totals.update((float(total), int(n)))
        for i in changed:
            self.items.updateValue((names[i],), (int(known[i]),))
        yield pd.DataFrame(out, columns=["key", "item", "seq", "label", "sum", "count", "mean", "attempts"])

    def close(self) -> None:
        pass


def stream_features(df: DataFrame, key: str, item: str, order: str, label: str, cap: int = 4) -> DataFrame:
    """Features of a streaming ``df``, state kept a key across micro-batches.

    Inside a micro-batch a key's rows are taken in ``order``; rows that arrive later count as later. State is
    read and written for the items of the batch only. Sets the session's state store to RocksDB (``STORE``),
    which such state needs.
    """
    df.sparkSession.conf.set(*STORE)
    rows = _rows(df, key, item, order, label)
    return rows.groupBy("key").transformWithStateInPandas(Knowledge(cap), OUT, "append", "none")


def batch_features(df: DataFrame, key: str, item: str, order: str, label: str, cap: int = 4) -> DataFrame:
    """What ``stream_features`` gives for rows that arrive in order and have labels, by windows."""
    rows = running_accuracy(_rows(df, key, item, order, label), ["key"], ["seq"], "label")
    rows = attempts(rows, ["key", "item"], ["seq"], "attempts", cap)
    return rows.selectExpr("key", "item", "seq", "label", "cast(sum as double) as sum", "count", "mean", "cast(attempts as int) as attempts")
