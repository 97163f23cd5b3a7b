"""Running features of a stream whose labels come later, in a stream of their own, and the same in batch.

Questions (key, item, order) get features at once: the sum, count and mean of the labels that are known of their
key, and how often its (key, item) was asked before. Answers (key, order, label) find their question among those
that are pending. Labels of questions asked in earlier micro-batches enter before the batch's questions get their
features, labels of the batch's own questions after; so no question sees a label of its own batch, even if both
come together. A question without an answer for ``expire_ms`` is forgotten by a timer; a later answer to it, and any
other without a pending question, changes nothing. Null labels take the question off and change nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..core.mapping import quoted
from ..operators.features import attempts
from .knowledge import STORE

OUT = "key long, item string, seq long, sum double, count long, mean double, attempts int"
#: What the mean is for a key without labels, and how long a question waits for its answer.
PRIOR, EXPIRE_MS = 0.68, 7 * 86_400_000


class Delayed(StatefulProcessor):
    """A key's label sums, how often its items were asked (a map), and its pending questions (a map by order)."""

    def __init__(self, cap: int, prior: float, expire_ms: int):
        self.cap, self.prior, self.expire_ms = cap, prior, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "sum double, count long")
        self.items = handle.getMapState("items", "item string", "asked int")
        self.pending = handle.getMapState("pending", "seq long", "since long")

    def _answer(self, answers: pd.DataFrame, total: float, n: int) -> tuple[float, int, list]:
        """Takes what has a pending question; the rest is handed back."""
        left = []
        for seq, label in zip(answers["seq"].tolist(), answers["label"].tolist(), strict=True):
            if not self.pending.containsKey((seq,)):
                left.append((seq, label))
                continue
            self.pending.removeKey((seq,))
            if not pd.isna(label):
                total, n = total + label, n + 1
        return total, n, left

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        total, n = self.totals.get() if self.totals.exists() else (0.0, 0)
        answers, questions = pdf[pdf["answer"]], pdf[~pdf["answer"]]
        total, n, early = self._answer(answers, total, n)
        out, asked = [], {}
        for r in questions.itertuples():
            name = "n" if pd.isna(r.item) else f"s{r.item}"
            if name not in asked:
                asked[name] = self.items.getValue((name,))[0] if self.items.containsKey((name,)) else 0
            out.append((r.key, r.item, r.seq, total, n, total / n if n else self.prior, min(asked[name], self.cap)))
            asked[name] = min(asked[name] + 1, self.cap)
            self.pending.updateValue((int(r.seq),), (r.at.value // 1_000_000,))
        for name, k in asked.items():
            self.items.updateValue((name,), (int(k),))
        if early:
            total, n, _ = self._answer(pd.DataFrame(early, columns=["seq", "label"]), total, n)
        self.totals.update((float(total), int(n)))
        if len(questions):
            self.handle.registerTimer(int(questions["at"].max().value // 1_000_000 + self.expire_ms))
        yield pd.DataFrame(out, columns=["key", "item", "seq", "sum", "count", "mean", "attempts"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() - self.expire_ms
        for seq in [s for s, since in self.pending.iterator() if since[0] <= due]:
            self.pending.removeKey(seq)
        yield pd.DataFrame([], columns=["key", "item", "seq", "sum", "count", "mean", "attempts"])

    def close(self) -> None:
        pass


def stream_features(questions: DataFrame, answers: DataFrame, key: str, item: str, order: str, label: str, time: str, cap: int = 4, prior: float = PRIOR, expire_ms: int = EXPIRE_MS, delay: str = "1 day") -> DataFrame:
    """Features of the streaming ``questions``; ``answers`` is a stream with the key, the order, the label and the time.

    One keyed operator takes both. Sets the session's state store to RocksDB, which maps in state need.
    """
    questions.sparkSession.conf.set(*STORE)
    q = questions.select(quoted(key).cast("long").alias("key"), quoted(item).cast("string").alias("item"), quoted(order).cast("long").alias("seq"), F.lit(None).cast("double").alias("label"), F.lit(False).alias("answer"), quoted(time).cast("timestamp").alias("at"))
    a = answers.select(quoted(key).cast("long").alias("key"), F.lit(None).cast("string").alias("item"), quoted(order).cast("long").alias("seq"), quoted(label).cast("double").alias("label"), F.lit(True).alias("answer"), quoted(time).cast("timestamp").alias("at"))
    return q.unionByName(a).withWatermark("at", delay).groupBy("key").transformWithStateInPandas(Delayed(cap, prior, expire_ms), OUT, "append", "eventTime")


def batch_features(df: DataFrame, key: str, item: str, order: str, batch: str, label: str, cap: int = 4, prior: float = PRIOR) -> DataFrame:
    """What ``stream_features`` gives if the questions of each ``batch`` are answered before the next one.

    Labels are summed by key and batch first, so the running sums have a row a key and batch.
    """
    rows = df.select(quoted(key).cast("long").alias("key"), quoted(item).cast("string").alias("item"), quoted(order).cast("long").alias("seq"), quoted(batch).cast("long").alias("batch"), quoted(label).cast("double").alias("label"))
    before = Window.partitionBy("key").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("key", "batch").agg(F.coalesce(F.sum("label"), F.lit(0.0)).alias("s"), F.count("label").alias("n"))
    sums = sums.select(F.col("key").alias("k"), F.col("batch").alias("b"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("sum"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("count"))
    rows = attempts(rows, ["key", "item"], ["seq"], "attempts", cap)
    both = rows.join(sums, F.col("key").eqNullSafe(F.col("k")) & F.col("batch").eqNullSafe(F.col("b")))
    return both.select("key", "item", "seq", "sum", "count", F.coalesce(F.try_divide(F.col("sum"), F.col("count")), F.lit(prior)).alias("mean"), F.col("attempts").cast("int").alias("attempts"))
