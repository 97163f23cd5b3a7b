"""Statistics of a slot over days before each of its days, without a task that holds a slot.

Sums, spreads and extremes come from figures by slot and day. Different values are counted at their last day in a
frame, as intervals of the days that see them there. Medians are looked for by value: rows are dealt to buckets of
the order of (slot, value), counts by bucket and day say which bucket holds a frame's middle, and a task finds it
among the rows of its bucket, a bounded number.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.frames import kth_smallest
from ..core.order import kept, placed
from .windows import ROWS

STATS = {"min", "max", "sum", "count", "mean", "std", "skew", "median", "nunique"}


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``a`` with the columns that ``b`` has beyond ``on``; null matches null."""
    renamed = b.select(*[F.col(c).alias(f"{c}_2") if c in on else F.col(c) for c in b.columns])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_2")) for c in on])
    return a.join(renamed, same, how).drop(*[f"{c}_2" for c in on])


def slot_history(rows: DataFrame, stats: list[str], low: int | None, high: int, bucket: int = ROWS) -> DataFrame:
    """(slot, d, and a column for each of ``stats``) for every slot and day ``d`` of ``rows`` (slot, d, x), d a number and never null.

    A day's frame goes from ``low`` (None: the first day) to ``high`` days from it.
    """
    w = Window.partitionBy("slot").orderBy("d").rangeBetween(Window.unboundedPreceding if low is None else low, high)
    days = rows.select("slot", "d").distinct()
    out, plain = days, set(stats) - {"median", "nunique"}
    number = isinstance(rows.schema["x"].dataType, T.NumericType)
    aggs = {"n": F.count("x"), "mi": F.min("x"), "ma": F.max("x")} | ({"s": F.sum("x")} if plain & {"sum", "mean"} else {})
    based = rows
    if plain & {"std", "skew"}:
        centre = rows.groupBy("slot").agg(F.avg("x").alias("c"))
        based = _joined(rows, centre, ["slot"]).withColumn("e", F.col("x").cast("double") - F.col("c"))
        aggs |= {f"e{k}": F.sum(F.pow("e", F.lit(float(k)))) for k in (1, 2, 3)}
    by_day = based.groupBy("slot", "d").agg(*[e.alias(n) for n, e in aggs.items()])
    f = {n: (F.min if n == "mi" else F.max if n == "ma" else F.sum)(n).over(w).alias(n) for n in aggs}
    made = by_day.select("slot", "d", *f.values()).withColumn("n", F.coalesce("n", F.lit(0)))
    n, flat = F.col("n"), F.col("mi") == F.col("ma")
    figures: dict[str, Column] = {"count": n, "min": F.col("mi"), "max": F.col("ma")}
    if plain & {"sum", "mean"}:
        figures |= {"sum": F.col("s"), "mean": F.try_divide(F.col("s").cast("double"), n)}
    if plain & {"std", "skew"}:
        m = F.col("e1") / n
        p2 = F.greatest(F.lit(0.0), F.col("e2") - n * m * m)
        p3 = F.col("e3") - 3 * m * F.col("e2") + 2 * n * m * m * m
        figures["std"] = F.when(n > 1, F.when(flat, 0.0).otherwise(F.sqrt(p2 / (n - 1))))
        figures["skew"] = F.when(n > 2, F.when(flat | (p2 == 0), 0.0).otherwise(p3 / n / F.pow(p2 / n, F.lit(1.5)) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2)))
    out = made.select("slot", "d", n.alias("__n"), *[figures[s].alias(s) for s in stats if s in plain])
    some = rows.filter("x is not null")
    if "nunique" in stats:
        out = _joined(out, _different(some, days, low, high), ["slot", "d"]).withColumn("nunique", F.when(F.col("__n") > 0, F.col("nunique")))
    if "median" in stats:
        if not number:
            raise TypeError("medians are of numbers")
        out = _joined(out, _medians(some, days, low, high, bucket), ["slot", "d"])
    return out.select("slot", "d", *stats)


def _different(some: DataFrame, days: DataFrame, low: int | None, high: int) -> DataFrame:
    """(slot, d, nunique): a value counts at its last day of a frame, so from there until it comes again or leaves."""
    seen = some.select("slot", "x", "d").distinct()
    again = F.lead("d").over(Window.partitionBy("slot", "x").orderBy("d")) - high
    seen = seen.withColumn("end", again if low is None else F.least(again, F.col("d") - low + 1)).withColumn("from", F.col("d") - high)
    steps = seen.select("slot", F.col("from").alias("d"), F.lit(1).alias("step")).unionByName(seen.filter("end is not null").select("slot", F.col("end").alias("d"), F.lit(-1).alias("step")))
    steps = steps.groupBy("slot", "d").agg(F.sum("step").alias("step"))
    both = steps.withColumn("own", F.lit(False)).unionByName(days.select("slot", "d", F.lit(0).cast("long").alias("step"), F.lit(True).alias("own")))
    w = Window.partitionBy("slot").orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("nunique", F.sum("step").over(w)).filter("own").select("slot", "d", "nunique")


def _medians(some: DataFrame, days: DataFrame, low: int | None, high: int, bucket: int) -> DataFrame:
    """(slot, d, median) of the days whose frame has values."""
    at = placed(some.select("slot", "d", F.col("x").cast("double").alias("x")), ["slot", "x"], "__p").withColumn("b", F.floor(F.col("__p") / bucket)).drop("__p")
    counts = kept(at.groupBy("slot", "b", "d").agg(F.count("*").alias("n")))
    grid = _joined(days, counts.select("slot", "b").distinct(), ["slot"], "inner")
    own = Window.partitionBy("slot", "b").orderBy("d").rangeBetween(Window.unboundedPreceding if low is None else low, high)
    grid = _joined(grid, counts, ["slot", "b", "d"]).withColumn("n", F.coalesce(F.sum("n").over(own), F.lit(0)))
    frame = Window.partitionBy("slot", "d")
    grid = grid.withColumns({"before": F.coalesce(F.sum("n").over(frame.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("n").over(frame)})
    k = [F.floor((F.col("all") - 1) / 2) - F.col("before"), F.floor(F.col("all") / 2) - F.col("before")]
    asked = grid.filter("all > 0").select(F.col("slot").alias("of"), F.col("b").alias("at"), F.col("d").alias("day"), *[F.when((x >= 0) & (x < F.col("n")), x).alias(f"k{i}") for i, x in enumerate(k)]).filter("k0 is not null or k1 is not null")
    schema = T.StructType([at.schema["slot"], at.schema["d"], T.StructField("v", T.DoubleType())])

    def find(values: pa.Table, wanted: pa.Table) -> pa.Table:
        """The sum of the one or two values of the bucket that each frame asks for."""
        slots = pa.chunked_array([*values.column("slot").chunks, *wanted.column("of").chunks], values.schema.field("slot").type)
        code = slots.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        has, ask = code[: values.num_rows], code[values.num_rows :]
        d, want = values.column("d").to_numpy().astype(np.int64), wanted.column("day").to_numpy().astype(np.int64)
        order = np.lexsort((d, has))
        key, x = (has[order] << 34) + d[order] + (1 << 32), values.column("x").to_numpy()[order]
        first = (ask << 34) if low is None else (ask << 34) + want + low + (1 << 32)
        a, b = np.searchsorted(key, first, "left"), np.searchsorted(key, (ask << 34) + want + high + (1 << 32), "right")
        v = np.zeros(len(want))
        for c in ("k0", "k1"):
            k = wanted.column(c).combine_chunks()
            there = k.is_valid().to_numpy(zero_copy_only=False)
            v[there] += kth_smallest(x, a[there], b[there], k.drop_null().to_numpy()) if there.any() else 0.0
        return pa.table([wanted.column("of"), wanted.column("day"), pa.array(v)], names=["slot", "d", "v"])

    found = at.groupBy("b").cogroup(asked.groupBy("at")).applyInArrow(find, schema)
    return found.groupBy("slot", "d").agg((F.sum("v") / 2).alias("median"))
