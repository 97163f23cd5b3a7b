"""Windows over long series, with or without a key, in bounded tasks.

``time_windows`` deals a series to buckets of time, a few spans wide, and gives each the rows of the span before it.
The others number the rows by ranges of the order (``core.order.placed``) and deal them to buckets of equal size:
``row_windows`` and ``shifted`` give each bucket the rows that its first ones look back (or ahead) to;
``running`` and ``filled_back`` aggregate the buckets, run over these (a row a bucket), and carry the result into
each. Statistics of frames come from ``core.frames``, in n log n for any width of the frames.

Rows without a time get no statistics and a count of 0. NaN counts as null in medians and distinct counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.frames import distinct_counts, extremes, medians, power_sums
from ..core.mapping import clean, quoted
from ..core.order import placed

ORDERED = {"median": T.DoubleType(), "nunique": T.LongType()}
#: Statistics of numbers that frames with two ends get from ``core.frames``; Spark's windows look at all rows of each such frame.
SUMMED = {"mean": T.DoubleType(), "std": T.DoubleType(), "skew": T.DoubleType(), "count": T.LongType()}
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Rows of a bucket, spans that a bucket of time is wide, and rows of groups that a task takes at once.
ROWS, SPANS, GATHER = 1 << 20, 4, 1 << 16


def known(stats: list[str]) -> None:
    """Refuses statistics that windows don't have."""
    for s in stats:
        if s not in {*ORDERED, "min", "max", "mean", "sum", "count", "std", "skew", "first", "last"}:
            raise KeyError(s)


def _simple(stat: str, x: Column, w) -> Column:
    n = F.count(x).over(w).cast("double")
    if stat == "skew":
        g = F.skewness(x).over(w) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
        return F.when(n < 3, None).when(F.var_pop(x).over(w) == 0, 0.0).otherwise(g)
    return {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "count": F.count, "std": F.stddev_samp, "first": F.first, "last": F.last}[stat](x).over(w)


def framed(df: DataFrame, group: list[str], order: list[str], col: str, stats: list[str], prefix: str, low: int | None, high: int, by_rows: bool, min_periods: int = 1) -> DataFrame:
    """Statistics over a frame of each row in its group's order, from ``low`` (None: the first row) to ``high``.

    The group has a column at least. Bounds are numbers of rows or, without ``by_rows``, distances of the only order column, a number. A group is
    one task's, which takes those of a batch together: medians and distinct counts take n log n there, and so do
    other statistics of numbers, but for the first and last row, where frames have a lower end. The rest are Spark's windows.
    """
    known(stats)
    of, own_type = df.schema[col].dataType, {}
    if low is not None and isinstance(of, (*WHOLE, T.FloatType, T.DoubleType)):
        own_type = SUMMED | {"min": of, "max": of, "sum": T.LongType() if isinstance(of, WHOLE) else T.DoubleType()}
    made_here = ORDERED | own_type
    x = clean(df, col)
    own = Window.partitionBy(*map(quoted, group)).orderBy(*map(quoted, order))
    w = own.rowsBetween(Window.unboundedPreceding if low is None else low, high) if by_rows else own.rangeBetween(Window.unboundedPreceding if low is None else low, high)
    enough = F.count(x).over(w) >= min_periods
    plain, hard = [s for s in stats if s not in made_here], [s for s in stats if s in made_here]
    made = {f"{prefix}{s}": _simple(s, x, w) if s == "count" else F.when(enough, _simple(s, x, w)) for s in plain}
    if not hard:
        return df.withColumns(made)
    out = df.repartition(*map(quoted, group)).withColumns({**made, "__place": F.row_number().over(own)})
    out = out.sortWithinPartitions(*map(quoted, group), "__place")
    schema = T.StructType([*[f for f in out.schema if f.name != "__place"], *[T.StructField(f"{prefix}{s}", made_here[s]) for s in hard]])

    def bounds(rows: pa.Table, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first row and the end of each row's frame; groups begin at ``start`` and stop at ``end``."""
        first, stop = np.repeat(start, end - start), np.repeat(end, end - start)
        if by_rows:
            place = np.arange(rows.num_rows)
            return first if low is None else np.clip(place + low, first, stop), np.clip(place + high + 1, first, stop)
        at = rows.column(order[0]).cast(pa.int64()).fill_null(-(1 << 60)).to_numpy()
        a, b = first.copy(), np.empty(len(at), np.int64)
        for i, j in zip(start.tolist(), end.tolist(), strict=True):
            if low is not None:
                a[i:j] += np.searchsorted(at[i:j], at[i:j] + low, "left")
            b[i:j] = i + np.searchsorted(at[i:j], at[i:j] + high, "right")
        return a, b

    def summed(values: pa.Array, a: np.ndarray, b: np.ndarray, enough: np.ndarray) -> Iterator[tuple[str, pa.Array]]:
        """The statistics of ``own_type`` that are asked for, over ``values[a:b]``."""
        asked = set(hard) & set(own_type)
        yield "count", pa.array(b - a)
        x = values.to_numpy(zero_copy_only=False)
        for s in asked & {"min", "max"}:
            yield s, pa.array(extremes(x, a, b, s == "max"), values.type, mask=~enough)
        if pa.types.is_integer(values.type) and "sum" in asked:
            total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
            yield "sum", pa.array(total[b] - total[a], mask=~enough)
            asked -= {"sum"}
        power = 3 if "skew" in asked else 2 if "std" in asked else 1 if asked & {"sum", "mean"} else 0
        if not power:
            return
        n, total, *spread = power_sums(x, a, b, power)
        some = np.maximum(n, 1)
        if "sum" in asked:
            yield "sum", pa.array(total, mask=~enough)
        yield "mean", pa.array(total / some, mask=~enough)
        if power > 1:
            yield "std", pa.array(np.sqrt(spread[0] / np.maximum(n - 1, 1)), mask=~enough | (n < 2))
        if power > 2:
            flat = spread[0] == 0
            g = spread[1] / some / np.where(flat, 1.0, spread[0] / some) ** 1.5
            yield "skew", pa.array(np.where(flat, 0.0, g * np.sqrt(n * (n - 1)) / np.maximum(n - 2, 1)), mask=~enough | (n < 3))

    def whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(rows.column("__place").to_numpy() == 1)
        a, b = bounds(rows, start, np.append(start[1:], rows.num_rows))
        b = np.maximum(a, b)
        values = rows.column(col)
        if pa.types.is_floating(values.type):
            values = pc.if_else(pc.is_nan(values), pa.scalar(None, values.type), values)
        counts = np.concatenate([[0], np.cumsum(values.is_valid().to_numpy())])
        a, b = counts[a], counts[b]
        values, enough = values.drop_null().combine_chunks(), b - a >= max(1, min_periods)
        sums = {s: r for s, r in summed(values, a, b, enough) if s in hard}
        for s in hard:
            if s in sums:
                rows = rows.append_column(f"{prefix}{s}", sums[s])
                continue
            if s == "median":
                made = pa.array(medians(values.cast(pa.float64()).to_numpy(zero_copy_only=False), a, b), mask=~enough)
            else:
                codes = (values.dictionary_encode() if len(values) else pa.array([], pa.string()).dictionary_encode()).indices.to_numpy(zero_copy_only=False)
                made = pa.array(distinct_counts(codes.astype(np.int64), a, b), mask=b - a < min_periods)
            rows = rows.append_column(f"{prefix}{s}", made)
        yield from rows.drop_columns("__place").combine_chunks().to_batches()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            heads = np.flatnonzero(batch.column("__place").to_numpy() == 1)
            if size + batch.num_rows >= GATHER and len(heads) and size + heads[-1]:
                yield from whole(pa.Table.from_batches([*held, batch.slice(0, heads[-1])]).combine_chunks())
                held, size, batch = [], 0, batch.slice(heads[-1])
            held.append(batch)
            size += batch.num_rows
        if size:
            yield from whole(pa.Table.from_batches(held).combine_chunks())

    return out.mapInArrow(frames, schema).select(*[quoted(c) for c in [*df.columns, *[f"{prefix}{s}" for s in stats]]])


def time_windows(df: DataFrame, ts: str, col: str, span_us: int, stats: list[str], prefix: str, keys: tuple[str, ...] | list[str] = (), min_periods: int = 1, spans: int = SPANS) -> DataFrame:
    """Statistics over [t - span, t): rows of the current time are left out.

    A bucket holds ``spans`` spans of time of one key and the span before it, so a row is in two at most, and the
    work of a task follows from how many rows such a stretch has, not from the series' length.
    """
    t, width = F.unix_micros(quoted(ts).cast("timestamp")), spans * span_us
    rows = df.withColumn("__t", t)
    timed = rows.filter("__t is not null").withColumn("__home", ((F.col("__t") - F.pmod("__t", F.lit(width))) / width).cast("long"))
    ahead = F.col("__t") + span_us >= (F.col("__home") + 1) * width
    timed = timed.withColumn("__bucket", F.explode(F.when(ahead, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home"))))
    out = framed(timed, [*keys, "__bucket"], ["__t"], col, stats, prefix, -span_us, -1, False, min_periods)
    out = out.filter("__bucket = __home").drop("__t", "__home", "__bucket")
    if not dict((f.name, f.nullable) for f in df.schema)[ts]:
        return out
    none = {f"{prefix}{s}": F.lit(0 if s == "count" else None).cast(out.schema[f"{prefix}{s}"].dataType) for s in stats}
    return out.unionByName(rows.filter("__t is null").drop("__t").withColumns(none))


def _dealt(df: DataFrame, order: list[str], size: int, back: int, ahead: int = 0) -> DataFrame:
    """``df`` with __p (place), __home (its bucket) and __bucket, also those whose rows look back or ahead to it."""
    at = placed(df, order, "__p").withColumn("__home", F.floor(F.col("__p") / size))
    first, last = F.floor(F.greatest(F.col("__p") - ahead, F.lit(0)) / size), F.floor((F.col("__p") + back) / size)
    return at.withColumn("__bucket", F.explode(F.sequence(first, last)))


def row_windows(df: DataFrame, order: list[str], col: str, size: int, stats: list[str], prefix: str, min_periods: int = 1, rows: int = ROWS) -> DataFrame:
    """Statistics over the last ``size`` rows of the whole series, the current one included."""
    dealt = _dealt(df, order, max(rows, size), size - 1)
    out = framed(dealt, ["__bucket"], ["__p"], col, stats, prefix, -(size - 1), 0, True, min_periods)
    return out.filter("__bucket = __home").drop("__p", "__home", "__bucket")


def shifted(df: DataFrame, order: list[str], cols: dict[str, tuple[str, int]], rows: int = ROWS) -> DataFrame:
    """``cols`` names new columns: (column, by how many rows of the whole series; below 0 looks ahead)."""
    back, ahead = max([0, *[k for _, k in cols.values()]]), max([0, *[-k for _, k in cols.values()]])
    w = Window.partitionBy("__bucket").orderBy("__p")
    out = _dealt(df, order, max(rows, back, ahead, 1), back, ahead).withColumns({n: F.lag(quoted(c), k).over(w) for n, (c, k) in cols.items()})
    return out.filter("__bucket = __home").drop("__p", "__home", "__bucket")


def running(df: DataFrame, order: list[str], col: str, stats: list[str], prefix: str, min_periods: int = 1, rows: int = ROWS) -> DataFrame:
    """Statistics over all rows of the series so far, the current one included: count, sum, mean, std, min, max, nunique.

    Sums are of differences from the overall mean, so that the spread keeps its digits.
    """
    if odd := set(stats) - {"count", "sum", "mean", "std", "min", "max", "nunique"}:
        raise ValueError(f"no running statistics: {sorted(odd)}")
    x = clean(df, col)
    at = placed(df, order, "__p").withColumn("__b", F.floor(F.col("__p") / rows)).withColumn("__x", x)
    if "nunique" in stats:
        firsts = at.filter("__x is not null").groupBy("__x").agg(F.min("__p").alias("__p")).select(F.col("__p").alias("__first"))
        at = at.join(firsts, F.col("__p") == F.col("__first"), "left").withColumn("__new", F.col("__first").isNotNull().cast("long")).drop("__first")
    else:
        at = at.withColumn("__new", F.lit(0).cast("long"))
    number = isinstance(df.schema[col].dataType, T.NumericType)
    mean = (at.agg(F.avg("__x")).first()[0] or 0.0) if number else 0.0
    d = F.col("__x").cast("double") - float(mean) if number else F.lit(None).cast("double")
    at = at.withColumn("__d", d).withColumn("__q", F.col("__d") * F.col("__d"))
    parts = {"__n": F.count("__x"), "__s": F.coalesce(F.sum("__d"), F.lit(0.0)), "__ss": F.coalesce(F.sum("__q"), F.lit(0.0)), "__lo": F.min("__x"), "__hi": F.max("__x"), "__u": F.sum("__new")}
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = at.groupBy("__b").agg(*[e.alias(n) for n, e in parts.items()])
    carry = carry.select(F.col("__b").alias("__c"), *[(F.min(n) if n == "__lo" else F.max(n) if n == "__hi" else F.sum(n)).over(before).alias(n) for n in parts])
    w = Window.partitionBy("__b").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    both = at.join(carry, F.col("__b") == F.col("__c"))
    n = F.coalesce("__n", F.lit(0)) + F.count("__x").over(w)
    s, q = (F.coalesce(c, F.lit(0.0)) + F.coalesce(F.sum(v).over(w), F.lit(0.0)) for c, v in (("__s", "__d"), ("__ss", "__q")))
    both = both.withColumns({"__N": n, "__S": s, "__Q": q, "__L": F.least("__lo", F.min("__x").over(w)), "__H": F.greatest("__hi", F.max("__x").over(w)), "__U": F.coalesce("__u", F.lit(0)) + F.sum("__new").over(w)})
    n, s, q = F.col("__N"), F.col("__S"), F.col("__Q")
    made = {
        "count": n, "sum": F.when(n > 0, s + n * float(mean)), "mean": F.when(n > 0, s / n + float(mean)), "min": F.col("__L"), "max": F.col("__H"), "nunique": F.col("__U"),
        "std": F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), q - s * s / n) / (n - 1))),
    }
    out = both.withColumns({f"{prefix}{k}": made[k] if k == "count" else F.when(n >= min_periods, made[k]) for k in stats})
    return out.select(*[quoted(c) for c in [*df.columns, *[f"{prefix}{k}" for k in stats]]])


def filled_back(df: DataFrame, order: list[str], cols: list[str], rows: int = ROWS) -> DataFrame:
    """Each null of ``cols`` takes the next value of the whole series that isn't.

    Rows are run over from the last: a frame that ends with the bucket would be read to its end from every row.
    """
    at = placed(df, order, "__p").withColumn("__b", F.floor(F.col("__p") / rows))
    w = Window.partitionBy("__b").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    firsts = at.groupBy("__b").agg(*[F.min(F.when(quoted(c).isNotNull(), F.struct("__p", quoted(c).alias("v"))))["v"].alias(f"__v{i}") for i, c in enumerate(cols)])
    after = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = firsts.select(F.col("__b").alias("__c"), *[F.last(f"__v{i}", True).over(after).alias(f"__v{i}") for i in range(len(cols))])
    made = {c: F.coalesce(F.last(quoted(c), True).over(w), F.col(f"__v{i}")) for i, c in enumerate(cols)}
    return at.join(carry, F.col("__b") == F.col("__c")).withColumns(made).select(*map(quoted, df.columns))
