"""Statistics of many spans before many anchor dates, from one pass over the rows.

Rows are aggregated by key and day, and a key's days meet in one row, so what is shuffled doesn't depend on how many
anchors and spans there are. Every figure is then told from the days in order: counts, sums and spreads by the
difference of two running sums, least and largest values by a table of the extremes of 1, 2, 4, ... days in a row.
All keys of a batch are taken at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.mapping import clean, quoted

STATS = ("sum", "count", "mean", "std", "min", "max")
#: Anchors that tasks are sent.
MOST = 10_000


def _extremes(values: np.ndarray, low: np.ndarray, high: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """The least or largest of ``values[low:high]`` (not empty), from extremes of stretches of 2**k."""
    out, table, k = np.empty(len(low)), values, 0
    level = np.frexp((high - low).astype(float))[1] - 1
    while True:
        own = np.flatnonzero(level == k)
        out[own] = pick(table[low[own]], table[high[own] - (1 << k)])
        k += 1
        if not (level >= k).any():
            return out
        half = 1 << (k - 1)
        table = pick(table[: len(table) - half], table[half:])


def anchor_statistics(df: DataFrame, anchors: DataFrame, keys: list[str], day: str, col: str, spans: list[int], stats: list[str], closed: str = "left") -> DataFrame:
    """A row for each anchor and key with a row in its longest span; columns ``<col>_<stat>_<span>``.

    ``closed``: ``left`` takes [anchor - span, anchor), ``neither`` (anchor - span, anchor). ``anchors`` has the
    column ``anchor``. Null days are in no span; NaN counts as null.
    """
    dates = [r[0] for r in anchors.select("anchor").filter("anchor is not null").distinct().orderBy("anchor").limit(MOST + 1).collect()]
    if len(dates) > MOST:
        raise ValueError(f"over {MOST} anchors")
    kind = anchors.schema["anchor"].dataType
    at = np.array([np.datetime64(d, "D").astype(np.int64) for d in dates], np.int64)
    x, date = clean(df, col).cast("double"), F.datediff(F.to_date(quoted(day)), F.lit("1970-01-01"))
    daily = df.groupBy(*map(quoted, keys), date.alias("__d")).agg(F.count("*").alias("__rows"), F.count(x).alias("__n"), F.avg(x).alias("__m"), (F.var_pop(x) * F.count(x)).alias("__v"), F.min(x).alias("__lo"), F.max(x).alias("__hi")).filter("__d is not null")
    figures = ("__rows", "__n", "__m", "__v", "__lo", "__hi")
    packed = daily.groupBy(*map(quoted, keys)).agg(F.array_sort(F.collect_list(F.struct("__d", *figures))).alias("__days"))
    packed = packed.select(*map(quoted, keys), *[F.col(f"__days.{f}").alias(f) for f in ("__d", *figures)])
    names = [(s, f"{col}_{s}_{n}") for n in spans for s in stats]
    schema = T.StructType([T.StructField("anchor", kind), *[packed.schema[k] for k in keys], *[T.StructField(n, T.LongType() if s == "count" else T.DoubleType()) for s, n in names]])

    def figures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(at):
                continue
            lists = {f: batch.column(len(keys) + i) for i, f in enumerate(("__d", *figures))}
            bounds = lists["__d"].offsets.to_numpy().astype(np.int64)
            bounds -= bounds[0]
            d, rows, n, m, v, lo, hi = (np.nan_to_num(lists[f].flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(float)) for f in ("__d", *figures))
            key = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            lo, hi = np.where(n > 0, lo, np.inf), np.where(n > 0, hi, -np.inf)
            total = np.add.reduceat(n, bounds[:-1])
            mean = np.add.reduceat(n * m, bounds[:-1]) / np.maximum(total, 1)
            off = n * (m - mean[key])
            sums = [np.concatenate([[0.0], np.cumsum(y)]) for y in (rows, n, off, v + off * (m - mean[key]))]
            # the days of all keys in one order: key times a range beyond all days, plus the day
            first, wide = int(min(d.min(), at.min())) - max(spans) - 1, int(max(d.max(), at.max()) - min(d.min(), at.min())) + 2 * max(spans) + 4
            place = key * wide + d.astype(np.int64) - first
            base = (np.arange(batch.num_rows) * wide - first)[:, None]

            def bound(days: np.ndarray) -> np.ndarray:
                return np.searchsorted(place, (base + days[None, :]).ravel(), "left")

            high, made, some = bound(at), [], None
            for span in spans:
                low = bound(at - span + (closed != "left"))
                count_rows, count, s, q = (y[high] - y[low] for y in sums)
                if span == max(spans):
                    some = count_rows > 0
                mu = np.repeat(mean, len(at))
                has = count > 0
                for stat in stats:
                    if stat == "count":
                        made.append((count.astype(np.int64), None))
                    elif stat == "sum":
                        made.append((s + count * mu, has))
                    elif stat == "mean":
                        made.append((s / np.maximum(count, 1) + mu, has))
                    elif stat == "std":
                        made.append((np.sqrt(np.maximum(q - s * s / np.maximum(count, 1), 0) / np.maximum(count - 1, 1)), count > 1))
                    else:
                        out = np.zeros(len(low))
                        out[has] = _extremes(lo if stat == "min" else hi, low[has], high[has], np.minimum if stat == "min" else np.maximum)
                        made.append((out, has))
            own = np.flatnonzero(some)
            whose = pa.array(own // len(at))
            columns = [pa.array([dates[i] for i in own % len(at)], schema_types[0]), *[batch.column(i).take(whose) for i in range(len(keys))]]
            columns += [pa.array(y[own], mask=None if ok is None else ~ok[own]) for y, ok in made]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    schema_types = [pa.date32() if isinstance(kind, T.DateType) else pa.timestamp("us", None if isinstance(kind, T.TimestampNTZType) else "UTC")]
    if odd := set(stats) - set(STATS):
        raise ValueError(f"not among {STATS}: {sorted(odd)}")
    return packed.mapInArrow(figures_of, schema)
