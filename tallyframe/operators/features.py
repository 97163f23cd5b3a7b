"""Feature operators: windows over rows and time, decayed means, anchors, pivots, fills, crosses, joins.

Row order is always an explicit column. Windows are partitioned by their keys; for one long series without a key,
or for hot keys, see ``windows``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.mapping import clean, quoted
from ..core.order import numbered, quantiles
from ..functions.stats import BUNDLE
from .anchors import STATS, anchor_statistics
from .history import STATS as HISTORY
from .history import slot_history
from .windows import framed, known, time_windows

DAY_US = 86_400_000_000


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(quoted(ts).cast("timestamp"))


def transform_stats(df: DataFrame, keys: list[str], col: str, stats: list[str], prefix: str) -> DataFrame:
    """Group statistics on every row, by one aggregation that is joined back."""
    g = df.groupBy(*[quoted(k).alias(f"__{k}") for k in keys]).agg(*[BUNDLE[s](quoted(col)).alias(f"{prefix}{s}") for s in stats])
    same = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(F.col(f"`__{k}`")) for k in keys])
    return df.join(g, same, "left").drop(*[f"__{k}" for k in keys])


def fill_from_groups(df: DataFrame, col: str, levels: list[list[str]], stat: str = "median") -> DataFrame:
    """Nulls of ``col`` filled with the group's statistic, level by level; a level sees what the one before has filled."""
    out = df
    for i, keys in enumerate(levels):
        g = out.groupBy(*[quoted(k).alias(f"__{k}") for k in keys]).agg(BUNDLE[stat](quoted(col)).alias("__fill"))
        same = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(F.col(f"`__{k}`")) for k in keys]) if keys else F.lit(True)
        out = out.join(F.broadcast(g) if not keys else g, same, "left").withColumn(col, F.coalesce(quoted(col), F.col("__fill"))).drop("__fill", *[f"__{k}" for k in keys])
    return out


def cascade(df: DataFrame, col: str, levels: list[list[str]], out: str, source: DataFrame | None = None) -> DataFrame:
    """``out``: the mean of ``col`` in the finest group of ``levels`` that ``source`` has, then in coarser ones."""
    source = source if source is not None else df
    found, res = [], df
    for i, keys in enumerate(levels):
        g = source.groupBy(*[quoted(k).alias(f"__{k}") for k in keys]).agg(F.avg(quoted(col)).alias(f"__mean{i}"))
        same = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(F.col(f"`__{k}`")) for k in keys])
        res = res.join(g, same, "left").drop(*[f"__{k}" for k in keys])
        found.append(F.col(f"__mean{i}"))
    return res.withColumn(out, F.coalesce(*found)).drop(*[f"__mean{i}" for i in range(len(levels))])


def lag_diff(df: DataFrame, keys: list[str], order: list[str], col: str, lags: list[int]) -> DataFrame:
    w = Window.partitionBy(*map(quoted, keys)).orderBy(*map(quoted, order))
    made = {}
    for k in lags:
        made[f"{col}_lag{k}"] = F.lag(quoted(col), k).over(w)
        made[f"{col}_diff{k}"] = quoted(col) - F.lag(quoted(col), k).over(w)
    return df.withColumns(made)


def horizontal_stats(df: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    """mean, min, max, std, median and mad across columns of a row; nulls are left out."""
    a = F.filter(F.array(*[quoted(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    df = df.withColumn("__a", F.array_sort(a)).withColumn("__n", F.size("__a"))
    total = F.aggregate("__a", F.lit(0.0), lambda s, x: s + x)
    df = df.withColumn(f"{prefix}mean", F.try_divide(total, F.col("__n")))
    m = F.col(f"{prefix}mean")
    sq = F.aggregate("__a", F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    ad = F.aggregate("__a", F.lit(0.0), lambda s, x: s + F.abs(x - m))
    low, high = F.floor((F.col("__n") + 1) / 2).cast("int"), F.floor((F.col("__n") + 2) / 2).cast("int")
    mid = F.when(F.col("__n") > 0, (F.element_at("__a", F.greatest(low, F.lit(1))) + F.element_at("__a", F.greatest(high, F.lit(1)))) / 2)
    return df.withColumns({
        f"{prefix}min": F.array_min("__a"), f"{prefix}max": F.array_max("__a"), f"{prefix}median": mid,
        f"{prefix}std": F.when(F.col("__n") > 1, F.sqrt(sq / (F.col("__n") - 1))), f"{prefix}mad": F.try_divide(ad, F.col("__n")),
    }).drop("__a", "__n")


@F.pandas_udf(T.StructType([T.StructField(f, T.DoubleType()) for f in ("skew", "kurt", "cv")]))
def _moments(*cols: pd.Series) -> pd.DataFrame:
    """Figures of each row, column by column for all rows of a batch.

    Mean and sums of powers of the differences from it are updated value by value: no power is of a difference from
    a mean that was rounded once for all values, which would stand out where they differ by their last digits only.
    """
    n, m, p2, p3, p4, q, total = np.zeros((7, len(cols[0])))
    with np.errstate(all="ignore"):
        for x in (c.to_numpy(float) for c in cols):
            there = ~np.isnan(x)
            x, more = np.where(there, x, m), n + there
            d = x - m
            dn = np.where(there, d / more, 0.0)
            t = d * dn * n
            p4 += t * dn * dn * (more * more - 3 * more + 3) + 6 * dn * dn * p2 - 4 * dn * p3
            p3 += t * dn * (more - 2) - 3 * dn * p2
            p2 += t
            m, n, total = m + dn, more, total + np.where(there, x, 0.0)
            q += d * (x - m)
        g1, g2 = p3 / n / (p2 / n) ** 1.5, p4 / n / (p2 / n) ** 2 - 3
        skew, kurt = g1 * np.sqrt(n * (n - 1)) / (n - 2), ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))
        mean = total / n
        cv = np.where((n > 1) & (mean != 0), np.sqrt(q / (n - 1)) / mean, np.nan)
        return pd.DataFrame({"skew": np.where(n >= 3, np.where(q == 0, 0.0, skew), np.nan), "kurt": np.where(n >= 4, np.where(q == 0, 0.0, kurt), np.nan), "cv": cv})


def horizontal_moments(df: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    """skew, kurt (both bias-corrected), q1, q3 and cv (std over mean) across columns of a row; nulls are left out."""
    a = F.array_sort(F.filter(F.array(*[clean(df, c).cast("double") for c in cols]), lambda x: x.isNotNull()))
    df = df.withColumn("__m", _moments(*[clean(df, c).cast("double") for c in cols])).withColumn("__a", a).withColumn("__n", F.size("__a").cast("double"))
    n = F.col("__n")

    def quantile(q: float) -> Column:
        at = q * (n - 1)
        low, high = F.floor(at).cast("int") + 1, F.ceil(at).cast("int") + 1
        return F.when(n > 0, F.element_at("__a", low) + (at - F.floor(at)) * (F.element_at("__a", high) - F.element_at("__a", low)))

    figures = {f"{prefix}skew": F.col("__m.skew"), f"{prefix}kurt": F.col("__m.kurt"), f"{prefix}q1": quantile(0.25), f"{prefix}q3": quantile(0.75), f"{prefix}cv": F.col("__m.cv")}
    return df.withColumns(figures).drop("__a", "__n", "__m")


def date_difference_stats(df: DataFrame, keys: list[str], day: str, col: str, prefix: str) -> DataFrame:
    """abs_mean, std, max and min of the differences of the key's daily sums between neighbouring dates.

    Dates are those that the table has; a key has a difference where it has both of two neighbours, and null
    statistics if it has none.
    """
    daily = df.groupBy(*map(quoted, keys), F.to_date(quoted(day)).alias("__d")).agg(F.sum(quoted(col)).alias("__v"))
    dates, small = numbered(daily.select("__d").distinct(), ["__d"], "__i")
    at = daily.join(F.broadcast(dates) if small else dates, "__d").drop("__d")
    before = at.select(*map(quoted, keys), (F.col("__i") + 1).alias("__i"), F.col("__v").alias("__p"))
    diff = F.col("__v") - F.col("__p")
    both = at.join(before, [*keys, "__i"], "left")
    return both.groupBy(*map(quoted, keys)).agg(F.avg(F.abs(diff)).alias(f"{prefix}abs_mean"), F.stddev_samp(diff).alias(f"{prefix}std"), F.max(diff).alias(f"{prefix}max"), F.min(diff).alias(f"{prefix}min"))


def activity_span(df: DataFrame, keys: list[str], day: str, anchor: Column) -> DataFrame:
    """first_days and last_days (from the key's first and last day to ``anchor``), run_days between them, active_days."""
    d = F.to_date(quoted(day))
    return df.groupBy(*map(quoted, keys)).agg(
        F.datediff(anchor, F.min(d)).alias("first_days"), F.datediff(anchor, F.max(d)).alias("last_days"), F.datediff(F.max(d), F.min(d)).alias("run_days"), F.count_distinct(d).alias("active_days")
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; of rows that are equal in it, the least in all columns. No key's rows are sorted."""
    least = F.min(F.struct(*[quoted(o).alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*map(quoted, df.columns)).alias("row"))).alias("least")
    return df.groupBy(*[quoted(k).alias(f"__{k}") for k in keys]).agg(least).select("least.row.*")


def rolling_time(df: DataFrame, keys: list[str], ts: str, col: str, span_us: int, stats: list[str], prefix: str, min_periods: int = 1) -> DataFrame:
    """Statistics over [t - span, t): rows of the current time are left out."""
    return time_windows(df, ts, col, span_us, stats, prefix, keys, min_periods)


def expanding(df: DataFrame, keys: list[str], order: list[str], col: str, stats: list[str], prefix: str, min_periods: int = 1) -> DataFrame:
    """Statistics over the rows of the key so far, the current one included."""
    return framed(df, keys, order, col, stats, prefix, None, 0, True, min_periods)


def running_accuracy(df: DataFrame, keys: list[str], order: list[str], label: str, prefix: str = "") -> DataFrame:
    """Sum, count and mean of the label over the key's earlier rows."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(*map(quoted, order)).rowsBetween(Window.unboundedPreceding, -1)
    s, c = F.coalesce(F.sum(quoted(label)).over(w), F.lit(0)), F.count(quoted(label)).over(w)
    return df.withColumns({f"{prefix}sum": s, f"{prefix}count": c, f"{prefix}mean": F.try_divide(s.cast("double"), c)})


def attempts(df: DataFrame, keys: list[str], order: list[str], out: str, cap: int = 4) -> DataFrame:
    """How many earlier rows the key has, at most ``cap``."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(*map(quoted, order))
    return df.withColumn(out, F.least(F.row_number().over(w) - 1, F.lit(cap)))


def history_by_slot(df: DataFrame, slot: str, day: str, col: str, stats: list[str], prefix: str, same_day: bool = False, days: int | None = None) -> DataFrame:
    """Statistics of a slot (an hour, say) over earlier days, by (slot, day); ``days`` bounds how many.

    With ``same_day`` the day itself counts. Rows are first summed by slot and day where the statistics allow it; for
    medians and different values see ``history``. First and last values look at all rows of a slot in one task.
    """
    if set(stats) <= {"min", "max", "sum", "count", "mean"}:
        base = df.groupBy(quoted(slot), quoted(day)).agg(F.min(quoted(col)).alias("mi"), F.max(quoted(col)).alias("ma"), F.sum(quoted(col)).alias("s"), F.count(quoted(col)).alias("c"))
        w = Window.partitionBy(quoted(slot)).orderBy(F.datediff(quoted(day), F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding if days is None else -(days - (1 if same_day else 0)), 0 if same_day else -1)
        f = {"min": F.min("mi").over(w), "max": F.max("ma").over(w), "sum": F.sum("s").over(w), "count": F.coalesce(F.sum("c").over(w), F.lit(0)), "mean": F.sum("s").over(w) / F.sum("c").over(w)}
        return base.select(slot, day, *[f[s].alias(f"{prefix}{s}") for s in stats])
    known(stats)
    rows = df.select(quoted(slot).alias(slot), quoted(day).alias(day), quoted(col).alias(col)).withColumn("__d", F.datediff(quoted(day), F.lit("1970-01-01")))
    low, high = None if days is None else -(days - (1 if same_day else 0)), 0 if same_day else -1
    if set(stats) <= HISTORY:
        at = df.select(quoted(slot).alias("slot"), F.datediff(quoted(day), F.lit("1970-01-01")).alias("d"), clean(df, col).alias("x")).filter("d is not null")
        found = slot_history(at, stats, low, high).select(F.col("slot").alias("__slot"), F.col("d").alias("__day"), *[F.col(s).alias(f"{prefix}{s}") for s in stats])
        base = rows.select(quoted(slot), quoted(day), "__d").distinct()
        out = base.join(found, quoted(slot).eqNullSafe(F.col("__slot")) & (F.col("__d") == F.col("__day")), "left").drop("__d", "__slot", "__day")
        return out.na.fill(0, [f"{prefix}count"]) if "count" in stats else out
    rows = framed(rows, [slot], ["__d"], col, stats, prefix, low, high, False)
    return rows.groupBy(quoted(slot), quoted(day)).agg(*[F.first(f"{prefix}{s}").alias(f"{prefix}{s}") for s in stats])  # equal in all rows of a day


def decayed_mean(df: DataFrame, keys: list[str], col: str, age: Column, rates: list[float], prefix: str) -> DataFrame:
    """Sum of v * rate^age over sum of rate^age, one column a rate, in one aggregation."""
    a = df.withColumn("__age", age)
    return a.groupBy(*map(quoted, keys)).agg(*[(F.sum(quoted(col) * F.pow(F.lit(r), F.col("__age"))) / F.sum(F.when(quoted(col).isNotNull(), F.pow(F.lit(r), F.col("__age"))))).alias(f"{prefix}{i}") for i, r in enumerate(rates)])


def double_decayed_mean(df: DataFrame, keys: list[str], col: str, age: Column, rates: list[float], prefix: str) -> DataFrame:
    """Sums whose weights are multiplied up along the grid of rates: v * (r0 ... ri)^age over ri^age, one column a rate."""
    a, aggs, product = df.withColumn("__age", age), [], 1.0
    for i, r in enumerate(rates):
        product *= r
        aggs.append((F.sum(quoted(col) * F.pow(F.lit(product), F.col("__age"))) / F.sum(F.when(quoted(col).isNotNull(), F.pow(F.lit(r), F.col("__age"))))).alias(f"{prefix}{i}"))
    return a.groupBy(*map(quoted, keys)).agg(*aggs)


def position_weighted_mean(df: DataFrame, keys: list[str], order: list[str], col: str, out: str, power: int = 5) -> DataFrame:
    """Mean with weights ((position + 1) / length) ** power."""
    w = Window.partitionBy(*map(quoted, keys))
    r = df.withColumn("__w", F.pow(F.row_number().over(w.orderBy(*map(quoted, order))) / F.count(F.lit(1)).over(w), F.lit(float(power))))
    return r.groupBy(*map(quoted, keys)).agg((F.sum(quoted(col) * F.col("__w")) / F.sum("__w")).alias(out))


def anchor_windows(df: DataFrame, anchors: DataFrame, keys: list[str], day: str, col: str, spans: list[int], stats: list[str], closed: str = "left") -> DataFrame:
    """Statistics of the ``spans`` days before each anchor date, all anchors and spans in one aggregation.

    ``closed``: ``left`` takes [anchor - span, anchor), ``neither`` (anchor - span, anchor). Sums, counts, means,
    spreads and extremes come from days (see ``anchors``); with any other statistic every row is sent to the anchors
    of the longest span it falls in. ``anchors`` has the column ``anchor``.
    """
    if set(stats) <= set(STATS):
        return anchor_statistics(df, anchors, keys, day, col, spans, stats, closed)
    most = max(spans)
    days = anchors.select("anchor", F.explode(F.sequence(F.date_sub("anchor", most), F.date_sub("anchor", 1))).alias("__day"))
    j = df.join(days, F.to_date(quoted(day)) == F.col("__day"))
    age = F.datediff("anchor", "__day")
    aggs = []
    for s in spans:
        inside = (age <= s) if closed == "left" else (age < s)
        aggs += [BUNDLE[st](F.when(inside, quoted(col))).alias(f"{col}_{st}_{s}") for st in stats]
    return j.groupBy("anchor", *map(quoted, keys)).agg(*aggs)


def weekday_pivot(df: DataFrame, keys: list[str], day: str, col: str, stats: list[str]) -> DataFrame:
    """Columns ``d<k>_<stat>`` for the weekdays 0 (Monday) to 6."""
    aggs = [BUNDLE[s](F.when(F.weekday(quoted(day)) == k, quoted(col))).alias(f"d{k}_{s}") for k in range(7) for s in stats]
    return df.groupBy(*map(quoted, keys)).agg(*aggs)


def shifted_self_join(df: DataFrame, keys: list[str], day: str, col: str, shift: int, out: str) -> DataFrame:
    """Rows that have a row of the key ``shift`` days before, with its value and the difference."""
    other = df.select(*[quoted(k).alias(k) for k in keys], F.date_add(quoted(day), shift).alias(day), quoted(col).alias(out))
    return df.join(other, [*keys, day]).withColumn(f"{out}_diff", quoted(col) - quoted(out))


def nearest_flag(df: DataFrame, keys: list[str], day: str, flag: str) -> DataFrame:
    """The last flagged day before and the next after each row; the first and last day where there is none."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(day))
    on = F.when(quoted(flag) == 1, quoted(day))
    every = Window.partitionBy(*map(quoted, keys))
    back = every.orderBy(F.desc("__place"))  # a frame up to the last row would be read to its end from every row
    return df.withColumn("__place", F.row_number().over(w)).withColumns({
        "last_flag": F.coalesce(F.last(on, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.min(quoted(day)).over(every)),
        "next_flag": F.coalesce(F.last(on, True).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.max(quoted(day)).over(every)),
    }).drop("__place")


def bfill(df: DataFrame, keys: list[str], order: list[str], col: str) -> DataFrame:
    own = Window.partitionBy(*map(quoted, keys))
    back = own.orderBy(F.desc("__place")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__place", F.row_number().over(own.orderBy(*map(quoted, order)))).withColumn(col, F.last(quoted(col), True).over(back)).drop("__place")


def tail_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*map(quoted, keys)).orderBy(*[quoted(o).desc() for o in order])
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def average_rank(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*map(quoted, keys))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*map(quoted, keys), quoted(col)))
    return df.withColumn(out, F.rank().over(w.orderBy(quoted(col))) + (ties - 1) / 2)


def densify(df: DataFrame, key: str, day: str, col: str) -> DataFrame:
    """A row for each key and day between its first and last, 0 where there was none."""
    span = df.groupBy(quoted(key)).agg(F.min(quoted(day)).alias("a"), F.max(quoted(day)).alias("b"))
    grid = span.select(key, F.explode(F.sequence("a", "b")).alias(day))
    return grid.join(df.groupBy(key, day).agg(F.sum(quoted(col)).alias(col)), [key, day], "left").na.fill(0, [col])


def cut_width(df: DataFrame, col: str, k: int, out: str) -> DataFrame:
    """Equal-width bins 1 to k, closed on the right, and their left edges (the first 0.1 % of the range lower)."""
    r = df.agg(F.min(quoted(col)).cast("double").alias("a"), F.max(quoted(col)).cast("double").alias("b")).first()
    a, b = r["a"] or 0.0, r["b"] or 0.0
    width = (b - a) / k or 1.0
    bin_ = F.least(F.greatest(F.ceil((quoted(col) - a) / width), F.lit(1)), F.lit(k)).cast("int")
    left = F.when(bin_ == 1, a - 0.001 * (b - a)).otherwise(a + (bin_ - 1) * width)
    return df.withColumn(out, bin_).withColumn(f"{out}_left", left)


def cut_edges(df: DataFrame, col: str, edges: list[float], out: str) -> DataFrame:
    """Bin i for edges[i-1] < x <= edges[i]; 0 and len(edges) beyond the ends."""
    part = F.lit(0)
    for e in edges:
        part = part + (quoted(col) > F.lit(float(e))).cast("int")
    return df.withColumn(out, part)


def cut_quantiles(df: DataFrame, col: str, k: int, out: str) -> DataFrame:
    """Equal-frequency bins 1 to k by exact quantiles, the lowest edge included; equal edges are an error."""
    edges = quantiles(df, quoted(col), [i / k for i in range(k + 1)])
    if edges and len(set(edges)) < len(edges):
        raise ValueError("quantile edges are not unique")
    return cut_edges(df, col, (edges or [])[1:-1], "__b").withColumn(out, F.when(quoted(col).isNotNull(), F.col("__b") + 1)).drop("__b")


def pair_features(df: DataFrame, cols: list[str], offset: float = 0.01) -> DataFrame:
    """Ratios of every ordered pair, sums, products and differences of every pair."""
    made = {f"{a}_over_{b}": F.try_divide(quoted(a), quoted(b) + offset) for a in cols for b in cols if a != b}
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            made |= {f"{a}_plus_{b}": quoted(a) + quoted(b), f"{a}_times_{b}": quoted(a) * quoted(b), f"{a}_minus_{b}": quoted(a) - quoted(b)}
    return df.withColumns(made)


def cross_category(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.concat_ws("_", *[quoted(c).cast("string") for c in cols]))


def count_resolutions(df: DataFrame, col: str, decimals: list[int]) -> DataFrame:
    """How many rows share the value, raw and rounded half-even to each number of decimals."""
    keys = {f"{col}_count": quoted(col), **{f"{col}_count_{d}": F.bround(quoted(col), d) for d in decimals}}
    out = df
    for name, key in keys.items():
        counts = df.groupBy(key.alias("__k")).agg(F.count("*").alias(name))
        out = out.join(counts, key.eqNullSafe(F.col("__k")), "left").drop("__k")
    return out


def session_profile(df: DataFrame, key: str, kind: str, kinds: list[str], secs: Column, bins: int = 15) -> DataFrame:
    """Counts and log time by kind, spread of the counts, a log histogram of times, log sum, mean, std and median."""
    s = df.withColumn("__s", secs)
    n = [F.sum(F.when(quoted(kind) == k, 1).otherwise(0)) for k in kinds]
    t = [F.log1p(F.sum(F.when(quoted(kind) == k, F.col("__s")).otherwise(0.0))) for k in kinds]
    bucket = F.least(F.floor(F.log1p("__s")), F.lit(bins - 1))
    h = [F.sum(F.when(bucket == b, 1).otherwise(0)) for b in range(bins)]
    wide = s.groupBy(quoted(key)).agg(
        *[c.alias(f"n_{k}") for c, k in zip(n, kinds, strict=True)], *[c.alias(f"t_{k}") for c, k in zip(t, kinds, strict=True)], *[c.alias(f"h_{b}") for b, c in enumerate(h)],
        F.log1p(F.sum("__s")).alias("log_sum"), F.log1p(F.avg("__s")).alias("log_mean"), F.log1p(F.stddev_samp("__s")).alias("log_std"), F.log1p(F.median("__s")).alias("log_median"),
    )
    counts = df.groupBy(quoted(key), quoted(kind)).agg(F.count("*").alias("__c")).groupBy(quoted(key)).agg(F.count("*").alias("n_unique"), F.avg("__c").alias("c_mean"), F.stddev_pop("__c").alias("c_std"))
    return wide.join(counts, key)


def range_filter(df: DataFrame, col: str, other: DataFrame) -> DataFrame:
    """Rows whose value is between the other table's least and largest."""
    r = other.agg(F.min(quoted(col)).alias("a"), F.max(quoted(col)).alias("b")).first()
    return df.filter(quoted(col).between(F.lit(r["a"]), F.lit(r["b"])))


def scale_tails(df: DataFrame, col: str, low: float = 0.005, high: float = 0.995, down: float = 0.77, up: float = 1.1) -> DataFrame:
    """Values up to the low quantile times ``down``, from the high one on times ``up``."""
    q = quantiles(df, quoted(col), [low, high]) or [None, None]
    return df.withColumn(col, F.when(quoted(col) <= q[0], quoted(col) * down).when(quoted(col) >= q[1], quoted(col) * up).otherwise(quoted(col)))


def scale(df: DataFrame, cols: list[str], how: str = "standard", ddof: int = 1) -> DataFrame:
    """standard (mean, std), minmax, or robust (median, interquartile range) scaling; the figures of the first two are one aggregation."""
    if how == "robust":
        q = {c: quantiles(df, quoted(c), [0.25, 0.5, 0.75]) or [None] * 3 for c in cols}
        return df.withColumns({c: F.try_divide(quoted(c) - F.lit(q[c][1]), F.lit(q[c][2]) - F.lit(q[c][0])) for c in cols})
    f = {"standard": (F.avg, F.stddev_samp if ddof else F.stddev_pop), "minmax": (F.min, lambda x: F.max(x) - F.min(x))}[how]
    r = df.agg(*[g(quoted(c)).cast("double").alias(f"{k}:{c}") for c in cols for k, g in zip("ab", f, strict=True)]).first()
    return df.withColumns({c: F.try_divide(quoted(c) - F.lit(r[f"a:{c}"]), F.lit(r[f"b:{c}"])) for c in cols})


def boxcox1p(x: Column, lam: float) -> Column:
    return F.log1p(x) if abs(lam) < 1e-12 else (F.pow(1 + x, F.lit(lam)) - 1) / lam


def boxcox_lambda(df: DataFrame, col: str, grid: list[float]) -> float:
    """The exponent of ``grid`` with the largest log-likelihood, all in one aggregation."""
    x = quoted(col)
    r = df.agg(F.count(x).alias("n"), F.sum(F.log1p(x)).alias("s"), *[F.var_pop(boxcox1p(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
    def ll(i: int) -> float:
        return (grid[i] - 1) * r["s"] - r["n"] / 2 * math.log(r[f"v{i}"]) if r[f"v{i}"] else -math.inf

    return grid[max(range(len(grid)), key=ll)]


def boxcox_lambdas(df: DataFrame, cols: list[str], low: float = -2.0, high: float = 2.0, within: float = 1e-4, rounds: int = 10, points: int = 9) -> dict[str, float]:
    """The exponents with the largest log-likelihood of 1 + x, of all columns at once.

    Each round is one pass with the likelihoods of ``points`` exponents a column between its bounds; the next
    bounds are the neighbours of the best, or further out if that is an end. Stops when all bounds are ``within``.
    The powers of a grid are a first power times a step, again and again, so a value costs two powers a round.
    """
    xs = df.select(*[clean(df, c).cast("double").alias(f"{k}") for k, c in enumerate(cols)])
    bounds = {c: (low, high) for c in cols}
    best = dict.fromkeys(cols, 0.0)
    for _ in range(rounds):
        if all(b - a <= within for a, b in bounds.values()):
            break
        grids = {c: [a + (b - a) * i / (points - 1) for i in range(points)] for c, (a, b) in bounds.items()}
        parts: dict[tuple[int, int], list[tuple[float, float, float, float]]] = {}
        for r in xs.mapInArrow(partial(_power_spreads, grids=list(grids.values())), "k int, i int, n double, s double, m double, q double").collect():  # a row a task and exponent
            parts.setdefault((r["k"], r["i"]), []).append((r["n"], r["s"], r["m"], r["q"]))
        for k, c in enumerate(cols):
            ll = []
            for i, g in enumerate(grids[c]):
                n, s, m, q = np.array(parts.get((k, i), [(0.0, 0.0, 0.0, 0.0)])).T
                total = n.sum()
                v = (q.sum() + (n * (m - (n * m).sum() / total) ** 2).sum()) / total if total else 0.0
                ll.append((g - 1) * s.sum() - total / 2 * math.log(v) if v > 0 else -math.inf)
            i = max(range(points), key=lambda j: ll[j])
            best[c], (a, b) = grids[c][i], bounds[c]
            step = (b - a) / (points - 1)
            bounds[c] = (a - (b - a) / 2, b - (b - a) / 2) if i == 0 else (a + (b - a) / 2, b + (b - a) / 2) if i == points - 1 else (grids[c][i] - step, grids[c][i] + step)
    return best


def _power_spreads(batches: Iterator[pa.RecordBatch], grids: list[list[float]]) -> Iterator[pa.RecordBatch]:
    """(k, i, n, s, m, q): of column k under exponent i of its grid, in one task: values, sum of the logarithms, mean and sum of squares about it.

    Powers are without the constant of the transformation, which would cost digits where they are small.
    """
    figures = np.zeros((4, len(grids), max(map(len, grids))))
    for batch in batches:
        for k, grid in enumerate(grids):
            x = np.log1p(batch.column(k).drop_null().to_numpy(zero_copy_only=False))
            if not len(x):
                continue
            step = np.exp((grid[1] - grid[0]) * x) if len(grid) > 1 else x
            power = np.exp(grid[0] * x)
            for i, lam in enumerate(grid):
                if i:
                    power = power * step
                y = power / lam if abs(lam) > 0.01 else np.expm1(lam * x) / lam if abs(lam) >= 1e-12 else x
                mean = float(y.mean())
                d = y - mean
                n, _, m, _ = old = figures[:, k, i].copy()
                more, gap = n + len(x), mean - m
                figures[:, k, i] = more, old[1] + x.sum(), m + gap * len(x) / more, old[3] + np.dot(d, d) + gap * gap * n * len(x) / more
    k, i = np.indices(figures.shape[1:])
    yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(i.ravel(), pa.int32()), *[pa.array(f.ravel()) for f in figures]], ["k", "i", "n", "s", "m", "q"])


def reservation_features(df: DataFrame, key: str, made: str, due: str, amount: str) -> DataFrame:
    """By key and due day: reservations, their sum, and the mean of the days they were made ahead."""
    ahead = F.datediff(F.to_date(quoted(due)), F.to_date(quoted(made)))
    return df.groupBy(quoted(key), F.to_date(quoted(due)).alias("due_day")).agg(F.count("*").alias("n"), F.sum(quoted(amount)).alias("total"), F.avg(ahead).alias("days_ahead"))
