"""Statistics with pandas' definitions, screening of columns, and stability of distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.mapping import quoted
from ..core.order import kept, quantiles
from .gram import correlation_pairs


def _n(x: Column) -> Column:
    return F.count(x).cast("double")


def skew(x: Column) -> Column:
    """Bias-corrected skewness; null below 3 values, 0 without variance."""
    n = _n(x)
    g = F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, None).when(F.coalesce(F.var_pop(x), F.lit(0.0)) == 0, 0.0).otherwise(g)


def kurt(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null below 4 values, 0 without variance."""
    n = _n(x)
    g = ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n < 4, None).when(F.coalesce(F.var_pop(x), F.lit(0.0)) == 0, 0.0).otherwise(g)


#: Pairs of columns up to which correlations are aggregates of their own in one plan.
FEW = 64

BUNDLE = {
    "min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "sum": F.sum, "count": F.count, "std": F.stddev_samp, "skew": skew,
    "nunique": F.count_distinct, "kurt": kurt, "q1": lambda x: F.percentile(x, F.lit(0.25)), "q3": lambda x: F.percentile(x, F.lit(0.75)),
}


def bundle(df: DataFrame, keys: list[str], col: str, stats: list[str], prefix: str = "") -> DataFrame:
    """One aggregation with the named statistics of ``col`` by ``keys``."""
    return df.groupBy(*map(quoted, keys)).agg(*[BUNDLE[s](quoted(col)).alias(f"{prefix}{s}") for s in stats])


def mean_absolute_deviation(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Mean of |x - mean of the group|, by joining the means back."""
    means = df.groupBy(*keys).agg(F.avg(quoted(col)).alias("__mean"))
    return df.join(means, keys).groupBy(*keys).agg(F.avg(F.abs(quoted(col) - F.col("__mean"))).alias(out))


def value_counts(df: DataFrame, col: str, normalize: bool = False, dropna: bool = True) -> DataFrame:
    src = df.filter(quoted(col).isNotNull()) if dropna else df
    t = src.groupBy(quoted(col).alias("value")).agg(F.count("*").alias("n"))
    return t.withColumn("n", F.col("n") / F.lit(src.count())) if normalize else t


def mode(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """The most frequent value of each group, the smallest of those tied."""
    counts = df.filter(quoted(col).isNotNull()).groupBy(*keys, quoted(col).alias("__v")).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.max_by("__v", F.struct(F.col("__n"))).alias("__any"), F.max("__n").alias("__m")).join(counts, keys).filter("__n = __m").groupBy(*keys).agg(F.min("__v").alias(out))


def missing_report(df: DataFrame) -> DataFrame:
    """(column, n_missing, share), a row a column."""
    one = df.agg(F.count("*").alias("__n"), *[F.sum(quoted(c).isNull().cast("long")).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("n_missing")) for c in df.columns])
    return one.select(F.explode(pairs).alias("p"), "__n").select("p.column", "p.n_missing", F.try_divide(F.col("p.n_missing").cast("double"), F.col("__n")).alias("share"))


def dominant_share(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, share): the share of the most frequent value; one scan for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in cols])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg((F.max("n") / F.sum("n")).alias("share"))


def drop_dominant(df: DataFrame, cols: list[str], over: float = 0.9994) -> DataFrame:
    return df.drop(*[r["column"] for r in dominant_share(df, cols).filter(F.col("share") > over).collect()])


def unique_row_flag(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    """Whether a row has a value in one of ``cols`` that no other row has there.

    Columns and values of all rows are counted in one aggregation, which keeps a value's row; the rows found are
    joined once, however many columns there are. Values are told by their text.
    """
    rows = kept(df.withColumn("__row", F.monotonically_increasing_id()))
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), quoted(c).cast("string").alias("v")) for i, c in enumerate(cols)])
    values = rows.select("__row", F.inline(F.filter(pairs, lambda p: p["v"].isNotNull())))
    alone = values.groupBy("c", "v").agg(F.count("*").alias("n"), F.min("__row").alias("__one")).filter("n = 1").select("__one").distinct()
    return rows.join(alone, F.col("__row") == F.col("__one"), "left").withColumn(out, F.col("__one").isNotNull()).drop("__row", "__one")


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) of every two columns, in one pass: Spark's aggregates for up to ``FEW`` pairs, else cross products (see ``gram``)."""
    pairs = [(a, b) for i, b in enumerate(cols) for a in cols[:i]]
    if len(pairs) > FEW:
        return correlation_pairs(df, cols).select("a", "b", "r")
    one = df.agg(*[F.corr(quoted(a), quoted(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(cells))


def drop_correlated(df: DataFrame, cols: list[str], over: float = 0.95) -> list[str]:
    """The later column of every pair with |r| above ``over``."""
    return sorted({r["b"] for r in correlations(df, cols).filter(F.abs("r") > over).collect()})


def top_correlated(df: DataFrame, cols: list[str], target: str, k: int) -> DataFrame:
    one = df.agg(*[F.corr(quoted(c), quoted(target)).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("r")) for c in cols])
    return one.select(F.inline(cells)).orderBy(F.desc("r"), "column").limit(k)


def cumulative_importance(importances: DataFrame, share: float = 0.93) -> DataFrame:
    """(feature, importance, cum, keep): features beyond ``share`` of the running sum are dropped."""
    order = Window.orderBy(F.desc("importance"), "feature")
    t = importances.withColumn("cum", F.sum("importance").over(order) / F.sum("importance").over(Window.partitionBy()))
    return t.withColumn("keep", F.col("cum") <= share)


def psi(train: DataFrame, test: DataFrame, col: str, bins: int = 5, null: float = -998.0) -> DataFrame:
    """One row (psi): stability of ``col``; edges are quantiles of ``train``, its nulls counted as ``null``."""
    x = F.coalesce(quoted(col).cast("double"), F.lit(null))
    edges = sorted(set(quantiles(train, x, [i / bins for i in range(1, bins)]) or []))
    part = F.lit(0)
    for e in edges:  # right-closed bins
        part = part + (x > F.lit(e)).cast("int")

    def shares(df: DataFrame, name: str) -> DataFrame:
        t = df.groupBy(part.alias("bin")).agg(F.count("*").alias("n"))
        return t.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))

    both = shares(train, "q").join(shares(test, "p"), "bin", "full_outer").na.fill(0.0, ["p", "q"])
    infinite = F.lit(float("inf"))
    term = F.when((F.col("p") == 0) | (F.col("q") == 0), infinite).otherwise((F.col("q") - F.col("p")) * (F.ln("q") - F.ln("p")))
    return both.agg(F.sum(term).alias("psi"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, count, mean, std, min, q1, median, q3, max), a row a numeric column; exact quartiles."""
    stats = {"count": lambda x: F.count(x).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": lambda x: F.min(x).cast("double"), "max": lambda x: F.max(x).cast("double")}
    one = df.agg(*[f(quoted(c)).alias(f"{c}:{n}") for c in cols for n, f in stats.items()])
    quartiles = {c: quantiles(df, quoted(c), [0.25, 0.5, 0.75]) or [None] * 3 for c in cols}

    def cell(c: str) -> Column:
        q = [F.lit(v).cast("double").alias(n) for n, v in zip(("q1", "median", "q3"), quartiles[c], strict=True)]
        s = [F.col(f"`{c}:{n}`").cast("double").alias(n) for n in stats]
        return F.struct(F.lit(c).alias("column"), *s[:4], *q, s[4])

    return one.select(F.inline(F.array(*map(cell, cols))))


def describe_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, count, unique, top, freq), a row a text column; of the most frequent values the first in order."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in cols])
    counts = df.select(F.explode(pairs).alias("p")).filter("p.value is not null").groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"), F.min_by("value", F.struct(-F.col("n"), "value")).alias("top"), F.max("n").alias("freq")
    )


def shrink_types(df: DataFrame) -> DataFrame:
    """Integer columns as the narrowest type that holds their range."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType))]
    if not cols:
        return df
    r = df.agg(*[f(quoted(c)).alias(f"{n}:{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))]).first()
    kinds = {}
    for c in cols:
        low, high = r[f"min:{c}"], r[f"max:{c}"]
        if low is not None:
            kinds[c] = next(k for k, bits in (("byte", 7), ("short", 15), ("int", 31), ("long", 63)) if -(1 << bits) <= low and high < 1 << bits)
    return df.select(*[quoted(c).cast(kinds[c]).alias(c) if c in kinds else quoted(c) for c in df.columns])
