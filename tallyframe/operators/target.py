"""Encoders that use the target: target, leave-one-out, ordered, m-estimate, weight of evidence, James-Stein.

``fit(df)`` takes sums and counts a category (null is one) in one aggregation; ``transform(df)`` gives what a
test row gets; ``fit_transform(df)`` and ``transform(df, training=True)`` what a training row gets, which
needs the target column. ``sigma`` multiplies training values by N(1, sigma), seeded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.mapping import categorical_columns, check_no_nulls, clean, fetched, look_up, quoted, settle
from ..core.order import sums_before

SUMS = ("s", "c", "v")


class TargetBase:
    #: What unknown and unseen missing categories get; None stands for the prior.
    other: float | None = None

    def __init__(self, label_col: str, cols: list[str] | None = None, handle_unknown: str = "value", handle_missing: str = "value", sigma: float | None = None, seed: int = 0):
        for p in (handle_unknown, handle_missing):
            if p not in ("value", "return_nan", "error"):
                raise ValueError(f"{type(self).__name__} takes value, return_nan and error, not {p!r}")
        self.label_col, self.cols, self.sigma, self.seed = label_col, cols, sigma, seed
        self.handle_unknown, self.handle_missing = handle_unknown, handle_missing
        self.tables: dict[str, tuple[DataFrame, bool]] | None = None

    def fit(self, df: DataFrame) -> TargetBase:
        if self.label_col not in df.columns:
            raise ValueError(f"no label column {self.label_col}")
        self.active = [c for c in categorical_columns(df, self.cols) if c != self.label_col]
        if self.handle_missing == "error":
            check_no_nulls(df, self.active, "fit")
        y = quoted(self.label_col).cast("double")
        total = df.agg(F.avg(y).alias("prior"), F.count("*").alias("n"), F.sum(y).alias("s"), F.var_samp(y).alias("v"), F.sum(F.when(y.isin(0.0, 1.0), 0).otherwise(1)).alias("odd")).first()
        if not total["n"] or total["prior"] is None:
            raise ValueError("nothing to fit on")
        self.prior, self.n, self.sum, self.var, self.odd = total["prior"], total["n"], total["s"], total["v"], total["odd"]
        self.width = df.columns
        self._check()
        self.tables, self.k = {}, {}
        for c in self.active:
            stats = df.groupBy(clean(df, c).alias("cat")).agg(F.sum(y).alias("s"), F.count("*").alias("c"), F.var_samp(y).alias("v"))
            table, small = settle(stats)
            k = table.count()
            self.k[c] = k
            self.tables[c] = (table.withColumn("value", F.lit(self.id_like()) if k == self.n and self.id_like() is not None else self._value(c, table)), small)
        return self

    def _check(self) -> None:
        pass

    def id_like(self) -> float | None:
        """What all rows get if every row has a category of its own; None if that is no special case."""
        return None

    def _value(self, col: str, table: DataFrame) -> Column:
        raise NotImplementedError

    def _train_value(self, col: str) -> Column:
        """The value of a training row, from __s, __c, __value and the row's own target."""
        return F.col("__value")

    def transform(self, df: DataFrame, training: bool = False) -> DataFrame:
        if self.tables is None:
            raise ValueError("the encoder has to be fitted before it transforms")
        if training and self.label_col not in df.columns:
            raise ValueError(f"a training table needs its label column {self.label_col}")
        if self.handle_missing == "error":
            check_no_nulls(df, self.active, "transform")
        out, prior = df, F.lit(float(self.prior if self.other is None else self.other))
        for k, c in enumerate(self.active):
            table, small = self.tables[c]
            renamed = table.select("cat", F.col("s").alias("__s"), F.col("c").alias("__c"), F.col("value").alias("__value"))
            out = look_up(out, clean(df, c), renamed, small, ["__s", "__c", "__value"])
            value = self._train_value(c) if training else F.col("__value")
            if training and self.sigma:
                value = value * (1 + self.sigma * F.randn(self.seed + k))
            isnull = clean(df, c).isNull()
            unknown = F.raise_error(F.lit(f"unknown category in {c}")).cast("double") if self.handle_unknown == "error" else prior if self.handle_unknown == "value" else F.lit(None).cast("double")
            missing = prior if self.handle_missing == "value" else F.lit(None).cast("double")
            new = F.when(F.col("__c").isNull(), F.when(isnull, missing).otherwise(unknown)).otherwise(value)
            if self.handle_missing == "return_nan":
                new = F.when(~isnull, new)
            out = out.withColumn(c, new).drop("__s", "__c", "__value")
        return out.select(*map(quoted, df.columns))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df, training=True)


def _mean() -> Column:
    return F.col("s") / F.col("c")


class TargetEncoder(TargetBase):
    """prior (1 - w) + mean w with w = 1 / (1 + exp(-(c - min_samples_leaf) / smoothing)); the prior for single rows."""

    def __init__(self, label_col, cols=None, min_samples_leaf: float = 1, smoothing: float = 1.0, **how):
        super().__init__(label_col, cols, **how)
        self.leaf, self.smoothing = min_samples_leaf, smoothing

    def _value(self, col, table):
        w = 1 / (1 + F.exp(-(F.col("c") - self.leaf) / self.smoothing))
        return F.when(F.col("c") == 1, self.prior).otherwise(self.prior * (1 - w) + _mean() * w)


class LeaveOneOutEncoder(TargetBase):
    """Test rows: the mean, the prior for single rows. Training rows: the mean of the category's other rows."""

    def _value(self, col, table):
        return F.when(F.col("c") > 1, _mean()).otherwise(F.lit(self.prior))

    def _train_value(self, col):
        y = quoted(self.label_col).cast("double")
        return F.when(F.col("__c") > 1, F.try_divide(F.col("__s") - y, F.col("__c") - 1)).otherwise(F.lit(self.prior))


class CatBoostEncoder(TargetBase):
    """Ordered target statistics: training rows see the rows of their category before them in ``order_col``.

    See ``sums_before`` for categories with very many rows.
    """

    def __init__(self, label_col, order_col: str, cols=None, a: float = 1.0, hot: int | None = None, **how):
        super().__init__(label_col, cols, **how)
        self.order_col, self.a, self.hot = order_col, a, hot

    def _value(self, col, table):
        return F.when(F.col("c") > 1, (F.col("s") + self.prior) / (F.col("c") + self.a)).otherwise(F.lit(self.prior))

    def transform(self, df: DataFrame, training: bool = False) -> DataFrame:
        if not training:
            return super().transform(df)
        if self.tables is None:
            raise ValueError("the encoder has to be fitted before it transforms")
        out, y = df, quoted(self.label_col)
        for k, c in enumerate(self.active):
            largest = self.tables[c][0].agg(F.max("c")).first()[0] or 0
            out = sums_before(out, clean(df, c), self.order_col, {"__s": y, "__c": F.lit(1)}, largest, self.hot)
            value = (F.col("__s") + self.prior) / (F.col("__c") + self.a) * (1 + self.sigma * F.randn(self.seed + k) if self.sigma else F.lit(1.0))
            out = out.withColumn(f"__new{k}", value).drop("__s", "__c")
        return out.select(*[quoted(f"__new{self.active.index(c)}").alias(c) if c in self.active else quoted(c) for c in df.columns])


class MEstimateEncoder(TargetBase):
    def __init__(self, label_col, cols=None, m: float = 1.0, **how):
        super().__init__(label_col, cols, **how)
        self.m = m

    def id_like(self):
        return float(self.prior)

    def _value(self, col, table):
        return (F.col("s") + self.prior * self.m) / (F.col("c") + self.m)


class WOEEncoder(TargetBase):
    """ln of the category's share of positives over its share of negatives, regularised; 0 for single rows."""

    other = 0.0

    def __init__(self, label_col, cols=None, regularization: float = 1.0, **how):
        super().__init__(label_col, cols, **how)
        self.r = regularization

    def _check(self):
        if self.odd or self.sum in (0, self.n):
            raise ValueError("the target has to have the values 0 and 1, and both")

    def _value(self, col, table):
        r, positive, negative = self.r, self.sum, self.n - self.sum
        good = (F.col("s") + r) / (positive + 2 * r)
        bad = (F.col("c") - F.col("s") + r) / (negative + 2 * r)
        return F.when(F.col("c") == 1, 0.0).otherwise(F.ln(good / bad))


class JamesSteinEncoder(TargetBase):
    """Means shrunk towards the prior; ``model``: independent, pooled, beta or binary."""

    def __init__(self, label_col, cols=None, model: str = "independent", **how):
        super().__init__(label_col, cols, **how)
        if model not in ("independent", "pooled", "beta", "binary"):
            raise ValueError(f"no such model: {model}")
        self.model = model
        self.other = 0.0 if model == "binary" else None

    def _check(self):
        if self.model == "binary" and self.odd:
            raise ValueError("the binary model takes targets 0 and 1")

    def id_like(self):
        return 0.0 if self.model == "binary" else float(self.prior)

    def _value(self, col, table):
        k, m, prior = self.k[col], _mean(), self.prior
        if self.model == "independent":
            own = F.when(F.col("c") > 1, F.col("v")).otherwise(0.0)
            b = F.try_divide(own, F.lit(float(self.var or 0.0)) + own) * ((k - 3) / (k - 1) if k > 1 else 0.0)
            w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(b, F.lit(0.0))))
            return w * m + (1 - w) * prior
        if self.model == "pooled":
            t = table.agg(F.avg("c").alias("size"), F.sum(F.pow(m - prior, 2)).alias("sse")).first()
            if not t["sse"]:
                return m
            b = min(1.0, max(0.0, (k - 3) * (self.var or 0.0) / t["size"] / t["sse"]))
            return prior + (1 - b) * (m - prior)
        if self.model == "beta":
            w = F.col("c") / (F.col("c") + self.n)
            return w * m + (1 - w) * prior
        return self._binary(table, k)

    def _binary(self, table: DataFrame, k: int) -> Column:
        """Shrunk log odds of each category against the others, with Yates' correction.

        The spread between categories solves sum of w (mu_k - mu)^2 = K - 1 with w = 1 / (sigma^2 + sigma_k^2); the
        left side falls with sigma, so bisection over a row a category finds it.
        """
        if k == 1:
            return F.lit(0.0)
        positive, negative = self.sum, self.n - self.sum
        half = F.lit(0.5)
        s, f = F.col("s"), F.col("c") - F.col("s")
        mu = F.ln((s + half) * (negative - f + half) / ((positive - s + half) * (f + half)))
        var = 1 / (s + half) + 1 / (positive - s + half) + 1 / (f + half) + 1 / (negative - f + half)
        one = table.select(mu.alias("mu"), var.alias("var"))

        def gaps(sigma2: list[float]) -> list[tuple[float, float]]:
            """(what is left of the equation, the mean) at each candidate, in one job."""
            aggs = []
            for i, x in enumerate(sigma2):
                w = 1 / (x + F.col("var"))
                aggs += [F.sum(w).alias(f"w{i}"), F.sum(w * F.col("mu")).alias(f"m{i}"), F.sum(w * F.col("mu") * F.col("mu")).alias(f"q{i}")]
            r = one.agg(*aggs).first()
            return [(r[f"q{i}"] - r[f"m{i}"] ** 2 / r[f"w{i}"] - (k - 1), r[f"m{i}"] / r[f"w{i}"]) for i in range(len(sigma2))]

        rows = fetched(one)
        if rows is not None:  # a table that is small anyway is summed here
            m, v = np.array([r["mu"] for r in rows]), np.array([r["var"] for r in rows])

            def gaps(sigma2: list[float]) -> list[tuple[float, float]]:  # noqa: F811
                out = []
                for x in sigma2:
                    w = 1 / (x + v)
                    mean = float((w * m).sum() / w.sum())
                    out.append((float((w * (m - mean) ** 2).sum() - (k - 1)), mean))
                return out

        low, high = 0.0, 0.0
        if gaps([0.0])[0][0] > 0:
            ends = [2.0**i for i in range(21)]
            high = next((e for e, (g, _) in zip(ends, gaps(ends), strict=True) if g <= 0), ends[-1])
            for _ in range(12):  # each round cuts the stretch into 32
                grid = [low + (high - low) * i / 32 for i in range(1, 32)]
                over = sum(g > 0 for g, _ in gaps(grid))
                low, high = [low, *grid, high][over : over + 2]
        sigma2 = low
        mean = gaps([sigma2])[0][1]
        b = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - 3) * var / ((k - 1) * (sigma2 + var))))
        return mean + (1 - b) * (mu - mean)


def multi_class(df: DataFrame, label_col: str, cols: list[str], make: Callable[[str], TargetBase], max_classes: int = 1000) -> DataFrame:
    """Columns ``<col>_<class>`` for every class but the first, by an encoder of each; the other columns first.

    One aggregation and one join a column, whatever the number of classes.
    """
    classes = [r[0] for r in df.select(quoted(label_col)).filter(quoted(label_col).isNotNull()).distinct().orderBy(label_col).limit(max_classes + 1).collect()]
    if len(classes) > max_classes:
        raise ValueError(f"over {max_classes} classes")
    flags = {f"__s{i}": F.sum(F.when(quoted(label_col) == F.lit(k), 1.0).otherwise(0.0)) for i, k in enumerate(classes[1:])}
    total = df.agg(F.count("*").alias("n"), *[e.alias(n) for n, e in flags.items()]).first()
    out, rest = df, [c for c in df.columns if c not in cols]

    def spread(s: Column, n: Column) -> Column:
        return F.when(n > 1, (s - s * s / n) / (n - 1))

    for c in cols:
        # the sums of all classes in one aggregation, the values of all in one table
        table, _ = settle(df.groupBy(clean(df, c).alias("cat")).agg(F.count("*").alias("c"), *[e.alias(n) for n, e in flags.items()]))
        k, names = table.count(), {}
        for i, of in enumerate(classes[1:]):
            enc, s, n = make("__y"), total[f"__s{i}"], total["n"]
            enc.active, enc.width, enc.tables, enc.k = [c], df.columns, {}, {c: k}
            enc.prior, enc.n, enc.sum, enc.var, enc.odd = s / n, n, s, (s - s * s / n) / (n - 1) if n > 1 else None, 0
            enc._check()
            table = table.withColumn("s", F.col(f"__s{i}")).withColumn("v", spread(F.col(f"__s{i}"), F.col("c")))
            alike = enc.id_like()
            table = table.withColumn(f"__value{i}", F.lit(alike) if k == n and alike is not None else enc._value(c, table)).drop("s", "v")
            names[f"__value{i}"] = (f"{c}_{of}", float(enc.prior if enc.other is None else enc.other))
        table, small = settle(table.select("cat", *names))
        out = look_up(out, clean(df, c), table, small, list(names))
        out = out.withColumns({new: F.coalesce(v, F.lit(other)) for v, (new, other) in names.items()}).drop(*names)
    made = [f"{c}_{k}" for k in classes[1:] for c in cols]
    return out.select(*map(quoted, rest), *map(quoted, made))


def out_of_fold(df: DataFrame, col: str, label_col: str, fold_col: str, value: Callable[[Column, Column, Column], Column], out: str) -> DataFrame:
    """``out``: ``value(sum, count, prior)`` of the category over all rows but those of the row's fold.

    Sums a category and fold are taken once; "all but the fold" is total minus fold, so nothing is fitted twice.
    A category that only the row's own fold has gets the prior of the other folds.
    """
    y = quoted(label_col).cast("double")
    cells = df.groupBy(clean(df, col).alias("cat"), quoted(fold_col).alias("fold")).agg(F.sum(y).alias("s"), F.count("*").alias("c"))
    folds = df.groupBy(quoted(fold_col).alias("fold")).agg(F.sum(y).alias("fs"), F.count("*").alias("fc"))
    total = df.agg(F.sum(y).alias("s"), F.count("*").alias("c")).first()
    by_cat = Window.partitionBy("cat")
    rest = cells.join(folds, "fold").select(
        "cat", "fold", (F.sum("s").over(by_cat) - F.col("s")).alias("s"), (F.sum("c").over(by_cat) - F.col("c")).alias("c"),
        F.try_divide(F.lit(total["s"]) - F.col("fs"), F.lit(total["c"]) - F.col("fc")).alias("prior"),
    )
    rest = rest.select(F.col("cat").alias("__cat"), F.col("fold").alias("__fold"), F.when(F.col("c") > 0, value(F.col("s"), F.col("c"), F.col("prior"))).otherwise(F.col("prior")).alias(out))
    return df.join(rest, clean(df, col).eqNullSafe(F.col("__cat")) & quoted(fold_col).eqNullSafe(F.col("__fold")), "left").drop("__cat", "__fold")


def logistic_weight(k: float = 2, f: float = 1) -> Callable[[Column, Column, Column], Column]:
    """The value lambda prior + (1 - lambda) mean with lambda(c) = 1 / (1 + exp((c - k) / f))."""

    def value(s: Column, c: Column, prior: Column) -> Column:
        lam = 1 / (1 + F.exp((c - k) / f))
        return lam * prior + (1 - lam) * s / c

    return value


def test_mean_over_folds(train: DataFrame, col: str, label_col: str, fold_col: str, value: Callable[[Column, Column, Column], Column], max_folds: int = 1000) -> DataFrame:
    """(cat, value): the mean over the folds of what a category gets without that fold; null is a fold."""
    y = quoted(label_col).cast("double")
    cells = train.groupBy(clean(train, col).alias("cat"), quoted(fold_col).alias("fold")).agg(F.sum(y).alias("s"), F.count("*").alias("c"))
    folds = train.groupBy(quoted(fold_col).alias("fold")).agg(F.sum(y).alias("fs"), F.count("*").alias("fc"))
    totals = train.agg(F.sum(y).alias("s"), F.count("*").alias("c")).first()
    cats = cells.groupBy("cat").agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    folds = folds.select("fold", F.try_divide(F.lit(totals["s"]) - F.col("fs"), F.lit(totals["c"]) - F.col("fc")).alias("prior"))
    found = folds.orderBy("fold").limit(max_folds + 1).collect()
    if len(found) > max_folds:
        raise ValueError(f"over {max_folds} folds")
    kind = train.schema[fold_col].dataType
    ids = F.array(*[F.struct(F.lit(r["fold"]).cast(kind).alias("fold"), F.lit(r["prior"]).alias("prior")) for r in found])
    grid = cats.withColumn("f", F.explode(ids)).select("cat", "ts", "tc", "f.fold", "f.prior")
    own = cells.withColumnRenamed("cat", "__cat").withColumnRenamed("fold", "__fold")
    rest = grid.join(own, F.col("cat").eqNullSafe(F.col("__cat")) & F.col("fold").eqNullSafe(F.col("__fold")), "left")
    s, c = F.col("ts") - F.coalesce("s", F.lit(0.0)), F.col("tc") - F.coalesce("c", F.lit(0))
    return rest.groupBy("cat").agg(F.avg(F.when(c > 0, value(s, c, F.col("prior"))).otherwise(F.col("prior"))).alias("value"))


test_mean_over_folds.__test__ = False


#: Statistics that follow from a part's count, sum, square sum, least and largest value.
_OF_PARTS: dict[Callable, Callable[[], Column]] = {
    F.max: lambda: F.max("hi"), F.min: lambda: F.min("lo"), F.sum: lambda: F.sum("s"), F.count: lambda: F.sum("n"), F.avg: lambda: F.try_divide(F.sum("s"), F.sum("n")),
    F.stddev_samp: lambda: F.when(F.sum("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.sum("m2") + F.sum(F.when(F.col("n") > 0, F.col("s") * F.col("s") / F.col("n"))) - F.sum("s") * F.sum("s") / F.sum("n")) / (F.sum("n") - 1))),
}


def _without_fold(df: DataFrame, col: str, label_col: str, fold_col: str, n_folds: int, stats: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(__cat, __fold, a column a statistic): statistics of the target over a category's rows outside the fold.

    What can be told from parts is: figures by category and fold go to the folds they aren't in. Medians come from the
    category's rows in order (see ``_medians_without_fold``). Any other statistic needs the rows in each fold's rest.
    """
    y = quoted(label_col).cast("double")
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: k != F.col("__own")))
    rows = df.select(clean(df, col).alias("__cat"), quoted(fold_col).alias("__own"), y.alias("__y"))
    parts = {n: _OF_PARTS[f]() for n, f in stats.items() if f in _OF_PARTS}
    whole = {n: f(F.col("__y")) for n, f in stats.items() if f not in _OF_PARTS and f is not F.median}
    found = []
    if parts:
        cells = rows.groupBy("__cat", "__own").agg(F.count("__y").alias("n"), F.sum("__y").alias("s"), (F.var_pop("__y") * F.count("__y")).alias("m2"), F.min("__y").alias("lo"), F.max("__y").alias("hi"))
        found.append(cells.withColumn("__fold", others).groupBy("__cat", "__fold").agg(*[e.alias(n) for n, e in parts.items()]))
    if medians := [n for n, f in stats.items() if f is F.median]:
        found.append(_medians_without_fold(rows, n_folds).select("__cat", "__fold", *[F.col("__median").alias(n) for n in medians]))
    if whole:
        found.append(rows.withColumn("__fold", others).groupBy("__cat", "__fold").agg(*[e.alias(n) for n, e in whole.items()]))
    out = found[0]
    for more in found[1:]:
        more = more.withColumnsRenamed({"__cat": "__c", "__fold": "__f"})
        out = out.join(more, F.col("__cat").eqNullSafe(F.col("__c")) & (F.col("__fold") == F.col("__f"))).drop("__c", "__f")
    return out


def _medians_without_fold(rows: DataFrame, n_folds: int) -> DataFrame:
    """(__cat, __fold, __median): the median of __y over the category's rows outside the fold, for folds with such a row.

    A row's place among those outside a fold is its place in the category less the fold's rows up to it. So one sort of
    a category, with a running count a fold, has the middle rows of all folds' rests; no row is copied.
    """
    w = Window.partitionBy("__cat")
    some = F.col("__y").isNotNull()
    so_far = w.orderBy(F.asc_nulls_last("__y")).rowsBetween(Window.unboundedPreceding, 0)
    own = [(F.col("__own") == k) & some for k in range(n_folds)]
    # one call, so that the functions of each window are one node of the plan
    running = {"__r": F.count("__y").over(so_far)} | {f"__r{k}": F.count(F.when(own[k], 1)).over(so_far) for k in range(n_folds)}
    totals = {"__n": F.count("__y"), "__all": F.count("*")} | {f"__n{k}": F.count(F.when(own[k], 1)) for k in range(n_folds)} | {f"__a{k}": F.count(F.when(F.col("__own") == k, 1)) for k in range(n_folds)}
    at = rows.withColumns(running | {n: e.over(w) for n, e in totals.items()})
    aggs = []
    for k in range(n_folds):
        place, m = F.col("__r") - F.col(f"__r{k}"), F.col("__n") - F.col(f"__n{k}")
        middle = (place == F.floor((m + 1) / 2)) | (place == F.floor((m + 2) / 2))
        aggs += [F.avg(F.when(some & ~F.coalesce(own[k], F.lit(False)) & middle, F.col("__y"))).alias(f"__m{k}"), F.max(F.col("__all") - F.col(f"__a{k}")).alias(f"__rest{k}")]
    cells = F.array(*[F.struct(F.lit(k).alias("__fold"), F.col(f"__m{k}").alias("__median"), F.col(f"__rest{k}").alias("__rest")) for k in range(n_folds)])
    return at.groupBy("__cat").agg(*aggs).select("__cat", F.inline(cells)).filter("__rest > 0").drop("__rest")


def target_statistic(df: DataFrame, col: str, label_col: str, fold_col: str, n_folds: int, stats: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``<col>_<stat>``: a statistic of the target over the category's rows in all folds but the row's own.

    Where the category has no such row, the statistic over all rows is taken.
    """
    y = quoted(label_col).cast("double")
    cells = _without_fold(df, col, label_col, fold_col, n_folds, {f"{col}_{n}": f for n, f in stats.items()})
    whole = df.agg(*[f(y).alias(n) for n, f in stats.items()]).first()
    out = df.join(cells, clean(df, col).eqNullSafe(F.col("__cat")) & (quoted(fold_col) == F.col("__fold")), "left").drop("__cat", "__fold")
    return out.withColumns({f"{col}_{n}": F.coalesce(f"{col}_{n}", F.lit(whole[n])) for n in stats})


def test_target_statistic(train: DataFrame, col: str, label_col: str, fold_col: str, n_folds: int, stats: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(cat, a column a statistic): what a test row of the category gets, the mean over the folds of the statistic without the fold.

    A fold without which the category has no row counts with the statistic over all rows.
    """
    y = quoted(label_col).cast("double")
    whole = train.agg(*[f(y).alias(n) for n, f in stats.items()]).first()
    cells = _without_fold(train, col, label_col, fold_col, n_folds, stats)
    return cells.groupBy(F.col("__cat").alias("cat")).agg(*[((F.sum(F.coalesce(n, F.lit(whole[n]))) + (n_folds - F.count("*")) * F.lit(whole[n])) / n_folds).alias(n) for n in stats])


test_target_statistic.__test__ = False


def nested_cv(train: DataFrame, fold_col: str, make: Callable[[], TargetBase], tests: tuple[DataFrame, ...] = (), max_folds: int = 100) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(``train`` with each row encoded without its fold, each table of ``tests`` encoded from all of ``train``).

    ``make`` gives a new encoder, of any kind with ``fit`` and ``transform``. It is fitted once a fold, so use
    ``out_of_fold`` for what sums can tell. Null is a fold. Tests need the columns of ``train``.
    """
    folds = [r[0] for r in train.select(quoted(fold_col)).distinct().orderBy(quoted(fold_col)).limit(max_folds + 1).collect()]
    if len(folds) > max_folds:
        raise ValueError(f"over {max_folds} folds")
    parts = []
    for k in folds:
        own = quoted(fold_col).eqNullSafe(F.lit(k).cast(train.schema[fold_col].dataType))
        parts.append(make().fit(train.filter(~own)).transform(train.filter(own)))
    out = parts[0] if parts else train
    for p in parts[1:]:
        out = out.unionByName(p)
    full = make().fit(train) if tests else None
    return out, tuple(full.transform(t) for t in tests)


def expanding_mean(df: DataFrame, col: str, label_col: str, order_col: str, out: str, hot: int | None = None) -> DataFrame:
    """The mean of the target over the category's earlier rows; the prior where there is none. See ``sums_before``."""
    y = quoted(label_col).cast("double")
    cells = df.groupBy(quoted(col)).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.count(y).alias("c"))
    whole = cells.agg(F.max("n").alias("largest"), F.try_divide(F.sum("s"), F.sum("c")).alias("prior")).first()
    both = sums_before(df, quoted(col), order_col, {"__s": F.coalesce(y, F.lit(0.0)), "__c": y.isNotNull().cast("int")}, whole["largest"] or 0, hot)
    return both.withColumn(out, F.coalesce(F.try_divide(F.col("__s"), F.col("__c")), F.lit(whole["prior"]))).drop("__s", "__c")
