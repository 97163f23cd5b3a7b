"""Encoders that take the category alone: ordinal, one-hot, base-N, count, hashing, contrast codings.

Every encoder has ``fit(df)``, ``transform(df)``, ``fit_transform(df)`` and ``get_feature_names()``. Codes
follow the first appearance of a category, by an explicit ``order_col``; equal places are told apart by the
category itself. Encoded columns take the place of their source column.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..core.mapping import POLICIES, categorical_columns, check_no_nulls, clean, look_up, quoted, settle
from ..core.order import numbered

#: Sentinel codes.
UNKNOWN, MISSING = -1, -2


class Encoder:
    policies: tuple[str, ...] = POLICIES[:3]

    def __init__(self, cols: list[str] | None = None, order_col: str | None = None, handle_unknown: str = "value", handle_missing: str = "value", drop_invariant: bool = False):
        for p in (handle_unknown, handle_missing):
            if p not in self.policies:
                raise ValueError(f"{type(self).__name__} takes {self.policies}, not {p!r}")
        self.cols, self.order_col, self.drop_invariant = cols, order_col, drop_invariant
        self.handle_unknown, self.handle_missing = handle_unknown, handle_missing
        self.width: list[str] | None = None
        self.dropped: list[str] = []

    def fit(self, df: DataFrame) -> Encoder:
        self.width, self.dropped = df.columns, []
        self.active = categorical_columns(df, self.cols)
        if self.handle_missing == "error":
            check_no_nulls(df, self.active, "fit")
        self._fit(df)
        out = self._columns()
        if self.drop_invariant:
            made = [c for c in out if c not in df.columns or c in self.active]
            spread = self._transform(df).agg(*[F.var_samp(quoted(c)).alias(c) for c in made]).first() if made else {}
            self.dropped = [c for c in made if (spread[c] or 0.0) <= 1e-4]
        self.names = [c for c in out if c not in self.dropped]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.width is None:
            raise ValueError("the encoder has to be fitted before it transforms")
        if df.columns != self.width:
            raise ValueError(f"fitted on {self.width}, got {df.columns}")
        if self.handle_missing == "error":
            check_no_nulls(df, self.active, "transform")
        return self._transform(df).select(*map(quoted, self.names))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def get_feature_names(self) -> list[str]:
        if self.width is None:
            raise ValueError("the encoder has to be fitted before it has feature names")
        return list(self.names)

    def _columns(self) -> list[str]:
        return [n for c in self.width for n in (self.made(c) if c in self.active else [c])]

    def made(self, col: str) -> list[str]:
        """The columns that come from ``col``."""
        return [col]

    def _fit(self, df: DataFrame) -> None:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class OrdinalEncoder(Encoder):
    """Category -> 1, 2, ... by first appearance, or by ``mapping`` {column: {category: code}}."""

    def __init__(self, cols=None, order_col=None, mapping: dict[str, dict] | None = None, **policies):
        super().__init__(cols, order_col, **policies)
        self.mapping = mapping or {}

    def _fit(self, df: DataFrame) -> None:
        self.tables, self.small = {}, {}
        for c in self.active:
            if c in self.mapping:
                kind = df.schema[c].dataType.simpleString()
                self.tables[c], self.small[c] = df.sparkSession.createDataFrame(list(self.mapping[c].items()), f"cat {kind}, code int"), True
            else:
                self.tables[c], self.small[c] = first_codes(df, c, self.order_col)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.active:
            key = clean(df, c)
            out = look_up(out, key, self.tables[c].withColumnRenamed("code", "__code"), self.small[c], ["__code"])
            code = F.col("__code")
            if self.handle_missing == "return_nan":
                code = F.when(clean(df, c).isNotNull(), code)
            missing = F.lit(MISSING) if self.handle_missing == "value" else F.lit(None)
            unknown = F.lit(UNKNOWN) if self.handle_unknown == "value" else F.lit(None)
            if self.handle_unknown == "error":
                unknown = F.raise_error(F.lit(f"unknown category in {c}"))
            seen_null = F.when(clean(df, c).isNull() & code.isNull(), missing.cast("int")).when(code.isNull(), unknown.cast("int")).otherwise(code)
            out = out.withColumn(c, seen_null).drop("__code")
        return out

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Categories of the codes; sentinels and unknown codes give null."""
        out = df
        for c in self.active:
            back = self.tables[c].select(F.col("code").alias("cat"), F.col("cat").alias("__value"))
            out = look_up(out, quoted(c), back, self.small[c], ["__value"]).withColumn(c, F.col("__value")).drop("__value")
        return out.select(*map(quoted, df.columns))


def first_codes(df: DataFrame, col: str, order_col: str | None, most: int | None = None) -> tuple[DataFrame, bool]:
    """(cat, code) and whether it is small: the distinct values of ``col``, null included, numbered by first appearance."""
    if order_col is None:
        raise ValueError("codes by first appearance need an order_col")
    first = df.select(clean(df, col).alias("cat"), quoted(order_col).alias("at")).groupBy("cat").agg(F.min("at").alias("at"))
    table, small = numbered(first, ["at", "cat"], "code", most=most)
    return table.select("cat", "code"), small


def sorted_codes(df: DataFrame, col: str) -> tuple[DataFrame, bool]:
    """(cat, code) and whether it is small: 0-based codes of the values in their order; null has none."""
    values = df.select(clean(df, col).alias("cat")).distinct()
    return numbered(values.filter("cat is not null"), ["cat"], "code", 0)


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    table, small = sorted_codes(df, col)
    return look_up(df, clean(df, col), table.withColumnRenamed("code", "__code"), small, ["__code"]).withColumn(out, F.coalesce("__code", F.lit(-1))).drop("__code")


class _Coded(Encoder):
    """Encoders whose columns come from the list of categories in code order."""

    policies = POLICIES

    def __init__(self, cols=None, order_col=None, max_categories: int = 10_000, **policies):
        super().__init__(cols, order_col, **policies)
        self.max_categories = max_categories

    def _fit(self, df: DataFrame) -> None:
        self.cats: dict[str, list] = {}
        for c in self.active:
            table, small = first_codes(df, c, self.order_col, self.max_categories)
            if not small:
                raise ValueError(f"{c} has over {self.max_categories} categories")
            self.cats[c] = [r["cat"] for r in table.orderBy("code").collect()]

    def rows_of(self, c: str) -> dict[str, list]:
        """What a category's row of the joined table has besides its code, by name and in code order."""
        return {}

    def with_codes(self, df: DataFrame) -> DataFrame:
        """``df`` with ``__code_<col>``, the 1-based code or 0, and what ``rows_of`` adds; one join a column."""
        for c in self.active:
            extra = self.rows_of(c)
            kind = df.schema[c].dataType.simpleString()
            rows = [(v, i + 1, *(x[i] for x in extra.values())) for i, v in enumerate(self.cats[c])]
            table = df.sparkSession.createDataFrame(rows, f"cat {kind}, code int" + "".join(f", {n} array<double>" for n in extra))
            names = [f"__{n}_{c}" for n in ("code", *extra)]
            table = table.select("cat", *[quoted(n).alias(m) for n, m in zip(("code", *extra), names, strict=True)])
            df = look_up(df, clean(df, c), table, True, [f"`{n}`" for n in names]).withColumn(names[0], F.coalesce(quoted(names[0]), F.lit(0)))
        return df

    def code(self, df: DataFrame, c: str) -> Column:
        """The 1-based code; 0 for what has none."""
        return quoted(f"__code_{c}")

    def blank(self, df: DataFrame, c: str) -> Column:
        """Whether policy ``return_nan`` blanks the row."""
        isnull = clean(df, c).isNull()
        out = F.lit(False)
        if self.handle_missing == "return_nan":
            out = out | isnull
        if self.handle_unknown == "return_nan":
            out = out | (~isnull & (self.code(df, c) == 0))
        return out

    def _checked(self, df: DataFrame, c: str, code: Column) -> Column:
        if self.handle_unknown == "error":
            bad = clean(df, c).isNotNull() & (code == 0)
            return F.when(bad, F.raise_error(F.lit(f"unknown category in {c}")).cast("int")).otherwise(code)
        return code

    def _transform(self, df: DataFrame) -> DataFrame:
        coded, cells = self.with_codes(df), []
        for c in df.columns:
            cells += self._cells(df, c) if c in self.active else [quoted(c)]
        return coded.select(*cells)

    def _cells(self, df: DataFrame, c: str) -> list[Column]:
        raise NotImplementedError


class OneHotEncoder(_Coded):
    """A 0/1 column a category, ``<col>_<code>`` or ``<col>_<value>``; ``#`` is added to names that collide."""

    def __init__(self, cols=None, order_col=None, use_cat_names: bool = False, **policies):
        super().__init__(cols, order_col, **policies)
        self.use_cat_names = use_cat_names

    def _levels(self, c: str) -> list[tuple[str, str | int]]:
        """(suffix, what makes it 1: a code, or the sentinel of unknown or missing)."""
        out: list[tuple[str, str | int]] = []
        for i, v in enumerate(self.cats[c]):
            out.append((("nan" if v is None else str(v)) if self.use_cat_names else str(i + 1), i + 1))
        if self.handle_missing != "value" and None not in self.cats[c]:
            out.append(("nan" if self.use_cat_names else str(MISSING), "missing"))
        if self.handle_unknown != "value":
            out.append((str(UNKNOWN), "unknown"))
        return out

    def made(self, col: str) -> list[str]:
        names: list[str] = []
        for suffix, _ in self._levels(col):
            name = f"{col}_{suffix}"
            while name in names:
                name += "#"
            names.append(name)
        return names

    def _cells(self, df: DataFrame, c: str) -> list[Column]:
        code, isnull, blank = self._checked(df, c, self.code(df, c)), clean(df, c).isNull(), self.blank(df, c)
        tests = {"missing": isnull, "unknown": ~isnull & (code == 0)}
        return [F.when(~blank, F.when(tests[on] if on in tests else code == on, 1).otherwise(0)).alias(n) for n, (_, on) in zip(self.made(c), self._levels(c), strict=True)]

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        cells: list[Column] = []
        for c in self.width:
            if c not in self.active:
                cells.append(quoted(c))
                continue
            on = [F.when(quoted(n) == 1, F.lit(self.cats[c][k - 1])) for n, (_, k) in zip(self.made(c), self._levels(c), strict=True) if isinstance(k, int) and self.cats[c][k - 1] is not None]
            cells.append((F.coalesce(*on) if on else F.lit(None)).alias(c))
        return df.select(*cells)


def get_dummies(df: DataFrame, cols: list[str], dummy_na: bool = False, max_categories: int = 10_000) -> DataFrame:
    """Indicator columns ``<col>_<value>`` in the order of the values, at the end."""
    out = df
    for c in cols:
        values = [r[0] for r in df.select(clean(df, c)).distinct().orderBy(F.col(df.select(clean(df, c)).columns[0])).limit(max_categories + 1).collect() if r[0] is not None]
        if len(values) > max_categories:
            raise ValueError(f"{c} has over {max_categories} categories")
        made = {f"{c}_{v}": F.coalesce(clean(df, c) == F.lit(v), F.lit(False)).cast("int") for v in values}
        if dummy_na:
            made[f"{c}_nan"] = clean(df, c).isNull().cast("int")
        out = out.withColumns(made).drop(c)
    return out


def shared_dummies(df: DataFrame, cols: list[str], prefix: str, values: list) -> DataFrame:
    """Indicators of whether any of ``cols`` has the value."""
    return df.withColumns({f"{prefix}_{v}": F.greatest(*[F.coalesce(quoted(c) == F.lit(v), F.lit(False)) for c in cols]).cast("int") for v in values})


class BaseNEncoder(_Coded):
    """The code's digits in base ``base``, most significant first; all 0 for what has no code."""

    def __init__(self, cols=None, order_col=None, base: int = 2, **policies):
        super().__init__(cols, order_col, **policies)
        self.base = base

    def _codes(self, c: str) -> int:
        extra = (self.handle_unknown == "indicator") + (self.handle_missing == "indicator" and None not in self.cats[c])
        return len(self.cats[c]) + extra

    def digits(self, c: str) -> int:
        n = self._codes(c)
        if self.base == 1:
            return n + 1
        d, reach = 0, 1
        while reach < n:  # ceil(log_base(n)) without rounding
            d, reach = d + 1, reach * self.base
        return d + 1

    def made(self, col: str) -> list[str]:
        return [f"{col}_{i}" for i in range(self.digits(col))]

    def _cells(self, df: DataFrame, c: str) -> list[Column]:
        code, isnull = self._checked(df, c, self.code(df, c)), clean(df, c).isNull()
        n = len(self.cats[c])
        if self.handle_missing == "indicator" and None not in self.cats[c]:
            n += 1
            code = F.when(isnull, n).otherwise(code)
        if self.handle_unknown == "indicator":
            code = F.when(~isnull & (code == 0), n + 1).otherwise(code)
        d, blank = self.digits(c), self.blank(df, c)
        if self.base == 1:
            cells = [F.when((code == i) & (code > 0), 1).otherwise(0) for i in range(d)]
        else:
            cells = [(F.floor(code / self.base ** (d - 1 - i)) % self.base).cast("int") for i in range(d)]
        return [F.when(~blank, x).alias(name) for x, name in zip(cells, self.made(c), strict=True)]

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        cells = []
        for c in self.width:
            if c not in self.active:
                cells.append(quoted(c))
                continue
            names = self.made(c)
            code = sum((quoted(n) * (i if self.base == 1 else self.base ** (len(names) - 1 - i)) for i, n in enumerate(names)), F.lit(0))
            values = F.array(*[F.lit(v) for v in self.cats[c]])
            cells.append(F.when((code > 0) & (code <= len(self.cats[c])), F.element_at(values, F.greatest(code, F.lit(1)).cast("int"))).alias(c))
        return df.select(*cells)


class BinaryEncoder(BaseNEncoder):
    def __init__(self, cols=None, order_col=None, **policies):
        super().__init__(cols, order_col, base=2, **policies)


# contrast codings: matrices of one row a level

def helmert(n: int) -> np.ndarray:
    """Column j: -1 for the levels up to j, j + 1 at the next, 0 beyond."""
    m = np.zeros((n, n - 1))
    for j in range(n - 1):
        m[: j + 1, j] = -1
        m[j + 1, j] = j + 1
    return m


def backward_difference(n: int) -> np.ndarray:
    """Column j: (j + 1 - n) / n for the levels up to j, (j + 1) / n beyond."""
    level, j = np.arange(n)[:, None], np.arange(n - 1)[None, :]
    return np.where(level <= j, (j + 1 - n) / n, (j + 1) / n)


def sum_coding(n: int) -> np.ndarray:
    return np.vstack([np.eye(n - 1), -np.ones((1, n - 1))])


def polynomial(n: int) -> np.ndarray:
    """Orthonormal polynomials of degree 1 to n - 1 on equally spaced levels, rising at the last level."""
    x = np.arange(n) - (n - 1) / 2
    q, _ = np.linalg.qr(np.vander(x, n, increasing=True))
    q = q * np.where(q[-1] < 0, -1, 1)
    return np.where(np.abs(q) < 1e-12, 0.0, q)[:, 1:]


class ContrastEncoder(_Coded):
    """``intercept`` = 1 in front, then n - 1 columns ``<col>_<j>`` of a contrast matrix a source column.

    A column with fewer than two levels gives no columns. What has no code gets zeros.
    """

    matrix = staticmethod(helmert)

    def _level_count(self, c: str) -> int:
        return len(self.cats[c]) + (self.handle_unknown == "indicator") + (self.handle_missing == "indicator" and None not in self.cats[c])

    def made(self, col: str) -> list[str]:
        return [f"{col}_{j}" for j in range(max(0, self._level_count(col) - 1))]

    def matrix_of(self, c: str) -> list[list[float]]:
        n = self._level_count(c)
        return type(self).matrix(n).astype(float).tolist() if n > 1 else [[] for _ in range(n)]

    def rows_of(self, c: str) -> dict[str, list]:
        return {"row": self.matrix_of(c)[: len(self.cats[c])]}

    def _columns(self) -> list[str]:
        return ["intercept", *super()._columns()]

    def _transform(self, df: DataFrame) -> DataFrame:
        return super()._transform(df).withColumn("intercept", F.lit(1))

    def _cells(self, df: DataFrame, c: str) -> list[Column]:
        n = self._level_count(c)
        if n < 2:
            return []
        code, isnull, k = self._checked(df, c, self.code(df, c)), clean(df, c).isNull(), len(self.cats[c])
        if self.handle_missing == "indicator" and None not in self.cats[c]:
            k += 1
            code = F.when(isnull, k).otherwise(code)
        if self.handle_unknown == "indicator":
            code = F.when(~isnull & (code == 0), k + 1).otherwise(code)
        # rows of the matrix for the categories come with the join; only those of the indicators are literals
        blank, row = self.blank(df, c), quoted(f"__row_{c}")
        extra = [F.when(code == len(self.cats[c]) + 1 + i, F.array(*map(F.lit, r))) for i, r in enumerate(self.matrix_of(c)[len(self.cats[c]) :])]
        row = F.when(code >= 0, F.coalesce(row, *extra))  # the code is looked at, as it may raise
        return [F.when(~blank, F.coalesce(F.element_at(row, j + 1), F.lit(0.0))).alias(name) for j, name in enumerate(self.made(c))]


class HelmertEncoder(ContrastEncoder):
    matrix = staticmethod(helmert)


class BackwardDifferenceEncoder(ContrastEncoder):
    matrix = staticmethod(backward_difference)


class SumEncoder(ContrastEncoder):
    matrix = staticmethod(sum_coding)


class PolynomialEncoder(ContrastEncoder):
    matrix = staticmethod(polynomial)


#: Small categories up to which their joined names make the name of the merged group.
MERGED_NAMES = 10_000


class CountEncoder(Encoder):
    """Category -> its count, or its share with ``normalize``.

    Groups below ``min_group_size`` are merged, if there are two or more of them and not all are small, under
    their sorted names joined by ``_``, of which there may be ``MERGED_NAMES``, or ``min_group_name``. A ``min_group_size`` below 1 is a share. ``combine_min_nan_groups``:
    True merges null if it is small, ``"force"`` always, False never. Options may be dicts by column.
    """

    policies = ("value", "return_nan", "error", "count")

    def __init__(self, cols=None, handle_unknown=None, handle_missing="count", min_group_size=None, combine_min_nan_groups=True, min_group_name=None, normalize=False):
        super().__init__(cols, None)
        self.options = {"unknown": handle_unknown, "missing": handle_missing, "size": min_group_size, "nan": combine_min_nan_groups, "name": min_group_name, "normalize": normalize}

    def option(self, name: str, col: str):
        v = self.options[name]
        return v.get(col) if isinstance(v, dict) else v

    def _fit(self, df: DataFrame) -> None:
        self.tables, self.small = {}, {}
        total = df.count()
        for c in self.active:
            if self.option("missing", c) == "error":
                check_no_nulls(df, [c], "fit")
            t = df.groupBy(clean(df, c).alias("cat")).agg(F.count("*").alias("n"))
            least = self.option("size", c)
            if least is not None:
                least = least * total if 0 < least < 1 else least
                nan = self.option("nan", c)
                merge_null = F.lit(True) if nan == "force" else (F.col("n") < least) if nan else F.lit(False)
                small = F.when(F.col("cat").isNull(), merge_null).otherwise(F.col("n") < least)
                # one row of figures over the categories
                t = t.withColumn("small", small)
                sizes = t.agg(
                    F.sum(F.col("small").cast("int")).alias("k"), F.sum((F.col("cat").isNotNull() & ~F.col("small")).cast("int")).alias("large"), F.sum(F.when(F.col("small"), F.col("n"))).alias("merged"),
                ).first()
                merged = (sizes["k"] or 0) >= 2 and bool(sizes["large"])
                merge, name = F.col("small") if merged else F.lit(False), self.option("name", c)
                if merged and not name:
                    if sizes["k"] > MERGED_NAMES:
                        raise ValueError(f"over {MERGED_NAMES} small categories in {c}: give min_group_name")
                    name = "_".join(sorted(r[0] for r in t.filter("small").select(F.coalesce(F.col("cat").cast("string"), F.lit("nan"))).collect()))
                t = t.select("cat", F.when(merge, F.lit(sizes["merged"]).cast("long")).otherwise(F.col("n")).alias("n"), F.when(merge, F.lit(name)).alias("group"))
            if self.option("normalize", c):
                t = t.withColumn("n", F.col("n") / total)
            self.tables[c], self.small[c] = settle(t)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.active:
            key, unknown = clean(df, c), self.option("unknown", c)
            out = look_up(out, key, self.tables[c].withColumnRenamed("n", "__n"), self.small[c], ["__n"])
            value, kind = F.col("__n"), "double" if self.option("normalize", c) else "long"
            other = F.raise_error(F.lit(f"unknown category in {c}")).cast(kind) if unknown == "error" else F.lit(unknown if isinstance(unknown, (int, float)) else None).cast(kind)
            filled = F.when(value.isNull() & clean(df, c).isNotNull(), other).otherwise(value)
            if self.option("missing", c) == "return_nan":
                filled = F.when(clean(df, c).isNotNull(), filled)
            elif self.option("missing", c) == "error":
                check_no_nulls(df, [c], "transform")
            out = out.withColumn(c, filled).drop("__n")
        return out


def _mod_hex(digest: Column, n: int, length: int) -> Column:
    """A hexadecimal number modulo ``n``, eight digits at a time."""
    step, out = (1 << 32) % n, F.lit(0).cast("long")
    for k in range(0, length, 8):
        part = F.conv(F.substring(digest, k + 1, 8), 16, 10).cast("long")
        out = (out * step + part) % n
    return out


class HashingEncoder(Encoder):
    """``col_0`` ... ``col_<n-1>``: how many of the columns' values hash to the bucket; then the other columns."""

    def __init__(self, cols=None, n_components: int = 8, hash_method: str = "md5"):
        super().__init__(cols)
        self.n, self.method = n_components, hash_method
        hashlib.new(hash_method)

    def _fit(self, df: DataFrame) -> None:
        pass

    def _columns(self) -> list[str]:
        return [*(f"col_{b}" for b in range(self.n)), *(c for c in self.width if c not in self.active)]

    def bucket(self, c: Column) -> Column:
        text = c.cast("string")
        built_in = {"md5": (F.md5, 32), "sha1": (F.sha1, 40), "sha256": (lambda x: F.sha2(x, 256), 64), "sha512": (lambda x: F.sha2(x, 512), 128)}
        if self.method in built_in:
            f, length = built_in[self.method]
            return _mod_hex(f(text), self.n, length)
        method, n = self.method, self.n

        @pandas_udf("long")
        def other(s: pd.Series) -> pd.Series:
            return s.map(lambda v: None if v is None else int(hashlib.new(method, v.encode()).hexdigest(), 16) % n)

        return other(text)

    def _transform(self, df: DataFrame) -> DataFrame:
        buckets = df.withColumn("__buckets", F.array(*[self.bucket(quoted(c)) for c in self.active]))

        def equals(b: int):
            return lambda x: x == b

        count = [F.size(F.filter("__buckets", equals(b))).alias(f"col_{b}") for b in range(self.n)]
        return buckets.select(*count, *[quoted(c) for c in df.columns if c not in self.active])


def same_set_codes(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """(cat, code): values of both tables first, then those of ``train`` only, then of ``test`` only; 0-based, in order."""
    a = train.select(quoted(col).alias("cat")).distinct().withColumn("a", F.lit(1))
    b = test.select(quoted(col).alias("cat")).distinct().withColumn("b", F.lit(1))
    both = a.join(b, "cat", "full_outer").withColumn("part", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 0).when(F.col("a").isNotNull(), 1).otherwise(2))
    return numbered(both.select("part", "cat"), ["part", "cat"], "code", 0)[0].select("cat", "code")


def fold_rare(df: DataFrame, col: str, least: int, other: str = "OTHER") -> DataFrame:
    """``col`` with the categories of fewer than ``least`` rows replaced."""
    counts, small = settle(df.groupBy(quoted(col).alias("cat")).agg(F.count("*").alias("__n")).filter(F.col("__n") < least))
    return look_up(df, quoted(col), counts, small, ["__n"]).withColumn(col, F.when(F.col("__n").isNotNull(), F.lit(other)).otherwise(quoted(col))).drop("__n")
