"""Joins as feature tables use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.mapping import look_up, quoted, settle


def left_merge(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The keys and the columns of ``right`` only, a row for each row of ``left``."""
    return left.select(*map(quoted, on)).join(right, on, "left")


def keep_listed(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    return df.join(ids.select(*map(quoted, on)), on, "left_semi")


def drop_listed(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    return df.join(ids.select(*map(quoted, on)), on, "left_anti")


def map_values(df: DataFrame, col: str, mapping: DataFrame, key: str, value: str, keep: bool = False) -> DataFrame:
    """``col`` replaced by ``value`` of the row of ``mapping`` with that ``key``; unmatched null, or kept."""
    table, small = settle(mapping.select(quoted(key).alias("cat"), quoted(value).alias("__v")))
    out = look_up(df, quoted(col), table, small, ["__v"])
    return out.withColumn(col, F.coalesce("__v", quoted(col)) if keep else F.col("__v")).drop("__v")


def shifted_dimension(df: DataFrame, dimension: DataFrame, day: str, value: str, shifts: list[int]) -> DataFrame:
    """``<value>_<k>``: the dimension's value ``k`` days after the row's day."""
    out = df
    for k in shifts:
        d = dimension.select(F.date_sub(quoted(day), k).alias("__day"), quoted(value).alias(f"{value}_{k}"))
        out = out.join(d, quoted(day) == F.col("__day"), "left").drop("__day")
    return out


def membership_audit(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """(part, n): distinct values in both tables, in the first only, in the second only."""
    both = a.select(quoted(col).alias("v")).distinct().withColumn("a", F.lit(1)).join(b.select(quoted(col).alias("v")).distinct().withColumn("b", F.lit(1)), "v", "full_outer")
    part = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "first").otherwise("second")
    return both.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


def count_ratio(df: DataFrame, keys: list[str], within: list[str], out: str) -> DataFrame:
    """``out``: rows of keys and ``within`` over rows of keys; with ``<out>_n`` the first count."""
    inner = df.groupBy(*map(quoted, [*keys, *within])).agg(F.count("*").alias(f"{out}_n"))
    outer = inner.groupBy(*map(quoted, keys)).agg(F.sum(f"{out}_n").alias("__all"))
    return inner.join(outer, keys).withColumn(out, F.col(f"{out}_n") / F.col("__all")).drop("__all")


def flag(test: Column) -> Column:
    """1 where the test holds, else 0; null counts as not."""
    return F.coalesce(test, F.lit(False)).cast("int")


def assemble(base: DataFrame, blocks: list[DataFrame], on: list[str]) -> DataFrame:
    """``base`` with the columns of feature blocks, joined by key; a block has a row a key at most."""
    for b in blocks:
        base = base.join(b, on, "left")
    return base
