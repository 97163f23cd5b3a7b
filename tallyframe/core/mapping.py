"""Column resolution, null policy, and category tables that transforms join with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of their text, up to which a category table is gathered and broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20

POLICIES = ("value", "return_nan", "error", "indicator")


def categorical_columns(df: DataFrame, cols: list[str] | None, booleans: bool = False) -> list[str]:
    """``cols`` if given, else the string columns (and booleans on request)."""
    if cols is not None:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        return list(cols)
    kinds = (T.StringType, T.BooleanType) if booleans else (T.StringType,)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    c = quoted(name)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c


def fetched(table: DataFrame, most: int | None = None) -> list[Row] | None:
    """The rows of a small table, in its order; None if it has over ``BROADCAST_ROWS`` rows or ``BROADCAST_BYTES`` of text.

    One job: the rows are packed where they are counted, and come to the driver only if they are few.
    """
    most = BROADCAST_ROWS if most is None else most
    size = F.lit(64)
    for f in table.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(quoted(f.name)), F.lit(0))
    some = table.limit(most + 1)
    packed = some.agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.collect_list(F.struct(*map(quoted, table.columns))).alias("rows"))
    few = (F.col("n") <= most) & (F.coalesce("bytes", F.lit(0)) <= 64 * most + BROADCAST_BYTES)
    return packed.select(F.when(few, F.col("rows")).alias("rows")).first()["rows"]


def settle(table: DataFrame) -> tuple[DataFrame, bool]:
    """A category table computed once, and whether it is small enough to be broadcast.

    A small table becomes a local relation. A larger one is kept in the shared checkpoint folder where there is
    one, else it is computed again by each use.
    """
    spark, rows = table.sparkSession, fetched(table)
    if rows is not None:
        return spark.createDataFrame(rows, table.schema), True
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return table.checkpoint(), False
    return table, False


def look_up(df: DataFrame, key: Column, table: DataFrame, small: bool, values: list[str]) -> DataFrame:
    """``df`` with ``values`` of the row of ``table`` (key column ``cat``) whose category is ``key``; null matches null."""
    renamed = table.select(F.col("cat").alias("__cat"), *values)
    out = df.withColumn("__key", key)
    return out.join(F.broadcast(renamed) if small else renamed, F.col("__key").eqNullSafe(F.col("__cat")), "left").drop("__key", "__cat")


def check_no_nulls(df: DataFrame, cols: list[str], when: str) -> None:
    some = None
    for c in cols:
        isnull = clean(df, c).isNull()
        some = isnull if some is None else some | isnull
    if some is not None and df.filter(some).limit(1).count():
        raise ValueError(f"columns to be encoded have nulls at {when}")
