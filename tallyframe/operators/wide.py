"""Fitting and applying tables of many categorical columns at once: a bounded number of jobs whatever their number.

All columns are grouped by (column, value) in one pass, with partial sums in the tasks that read them; codes are
numbered over the whole table, by ranges, less where their column starts. A table of bounded size is sent to the
tasks, which look up a batch's columns one after the other; a larger one is joined once by (column, value), and the
values come back to their rows by one aggregation. Values are told by their text; null is a value of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.mapping import clean, fetched, quoted
from ..core.order import kept, placed

#: Cells, and bytes, that a task groups at once.
CHUNK, BYTES = 1 << 22, 1 << 28


def unpivoted(df: DataFrame, cols: list[str], keep: dict[str, Column]) -> DataFrame:
    """(c, v, and ``keep``): a row for each row and column; c counts from 0 in ``cols``."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), clean(df, c).cast("string").alias("v")) for i, c in enumerate(cols)])
    return df.select(*[e.alias(n) for n, e in keep.items()], F.inline(cells)).select("c", "v", *keep)


def packed(values: list[Column]) -> Column:
    """The values, of one type, as an array; flattened it is all cells, row after row.

    Spark asks for the size of a batch for Python at every row, column by column, so many columns cost more than one
    that holds them. The higher-order function round the first value keeps it from making one method of all columns:
    the JVM doesn't compile those of over 8,000 bytes. Projections are only put together if none uses a column twice.
    """
    return F.array(F.get(F.transform(F.array(values[0]), lambda v: v), F.lit(0)), *values[1:])


def column_values(df: DataFrame, cols: list[str], aggs: dict[str, tuple[str, str]], using: dict[str, Column], text: bool = True) -> DataFrame:
    """(c, v, and ``aggs``: name to (min, sum or count, which of ``using``)) for every value of every column, in one pass.

    A task groups ``CHUNK`` cells column by column, so rows aren't multiplied by columns before they are summed.
    Without ``text`` the columns have one type, and so has v.
    """
    values = [clean(df, c).cast("string") if text else clean(df, c) for c in cols]
    rows = df.select(packed(values).alias("__cells"), *[e.alias(n) for n, e in using.items()])
    p, schema = len(cols), T.StructType([T.StructField("c", T.IntegerType()), T.StructField("v", rows.schema["__cells"].dataType.elementType)])
    for n, (how, x) in aggs.items():
        of = rows.schema[x].dataType
        schema = schema.add(n, of if how == "min" else T.LongType() if how == "count" or isinstance(of, T.IntegralType) else T.DoubleType())

    def grouped(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        told = pa.concat_arrays([x.column("__cells").flatten() for x in held]).dictionary_encode()
        at = pc.fill_null(told.indices, -1).to_numpy().reshape(-1, p)
        for i in range(p):
            part = table.drop_columns("__cells").append_column("__at", pa.array(np.ascontiguousarray(at[:, i])))
            part = part.group_by("__at", use_threads=False).aggregate([(x, how) for how, x in aggs.values()])
            k = part.column("__at").to_numpy()
            v = told.dictionary.take(pa.array(k, mask=k < 0))
            made = [pa.array([i] * part.num_rows, pa.int32()), v, *[part.column(f"{x}_{how}") for how, x in aggs.values()]]
            yield from pa.table(made, names=[f.name for f in schema]).combine_chunks().to_batches()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) * p >= CHUNK or sum(x.nbytes for x in held) >= BYTES:
                yield from grouped(held)
                held = []
        if held:
            yield from grouped(held)

    return rows.mapInArrow(partial, schema).groupBy("c", "v").agg(*[(F.min if how == "min" else F.sum)(n).alias(n) for n, (how, _) in aggs.items()])


def codes(table: DataFrame, by: list[str], out: str = "code", nulls: bool = False) -> DataFrame:
    """``table`` of (c, v, ...) with codes from 1 in each column, in the order of ``by``; null gets none but with ``nulls``."""
    some = kept(table) if nulls else kept(table.filter("v is not null"))
    at = placed(some, ["c", *by], "__p")
    first = at.groupBy(F.col("c").alias("__c")).agg(F.min("__p").alias("__start"))
    return at.join(F.broadcast(first), F.col("c") == F.col("__c")).withColumn(out, F.col("__p") - F.col("__start") + 1).drop("__p", "__c", "__start")  # a row a column


def looked_up(df: DataFrame, cols: list[str], table: DataFrame, value: str, unknown: float | int | None = None, most: int | None = None) -> DataFrame:
    """``df`` with each of ``cols`` replaced by the ``value`` that ``table`` (c, v, value) has for it, or ``unknown``.

    ``most`` is the number of rows up to which the table is sent to the tasks.
    """
    kind = table.schema[value].dataType
    schema = T.StructType([T.StructField(f.name, kind) if f.name in cols else f for f in df.schema])
    rows = fetched(table.select("c", "v", value), most)
    if rows is None:
        return _joined(df, cols, table, value, unknown, schema)
    known: list[tuple[list, list]] = [([], []) for _ in cols]
    for c, v, x in rows:
        known[c][0].append(v)
        known[c][1].append(x)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {c: (pa.array(v, pa.string()), pa.array([*x, unknown])) for c, (v, x) in zip(cols, known, strict=True)}
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts = columns["__cells"].flatten()
            for i, (c, (values, results)) in enumerate(tables.items()):
                at = pc.index_in(texts.take(pa.array(np.arange(i, len(texts), len(cols)))), values)
                columns[c] = results.take(pc.fill_null(at, len(values)))
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], [f.name for f in schema])

    texts = df.select(*[quoted(c) for c in df.columns if c not in cols], packed([clean(df, c).cast("string") for c in cols]).alias("__cells"))
    return texts.mapInArrow(replace, schema)


def _joined(df: DataFrame, cols: list[str], table: DataFrame, value: str, unknown: float | int | None, schema: T.StructType) -> DataFrame:
    rows = kept(df.withColumn("__row", F.monotonically_increasing_id()))
    cells = unpivoted(rows, cols, {"__row": F.col("__row")})
    other = table.select(F.col("c").alias("__c"), F.col("v").alias("__v"), F.col(value).alias("__x"), F.lit(True).alias("__known"))
    found = cells.join(other, (F.col("c") == F.col("__c")) & F.col("v").eqNullSafe(F.col("__v")), "left")
    kind = schema[cols[0]].dataType
    got = F.when(F.col("__known"), F.col("__x")).otherwise(F.lit(unknown).cast(kind))
    back = found.groupBy(F.col("__row").alias("__of")).agg(*[F.max(F.when(F.col("c") == i, got)).alias(f"__{i}") for i in range(len(cols))])
    both = rows.join(back, F.col("__row") == F.col("__of"))
    return both.select(*[F.col(f"__{cols.index(f.name)}").alias(f.name) if f.name in cols else quoted(f.name) for f in schema])


def ordinal(df: DataFrame, cols: list[str], order: str) -> DataFrame:
    """(c, v, code): codes by first appearance in ``order``, ties by value, of all columns."""
    first = column_values(df, cols, {"first": ("min", "o")}, {"o": quoted(order)})
    return codes(first, ["first", "v"]).select("c", "v", "code")


def means(df: DataFrame, cols: list[str], label: str, m: float = 1.0) -> DataFrame:
    """(c, v, value): means of the label drawn towards the overall one by ``m`` rows, of all columns."""
    y = quoted(label).cast("double")
    prior = df.agg(F.avg(y)).first()[0] or 0.0
    sums = column_values(df, cols, {"s": ("sum", "y"), "n": ("count", "y")}, {"y": y})
    return sums.select("c", "v", ((F.coalesce("s", F.lit(0.0)) + prior * m) / (F.col("n") + m)).alias("value"))
