"""Places and quantiles in the order of a whole table, without sorting it in one task."""

from __future__ import annotations

import math
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mapping import fetched, quoted

#: Buckets of a large table's order, and rows up to which exact quantiles are one aggregation.
BUCKETS, ROWS = 256, 1_000_000
#: Rows of one key from which running sums are taken in two levels.
HOT = 1_000_000


def numbered(table: DataFrame, by: list[str], out: str, first: int = 1, most: int | None = None) -> tuple[DataFrame, bool]:
    """``table`` with ``out``, the place of each row in the order of ``by`` (nulls first), and whether it is small.

    A small table (see ``fetched``) is numbered on its way and becomes a local relation. A large one is numbered by
    ranges of the order (see ``placed``), with 64-bit places where 32 bits don't hold them.
    """
    rows = fetched(table.orderBy(*by), most)
    spark, schema = table.sparkSession, T.StructType([*table.schema, T.StructField(out, T.IntegerType())])
    if rows is not None:
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows, first)], schema), True
    at = placed(table, by, "__place")
    n = at.agg(F.max("__place")).first()[0] or 0
    return at.withColumn(out, (F.col("__place") + first).cast("int" if n + first < 1 << 31 else "long")).drop("__place"), False


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and cut from its plan.

    The folder is ``spark.checkpoint.dir`` or what ``setCheckpointDir`` has set. A local session with neither gets
    one under ``spark.local.dir``; a cluster is refused, as its executors don't see the driver's folders.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.local.dir', '/tmp')}/checkpoint-{uuid.uuid4().hex}")
    return df.checkpoint()


def placed(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, the place from 0 of each row in the order of ``by`` (nulls first) over the whole table.

    Rows are dealt to ranges of the order and sorted there; the sizes of the ranges, a row each, are added up. Rows
    equal in the order are split over ranges too, so no range is larger for them. The places are kept, as another
    run would deal ties otherwise.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*map(quoted, by), F.col("__tie")]
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__tie")
    dealt = kept(dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")))
    sizes = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}  # a row a range
    ends = dict(zip(sorted(sizes), accumulate(sizes[p] for p in sorted(sizes)), strict=True))
    starts = spark.createDataFrame([(p, ends[p] - n) for p, n in sizes.items()], "__of int, __before long")
    return dealt.join(F.broadcast(starts), F.col("__part") == F.col("__of")).withColumn(out, F.col("__before") + F.col("__at")).drop("__part", "__of", "__before", "__at")


def summed_before(table: DataFrame, place: str, value: Column, out: str, bucket: int = 1 << 20) -> DataFrame:
    """``table`` with the sum of ``value`` over the rows of lower ``place`` (dense, from 0), in two levels."""
    t = table.withColumn("__b", F.floor(F.col(place) / bucket)).withColumn("__v", value)
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = t.groupBy("__b").agg(F.sum("__v").alias("__s"))
    starts = starts.select(F.col("__b").alias("__c"), F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s"))
    inside = Window.partitionBy("__b").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    both = t.join(starts, F.col("__b") == F.col("__c"))
    return both.withColumn(out, F.col("__s") + F.coalesce(F.sum("__v").over(inside), F.lit(0))).drop("__b", "__c", "__s", "__v")


def order_statistics(df: DataFrame, x: Column, places: list[int], rows: int = ROWS) -> list[float]:
    """The values at ``places`` (from 0) of the sorted column, which has no nulls; each round narrows where they are."""
    if not places:
        return []
    values = df.select(x.cast("double").alias("x"))
    n = values.count()
    near = values.agg(F.percentile_approx("x", F.array(*[F.lit(min(1.0, max(0.0, (p + s * 4 * n / 10_000) / max(n, 1)))) for p in places for s in (-1, 1)]), 10_000).alias("e")).first()["e"]
    out = []
    for k, p in enumerate(places):
        low, high = near[2 * k], near[2 * k + 1]
        r = values.agg(F.sum((F.col("x") < low).cast("long")).alias("below"), F.sum(F.col("x").between(low, high).cast("long")).alias("inside")).first()
        if not r["below"] <= p < r["below"] + r["inside"]:  # the sketch was further off than it says
            low, high, r = -math.inf, math.inf, {"below": 0, "inside": n}
        if low == high:
            out.append(low)
            continue
        inside = values.filter(F.col("x").between(low, high)).groupBy("x").count()
        counts = inside.orderBy("x").limit(rows + 1).collect()
        if len(counts) > rows and r["inside"] < n:
            out += order_statistics(values.filter(F.col("x").between(low, high)), F.col("x"), [p - r["below"]], rows)
            continue
        at = r["below"]
        for c in counts:
            at += c["count"]
            if at > p:
                out.append(c["x"])
                break
    return out


def quantiles(df: DataFrame, x: Column, shares: list[float], rows: int = ROWS) -> list[float] | None:
    """Exact quantiles by linear interpolation, nulls left out; None without values.

    Up to ``rows`` values these are one aggregation, whose state holds each distinct value; for more, the values
    next to a quantile's place are looked for among those that a sketch puts there.
    """
    some = df.select(x.cast("double").alias("x")).filter("x is not null")
    n = some.count()
    if n <= rows:
        return some.agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).first()["q"] if n else None
    at = [s * (n - 1) for s in shares]
    places = sorted({p for a in at for p in (math.floor(a), math.ceil(a))})
    value = dict(zip(places, order_statistics(some, F.col("x"), places, rows), strict=True))
    return [value[math.floor(a)] + (a - math.floor(a)) * (value[math.ceil(a)] - value[math.floor(a)]) for a in at]


def sums_before(df: DataFrame, key: Column, order: str, values: dict[str, Column], largest: int, hot: int | None = None) -> DataFrame:
    """``df`` with sums of ``values`` over the key's rows before each row in ``order``, 0 where there are none.

    A key's rows meet in one task, unless ``largest``, the most rows of a key, is over ``hot`` (``HOT``) and the
    order is a number or a time: then they are dealt to buckets of the order, summed inside each, and the sums of
    the buckets before are joined to them. Rows of equal place are in any order.
    """
    kind = df.schema[order].dataType
    at = F.col(f"`{order}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        at = F.unix_micros(at.cast("timestamp"))
    keyed = df.withColumn("__k", key).withColumns({f"__v{i}": v.cast("double") for i, v in enumerate(values.values())})
    names = {f"__v{i}": n for i, n in enumerate(values)}
    if largest <= (HOT if hot is None else hot) or not isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        before = Window.partitionBy("__k").orderBy(F.col(f"`{order}`")).rowsBetween(Window.unboundedPreceding, -1)
        return keyed.withColumns({n: F.coalesce(F.sum(v).over(before), F.lit(0.0)) for v, n in names.items()}).drop("__k", *names)
    edges = df.agg(F.percentile_approx(at.cast("double"), F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), 10_000).alias("e")).first()["e"] or []
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e < at.cast("double")))
    keyed = keyed.withColumn("__b", bucket)
    earlier = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("__k", "__b").agg(*[F.sum(v).alias(v) for v in names])
    starts = sums.select(F.col("__k").alias("__k2"), F.col("__b").alias("__b2"), *[F.coalesce(F.sum(v).over(earlier), F.lit(0.0)).alias(f"{v}s") for v in names])
    inside = Window.partitionBy("__k", "__b").orderBy(F.col(f"`{order}`")).rowsBetween(Window.unboundedPreceding, -1)
    both = keyed.join(starts, F.col("__k").eqNullSafe(F.col("__k2")) & (F.col("__b") == F.col("__b2")))
    both = both.withColumns({n: F.col(f"{v}s") + F.coalesce(F.sum(v).over(inside), F.lit(0.0)) for v, n in names.items()})
    return both.drop("__k", "__b", "__k2", "__b2", *names, *[f"{v}s" for v in names])
