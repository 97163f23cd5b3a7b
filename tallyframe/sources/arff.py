"""ARFF files through Spark's text source, and the rule that makes a binary task of a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.mapping import clean, quoted

#: Names of target columns, the first one that a table has counts; else its last column is the target.
TARGETS = ("class", "Class", "type", "TYPE", "Type", "symboling", "OVERALL_DIAGNOSIS", "LRS-class", "num", "Class_attribute", "Contraceptive_method_used", "surgical_lesion", "band_type", "Survival_status", "surgical lesion", "decision", "ACTION")
NUMERIC = ("numeric", "real", "integer")
#: Lines of the header that are looked at.
HEADER = 100_000


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an ARFF file: numeric attributes as doubles, others as strings; ``?`` is null.

    The header's attributes come to the driver, the data lines are parsed by Spark's CSV reader in the tasks.
    Values may be quoted with ``'``. Sparse rows aren't read.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line != '' AND NOT line LIKE '\\%%'")
    head = lines.filter(F.lower("line").startswith("@attribute")).limit(HEADER + 1).collect()
    if len(head) > HEADER:
        raise ValueError(f"over {HEADER} attributes")
    fields = []
    for r in head:
        m = re.match(r"@attribute\s+('(?:[^'\\]|\\.)*'|\"[^\"]*\"|\S+)\s+(.*)", r["line"], re.IGNORECASE)
        if not m:
            raise ValueError(f"no attribute: {r['line']}")
        fields.append((m[1].strip("'\""), m[2].strip().lower() in NUMERIC))
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(fields))])
    rows = lines.filter(~F.col("line").startswith("@")).select(F.from_csv("line", schema.simpleString()[7:-1].replace(":", " "), {"quote": "'", "escape": "\\", "nullValue": "?", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    return rows.select(*[F.col(f"r._{i}").cast("double" if number else "string").alias(name) for i, (name, number) in enumerate(fields)])


def target_column(columns: list[str], names: tuple[str, ...] = TARGETS) -> str:
    return next((n for n in names if n in columns), columns[-1])


def binary_task(df: DataFrame, target: str | None = None, most_folds: int = 10) -> tuple[DataFrame, str, int]:
    """(table, target, folds): rows without a target go, the most frequent class (of equal ones the least) is 1, the others 0.

    Text columns whose values are all numbers become doubles; that is one aggregation for all of them. ``folds`` is how
    many stratified folds the rarer side allows.
    """
    target = target or target_column(df.columns)
    some = df.filter(clean(df, target).isNotNull())
    classes = some.groupBy(quoted(target).alias("y")).agg(F.count("*").alias("n"))
    top = classes.orderBy(F.desc("n"), "y").first()
    if top is None:
        raise ValueError("no row has a target")
    total = classes.agg(F.sum("n")).first()[0]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != target]
    odd = some.agg(*[F.count_if(quoted(c).isNotNull() & F.expr(f"try_cast(`{c.replace('`', '``')}` AS double)").isNull()).alias(f"{i}") for i, c in enumerate(texts)]).first() if texts else {}
    numbers = {c: quoted(c).cast("double") for i, c in enumerate(texts) if not odd[f"{i}"]}
    out = some.withColumns({**numbers, target: (quoted(target) == F.lit(top["y"])).cast("int")})
    return out, target, min(top["n"], total - top["n"], most_folds)
