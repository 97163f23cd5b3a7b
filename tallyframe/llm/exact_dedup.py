"""Exact deduplication by content hash, with a comparison of bytes.

Rows are grouped by the 128-bit hash of their normalised text. Inside a group the bytes decide: the first
aggregation groups by hash and text, so two different texts with one hash stay two classes, told apart by
their SHA-256. Copies meet in the partial aggregation of each task, so a group of any size sends at most
one row a task over the shuffle; the rows then find their class by a join of narrow rows, whose hot
partitions adaptive execution splits.

Null text counts as empty. A null id loses against any other id with as long a text; a class of null ids
only has a null ``keep_id``. Rows that share id and text are one document and get the same answer, so of
repeated rows, and of null ids in such a class, all have ``kept``. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, read


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[Column], Column] = F.md5) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Texts are equal when identical without ASCII white space. Of equal texts, the row with the most code
    points in its original text stays, then the one with the smallest id. ``hash_fn`` is there to test
    what happens when hashes collide.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = F.regexp_replace(text, SPACE + "+", "")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"), F.char_length(text).alias("cp"))
    sha = F.unhex(F.sha2("norm", 256)).alias("s")
    key = F.unhex(hash_fn(F.col("norm"))).alias("h")
    best = F.max(F.struct("cp", F.bitwise_not(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("low"), F.col("doc_id")))
    classes = base.groupBy(key, "norm").agg(best.alias("best"), F.count("*").alias("n")).select("h", sha, "best", "n")
    classes = classes.groupBy("h", "s").agg(F.max("best.doc_id").alias("keep_id"), F.max("n").alias("group_size"), F.count("*").alias("texts"))
    # two texts with one hash and one SHA-256 would be merged by the join below
    safe = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share both hashes"))).otherwise(F.col("group_size"))
    classes = cut(classes.select("h", "s", "keep_id", safe.alias("group_size")))
    rows = base.select("doc_id", key, sha)
    return rows.join(classes, ["h", "s"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
