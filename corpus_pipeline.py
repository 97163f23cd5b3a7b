"""A corpus pipeline: quality filter, near-duplicate removal, decontamination, mixing, sharding.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. Each stage's docstring says what it does with nulls and repeated rows; all take empty tables
and very long texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import cut, read, remove, shared_folder
from tallyframe.llm.decontaminate import decontaminate
from tallyframe.llm.jaccard_join import jaccard_components
from tallyframe.llm.mixing import Mix
from tallyframe.llm.quality import quality
from tallyframe.llm.sharding import shard

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model keeps.

    Documents without text go. A null id is never trusted, null is a language of its own, null sources and
    n_chars are kept. Rows are judged by id, text and language; equal rows stay or go together.
    """
    docs = docs.select(*COLUMNS)
    bad = quality(docs, read(spark, sf_dir, "labels")).filter(~F.col("kept")).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_text"), F.col("lang").alias("bad_lang")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_text")) & F.col("lang").eqNullSafe(F.col("bad_lang"))
    return docs.join(bad, same, "left_anti").select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts: that with the smallest id, null last, and then text hash.

    Rows are told apart by id and text, so that a row isn't lost for another text under its id. Of rows that
    share both, one stays, the least by language, source and n_chars (null first). Null and empty texts are
    like no other and all stay.
    """
    key = F.xxhash64("text")
    found = cut(jaccard_components(docs.select("doc_id", "text", key.alias("key")), keep=("key",))[0].filter("n_shingles > 0"))
    gone = found.filter("not is_first").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    left = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (key == F.col("gone_key")), "left_anti").select(*COLUMNS)
    again = cut(found.filter("is_first").groupBy(F.col("doc_id").alias("again_id"), F.col("key").alias("again_key")).count().filter("count > 1"))
    if not again.limit(1).count():
        return left
    same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (key == F.col("again_key"))
    once = left.join(again, same, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select("doc_id", "text", "rest.*")
    return left.join(again, same, "left_anti").unionByName(once).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item.

    Null and empty texts hold none and stay; null items and those of a few words match nothing. A null id is an
    id, nulls of other columns are kept. Rows are judged by id and text; equal rows stay or go together.
    """
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and pass over its source.

    Documents without words, null texts among them, go. A null source is a source of its own, last in order;
    null ids and languages are kept, equal rows count each, n_chars is that of the words taken.
    """
    return Mix(docs).documents(n_chars_col="n_chars").select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, checksum, shard and slot in it.

    A null text has no bytes (size 1), a null id is placed like any other; equal rows get slots of their own.
    """
    placed = shard(docs.select(*COLUMNS))
    return placed.select("row.*", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What stages hand on is written to the shared checkpoint folder, and deleted once the next stage is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{k}-{name}"
    return docs


#: None of the stages but the last few can be said in SQL; tests hold each against brute force.
ORACLE_SQL = None
