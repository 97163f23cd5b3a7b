"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    That is ``spark.checkpoint.dir`` or what ``setCheckpointDir`` has set. With neither, a session whose
    executors are in the driver's own process (``local[n]``) gets a folder under ``spark.local.dir``; any other
    one is refused, as its executors don't see the driver's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.local.dir', '/tmp')}/checkpoint-{uuid.uuid4().hex}")
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files and checkpoints that nothing refers to any more.

    It learns of them only when the driver's heap is collected, which a driver that holds little does seldom; Python
    lets go of its plans first.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``edges``; the root is the smallest node of the component.

    Alternates hooking a root to the smallest root next to it with pointer jumping, so the number of
    rounds grows with the logarithm of the longest chain. Each round is a few shuffles by node with
    partial aggregation; a node with very many edges is pre-aggregated before it is shuffled. Every
    round is checkpointed. No edge list or label reaches the driver, which only reads whether a round
    changed something.
    """
    links = cut(
        edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .union(edges.select(F.col(b).alias("x"), F.col(a).alias("y")))
        .distinct()
    )
    labels = cut(links.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = (
            links.join(labels.select(F.col("node").alias("y"), F.col("root").alias("ry")), "y")
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("ry").alias("ry"))
        )
        # the smallest root next to any node of a tree becomes the parent of that tree's root
        hooks = labels.join(near, "node").groupBy("root").agg(F.min("ry").alias("ry"))
        parents = labels.join(hooks, "root").select("node", "root", F.least("root", "ry").alias("up"))
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
        after = cut(parents.join(above, "up").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
        if not after.filter("moved").limit(1).count():
            return after.select("node", "root")
        labels = after.select("node", "root")
