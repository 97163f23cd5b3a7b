"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of ``ring`` positions; a row's id hashes to a position and
belongs to the first shard clockwise. Rows arrive in ``steps`` waves (a hash of id and text decides which),
inside a wave by position, inside a position by a hash. A row that finds its shard full continues clockwise
to the next one with room. Who is full when depends only on how many rows each (wave, position) has, so
Spark counts those cells, the driver walks over at most ``steps * ring`` counts whatever the input's size,
and the resulting segments (a cell, a range of ranks in it, a shard, a first slot) are joined back. The
segment table is broadcast; it has at most ``steps * ring + n_shards`` rows.

Waves spread the rows of one hot id over ``steps`` tasks. Rows that share id and text share a cell; where one
has over ``HOT`` rows and ``TIMES`` times the mean, its rows are cut into ``PARTS`` cells by a hash of all they hold,
equal ones dealt on from there, so another layout of the files gives the same placement. Nulls: a null id is a key like any other, a null text has no bytes. Rows
equal in everything are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core.order import placed
from .common import cut, read

#: Production parameters: points of the ring, points of a shard on it, waves.
RING, VNODES, STEPS = 4096, 64, 64
#: When a cell is cut, by rows and by times the mean, and into how many parts: at most RING * STEPS * PARTS / TIMES more cells.
HOT, TIMES, PARTS = 65_536, 64, 64


def ring_owners(n_shards: int, vnodes: int = VNODES, ring: int = RING) -> list[int]:
    """The shard that owns each position: that of the next virtual node clockwise.

    A virtual node's place depends on its shard and number only, so more shards move no node.
    """
    points = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") * ring / 2**64, s)
        for s in range(n_shards)
        for v in range(vnodes)
    )
    places = [p for p, _ in points]
    return [points[bisect_left(places, r) % len(points)][1] for r in range(ring)]


def capacities(total: int, n_shards: int, epsilon: float) -> list[int]:
    """Most rows of each shard. At epsilon 0 they add up to ``total`` and are at most one apart."""
    if epsilon:
        return [math.ceil((1 + epsilon) * total / n_shards)] * n_shards
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def place(cells: np.ndarray, owners: list[int], caps: list[int]) -> np.ndarray:
    """Segments (wave, position, part, first rank, end rank, shard, first slot) of cells (wave, position, part, rows), in order."""
    load = [0] * len(caps)
    open_ = [c > 0 for c in caps]

    def forward() -> list[int]:
        out, at = [-1] * len(owners), -1
        for r in [*range(len(owners) - 1, -1, -1)] * 2:  # twice, as the ring is closed
            at = owners[r] if open_[owners[r]] else at
            out[r] = at
        return out

    now = forward()
    segments = np.zeros((len(cells) + len(caps), 7), np.int64)
    n = 0
    for step, pos, part, rows in cells:
        rank = 0
        while rank < rows:
            s = now[pos]
            take = min(int(rows) - rank, caps[s] - load[s])
            segments[n] = step, pos, part, rank, rank + take, s, load[s]
            n += 1
            load[s] += take
            rank += take
            if load[s] == caps[s]:
                open_[s] = False
                now = forward()
    return segments[:n]


def shard(docs: DataFrame, n_shards: int = 16, epsilon: float = 0.0, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES, ring: int = RING, steps: int = STEPS, keep: list[str] | None = None, hot: int = HOT, times: int = TIMES) -> DataFrame:
    """All rows and columns (or those of ``keep``) of ``docs``, as struct ``row``, with size, text_crc32, shard and slot.

    ``epsilon`` is how far over the mean a shard may be filled; at 0 the shards' row counts are at most
    one apart. ``size`` is the text's UTF-8 bytes plus 1; slots count from 0 in each shard without gaps.
    """
    spark = docs.sparkSession
    text, key = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(key, F.lit("place")), F.lit(ring)).alias("pos"),
        F.pmod(F.xxhash64(key, text, F.lit("wave")), F.lit(steps)).alias("step"),
        F.xxhash64(key, text, F.lit("turn")).alias("turn"),
    )
    cells = _counted(keyed.withColumn("part", F.lit(0).cast("long")))
    large = cells[cells[:, 3] > max(hot, times * cells[:, 3].mean() if len(cells) else 0)] if len(cells) else cells
    if len(large):
        where = [F.lit(int(step * ring + pos)) for step, pos, _, _ in large]
        hot_cell = (F.col("step") * ring + F.col("pos")).isin(*where)
        # a row's part follows from what it holds; equal rows, which are interchangeable, are dealt on from there
        own = placed(keyed.filter(hot_cell).withColumn("all", F.xxhash64("row", "turn", "text_crc32", "size")), ["all"], "place")
        first = own.groupBy(F.col("all").alias("of_all")).agg(F.min("place").alias("first_place"))
        own = own.join(first, F.col("all") == F.col("of_all")).withColumn("part", F.pmod(F.col("place") - F.col("first_place") + F.pmod("all", F.lit(PARTS)), F.lit(PARTS)))
        keyed = cut(keyed.filter(~hot_cell).withColumn("part", F.lit(0).cast("long")).unionByName(own.select(*keyed.columns, "part")))
        cells = _counted(keyed)
    else:
        keyed = keyed.withColumn("part", F.lit(0).cast("long"))
    segments = place(cells, ring_owners(n_shards, vnodes, ring), capacities(int(cells[:, 3].sum()), n_shards, epsilon))
    names = ("of_step", "of_pos", "of_part", "first", "end", "shard", "first_slot")
    table = spark.createDataFrame(pa.table({n: segments[:, k] for k, n in enumerate(names)})).withColumn("shard", F.col("shard").cast("int"))
    turn = Window.partitionBy("step", "pos", "part").orderBy("turn", "text_crc32", "size", F.xxhash64("row"))
    ranked = keyed.withColumn("rank", (F.row_number().over(turn) - 1).cast("long"))
    own = (F.col("step") == F.col("of_step")) & (F.col("pos") == F.col("of_pos")) & (F.col("part") == F.col("of_part")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    return ranked.join(F.broadcast(table), own).select("row", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("first")).alias("slot"))


def _counted(keyed: DataFrame) -> np.ndarray:
    """(wave, position, part, rows) of each cell, in order."""
    counted = keyed.groupBy("step", "pos", "part").count().toArrow()
    cells = np.column_stack([counted.column(c).to_numpy() for c in ("step", "pos", "part", "count")]).astype(np.int64).reshape(-1, 4)
    return cells[np.lexsort((cells[:, 2], cells[:, 1], cells[:, 0]))]


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shard(docs, keep=["doc_id"])
    return placed.select(
        F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
