"""Importance resampling towards a target corpus, by packed streams of hashed features.

Features are the runs of 1 to 2 words, hashed to ``BUCKETS`` buckets. A first pass packs each run of documents to
one row: a stream of uint16 buckets and the documents' offsets in it, written to the shared folder. Counts come
from the sorted streams, run-length encoded; tasks add them up, so a task sends one row a bucket. The gain of a
bucket, the scaled logarithm of its smoothed share in the target over that in the corpus, goes back to the
tasks, which gather the gains along the streams and add them up by document with ``np.add.reduceat``.

The draw is without replacement: the largest sums of weight and seeded Gumbel noise. Scores are whole numbers of
a few ten thousand different values, so the cut is found from their counts, and only the drawn rows (and those
tied with the last) are sorted, by ranges.

Null and empty texts have no features, weight 0. A null id hashes as an empty one and comes last among ties;
equal rows are drawn each for itself. Columns other than the two named aren't read. An empty corpus gives no rows;
an empty target has no counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read
from .words import buffers, chunks

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Bytes of text whose features are packed to one row.
PACK = 1 << 16
#: Bytes of a word up to which checksums are taken of all words at once.
SHORT = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):  # the reflected polynomial of CRC-32
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1).astype(np.uint32)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the texts' bounds in words (one more than texts); no word crosses texts."""
    own = np.zeros(len(data) + 2, bool)
    own[1:-1] = _WORD[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    start, end = own[1:-1] & ~own[:-2], own[1:-1] & ~own[2:]
    start[edge] |= own[1:-1][edge]
    end[edge - 1] |= own[1:-1][edge - 1]
    first = np.flatnonzero(start)
    return first, np.flatnonzero(end) + 1, np.searchsorted(first, offsets)


def checksums(data: np.ndarray, first: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes of each word, from the given states."""
    size, out = end - first, state.copy()
    short = np.flatnonzero(size <= SHORT)
    order = short[np.argsort(-size[short], kind="stable")]
    active = np.searchsorted(-size[order], -np.arange(1, SHORT + 1), "right")
    c, at = out[order], first[order]
    for j in range(SHORT):
        n = active[j]
        if not n:
            break
        c[:n] = _TABLE[(c[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[order] = c
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(data[first[i] : end[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def stream(data: np.ndarray, offsets: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of texts one after the other, and each text's words; a word's bucket, then that of it and the next."""
    data = _LOWER[data]
    first, end, bounds = word_bounds(data, offsets)
    words = np.diff(bounds)
    fresh = np.full(len(first), 0xFFFFFFFF, np.uint32)
    one = checksums(data, first, end, fresh)
    pair = np.ones(len(first), bool)
    pair[bounds[1:][words > 0] - 1] = False
    a = np.flatnonzero(pair)
    spaced = _TABLE[(one[a] ^ np.uint32(0x20)) & np.uint32(255)] ^ (one[a] >> np.uint32(8))
    two = checksums(data, first[a + 1], end[a + 1], spaced)
    size = np.maximum(2 * words - 1, 0)
    base = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint16)
    place = 2 * (np.arange(len(first)) - np.repeat(bounds[:-1], words)) + np.repeat(base, words)
    out[place] = ~one % np.uint32(n_buckets)
    out[place[a] + 1] = ~two % np.uint32(n_buckets)
    return out, words


def run_lengths(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a stream in order, and how often each is there."""
    ordered = np.sort(buckets)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
    return ordered[at], np.diff(np.append(at, len(ordered)))


def streams(docs: DataFrame, id_col: str, text_col: str, n_buckets: int) -> DataFrame:
    """(ids, nulls, words, buckets): packed rows of some documents each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nulls = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.asarray(batch.column(0).is_null())
            for a, b, data, offsets in chunks(batch.column(1), PACK):
                buckets, words = stream(data, offsets, n_buckets)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids[a:b], nulls[a:b], words, buckets)], ["ids", "nulls", "words", "buckets"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(pack, "ids binary, nulls binary, words binary, buckets binary")


def bucket_counts(packed: DataFrame, n_buckets: int) -> np.ndarray:
    """How often each bucket is in the streams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            bucket, n = run_lengths(np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint16))
            total[bucket] += n
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(total[bucket])], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for r in packed.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the source, both with one more a bucket."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + float(n)) / ((s + 1.0) * (t_all + float(n))))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """floor(1000 times) a Gumbel variate told by the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, words, n_features, weight), a row for each row of ``docs``; the weight is the floored mean gain."""
    if not 0 < n_buckets <= 1 << 16:
        raise ValueError("a bucket has to fit in 16 bits")
    packed = cut(streams(docs, id_col, text_col, n_buckets))
    gain = gains(bucket_counts(packed, n_buckets), bucket_counts(streams(target.withColumn("__id", F.lit(0)), "__id", "text", n_buckets), n_buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, own = np.frombuffer(r["words"], np.int64), gain[np.frombuffer(r["buckets"], np.uint16)]
                n = np.maximum(2 * words - 1, 0)
                some, weight = np.flatnonzero(n), np.zeros(len(n), np.int64)
                if len(some):
                    weight[some] = np.add.reduceat(own, (np.cumsum(n) - n)[some]) // n[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["ids"], np.int64), mask=np.frombuffer(r["nulls"], bool)), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "words", "n_features", "weight"])

    return packed.mapInArrow(weigh, "doc_id long, words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of ``docs``.

    Of those with ``least_words`` words, ``share`` in a hundred are drawn: the highest scores, ties to the smaller
    id. ``rank`` counts from 1 and is null for the rest.
    """
    spark = docs.sparkSession
    scored = weights(docs, target, id_col, text_col, n_buckets)
    scored = cut(scored.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")))
    able = F.col("words") >= least_words
    counts = sorted(((r["score"], r["count"]) for r in scored.filter(able).groupBy("score").count().collect()), reverse=True)  # whole numbers in a small range
    wanted, seen, edge = share * sum(n for _, n in counts) // 100, 0, None
    for s, n in counts:
        if seen >= wanted:
            break
        seen, edge = seen + n, s
    cols = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if edge is None:
        return scored.select(*cols, none)
    near = able & (F.col("score") >= edge)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranged = scored.filter(near).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(ranged.select(*cols, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a row a partition
    before = [(p, sum(n for q, n in sizes.items() if q < p)) for p in sizes]
    starts = spark.createDataFrame(before, "part int, before long")
    rank = F.col("before") + F.col("at") + 1
    drawn = placed.join(F.broadcast(starts), "part").select(*cols, F.when(rank <= wanted, rank).alias("rank"))
    return drawn.unionByName(scored.filter(~near).select(*cols, none))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS t(n))
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, false AS target, text FROM documents UNION ALL SELECT NULL, NULL, true, text FROM benchmark
), words AS MATERIALIZED (
  SELECT r, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), f AS MATERIALIZED (
  SELECT r, target, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), kinds AS (
  SELECT f, list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT f FROM f)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM kinds, crc
), own AS MATERIALIZED (
  SELECT r, target, bucket FROM f JOIN hashed USING (f)
), n AS (
  SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM own GROUP BY bucket
), total AS (
  SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM n
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS gain FROM n, total
), weighed AS (
  SELECT r, count(*) AS n_features, sum(gain) AS g FROM own JOIN gain USING (bucket) WHERE NOT target GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce((g - ((g % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM words LEFT JOIN weighed USING (r) WHERE NOT target
), final AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
), drawn AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (words >= 20) OVER () AS able FROM final
)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM drawn
"""
