"""Mixing sources to target weights, with DataFrame functions only.

Each source's words are packed, document after document, into blocks of ``block`` words (the last may be
shorter). The mix has as many slots as the targets need blocks. Output shards of ``shard`` slots draw how
many slots each source gets from a multinomial law: a slot's source is that in whose stretch of [0, slots)
a hash of the slot falls. Sources drawn too often for their target hand their last slots to those drawn too
seldom, so every source has exactly the slots it needs. A source's slots run through its blocks epoch by
epoch, each epoch in the order of its own pseudorandom permutation (swap-or-not, a bijection on any range),
and slot and block are joined by the block's index. The last slot of a source takes only the words that
are still wanted of its block.

Words are numbered by two levels of prefix sums, inside a hash bucket of a source and over the buckets, so no
task sorts a whole source. There are ``BUCKETS`` or more, at most about ``PER_BUCKET`` documents each. Tables of one row a source, or a source and bucket or
output shard, are the only ones summed over.

Null texts and texts without words have size 0 and nothing is taken of them; a null source is a source of
its own, last in order. Rows that are equal in all columns read are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, read, word_count

#: Production parameters.
BLOCK, SHARD, WEIGHTS, MOST, SEED = 128, 4096, (5, 2, 1), 3, 17
CELLS, ROUNDS = 4096, 16
#: Fewest hash buckets of a source, and documents for each bucket.
BUCKETS, PER_BUCKET = 1024, 16_384


def _swap_or_not(x: Column, n: Column, key: Column, rounds: Column) -> Column:
    def one(x: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(key, r), n) - x
        other = F.when(other < 0, other + n).otherwise(other)
        return F.when(F.xxhash64(key, r, F.greatest(x, other)) % 2 == 0, x).otherwise(other)

    return F.aggregate(rounds, x, one)


def permute(x: Column, n: Column, key: Column) -> Column:
    """Image of ``x`` under a pseudorandom permutation of [0, n) that ``key`` names."""
    return _swap_or_not(x, n, key, F.sequence(F.lit(1), F.lit(ROUNDS)))


def permute_back(x: Column, n: Column, key: Column) -> Column:
    """Inverse of ``permute``: each round is its own inverse."""
    return _swap_or_not(x, n, key, F.sequence(F.lit(ROUNDS), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(sid, source, source_size, target) from (source, source_size), a row a source.

    Sources in code point order, null last, weigh ``weights``, repeating, and share the sum of all sizes;
    none gets over ``most`` times its size, and what it leaves is shared by the others by weight. With the
    sources in order of size over weight, those up to some point get their most and the rest a common
    multiple of their weights.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("sid", (F.row_number().over(order) - 1).cast("long")).withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    every, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest_words = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest_weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    t = t.withColumn("level", rest_words / rest_weight).withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    # past that point the running level only falls
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return t.select("sid", "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("w") * level)).alias("target"))


class Mix:
    """A mix of ``docs``: ``sources``, ``placed`` (documents on their source's line of words), ``slots``."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard: int = SHARD, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.block, self.shard, self.seed = block, shard, seed
        self.spark = docs.sparkSession
        text = F.col(text_col).cast("string")
        buckets = max(BUCKETS, 1 << (docs.count() // PER_BUCKET).bit_length())
        self.rows = docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(text).alias("size"),
            F.xxhash64(text).alias("tie"),
        ).withColumn("bucket", F.pmod(F.xxhash64("id", "tie"), F.lit(buckets)).cast("int"))
        buckets = cut(self.rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
        sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
        want = targets(sizes, weights, most).withColumn("want", F.least(F.floor(F.col("target") + 0.5), most * F.col("source_size")))
        self.sources = cut(self._slots_needed(want))
        earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = buckets.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).withColumnRenamed("source", "bsource").drop("words")
        own = self.sources.select(F.col("source").alias("ssource"), "sid", "source_size", "target")
        self.starts = starts.join(own, F.col("bsource").eqNullSafe(F.col("ssource"))).drop("ssource").withColumnRenamed("bucket", "bbucket")

    def _slots_needed(self, want: DataFrame) -> DataFrame:
        """Adds blocks, short (words of the last block), epochs (whole ones), rest (words wanted of the last epoch), rest_slots, n_slots."""
        L, size = F.lit(self.block), F.col("source_size")
        t = want.withColumn("blocks", F.ceil(size / L)).withColumn("short", size - (F.col("blocks") - 1) * L)
        t = t.withColumn("epochs", F.coalesce(F.try_divide(F.col("want") - F.col("want") % F.nullif(size, F.lit(0)), size), F.lit(0)).cast("long"))
        t = t.withColumn("rest", F.col("want") - F.col("epochs") * size)
        t = t.withColumn("short_at", F.when(F.col("blocks") > 0, permute_back(F.col("blocks") - 1, F.col("blocks"), self._key("epochs"))))
        k = F.ceil(F.col("rest") / L)
        late = F.ceil((F.col("rest") + L - F.col("short")) / L)
        t = t.withColumn("rest_slots", F.when(F.col("rest") == 0, 0).when(F.col("short_at") < k, late).otherwise(k).cast("long"))
        return t.withColumn("n_slots", F.col("epochs") * F.col("blocks") + F.col("rest_slots"))

    def _key(self, epoch: str) -> Column:
        return F.xxhash64(F.lit(self.seed), F.col("sid"), F.col(epoch))

    @property
    def placed(self) -> DataFrame:
        """The rows with sid, source_size, target, start (their first word on the source's line) and rn; (sid, bucket, rn) names a row."""
        r, s = self.rows, self.starts
        joined = r.join(s, r["source"].eqNullSafe(s["bsource"]) & (r["bucket"] == s["bbucket"])).drop("bsource", "bbucket")
        turn = Window.partitionBy("sid", "bucket").orderBy("id", "tie", "size")
        before = turn.rowsBetween(Window.unboundedPreceding, -1)
        return joined.withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("rn", F.row_number().over(turn)).drop("offset")

    @property
    def slots(self) -> DataFrame:
        """(slot, shard, sid, turn, epoch, block, words): what each output slot holds; turn is its rank in the source."""
        src = self.sources
        n = src.agg(F.sum("n_slots")).first()[0] or 0
        if not n:
            return self.spark.createDataFrame([], "slot long, shard long, sid long, turn long, epoch long, block long, words long, full boolean")
        cell = F.lit(max(1, -(-n // CELLS)))
        upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
        stretch = src.filter("n_slots > 0").select("sid", "n_slots", F.coalesce(F.sum("n_slots").over(upto), F.lit(0)).alias("low"))
        stretch = stretch.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("low") + F.col("n_slots") - 1) / cell))))
        draws = self.spark.range(n).select(
            F.col("id").alias("slot"), F.floor(F.col("id") / self.shard).alias("shard"), F.pmod(F.xxhash64(F.lit(self.seed), "id"), F.lit(n)).alias("u")
        ).withColumn("cell", F.floor(F.col("u") / cell))
        drawn = draws.join(stretch, "cell").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("low") + F.col("n_slots"))).select("slot", "shard", "sid")
        counts = cut(drawn.groupBy("shard", "sid").agg(F.count("*").alias("n")))
        earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        first = counts.select("shard", "sid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
        inside = Window.partitionBy("shard", "sid").orderBy("slot")
        ranked = drawn.withColumn("k", F.row_number().over(inside) - 1).join(first, ["shard", "sid"]).select("slot", "shard", "sid", (F.col("first") + F.col("k")).alias("turn"))
        # slots drawn beyond a source's need, in order, go to the sources that still need some, in order
        gap = src.join(counts.groupBy("sid").agg(F.sum("n").alias("drawn")), "sid", "left").select("sid", "n_slots", F.coalesce("drawn", F.lit(0)).alias("drawn"))
        over, under = F.greatest(F.col("drawn") - F.col("n_slots"), F.lit(0)), F.greatest(F.col("n_slots") - F.col("drawn"), F.lit(0))
        gap = cut(gap.select("sid", "n_slots", "drawn", F.coalesce(F.sum(over).over(upto), F.lit(0)).alias("over_at"), F.coalesce(F.sum(under).over(upto), F.lit(0)).alias("under_at")))
        ranked = ranked.join(gap.select("sid", "n_slots", "over_at"), "sid")
        fits = ranked.filter(F.col("turn") < F.col("n_slots")).select("slot", "shard", "sid", "turn")
        free = ranked.filter(F.col("turn") >= F.col("n_slots")).select("slot", "shard", (F.col("over_at") + F.col("turn") - F.col("n_slots")).alias("q"))
        open_ = gap.filter("drawn < n_slots").select("sid", F.explode(F.sequence(F.col("drawn"), F.col("n_slots") - 1)).alias("turn"), "drawn", "under_at")
        open_ = open_.select("sid", "turn", (F.col("under_at") + F.col("turn") - F.col("drawn")).alias("q"))
        given = cut(fits.unionByName(free.join(open_, "q").select("slot", "shard", "sid", "turn")))
        t = given.join(src.select("sid", "blocks", "short", "epochs", "rest", "short_at"), "sid")
        t = t.withColumn("epoch", F.least(F.floor(F.col("turn") / F.col("blocks")), F.col("epochs")))
        t = t.withColumn("j", F.col("turn") - F.col("epoch") * F.col("blocks"))
        t = t.withColumn("block", permute(F.col("j"), F.col("blocks"), self._key("epoch")))
        length = F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(F.lit(self.block))
        seen = F.col("j") * self.block - F.when(F.col("short_at") < F.col("j"), self.block - F.col("short")).otherwise(0)
        t = t.withColumn("length", length).withColumn("words", F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.least(length, F.col("rest") - seen)))
        return t.select("slot", "shard", "sid", "turn", "epoch", "block", "words", (F.col("words") == F.col("length")).alias("full"))

    def pieces(self, placed: DataFrame) -> DataFrame:
        """``placed`` without its texts, a row for each block that holds words of it (block null if it has no words)."""
        L, end = self.block, F.col("start") + F.col("size") - 1
        over = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / L), F.floor(end / L)))
        return placed.withColumn("block", F.explode_outer(over))

    def taken(self) -> DataFrame:
        """(id, size, source_size, target, taken): the words that the mix takes of each row of ``docs``, repeats counted."""
        takes = self.slots.groupBy("sid", "block").agg(F.sum(F.when(F.col("full"), 1).otherwise(0)).alias("times"), F.max(F.when(~F.col("full"), F.col("words"))).alias("part"))
        pieces = self.pieces(self.placed.drop("row", "source", "tie")).join(takes, ["sid", "block"], "left")
        low, high = F.greatest(F.col("start"), F.col("block") * self.block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block)
        part = F.greatest(F.least(high, F.col("block") * self.block + F.coalesce("part", F.lit(0))) - low, F.lit(0))
        words = F.coalesce((high - low) * F.col("times") + part, F.lit(0))
        return pieces.groupBy("sid", "bucket", "rn").agg(
            F.first("id").alias("id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(words).alias("taken")
        ).drop("sid", "bucket", "rn")

    def documents(self, text_col: str = "text", n_chars_col: str | None = None) -> DataFrame:
        """The rows of ``docs``, once for each epoch that takes words of them, with the words taken as their text.

        An epoch that takes all words gives the text as it is; a part gives its stretches of words, each with
        the white space after it. Rows of which nothing is taken are left out.
        """
        slots = self.slots
        takes = slots.groupBy("sid", "block").agg(F.collect_list(F.struct("epoch", "words")).alias("takes"))
        pieces = self.pieces(self.placed.select("sid", "bucket", "rn", "start", "size")).join(takes, ["sid", "block"]).withColumn("take", F.explode("takes"))
        low = F.greatest(F.col("start"), F.col("block") * self.block)
        high = F.least(F.col("start") + F.col("size"), F.col("block") * self.block + F.col("take.words"))
        pieces = pieces.select("sid", "bucket", "rn", "start", "size", F.col("take.epoch").alias("epoch"), low.alias("low"), high.alias("high")).filter("low < high")
        # a row of all its words needs no list of stretches
        whole = pieces.groupBy("sid", "bucket", "rn", "epoch").agg(
            F.sum(F.col("high") - F.col("low")).alias("got"), F.first("size").alias("size"),
            F.sort_array(F.collect_list(F.struct((F.col("low") - F.col("start")).cast("int").alias("at"), (F.col("high") - F.col("low")).cast("int").alias("n")))).alias("parts"),
        )
        whole = cut(whole.select("sid", "bucket", "rn", F.when(F.col("got") < F.col("size"), F.col("parts")).alias("parts")))
        out = self.placed.select("sid", "bucket", "rn", "row").join(whole, ["sid", "bucket", "rn"])
        words = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
        cutout = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, p["at"] + 1, p["n"]))), "")
        text = F.when(F.col("parts").isNull(), F.col(f"row.{text_col}")).otherwise(cutout)
        fields = out.schema["row"].dataType.fieldNames()
        out = out.withColumn("new_text", text)
        return out.select(*[
            F.col("new_text").alias(c) if c == text_col else F.char_length("new_text").cast("long").alias(c) if c == n_chars_col else F.col(f"row.`{c}`").alias(c) for c in fields
        ])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return Mix(docs).taken().select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, source, source_size, target): the part of ``op3_mixing`` that SQL can say."""
    docs = read(spark, sf_dir, "documents")
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    return targets(sizes).select("sid", "source", "source_size", F.round("target", 4).alias("target"))


LLM_MIX_TARGETS_SQL = r"""
WITH s AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS source_size FROM documents GROUP BY 1
), o AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s
), w AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w, 3 * source_size::DOUBLE AS cap FROM o
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, max(level) FILTER (cap > w * level) OVER () AS rest FROM l
)
SELECT sid, source, source_size, round(CASE WHEN cap <= w * level THEN cap ELSE least(cap, w * rest) END, 4) AS target FROM f
"""
