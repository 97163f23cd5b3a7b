"""Quality filter: perplexity under an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on all text that the labels trust. One pass over all documents counts every n-gram
(of ``ORDER`` characters, with marks for start and end), apart for trusted text; the counts meet by a
shuffle with partial aggregation. Counts of n-grams, their contexts and their shorter suffixes are then
joined, sharded by n-gram, order by order from single characters up: continuation counts, three discounts
an order, interpolation weights. This gives a log probability for each n-gram of the corpus, seen in
trusted text or not. Documents take theirs by a join on the n-gram: if the table has at most ``TABLE`` rows
it is broadcast and looked up in each batch; a larger one is joined with (document, n-gram, count) rows.

A model knows the text it was trained on too well. So trusted documents are halved by a hash of their id,
and each half is scored by a model of the other half (``VARIANTS``), all other documents by the model of all
trusted text. The three are trained in the same joins.

A document stays if its perplexity is not above its language's threshold, from histograms of ``BIN`` wide
bins of the logarithm. With n trusted documents of a language, this is the ``quantile`` of their perplexities,
raised by the part few / (n + few) of the way to the same quantile over all documents of the language, if
that is higher: the less trusted text a model has seen of a language, the less it says about its documents.
Without any they are only ranked among themselves. Null is a language, but its documents may be of any: if
there are languages without trusted text, these and null share the highest of their thresholds.

Text that repeats good words has good n-grams. What tells it apart is its variety: the least share of
different words in any ``SPAN`` words in a row (in all words of a shorter text). A document whose variety is
below that of all but a share ``repeats`` of the trusted documents of its language doesn't stay either. As it
needs no model, the trusted documents of all languages count as ``few`` more of the language for this.

Null and empty texts have no perplexity and don't stay. Without any trusted text there is no model: all
documents with text stay. A document is trusted if it has labels and all of them say quality 1 and toxic 0;
a null id is never trusted. Characters beyond U+FFFF share 2,048 numbers that no other character has. Extra
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chars import code_points, padded, row_sums
from .common import cut, read
from .words import buffers, chunks, mix, word_hashes

ORDER, QUANTILE, FEW, BIN = 4, 0.995, 50, 0.001
#: Words looked at for repetition, and the share of trusted documents that may be below the threshold of variety.
SPAN, REPEATS = 32, 0.005
#: Bytes of text whose n-grams are counted or looked up at once.
RUN = 1 << 20
#: Models: of all trusted text, without its first half, without its second half.
VARIANTS = 3
#: Rows of the n-gram table up to which it is broadcast (20 bytes each), and of labels (8 bytes each; languages up to a twentieth).
TABLE, LABELS = 4_000_000, 2_000_000


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their n-grams as 64-bit numbers of 16 bits a character, row bounds); the text is column 0."""
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(0), RUN):
            points, bounds = code_points(data, offsets)
            # 0 is the mark before the start, 1 that after the end
            points = np.where(points > 0xFFFF, 0xD800 + (points & 0x7FF), np.maximum(points, 2)).astype(np.uint64)
            line, at = padded(points, bounds, ORDER - 1, 1)
            line[at[1:] - 1] = 1
            grams = line[: len(line) - ORDER + 1].copy()
            for k in range(1, ORDER):
                grams = (grams << np.uint64(16)) | line[k : len(line) - ORDER + 1 + k]
            rows = np.repeat(np.arange(end - first), np.diff(at))[: len(grams)]
            counts = np.diff(bounds)
            keep = (np.arange(len(grams)) - at[rows] <= counts[rows]) & (counts[rows] > 0)
            yield batch.slice(first, end - first), grams[keep], np.concatenate([[0], np.cumsum(np.where(counts > 0, counts + 1, 0))])


def varieties(column: pa.Array, span: int = SPAN) -> np.ndarray:
    """The least share of different words in any ``span`` words in a row of each text; 1 for one without words."""
    _, offsets = buffers(column)
    out = np.ones(len(offsets) - 1)
    for first, end, data, at in chunks(column):
        hashes, bounds, _ = word_hashes(data, at)
        if not len(hashes):
            continue
        count = np.diff(bounds)
        row = np.repeat(np.arange(len(count)), count)
        key = mix(hashes ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        by = np.argsort(key, kind="stable")
        place = np.arange(len(hashes))
        before = np.full(len(hashes), -1)
        same = key[by[1:]] == key[by[:-1]]
        before[by[1:][same]] = by[:-1][same]
        # a word is new in the spans that start after the one before it, and hold it
        new = np.bincount(np.maximum(np.maximum(before + 1, place - span + 1), bounds[row]), minlength=len(hashes) + 1)
        new[1:] -= 1
        different = np.cumsum(new)[:-1]
        # spans start up to the last whole one of a row
        start = place <= np.maximum(bounds[row], bounds[row + 1] - span)
        some = np.flatnonzero(count)
        kept = np.append(0, np.cumsum(start))[bounds[some]]
        out[first + some] = np.minimum.reduceat(different[start], kept) / np.minimum(count[some], span)
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """(g, n1, n2): how often each n-gram of the corpus is in the first and the second half of the trusted text."""

    def count(batches):
        for rows, g, at in _grams(batches):
            half = np.repeat(rows.column(1).to_numpy(zero_copy_only=False), np.diff(at))
            once, inverse = np.unique(g, return_inverse=True)
            n = [np.bincount(inverse, weights=half == k, minlength=len(once)).astype(np.int64) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64)), *map(pa.array, n)], ["g", "n1", "n2"])

    return docs.select("text", "half").mapInArrow(count, "g long, n1 long, n2 long").groupBy("g").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))


def _tail(g: Column, k: int) -> Column:
    """The last k characters of an n-gram."""
    return g.bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < 4 else g


def _discounts(counts: DataFrame) -> dict[int, tuple[float, float, float]]:
    """The three discounts of each variant from how many of its n-grams occur 1 to 4 times."""
    found = {(r["v"], r["n"]): float(r["c"]) for r in counts.filter("n <= 4").groupBy("v", "n").agg(F.count("*").alias("c")).collect()}
    out = {}
    for v in range(VARIANTS):
        n1, n2, n3, n4 = (found.get((v, i), 0.0) for i in (1, 2, 3, 4))
        out[v] = (0.5, 0.5, 0.5)
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
            out[v] = tuple(min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw))
    return out


def _of_variant(values: dict[int, float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(values.get(v, 0.0))) for v in range(VARIANTS)]), F.col("v") + 1)


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(g, logp) for each row of (g, n1, n2): the logarithm of P(last character | those before) in each variant."""
    variants = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), n.alias("n")) for v, n in enumerate((F.col("n1") + F.col("n2"), F.col("n2"), F.col("n1")))]))
    orders = {ORDER: counts.select("g", variants.alias("x")).select("x.v", "g", "x.n").filter("n > 0")}
    grams = counts.select("g", F.explode(F.array(*map(F.lit, range(VARIANTS)))).alias("v"))
    for k in range(ORDER - 1, 0, -1):  # in how many ways a shorter n-gram is continued to the left
        orders[k] = cut(orders[k + 1].groupBy("v", _tail(F.col("g"), k).alias("g")).agg(F.count("*").alias("n")))
    vocabulary = {r["v"]: r["c"] for r in orders[1].groupBy("v").agg(F.count("*").alias("c")).collect()}
    lower = None
    for k in range(1, ORDER + 1):
        ds = _discounts(orders[k])
        d = F.when(F.col("n") == 1, _of_variant({v: x[0] for v, x in ds.items()})).when(F.col("n") == 2, _of_variant({v: x[1] for v, x in ds.items()})).otherwise(_of_variant({v: x[2] for v, x in ds.items()}))
        context = F.shiftrightunsigned("g", 16) if k > 1 else F.lit(0).cast("long")
        seen = orders[k].select("v", "g", context.alias("ctx"), (F.col("n") - d).alias("left"), d.alias("d"), "n")
        totals = seen.groupBy("v", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("off"))
        wanted = grams.select("v", _tail(F.col("g"), k).alias("g")).distinct() if k < ORDER else grams
        w = wanted.withColumn("ctx", context).join(seen.select("v", "g", "left"), ["v", "g"], "left").join(totals, ["v", "ctx"], "left")
        if lower is None:
            below = 1 / (_of_variant(vocabulary) + 1)
        else:
            w = w.withColumn("short", _tail(F.col("g"), k - 1)).join(lower.select("v", F.col("g").alias("short"), F.col("p").alias("below")), ["v", "short"])
            below = F.col("below")
        p = F.when(F.col("total").isNull(), below).otherwise(F.coalesce("left", F.lit(0.0)) / F.col("total") + F.col("off") / F.col("total") * below)
        lower = cut(w.select("v", "g", p.alias("p")))
    each = [F.max(F.when(F.col("v") == v, F.log("p").cast("float"))) for v in range(VARIANTS)]
    return lower.groupBy("g").agg(F.array(*each).alias("logp"))


def score(docs: DataFrame, table: DataFrame, most: int = TABLE) -> DataFrame:
    """``docs`` without text, with n (its n-grams), logp (their sum) and variety, by a join with (g, logp).

    Column ``half`` of ``docs`` names the variant: 0 all trusted text, 1 and 2 without that half.
    """
    keys = [c for c in docs.columns if c not in ("text", "half")]
    names = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)
    if table.limit(most + 1).count() <= most:
        rows = table.toArrow()
        g = rows.column("g").to_numpy().view(np.uint64)
        by = np.argsort(g)
        values = np.array(rows.column("logp").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, VARIANTS)
        shared = docs.sparkSession.sparkContext.broadcast((g[by], values[by]))

        def look_up(batches):
            known, logp = shared.value
            for rows, g, at in _grams(batches):
                half = np.repeat(rows.column(1).to_numpy(), np.diff(at))
                once, inverse = np.unique(g, return_inverse=True)
                value = logp[np.searchsorted(known, once)].ravel() if len(once) else np.zeros(0, np.float32)
                sums = row_sums(value[inverse * VARIANTS + half], at)
                yield pa.RecordBatch.from_arrays([*rows.columns[2:], pa.array(varieties(rows.column(0))), pa.array(np.diff(at)), pa.array(sums)], [*keys, "variety", "n", "logp"])

        return docs.select("text", "half", *keys).mapInArrow(look_up, f"{names}, variety double, n long, logp double")

    def ask(batches):
        for rows, g, at in _grams(batches):
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            order = np.lexsort((g, row))
            g, row = g[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])])) if len(g) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(g)))
            own = [c.take(pa.array(row[first])) for c in rows.columns[1:]]  # not the text
            yield pa.RecordBatch.from_arrays([*own, pa.array(varieties(rows.column(0))[row[first]]), pa.array(np.diff(at)[row[first]]), pa.array(g[first].view(np.int64)), pa.array(n)], ["half", *keys, "variety", "n", "g", "times"])

    asked = docs.select("text", "half", *keys).mapInArrow(ask, f"half long, {names}, variety double, n long, g long, times long")
    value = F.element_at("logp", (F.col("half") + 1).cast("int")).cast("double")
    sums = asked.join(table, "g").groupBy(*keys, "variety", "n").agg(F.sum("times").alias("all"), F.sum(F.col("times") * value).alias("logp"))
    # equal rows have been summed as one; each gets its share
    equal = (F.col("all") / F.col("n")).cast("int")
    sums = sums.select(*keys, "variety", "n", (F.col("logp") / equal).alias("logp"), F.explode(F.array_repeat(F.lit(0), equal)).alias("nth")).drop("nth")
    empty = docs.filter(F.coalesce(F.col("text"), F.lit("")) == "").select(*keys, F.lit(1.0).alias("variety"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("logp"))
    return sums.unionByName(empty)


def quantiles(bins: DataFrame, by: list[str], share: float) -> DataFrame:
    """(by, bin, all) of (by, bin, c): the bin in which ``share`` of the rows is reached, and the number of rows."""
    bins = bins.groupBy(*by, "bin").agg(F.sum("c").alias("c"))
    b = bins.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy("bin"))).withColumn("all", F.sum("c").over(Window.partitionBy(*by)))
    return b.filter(F.col("upto") >= share * F.col("all")).groupBy(*by).agg(F.min("bin").alias("bin"), F.first("all").alias("all"))


def thresholds(scored: DataFrame, quantile: float, repeats: float, few: int) -> DataFrame:
    """(lang, limit, low), a row a language and null: the greatest logarithm of a perplexity, the least variety."""
    some = scored.filter("n > 0")
    surprise, variety = (cut(some.groupBy("lang", F.floor(v / BIN).alias("bin"), "trusted").agg(F.count("*").alias("c"))) for v in (-F.col("logp") / F.col("n"), F.col("variety")))
    every = quantiles(surprise, ["lang"], quantile).select("lang", F.col("bin").alias("every"))
    upper = quantiles(surprise.filter("trusted"), ["lang"], quantile).select(F.col("lang").alias("l1"), F.col("bin").alias("upper"), "all")
    # of the language's own trusted documents and of all, which count as few documents together
    known = variety.filter("trusted").select("lang", "bin", F.col("c").cast("double").alias("c"))
    total = known.agg(F.sum("c").alias("total"))
    prior = known.groupBy("bin").agg(F.sum("c").alias("c")).crossJoin(F.broadcast(total)).select("bin", (F.col("c") * few / F.col("total")).alias("c"))
    both = known.unionByName(every.select("lang").crossJoin(F.broadcast(prior)))
    lower = quantiles(both, ["lang"], repeats).select(F.col("lang").alias("l2"), (F.col("bin") * BIN).alias("low"))
    t = every.join(upper, F.col("lang").eqNullSafe(F.col("l1")), "left").join(lower, F.col("lang").eqNullSafe(F.col("l2")), "left")
    part = few / (F.coalesce("all", F.lit(0)) + few) if few else F.when(F.col("all").isNull(), 1.0).otherwise(0.0)
    own = F.coalesce("upper", "every")
    t = t.select("lang", F.col("all").isNull().alias("new"), ((own + part * F.greatest(F.lit(0), F.col("every") - own) + 1) * BIN).alias("limit"), "low")
    t = cut(t)
    shared = t.filter("new or lang is null").agg(F.max("limit").alias("shared"), F.max("new").alias("any"))
    return t.crossJoin(F.broadcast(shared)).select("lang", F.when(F.col("any") & (F.col("new") | F.col("lang").isNull()), F.col("shared")).otherwise(F.col("limit")).alias("limit"), "low")


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return cut(good.filter("q = 1 and t = 0").select(F.col("doc_id").alias("good")))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, few: int = FEW, most: int = TABLE, repeats: float = REPEATS) -> DataFrame:
    """(doc_id, lang, text_key, n, perplexity, threshold, variety, least, kept), a row a document; text_key is a hash of its text."""
    good = trusted_ids(labels)
    if good.count() <= LABELS:
        good = F.broadcast(good)
    text = F.col("text").cast("string")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    half = F.when(F.col("good").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) + 1).otherwise(0).cast("long")
    src = src.join(good, F.col("doc_id") == F.col("good"), "left").select("doc_id", "lang", "text_key", F.col("good").isNotNull().alias("trusted"), half.alias("half"), "text")
    table = cut(log_probabilities(cut(count_grams(src))))
    scored = cut(score(src, table, most))
    scored = scored.withColumn("logp", F.round("logp", 6))  # sums in any order agree
    log_ppl = F.when(F.col("n") > 0, -F.col("logp") / F.col("n"))
    by_lang = thresholds(scored, quantile, repeats, few).withColumnRenamed("lang", "of")
    # without any trusted text there is no model
    if not scored.filter("trusted and n > 0").limit(1).count():
        by_lang = by_lang.limit(0)
    limit, least = F.coalesce("limit", F.lit(float("inf"))), F.coalesce("low", F.lit(0.0))
    by_lang = cut(by_lang)
    if by_lang.count() <= LABELS // 20:
        by_lang = F.broadcast(by_lang)
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left")
    return out.select(
        "doc_id", "lang", "text_key", "n", F.exp(log_ppl).alias("perplexity"), F.exp(limit).alias("threshold"), "variety", least.alias("least"), F.coalesce((log_ppl <= limit) & (F.col("variety") >= least), F.lit(False)).alias("kept")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "perplexity", "threshold", "kept")
