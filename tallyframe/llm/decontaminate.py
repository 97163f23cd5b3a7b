"""Benchmark decontamination: rare n-gram seeds join documents to test items, Smith-Waterman scores the pairs.

``matches`` takes the runs of ``SEED`` words of the items as seeds. A first pass over the documents counts how often
each seed is in them; an item keeps those with up to ``RARE`` occurrences and in any case its ``ALWAYS`` rarest that
occur. A second pass picks the documents that have a kept seed (tasks get a Bloom filter of fixed size; what it lets
pass for nothing is dropped by the join), and their seeds join the items' by a shuffle. So after the two passes the
work goes with the seeds that meet, not with documents times items. A pair is aligned where its seeds are.

The item is aligned with a document's words: ``MATCH`` for equal words, ``-MISS`` for different ones and for
each word left out or put in. The score is the best local alignment over that of the whole item with itself;
from ``least`` on, and with ``FLOOR`` equal words, the document counts as contaminated by the item. An item of fewer
words, a "yes" say, is no passage: it matches documents that consist of it.

A pair without a kept seed is lost: a copy edited every third word or more often, or one of which only very common
runs are left. ``contaminated`` is the exact way. It loses no pair: an alignment that is good enough bounds from below
how many of the item's words it matches, and from above how many words of the document it spans. So of the item's
rarest words all but the number that may be unmatched are in such a span; taking ``HITS`` words more, at least that
many are. Spans with these are kept if adding ``MATCH`` for each word that the item has anywhere and ``-MISS`` for
each other one, which no alignment exceeds, can reach what is needed. It takes the items in blocks of about ``BLOCK``
words, all documents pass twice a block, and items under ``FLOOR`` words match nothing in it.

Words are compared by a hash, A-Z as a-z. Null and empty texts and items match nothing. Equal rows of one
document or item give one row. A null id is an id. Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .candidates import bloom_of, in_bloom_of
from .common import cut, read, word_count
from .words import chunks, ngrams, word_hashes

FLOOR, HITS, MATCH, MISS, LEAST, BLOCK = 4, 4, 2, 1, 0.5, 1_000_000
#: Words of a seed, occurrences up to which a seed is kept, an item's rarest seeds that are kept in any case, and seeds that a task counts before it hands them on.
SEED, RARE, ALWAYS, HELD = 3, 1000, 8, 1 << 20
FOUND = "doc_id long, item_id long, text_key long, score double, first_word long, end_word long"


class Items:
    """The test items of a block: their words, and those of them that a contaminated document must have."""

    def __init__(self, ids: list, texts: list[str | None], least: float, floor: int):
        column = pa.array([t or "" for t in texts], pa.large_string())
        self.ids, self.words = list(ids), []
        for _, _, data, offsets in chunks(column):
            hashes, bounds, _ = word_hashes(data, offsets)
            self.words += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        self.own = [np.searchsorted(self.known, w) for w in self.words]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        #: Scores needed, and the most words of a document that an alignment with such a score spans.
        self.need = np.maximum(least * MATCH * self.lengths, MATCH * floor)
        self.span = self.lengths + np.floor((MATCH * self.lengths - self.need) / MISS + 1e-9).astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def choose(self, count: np.ndarray, hits: int) -> None:
        """Chooses each item's rarest words by ``count``, so that an alignment has ``self.hits`` of them."""
        matched = np.ceil(self.need / MATCH - 1e-9).astype(np.int64)
        self.hits = np.minimum(hits, matched)
        word, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, own in enumerate(self.own):
            if len(own) and matched[i] <= len(own):
                rare = own[np.argsort(count[own], kind="stable")][: len(own) - matched[i] + self.hits[i]]
                word.append(np.unique(rare))
                item.append(np.full(len(word[-1]), i))
        words, items = np.concatenate(word), np.concatenate(item)
        by = np.argsort(words, kind="stable")
        self.items, self.bounds = items[by], np.searchsorted(words[by], np.arange(len(self.known) + 1))
        #: Slots of (item, word); those that share one with another only raise the bound.
        n = int(self.lengths.sum())
        self.has = np.zeros(1 << max(16, (16 * n).bit_length()), bool)
        for i, own in enumerate(self.own):
            self.has[self.slot(np.full(len(own), i), own)] = True

    def slot(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        x = (item.astype(np.uint64) << np.uint64(32)) + word.astype(np.uint64)
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.has).bit_length())).astype(np.int64)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``hashes``, place in ``known``) of the words that some item has."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        word = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        same = self.known[word] == hashes[at] if len(at) else np.zeros(0, bool)
        return at[same], word[same]

    def stretches(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first, end) of stretches of the rows' words, which hold all alignments that are good enough."""
        place, word = self.look_up(hashes)
        times = self.bounds[word + 1] - self.bounds[word]
        ends = np.cumsum(times)
        if not len(ends) or not ends[-1]:
            return
        item = self.items[np.arange(ends[-1]) - np.repeat(ends - times, times) + np.repeat(self.bounds[word], times)]
        key = np.sort(item * len(hashes) + np.repeat(place, times))
        item, at = key // len(hashes), key % len(hashes)
        # enough hits in a row of one document in one span
        last = np.arange(len(key)) + self.hits[item] - 1
        k = np.flatnonzero(last < len(key))
        k = k[(item[last[k]] == item[k]) & (at[last[k]] - at[k] < self.span[item[k]])]
        row = np.searchsorted(bounds, at[k], "right") - 1
        same = at[last[k]] < bounds[row + 1]
        k, row = k[same], row[same]
        if not len(k):
            return
        item, low, high = item[k], np.maximum(at[k] - self.span[item[k]], bounds[row]), np.minimum(at[k] + self.span[item[k]], bounds[row + 1])
        new = np.ones(len(k), bool)
        new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (low[1:] > high[:-1])
        first = np.flatnonzero(new)
        row, item, low, high = row[first], item[first], low[first], high[np.append(first[1:], len(k)) - 1]
        known = np.full(len(hashes), -1, np.int64)
        known[place] = word
        # the best sum over a run of words, in parts of bounded size
        size = high - low
        part = np.cumsum(size) // (1 << 20)
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            n = size[own]
            of = np.repeat(np.arange(len(own)), n)
            w = known[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[own], n)]
            gain = np.where((w >= 0) & self.has[self.slot(item[own][of], np.maximum(w, 0))], MATCH, -MISS)
            total = np.cumsum(gain)
            apart = of * ((MATCH + MISS) * (len(of) + 1))
            best = total - (np.minimum.accumulate(total - gain - apart) + apart)
            good = np.maximum.reduceat(best, np.cumsum(n) - n) >= self.need[item[own]] - 1e-9
            for s in own[good].tolist():
                yield int(row[s]), int(item[s]), int(low[s]), int(high[s])


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(score, end) of the best local alignment of ``item`` with ``words``; it ends before ``words[end]``."""
    gaps = MISS * np.arange(len(words) + 1)
    above, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    for w in item:
        row = np.maximum(above - MISS, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(words == w, MATCH, -MISS))
        row = np.maximum.accumulate(row + gaps) - gaps  # words put in
        k = int(np.argmax(row))
        if row[k] > best:
            best, end = int(row[k]), k
        above = row
    return best, end


def _count(docs: DataFrame, items: Items) -> np.ndarray:
    """How often each known word is in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        n = np.zeros(len(known.known), np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                n += np.bincount(known.look_up(word_hashes(data, offsets)[0])[1], minlength=len(n))
        word = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n[word])], ["word", "n"])

    out = np.zeros(len(items.known), np.int64)
    for r in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["word"]] = r["n"]  # no more rows than the block's words
    return out


def _score(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = []
            for first, end, data, offsets in chunks(batch.column(2)):
                hashes, bounds, _ = word_hashes(data, offsets)
                rows, best = batch.slice(first, end - first), {}
                for row, i, low, high in known.stretches(hashes, bounds):
                    item = known.words[i]
                    got, stop = align(item, hashes[low:high])
                    if got >= known.need[i] - 1e-9 and got > best.get((row, i), (0,))[0]:
                        back = align(item[::-1], hashes[low : low + stop][::-1])[1]
                        best[row, i] = (got, int(low + stop - back - bounds[row]), int(low + stop - bounds[row]))
                for (row, i), (got, low, high) in best.items():
                    out.append((rows.column(0)[row].as_py(), known.ids[i], rows.column(1)[row].as_py(), got / (MATCH * len(known.words[i])), low, high))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 2, strict=True)], ["doc_id", "item_id", "text_key", "score", "first_word", "end_word"])

    return docs.select("id", "text_key", "text").mapInArrow(score, "doc_id long, item_id long, text_key long, score double, first_word long, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, floor: int = FLOOR, hits: int = HITS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, text_key, score, first_word, end_word) of documents that hold a test item.

    ``first_word`` and ``end_word`` bound the best stretch; ``text_key`` is the XXH64 of the text, to tell
    apart rows with one id.
    """
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    blocks = -(-(tests.agg(F.sum(word_count(F.col("text")))).first()[0] or 0) // block)
    found = None
    for b in range(blocks):
        rows = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows], least, floor)
        items.choose(_count(src, items), hits)
        scored = _score(src, items)
        found = scored if found is None else found.unionByName(scored)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    return found.dropDuplicates(["doc_id", "item_id", "text_key"])


def _item_seeds(tests: DataFrame, seed: int) -> DataFrame:
    """(key, item_id, words, seeds) of test items (key, item_id, text)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(2)):
                hashes, bounds, _ = word_hashes(data, offsets)
                grams, at, _ = ngrams(hashes, bounds, seed)
                rows = batch.slice(first, end - first)
                words = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                seeds = [np.unique(grams[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(words, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))], ["key", "item_id", "words", "seeds"])

    return tests.select("key", "item_id", "text").mapInArrow(split, "key long, item_id long, words binary, seeds array<long>")


def _seed_counts(src: DataFrame, seed: int, bloom: np.ndarray) -> DataFrame:
    """(seed, n): how often the documents have each run of words that may be a seed."""
    shared = src.sparkSession.sparkContext.broadcast(bloom)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            value, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times.astype(np.int64))], ["seed", "n"])

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                grams = ngrams(*word_hashes(data, offsets)[:2], seed)[0]
                held.append(grams[in_bloom_of(shared.value, grams)])
                n += len(held[-1])
                if n >= HELD:
                    yield out()
                    held, n = [], 0
        yield out()

    return src.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))


def _hit_documents(src: DataFrame, seed: int, bloom: np.ndarray) -> DataFrame:
    """(doc_id, text_key, words, seeds, at) of the documents with a run of words that may be a kept seed."""
    shared = src.sparkSession.sparkContext.broadcast(bloom)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(2)):
                hashes, bounds, _ = word_hashes(data, offsets)
                grams, at, word = ngrams(hashes, bounds, seed)
                hit = np.flatnonzero(in_bloom_of(shared.value, grams))
                cuts = np.searchsorted(hit, at)
                own = np.flatnonzero(np.diff(cuts))
                rows = batch.slice(first, end - first).take(pa.array(own))
                words = [hashes[bounds[r] : bounds[r + 1]].tobytes() for r in own]
                parts = [hit[cuts[r] : cuts[r + 1]] for r in own]
                columns = [rows.column(0), rows.column(1), pa.array(words, pa.binary()), pa.array([grams[h].view(np.int64) for h in parts], pa.list_(pa.int64())), pa.array([word[h] - bounds[r] for h, r in zip(parts, own, strict=True)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "words", "seeds", "at"])

    return src.select("id", "text_key", "text").mapInArrow(pick, "doc_id long, text_key long, words binary, seeds array<long>, at array<long>")


def best_stretch(item: np.ndarray, words: np.ndarray, at: np.ndarray, seed: int, least: float, floor: int) -> tuple[float, int, int] | None:
    """(score, first word, end) of the best alignment of ``item`` round the places ``at`` of seeds; None if it isn't good enough."""
    if len(item) < floor:
        return (1.0, 0, len(words)) if len(item) == len(words) and (item == words).all() else None
    need = max(least * MATCH * len(item), MATCH * floor)
    span = len(item) + int((MATCH * len(item) - need) / MISS + 1e-9)
    at = np.sort(at)
    new = np.flatnonzero(np.concatenate([[True], at[1:] - span > at[:-1] + span + seed]))
    best = (need - 1e-9, 0, 0)
    for first, last in zip(at[new], at[np.append(new[1:], len(at)) - 1], strict=True):
        low, high = max(0, int(first) - span), min(len(words), int(last) + span + seed)
        near = words[low:high]
        total = np.cumsum(np.where(np.isin(near, item), MATCH, -MISS))
        if (total - np.minimum.accumulate(np.concatenate([[0], total[:-1]]))).max() < best[0]:
            continue  # not even with the words in any order
        got, stop = align(item, near)
        if got > best[0]:
            back = align(item[::-1], near[:stop][::-1])[1]
            best = (got, low + stop - back, low + stop)
    return (best[0] / (MATCH * len(item)), best[1], best[2]) if best[2] else None


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, floor: int = FLOOR, seed: int = SEED, rare: int = RARE, always: int = ALWAYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, text_key, score, first_word, end_word) of documents that share a kept seed with a test item and align with it.

    The columns are those of ``contaminated``.
    """
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = cut(_item_seeds(tests.select(F.xxhash64("item_id", "text").alias("key"), "item_id", F.coalesce("text", F.lit("")).alias("text")), seed))
    seeds = items.select("key", F.explode("seeds").alias("seed"))
    counts = _seed_counts(src, seed, bloom_of(seeds.select("seed").distinct()))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("n", "seed"))
    kept = cut(seeds.join(counts, "seed").withColumn("rank", rank).filter((F.col("rank") <= always) | (F.col("n") <= rare)).select("seed", "key"))
    hits = cut(_hit_documents(src, seed, bloom_of(kept.select("seed").distinct())).withColumn("ref", F.monotonically_increasing_id()))
    met = hits.select("ref", F.inline(F.arrays_zip("seeds", "at"))).withColumnRenamed("seeds", "seed").join(kept, "seed")
    pairs = met.groupBy("ref", "key").agg(F.collect_list("at").alias("at")).join(items.select("key", "item_id", "words"), "key")  # places in one document

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            doc = left.to_pylist()[0]
            words = np.frombuffer(doc["words"], np.uint64)
            for r in right.to_pylist():
                best = best_stretch(np.frombuffer(r["words"], np.uint64), words, np.array(r["at"]), seed, least, floor)
                if best:
                    out.append((doc["doc_id"], r["item_id"], doc["text_key"], *best))
        kinds = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 2
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in FOUND.split(", ")])

    found = hits.select("ref", "doc_id", "text_key", "words").groupBy("ref").cogroup(pairs.select(F.col("ref").alias("of"), "item_id", "words", "at").groupBy("of")).applyInArrow(score, FOUND)
    return found.dropDuplicates(["doc_id", "item_id", "text_key"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: bool = False, **how) -> DataFrame:
    """``docs`` without the documents that hold a test item, found by ``matches`` or, if ``exact``, by ``contaminated``."""
    bad = (contaminated if exact else matches)(docs, benchmark, id_col=id_col, text_col=text_col, **how).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_text")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("bad_text"))
    return docs.join(bad, same, "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")
