"""Removal of lines that are like an earlier line: an exact set-similarity join of lines.

A line is the set of its words, A-Z as a-z; two lines match when the Jaccard index of their sets is
``percent`` hundredths or more. Lines are in order of document id, then of the text's hash, then of their
place in the text; a line goes if any earlier line matches it, whether that one stays or not.

1. Words are counted over all lines and ordered rare first; prefix, length, positional and signature filters
   leave candidates, as edges whose components hold all matching pairs (``candidates``).
2. The sets of a component that fit a task (``MOST`` sets, ``WORDS`` words) are compared there, exactly,
   oldest first, until the earliest match is found.
3. A larger component goes by rounds: its oldest sets, twice as many each round, are compared with all sets
   that have no match yet, in tasks of parts of both. As older sets come first, a match found is the earliest,
   so sets that copy one template are done after the first round, which is in proportion to their number.
4. Lines join the earliest match of their set; those after it go.

Lines without words never match. Null and empty texts have no line to lose. Rows that share id and text are
one document: the same lines go. A null id comes after all others. Extra columns aren't read or, by
``remove_lines``, are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .candidates import HOT, PAIRED, Sets, bloom_of, bucket_count, candidate_edges, cut_if_any, grouped, in_bloom_of, needed, order_of, parities, prefix_rows, slices, width
from .common import connected_components, cut, read, release
from .words import chunks, sets, word_hashes

PERCENT = 80
#: Most sets, and words of these, that are compared in one task.
MOST, WORDS = 4096, 1 << 21
NAME, PLACE = ("h", "s"), ("last", "id", "text_key", "line")


class Lines(Sets):
    """The lines with words of a run of texts: their row, place in the text, and sets of word hashes; and each text's lines."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        starts = np.concatenate([offsets[:-1], breaks + 1])
        row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
        by = np.lexsort((starts, row))  # a last, empty line starts where the next text does
        starts, row = starts[by], row[by]
        hashes, bounds, _ = word_hashes(data, np.append(starts, len(data)))
        words, at = sets(hashes, bounds)
        full = np.flatnonzero(np.diff(at))
        first = np.searchsorted(row, np.arange(len(offsets)))
        self.row, self.place = row[full], (np.arange(len(starts)) - first[row])[full]
        #: Lines of each text; an empty one has none.
        self.counts = np.where(np.diff(offsets) > 0, np.diff(first), 0)
        super().__init__(words, np.append(at[full], len(words)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[Sets]:
    """All words, to count them: a word that a line repeats counts as often, which the order may."""
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            yield Sets(*word_hashes(data, offsets)[:2])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[Lines]:
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            yield Lines(data, offsets)


def _occurrences(src: DataFrame, near: DataFrame) -> DataFrame:
    """(id, text_key, line, h, s, n, words), a row a line with words; and a row a text, with line -1 and n its lines.

    h and s name a line's set. Of the sets of ``near``, one line of each run of texts has the words too; a filter of
    fixed size, which may let others pass, tells them.
    """
    shared = src.sparkSession.sparkContext.broadcast(bloom_of(near.select("node")))

    def find(batches):
        for batch in slices(batches):
            seen: set[tuple[int, int]] = set()
            for first, end, data, offsets in chunks(batch.column(0)):
                ls = Lines(data, offsets)
                h, s, _ = ls.ids()
                words: list[bytes | None] = [None] * len(h)
                for i in np.flatnonzero(in_bloom_of(shared.value, h)).tolist():
                    name = (int(h[i]), int(s[i]))
                    if name not in seen:
                        seen.add(name)
                        words[i] = ls.one(i).tobytes()
                own = [batch.column(k).slice(first, end - first).take(pa.array(ls.row)) for k in (1, 2)]
                names = [pa.array(x.view(np.int64)) for x in (h, s)]
                columns = ["id", "text_key", "line", "h", "s", "n", "words"]
                yield pa.RecordBatch.from_arrays([*own, pa.array(ls.place.astype(np.int32)), *names, pa.array(ls.sizes), pa.array(words, pa.binary())], columns)
                texts, zero = [batch.column(k).slice(first, end - first) for k in (1, 2)], pa.array(np.zeros(end - first, np.int64))
                yield pa.RecordBatch.from_arrays([*texts, pa.array(np.full(end - first, -1, np.int32)), zero, zero, pa.array(ls.counts), pa.nulls(end - first, pa.binary())], columns)

    return src.select("text", "id", "text_key").mapInArrow(find, "id long, text_key long, line int, h long, s long, n long, words binary")


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("last"), F.coalesce("id", F.lit(0)).alias("id"), "text_key", "line")


def earliest(words: list[np.ndarray], t: int, old: np.ndarray | None = None, new: np.ndarray | None = None) -> list[int | None]:
    """For each set, in order of age, the index of the oldest before it that matches.

    With ``old`` and ``new``, only sets of ``new`` get one, and only sets of ``old`` are matched.
    """
    n = np.array([len(w) for w in words])
    packed = np.array([parities(w, width(int(n.max()))) for w in words])
    out: list[int | None] = [None]
    for i in range(1, len(words)):
        hit = None
        if new is None or new[i]:
            need = needed(n[:i], n[i], t)
            apart = np.bitwise_count(packed[:i] ^ packed[i]).sum(axis=1)
            could = (apart <= n[:i] + n[i] - 2 * need) & (np.minimum(n[:i], n[i]) >= need)
            for j in np.flatnonzero(could if old is None else could & old[:i]).tolist():
                if len(np.intersect1d(words[i], words[j], assume_unique=True)) >= need[j]:
                    hit = j
                    break
        out.append(hit)
    return out


def _compared(tasks: DataFrame, percent: int) -> DataFrame:
    """(h, s, match): the place of the oldest match that tasks find for a set.

    ``tasks``: (task, old, new, h, s, place, words); a set is matched with those that ``old`` marks if ``new``
    marks it.
    """
    kinds = {"h": pa.int64(), "s": pa.int64(), "last": pa.bool_(), "id": pa.int64(), "text_key": pa.int64(), "line": pa.int32()}

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    def compare(batches):
        out = []
        for _, group in grouped(batches):
            rows = list(group)
            old, new = (np.array([r[k] for r in rows]) for k in (0, 1))
            hits = earliest([np.frombuffer(r[-1], np.uint64) for r in rows], percent, old, new)
            out += [(r[2], r[3], *rows[j][4:8]) for r, j in zip(rows, hits, strict=True) if j is not None]
            if len(out) >= 10_000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    by_task = tasks.select("task", "old", "new", *NAME, *PLACE, "words").repartition("task").sortWithinPartitions("task", *PLACE)
    found = by_task.mapInArrow(compare, "h long, s long, last boolean, id long, text_key long, line int")
    return found.groupBy(*NAME).agg(F.min(F.struct(*PLACE)).alias("match"))


def _parts(most: int, words: int) -> Column:
    """The number of parts of a component's rows, so that two of them fit a task."""
    return F.greatest(F.lit(1), F.ceil(2 * F.col("sets") / most), F.ceil(2 * F.col("total") / words))


def _rounds(big: DataFrame, percent: int, most: int, words: int) -> DataFrame:
    """(h, s, match) of the sets of components beyond a task: (root, h, s, n, place, words)."""
    age = F.when(F.col("last"), F.lit((1 << 63) - 1)).otherwise(F.col("id"))
    big = cut(big.withColumn("age", age))
    largest = big.groupBy("root").count().agg(F.max("count")).first()[0]
    shares = [min(1.0, most * 2**k / largest) for k in range(64) if k == 0 or most * 2 ** (k - 1) < largest]
    limits = big.groupBy("root").agg(F.percentile_approx("age", F.array(*map(F.lit, shares)), F.lit(10_000)).alias("limits"))
    big = big.join(limits, "root")
    waiting, matched, salt = big, None, F.xxhash64(*NAME)
    for k in range(len(shares)):
        upto = F.element_at("limits", k + 1) if k + 1 < len(shares) else F.lit((1 << 63) - 1)
        old = big.filter(F.col("age") <= upto)
        if k:
            old = old.filter(F.col("age") > F.element_at("limits", k))
        sides = []
        for side, name in ((old, "o"), (waiting, "w")):
            count = side.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("total"))
            count = count.select("root", _parts(most, words).cast("long").alias(f"{name}_parts"))
            sides.append((side, count))
        both = sides[0][1].join(sides[1][1], "root")
        own = [side.join(both, "root").withColumn(f"{name}", F.pmod(salt, F.col(f"{name}_parts"))) for (side, _), name in zip(sides, "ow", strict=True)]
        other = [F.explode(F.sequence(F.lit(0).cast("long"), F.col("w_parts") - 1)).alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_parts") - 1)).alias("o")]
        tasks = None
        for rows, spread, name in ((own[0], other[0], "o"), (own[1], other[1], "w")):
            rows = rows.select("root", *NAME, *PLACE, "words", name, spread).withColumn("task", F.xxhash64("root", "o", "w"))
            rows = rows.select("task", F.lit(name == "o").alias("old"), F.lit(name == "w").alias("new"), *NAME, *PLACE, "words")
            tasks = rows if tasks is None else tasks.unionByName(rows)
        found = cut(_compared(tasks, percent))
        matched = found if matched is None else matched.unionByName(found)
        if k + 1 < len(shares):
            waiting = cut_if_any(waiting.join(found.select(*NAME), list(NAME), "left_anti"))
            if waiting is None:
                break
    return matched.groupBy(*NAME).agg(F.min("match").alias("match"))


def later_lines(docs: DataFrame, percent: int = PERCENT, **how) -> DataFrame:
    """(id, text_key, removed): the places, from 0, of the lines that go, of documents that lose some."""
    return _later(docs, percent, **how)[0]


def _later(docs: DataFrame, percent: int, most: int = MOST, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """What ``later_lines`` gives, and (id, text_key, n_lines), a row a document."""
    text = F.col(text_col).cast("string")
    src = docs.select(text.alias("text"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"))
    order = order_of(src.select("text"), _words)
    edges = cut(candidate_edges(prefix_rows(src, _lines, order, percent, hot, paired), percent, bucket_count(order)))
    near = connected_components(edges)
    del edges  # its plan holds the shuffle of the prefix rows
    release(docs.sparkSession)
    every = cut(_occurrences(src, near))
    found = every.filter("line >= 0")
    # sets that occur once and are like no other have no part in what follows
    known = found.groupBy(*NAME).agg(F.count("*").alias("times"), F.min("n").alias("n")).join(near, F.col("h") == F.col("node"), "left")
    known = known.filter("times > 1 or root is not null").drop("node")
    lines = cut(found.drop("words", "n").join(known, list(NAME)))
    release(docs.sparkSession)
    known = cut(lines.groupBy(*NAME, "root", "n").agg(F.min(_place()).alias("first")))
    near = known.filter("root is not null").select("root", *NAME, "n", "first.*")
    sizes = cut(near.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("total")))
    words_ = found.filter("words is not null").select(*NAME, "words").dropDuplicates(list(NAME))
    ready = near.join(words_, list(NAME)).join(sizes, "root")
    fits = (F.col("sets") <= most) & (F.col("total") <= words)
    large = sizes.filter(~fits).limit(1).count()
    if large:
        ready = cut(ready)
    small = ready.filter(fits).select(F.col("root").alias("task"), F.lit(True).alias("old"), F.lit(True).alias("new"), *NAME, *PLACE, "words")
    matched = _compared(small, percent)
    if large:
        matched = matched.unionByName(_rounds(ready.filter(~fits).drop("sets", "total"), percent, most, words))
    cuts = known.select(*NAME, "first").join(matched, list(NAME), "left").select(*NAME, F.coalesce("match", "first").alias("upto"))
    gone = lines.join(cut(cuts), list(NAME)).filter(_place() > F.col("upto"))
    gone = gone.groupBy("id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    return gone, every.filter("line < 0").select("id", "text_key", F.col("n").cast("int").alias("n_lines"))


def remove_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with their text without the lines that go; every row and column stays."""
    gone = later_lines(docs, percent, id_col=id_col, text_col=text_col, **how).select(F.col("id").alias("__id"), F.col("text_key").alias("__text"), F.col("removed").alias("__removed"))
    same = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__text"))
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains("__removed", i)), "\n")
    return docs.join(gone, same, "left").withColumn(text_col, F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(left)).drop("__id", "__text", "__removed")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): lines of each document, and the places, from 0, of those that go, joined by commas."""
    gone, docs = _later(read(spark, sf_dir, "documents"), PERCENT)
    gone = gone.select(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key"), "removed")
    out = docs.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", F.size(removed).alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed"))


#: For ids that are unique and not null.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE coalesce(text, '') <> ''
), l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS t FROM d
), w AS (
  SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS ws FROM l
), s AS (
  SELECT ws, len(ws) AS n, min({'d': doc_id, 'l': line}) AS first FROM w WHERE len(ws) > 0 GROUP BY ws
), x AS (
  SELECT ws, n, first, unnest(ws) AS word FROM s
), c AS (
  SELECT word, count(*) AS c FROM x GROUP BY 1
), p AS (
  SELECT ws, n, first, word FROM x JOIN c USING (word) QUALIFY row_number() OVER (PARTITION BY ws ORDER BY c, word) <= n - (80 * n + 99) // 100 + 1
), k AS (
  SELECT DISTINCT a.first AS own, b.first AS other, a.ws AS u, b.ws AS v FROM p a JOIN p b ON a.word = b.word AND b.first < a.first AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), m AS (
  SELECT own, min(other) AS upto FROM k WHERE 100 * len(list_intersect(u, v)) >= 80 * (len(u) + len(v) - len(list_intersect(u, v))) GROUP BY 1
), g AS (
  SELECT doc_id, line FROM w JOIN s ON w.ws = s.ws LEFT JOIN m ON m.own = s.first WHERE {'d': doc_id, 'l': line} > coalesce(m.upto, s.first)
), r AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(line, ',' ORDER BY line) AS removed FROM g GROUP BY 1
)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN r USING (doc_id)
"""
