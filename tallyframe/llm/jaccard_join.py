"""Similarity self-join of documents on the Jaccard index of word n-gram sets, with prefix trees.

1. How many documents hold an n-gram orders all n-grams: those of one document first (they can't match
   anything), those of many last. Spark counts, over all documents, the n-grams whose hash is 0 modulo
   ``ONE_IN``; the others come between the rare and the frequent ones. As the prefixes are shorter than
   the part that is counted, most documents' prefixes hold nothing else.
2. Documents with one set are one class, named by a 128-bit hash of the set, so copies are joined once.
3. Prefix, length, positional and signature filters leave candidates, as edges whose components hold all
   similar pairs (``candidates``); nearly all of these edges are links.
4. The sets of a component that fit one task (``MOST`` sets, ``GRAMS`` n-grams) are stored in a trie in the
   global order, frequent n-grams first, so that near copies share long paths. A set walks down the trie with
   the number of n-grams missed so far; a subtree ends when the n-grams missed exceed what the sizes still
   allow, or when all sets under it are in the walking set's own class already.
5. A larger component is cut at random into parts of half that size, which are joined alone; then one set of
   each class that this gives is joined with the others' in the same way. Now most sets share one class, and
   sets of one class need no further comparison. What is left are pairs of parts of different classes, and
   of sizes that are close enough; each is a task of its own.
6. Components of the links found are the classes of documents.

No pair list of a group is emitted: each task gives a spanning forest of its links, or all links if asked.

Null and empty texts have an empty set and are linked with nothing. A text of fewer than n words has one
n-gram, all its words. Rows that share text are linked, whatever their id; a null id doesn't count as the
smallest id of its class, and is null only if all ids are. Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .candidates import HOT, PAIRED, Order, Sets, bloom_of, bucket_count, candidate_edges, grouped, in_bloom_of, keys, needed, order_of, prefix_rows, slices
from .common import connected_components, cut, read, release
from .words import chunks, ngrams, sets, word_hashes

#: Most sets of a task, and n-grams of these; one in so many n-grams is counted to order them all.
MOST, GRAMS, ONE_IN = 4096, 1 << 21, 3


def _sets_of(n: int):
    """Sets of the distinct n-grams of each row; the text is column 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[Sets]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                hashes, bounds, _ = word_hashes(data, offsets)
                grams, at, _ = ngrams(hashes, bounds, n)
                yield Sets(*sets(grams, at))

    return of


class _Node:
    __slots__ = ("path", "children", "ends", "low", "high", "group")

    def __init__(self, path):
        self.path, self.children, self.ends = path, {}, -1
        self.low, self.high, self.group = 1 << 60, 0, None


class Trie:
    """Sets as paths of ranks, with one-child nodes joined. ``groups``: union-find over the sets."""

    def __init__(self, count: int):
        self.root, self.up = _Node(()), list(range(count))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def insert(self, key: int, path: tuple[int, ...]) -> None:
        node, rest, n = self.root, path, len(path)
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if node.group is not None and self.find(node.group) != self.find(key):
                node.group = None
            if not rest:
                node.ends = key
                return
            child = node.children.get(rest[0])
            if child is None:
                child = node.children[rest[0]] = _Node(rest)
                child.ends, child.low, child.high = key, n, n
                return
            p = child.path
            same, most = 1, min(len(p), len(rest))
            while same < most and p[same] == rest[same]:
                same += 1
            if same < len(p):
                mid = _Node(p[:same])
                mid.low, mid.high = child.low, child.high
                child.path = p[same:]
                mid.children[child.path[0]] = child
                node.children[mid.path[0]] = mid
                child = mid
            node, rest = child, rest[same:]

    def _group(self, node: _Node) -> int | None:
        """The one group of all sets under ``node``, if that is known. Groups only merge, so it stays known."""
        if node.group is not None:
            return self.find(node.group)
        seen = self.find(node.ends) if node.ends >= 0 else None
        for child in node.children.values():
            g = self.find(child.group) if child.group is not None else None if child.children else self.find(child.ends)
            if g is None or (seen is not None and g != seen):
                return None
            seen = g
        node.group = seen
        return seen

    def links(self, key: int, path: tuple[int, ...], t: int, every: bool) -> list[int]:
        """Sets stored before that are similar to that of ``path``; with ``every`` all, else one a group."""
        found, stack, members, n = [], [(self.root, 0, 0)], set(path), len(path)
        least, largest = -(-t * n // 100), 100 * n // t
        while stack:
            node, depth, hit = stack.pop()
            low, high = max(node.low, least), min(node.high, largest)
            if low > high or (not every and self._group(node) == self.find(key)):
                continue
            # n-grams of the stored sets that may still be missing in this one
            missed, spare = depth - hit, high - needed(n, high, t)
            for r in node.path:
                if r not in members:
                    missed += 1
                    if missed > spare:
                        break
            if missed > spare:
                continue
            depth += len(node.path)
            hit = depth - missed
            rest = n - bisect_right(path, node.path[-1]) if node.path else n
            if hit + min(rest, high - depth) < needed(n, low, t):
                continue
            if node.ends >= 0 and low <= depth <= high and hit >= needed(n, depth, t) and (every or self.find(node.ends) != self.find(key)):
                found.append(node.ends)
                self.union(key, node.ends)
            stack.extend((c, depth, hit) for c in node.children.values())
        return found


def join_sets(keys: list, arrays: list[np.ndarray], t: int, every: bool = False, second: np.ndarray | None = None, level=None, classes: list | None = None) -> list[tuple]:
    """Links (key, key) of sorted sets; with ``second`` (true for sets of a second run) only across the runs.

    ``level`` gives the places of n-grams in the global order; paths start with the last of it. Sets that
    share a value of ``classes`` are known to be in one class.
    """
    flat = np.concatenate(arrays)
    values, inverse = np.unique(flat, return_inverse=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -(level(values) if level else np.zeros(len(values), np.int64))))] = np.arange(len(values))
    ranks, out, at = rank[inverse], [], 0
    paths = []
    for a in arrays:
        paths.append(np.sort(ranks[at : at + len(a)]))
        at += len(a)
    trie = Trie(len(keys))
    known: dict = {}
    for i, c in enumerate(classes or []):
        if c in known:
            trie.union(i, known[c])
        known.setdefault(c, i)
    by_size = sorted(range(len(keys)), key=lambda i: (len(paths[i]), i))
    if second is not None:
        by_size = [i for i in by_size if not second[i]] + [i for i in by_size if second[i]]
    for i in by_size:
        path = tuple(paths[i].tolist())
        if second is None or second[i]:
            out += [(keys[i], keys[j]) for j in trie.links(i, path, t, every)]
        if second is None or not second[i]:
            trie.insert(i, path)
    return out


def _joined(tasks: DataFrame, order, percent: int, every: bool) -> DataFrame:
    """(a, b): the links that tasks find. ``tasks``: (task, second, across, class, set, words)."""

    def join(batches):
        for _, group in grouped(batches):
            rows = list(group)
            second = np.array([r[0] for r in rows]) if rows[0][1] else None
            found = join_sets([r[3] for r in rows], [np.frombuffer(r[4], np.uint64) for r in rows], percent, every, second, order.value.level, [r[2] for r in rows] if not every else None)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    by_task = tasks.select("task", "second", "across", "class", "set", "words").repartition("task").sortWithinPartitions("task")
    return by_task.mapInArrow(join, "a binary, b binary")


def _alone(sized: DataFrame, name) -> DataFrame:
    """Tasks of whole groups of rows of (set, class, words): ``name`` is the group."""
    return sized.select(name.alias("task"), F.lit(False).alias("second"), F.lit(False).alias("across"), "class", "set", "words")


def _split(rows: DataFrame, by: list[str], most: int, grams: int) -> DataFrame:
    """``rows`` with ``part``: a random cut of each group into parts of about half a task."""
    size = rows.groupBy(*by).agg(F.count("*").alias("__sets"), F.sum("n").alias("__n"))
    size = size.select(*[F.col(c).alias(f"__{c}") for c in by], F.greatest(F.lit(1), F.ceil(2 * F.col("__sets") / most), F.ceil(2 * F.col("__n") / grams)).alias("parts"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return rows.join(size, on).drop(*[f"__{c}" for c in by]).withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")))


def _large(big: DataFrame, order, percent: int, most: int, grams: int, every: bool) -> DataFrame:
    """(a, b): links of the components beyond a task. ``big``: (root, set, n, words)."""
    big, links, label = cut(big), None, F.col("set")
    if not every:
        parts = _split(big.withColumn("class", F.col("set")), ["root"], most, grams)
        links = cut(_joined(_alone(parts, F.concat_ws("/", F.hex("root"), "part")), order, percent, False))
        one = connected_components(links)
        # one set of each class: the class is named by one of its sets
        classes = big.select("root", "set").join(one.select("node", F.col("root").alias("class")), F.col("set") == F.col("node"), "left").select("root", F.coalesce("class", "set").alias("set")).distinct()
        firsts = big.join(classes.select("set"), "set", "left_semi").withColumn("class", F.col("set"))
        parts = _split(firsts, ["root"], most, grams)
        more = cut(_joined(_alone(parts, F.concat_ws("/", F.hex("root"), "part")), order, percent, False))
        links = links.unionByName(more)
        one = connected_components(links).select("node", F.col("root").alias("class"))
        big = cut(big.join(one, F.col("set") == F.col("node"), "left").withColumn("class", F.coalesce("class", "set")).drop("node"))
    else:
        big = big.withColumn("class", F.col("set"))
    # a class that fills parts of its own has them for itself; the others of a component share theirs
    step = math.log(100 / percent) * 1.0001  # no rounding may part two sizes that go together
    big = big.withColumn("cell", F.floor(F.log(F.col("n").cast("double")) / step))
    wide = big.groupBy("root", "class").agg(F.count("*").alias("sets"), F.sum("n").alias("total")).filter((F.col("sets") >= most // 2) | (F.col("total") >= grams // 2)).select(F.col("root").alias("r"), F.col("class").alias("whole"))
    big = big.join(wide, (F.col("root") == F.col("r")) & (F.col("class") == F.col("whole")), "left").drop("r")
    big = cut(_split(big, ["root", "whole", "cell"], most, grams))
    runs = big.select("root", "whole", "cell", "part").distinct().withColumn("run", F.xxhash64("root", "whole", "cell", "part"))
    other = runs.select("root", F.col("whole").alias("whole2"), F.col("cell").alias("cell2"), F.col("run").alias("run2"))
    # next cells only: sizes two cells apart differ by more than the Jaccard index allows
    pairs = runs.withColumn("cell2", F.explode(F.array(F.col("cell"), F.col("cell") + 1))).join(other, ["root", "cell2"])
    pairs = pairs.filter(((F.col("cell") < F.col("cell2")) | (F.col("run") < F.col("run2"))) & ~F.coalesce(F.col("whole") == F.col("whole2"), F.lit(False)))
    both = pairs.select(F.xxhash64("run", "run2").alias("task"), F.explode(F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("second")), F.struct(F.col("run2").alias("run"), F.lit(True).alias("second")))).alias("x"))
    rows = big.withColumn("run", F.xxhash64("root", "whole", "cell", "part"))
    across = rows.join(both.select("task", "x.*"), "run").select("task", "second", F.lit(True).alias("across"), "class", "set", "words")
    # what shares a part is joined there, unless it is one class
    own = _alone(rows.filter("whole is null"), F.col("run"))
    last = _joined(across.unionByName(own), order, percent, every)
    return last if links is None else links.unionByName(last)


def _words_of(src: DataFrame, sets_of, wanted: DataFrame) -> DataFrame:
    """(set, words) of the wanted sets, each once; a filter of fixed size spares most other sets the shuffle."""
    shared = src.sparkSession.sparkContext.broadcast(bloom_of(wanted.select("h")))

    def bring(batches):
        for batch in slices(batches):
            seen: dict[bytes, bytes] = {}
            for own in sets_of(iter([batch])):
                h, s, _ = own.ids()
                keep = np.flatnonzero(in_bloom_of(shared.value, h) & (own.sizes > 0))
                for k, i in zip(keys(h[keep], s[keep]).to_pylist(), keep.tolist(), strict=True):
                    if k not in seen:
                        seen[k] = own.one(i).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], ["set", "words"])

    return src.select("text").mapInArrow(bring, "set binary, words binary").join(wanted.select("set"), "set", "left_semi").dropDuplicates(["set"])


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, every: bool = False, order: Order | None = None, grams: int = GRAMS, hot: int = HOT, paired: int = PAIRED, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n_shingles, component_id, is_first) a row a document, (a, b) links between classes by their set's name).

    Documents link when the Jaccard index of their n-gram sets is ``percent`` hundredths or more.
    ``component_id`` is the smallest id that links reach. ``is_first`` marks the rows of a component with the
    smallest id, null last, and of these with the smallest columns of ``keep``, which are in the first frame too;
    a row with an empty set is alone. With ``every``, the second frame has all links between different sets, else
    a spanning forest of them.
    """
    spark, sets_of = docs.sparkSession, _sets_of(n)
    src = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in keep]).alias("kept"))
    order = order or order_of(src.select("text"), sets_of, ONE_IN)

    def name(batches):
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(0)):
                own = next(sets_of(iter([batch.slice(first, end - first)])))
                h, s, _ = own.ids()
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in batch.columns[1:]), pa.array(own.sizes), keys(h, s), pa.array(h.view(np.int64))], ["id", "kept", "n", "set", "h"])

    rows = cut(src.mapInArrow(name, src.drop("text").schema.add("n", T.LongType()).add("set", T.BinaryType()).add("h", T.LongType())))
    edges = cut(candidate_edges(prefix_rows(src, sets_of, order, percent, hot, paired), percent, bucket_count(order)))
    near = connected_components(edges)
    del edges  # its plan holds the shuffle of the prefix rows
    release(spark)
    near = cut(near.join(rows.groupBy("h", "set").agg(F.min("n").alias("n")), F.col("node") == F.col("h")).select("root", "h", "set", "n"))
    sizes = cut(near.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("total")))
    ready = near.drop("h").join(_words_of(src, sets_of, near), "set").join(sizes, "root")
    fits = (F.col("sets") <= most) & (F.col("total") <= grams)
    shared = spark.sparkContext.broadcast(order)
    large = sizes.filter(~fits).limit(1).count()
    if large:
        ready = cut(ready)
    links = _joined(_alone(ready.filter(fits).withColumn("class", F.col("set")), F.hex("root")), shared, percent, every)
    links = cut(links.unionByName(_large(ready.filter(~fits).select("root", "set", "n", "words"), shared, percent, most, grams, every)) if large else links)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "kept")
    classes = rows.filter("n > 0").groupBy("set").agg(F.min(place).alias("low"))
    labelled = classes.join(connected_components(links), F.col("set") == F.col("node"), "left").select("set", "low", F.coalesce("root", "set").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("low").alias("first"))
    answer = cut(labelled.join(lowest, "root").select("set", "first"))
    full = F.col("n") > 0
    out = rows.join(answer, "set", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(full, F.col("first.id")).otherwise(F.col("id")).alias("component_id"),
        (~full | ((F.col("first.id").eqNullSafe(F.col("id"))) & (F.col("first.kept") == F.col("kept")))).alias("is_first"), *[F.col(f"kept.`{c}`").alias(c) for c in keep]
    )
    return out, links


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id): three words, 0.9."""
    return jaccard_components(read(spark, sf_dir, "documents"), n=3, percent=90)[0].drop("is_first")


#: For ids that are unique and not null.
OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), c AS (
  SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, c.root FROM c JOIN e ON c.doc_id = e.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.root) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""
