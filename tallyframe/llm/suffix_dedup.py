"""Removal of long repeated passages by suffix arrays in a logarithmic family of levels.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller id. Which
strings do is decided by a ``SuffixFamily``: batches of suffixes, in the order of their documents, are sorted,
scanned against the levels there are, and become a level; levels of equal rank are merged.

So that Spark can deal the suffixes out, each ``length``-byte string is addressed by its anchor, the k-byte
string in it with the least hash (the first of equal ones). Equal strings have equal anchors, and the strings in a
row that share an anchor are one segment of a text, of at most ``2 * length - k`` bytes. Three passes over the
texts, kept packed in chunks of bounded size in the shared folder:

1. every chunk sends its distinct anchors to the regions of the hash; a region replies which it got twice,
2. every chunk sends the distinct segments with such anchors, each with its smallest id; a region collapses equal
   segments, sends those of anchors with different ones through a family, and replies a bit a string,
3. every chunk takes out what is covered.

Chunk and region sizes follow the input (``span``), so there are at most as many packets as bytes over 4 KB
up to some 16 TB, and tasks hold a chunk or a region. An anchor with ``HOT`` occurrences, in other words next to
it each time, would make its region large: its strings are sent one by one, addressed by their own hash. A
passage that many documents share is sent once a chunk.

Anchors and equal segments are told by hashes of 64 and 128 bits, strings in the family by their bytes. A null or
empty text has no bytes; one under ``length`` bytes keeps all. A null id is larger than any other; rows that
share an id, null too, don't lose bytes to each other. Columns other than the two named aren't read. An empty
table gives no rows.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, release
from .words import buffers, mix

LENGTH = 50
#: Least and most bytes of a chunk and of a region, occurrences from which an anchor's strings go one by one, and strings of a batch.
SMALL, LARGE, HOT, BATCH = 4 << 20, 256 << 20, 65_536, 16_384
_PIECE = 1 << 15
_PLACE = np.uint64((1 << 20) - 1)
_LATE = (1 << 63) - 1
#: Stands for the anchor of a string that is sent by itself.
_ALONE = 255

CHUNK = "chunk long, ids binary, nulls binary, sizes binary, text binary, segments binary"


def span(total: int) -> int:
    """Bytes of a chunk and of a region for ``total`` bytes of text: packets of about 4 KB, within bounds."""
    return min(LARGE, max(SMALL, math.isqrt(total * 4096)))


def anchor_bytes(length: int) -> int:
    return max(8, length // 2 - 1, length - 60)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


def _fold(words: list[np.ndarray]) -> np.ndarray:
    h = words[0] * np.uint64(0x9E3779B97F4A7C15)
    for w in words[1:]:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _grams(words: np.ndarray, k: int, at: np.ndarray | slice) -> np.ndarray:
    """Hashes of the k-byte strings at ``at`` (a slice from 0, or places)."""
    offsets = [*range(0, k - 7, 8)] + ([k - 8] if k % 8 else [])
    if isinstance(at, slice):
        return _fold([words[o : at.stop + o] for o in offsets])
    return _fold([words[at + o] for o in offsets])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    s = 1
    while 2 * s <= width:
        v = np.minimum(v[:-s], v[s:])
        s *= 2
    return np.minimum(v[: len(v) - (width - s)], v[width - s :]) if s < width else v


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string's place, strings, anchor's distance from the first place) of the segments of texts one after the other."""
    k, starts, counts, anchors = anchor_bytes(length), [], [], []
    ends = offsets[1:]
    for p in range(0, len(data) - length + 1, _PIECE):
        part = data[p : p + _PIECE + length - 1]
        n = len(part) - length + 1
        words = _words(part)
        grams = len(part) - k + 1
        v = (_grams(words, k, slice(0, grams)) * np.uint64(0xD6E8FEB86659FD93)) & ~_PLACE
        v |= np.arange(grams, dtype=np.uint64)
        at = (_least(v, length - k + 1) & _PLACE).astype(np.int64)
        inside = np.ones(n + 1, bool)
        inside[n] = False
        near = ends[np.searchsorted(ends, p, "right") : np.searchsorted(ends, p + n + length, "right")]
        if len(near):
            over = np.zeros(n + 1, np.int64)
            np.add.at(over, np.clip(near - length + 1 - p, 0, n), 1)
            np.add.at(over, np.clip(near - p, 0, n), -1)
            inside[:n] = np.cumsum(over)[:n] == 0
        edge = np.ones(n + 1, bool)
        edge[1:n] = (at[1:] != at[:-1]) | ~inside[: n - 1]
        edge |= ~inside
        stops = np.flatnonzero(edge)
        own = np.flatnonzero(inside[stops[:-1]])
        first = stops[own]
        starts.append(first + p)
        counts.append(stops[own + 1] - first)
        anchors.append(at[first] - first)
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(anchors)


def _zip(x: np.ndarray, level: int = 1) -> bytes:
    return pa.Codec("zstd", level).compress(np.ascontiguousarray(x).tobytes(), asbytes=True)


def _unzip(x: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)


class Chunk:
    """Some documents' texts one after the other, and their segments."""

    def __init__(self, row: dict, length: int):
        self.length, self.number = length, row["chunk"]
        self.ids, self.nulls = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
        self.data = _unzip(row["text"], int(self.offsets[-1]))
        n = int(np.frombuffer(row["segments"][:8], np.int64)[0])
        packed = _unzip(row["segments"][8:], 6 * n)
        self.count, self.anchor = packed[4 * n : 5 * n].astype(np.int64), packed[5 * n :].astype(np.int64)
        gap = packed[: 4 * n].view(np.uint32).astype(np.int64)
        self.start = np.cumsum(gap + np.concatenate([[0], self.count[:-1]])[:n])
        self.words = _words(self.data) if len(self.data) >= 8 else np.zeros(0, np.uint64)
        self.key = mix(_grams(self.words, anchor_bytes(length), self.start + self.anchor)) if n else np.zeros(0, np.uint64)
        self.doc = self.ids[np.searchsorted(self.offsets, self.start, "right") - 1]

    @staticmethod
    def row(number: int, ids: list[np.ndarray], nulls: list[np.ndarray], sizes: list[np.ndarray], texts: list[np.ndarray], length: int) -> tuple:
        data, size = np.concatenate([np.zeros(0, np.uint8), *texts]), np.concatenate([np.zeros(0, np.int64), *sizes])
        start, count, anchor = segments(data, np.concatenate([[0], np.cumsum(size)]), length)
        gap = np.diff(start, prepend=0) - np.concatenate([[0], count[:-1]])[: len(start)]  # mostly none
        packed = np.concatenate([gap.astype(np.uint32).view(np.uint8), count.astype(np.uint8), anchor.astype(np.uint8)])
        return number, np.concatenate(ids).tobytes(), np.concatenate(nulls).tobytes(), size.tobytes(), _zip(data, 6), np.int64(len(start)).tobytes() + _zip(packed)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors in order, their occurrences (up to 127, plus 128 if documents of two ids have it), and each segment's place among them."""
        order = np.argsort(self.key, kind="stable")
        key = self.key[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        if not len(first):
            return key, np.zeros(0, np.uint8), first
        doc, n = self.doc[order], np.diff(np.append(first, len(key)))
        shared = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        which = np.empty(len(key), np.int64)
        which[order] = np.repeat(np.arange(len(first)), n)
        return key[first], (np.minimum(n, 127) + 128 * shared).astype(np.uint8), which

    def entries(self, state: np.ndarray, which: np.ndarray) -> Entries:
        """The distinct segments whose anchor's state is 1, and the distinct strings of those where it is 2."""
        own = state[which]
        one, hot = np.flatnonzero(own == 1), np.flatnonzero(own == 2)
        n = self.count[hot]
        of = np.repeat(hot, n)
        at = self.start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return Entries(self, np.concatenate([self.start[one], at]), np.concatenate([self.count[one], np.ones(len(of), np.int64)]), np.concatenate([self.doc[one], self.doc[of]]), self.key[one], np.concatenate([self.anchor[one], np.full(len(of), _ALONE)]))


def content_hash(words: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """A hash of the ``size`` bytes (8 to ``most``) from each start on."""
    return mix(_fold([words[start + np.minimum(o, size - 8)] for o in [*range(0, most, 8)]]) + size.astype(np.uint64))


class Entries:
    """Occurrences of what a chunk sends; ``first`` are the distinct ones, in the order of their keys, each with its smallest id."""

    def __init__(self, chunk: Chunk, start: np.ndarray, count: np.ndarray, doc: np.ndarray, key: np.ndarray, anchor: np.ndarray):
        size = count + chunk.length - 1
        content = content_hash(chunk.words, start, size, 2 * chunk.length - anchor_bytes(chunk.length)) if len(start) else np.zeros(0, np.uint64)
        key = np.concatenate([key, content[len(key) :]])
        order = np.lexsort((doc, content, key))
        k, c = key[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        self.order, self.first = order, order[new]
        self.which = np.cumsum(new) - 1  # of the occurrences in order
        self.start, self.count, self.doc, self.key, self.anchor, self.size = start, count, doc, key, anchor, size

    def marked(self, bits: np.ndarray, length: int, n_bytes: int) -> np.ndarray:
        """Which bytes go, from the region's bits of each distinct entry; an occurrence in a later document than the first goes whole."""
        start, count = self.start[self.order], self.count[self.order]
        whole = self.doc[self.order] > self.doc[self.first][self.which]
        edges = np.zeros(n_bytes + 1, np.int64)
        np.add.at(edges, start[whole], 1)
        np.subtract.at(edges, start[whole] + count[whole] - 1 + length, 1)
        bits = np.where(whole, 0, bits[self.which])
        for j in range(int(count.max()) if len(count) else 0):
            p = start[(bits >> np.uint64(j)) & np.uint64(1) == 1] + j
            np.add.at(edges, p, 1)
            np.subtract.at(edges, p + length, 1)
        return np.cumsum(edges)[:-1] > 0


class SuffixFamily:
    """Sorted suffixes, by their first ``length`` bytes, in levels whose sizes double; batches come in the order of their documents."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        #: (rank, sorted strings, the first document of each); ranks fall from the first level on.
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []

    def add(self, text: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The first document, of this batch and those before, that has the string at each of the places ``at``."""
        strings = np.empty((len(at), self.length + 1), np.uint8)
        strings[:, : self.length] = np.lib.stride_tricks.sliding_window_view(text, self.length)[at]
        strings[:, self.length] = 1  # so that zeros at the end count
        strings = strings.view(f"S{self.length + 1}").ravel()
        array = np.argsort(strings, kind="stable")  # the suffix array of the batch; equal ones in the order of documents
        strings = strings[array]
        new = np.ones(len(array), bool)
        new[1:] = strings[1:] != strings[:-1]
        strings, found = strings[new], doc[array][new]
        there = np.zeros(len(strings), bool)
        for _, known, docs in self.levels:
            p = np.minimum(np.searchsorted(known, strings), len(known) - 1)
            same = known[p] == strings
            found = np.where(same, np.minimum(found, docs[p]), found)
            there |= same
        out = np.empty(len(at), np.int64)
        out[array] = found[np.cumsum(new) - 1]
        if not there.all():
            self._keep(0, strings[~there], found[~there])
        return out

    def _keep(self, rank: int, strings: np.ndarray, docs: np.ndarray) -> None:
        while self.levels and self.levels[-1][0] <= rank:
            _, s, d = self.levels.pop()
            strings = np.concatenate([s, strings])
            order = np.argsort(strings, kind="stable")  # two runs in order
            strings, docs, rank = strings[order], np.concatenate([d, docs])[order], rank + 1
        self.levels.append((rank, strings, docs))


def region_bits(anchor: np.ndarray, count: np.ndarray, doc: np.ndarray, text: np.ndarray, length: int, batch: int = BATCH) -> np.ndarray:
    """For each entry of a region a bit for each of its strings: whether a smaller id has it.

    ``anchor`` is the place of the anchor in each, or ``_ALONE``; ``text`` holds the entries' bytes in a row.
    """
    size, words, k = count + length - 1, _words(text), anchor_bytes(length)
    start = np.cumsum(size) - size
    content = content_hash(words, start, size, 2 * length - k)
    alone = anchor == _ALONE
    key = np.where(alone, content, mix(_grams(words, k, start + np.where(alone, 0, anchor))))
    order = np.lexsort((doc, content, key))
    k, c, d = key[order], content[order], doc[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= c[1:] != c[:-1]
    which = np.cumsum(new) - 1
    first = order[new]  # of equal segments one with the smallest id
    variants = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))
    several = first[np.repeat(variants, variants) > 1]
    bits = np.zeros(len(anchor), np.uint64)
    several = several[np.argsort(doc[several], kind="stable")]
    family, ends = SuffixFamily(length), np.cumsum(count[several])
    a = 0
    while a < len(several):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + batch, "right")))
        own, n = several[a:b], count[several[a:b]]
        of = np.repeat(own, n)
        j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        earlier = family.add(text, start[of] + j, doc[of]) < doc[of]
        bits[own] = np.bitwise_or.reduceat(earlier.astype(np.uint64) << j.astype(np.uint64), np.cumsum(n) - n)
        a = b
    out = np.empty(len(key), np.uint64)
    every = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
    out[order] = np.where(d > doc[first][which], every[order], bits[first][which])
    return out


def _slices(key: np.ndarray, regions: int) -> tuple[np.ndarray, np.ndarray]:
    """The regions that sorted keys are in, and the bounds of each."""
    region = ((key >> np.uint64(32)) * np.uint64(regions) >> np.uint64(32)).astype(np.int64)
    at = np.searchsorted(region, np.arange(regions + 1))
    some = np.flatnonzero(np.diff(at))
    return some, np.append(at[some], len(key))


def _short(key: np.ndarray) -> np.ndarray:
    """The lower 40 bits, which with the region, told by the upper ones, tell anchors apart; two that are taken for one only make work."""
    return np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :5]).view(np.dtype(("V", 5))).ravel()


def _cells(x: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of runs of an array."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * x.itemsize).astype(np.int32)), pa.py_buffer(x.view(np.uint8))])


def _joined(column: pa.ChunkedArray, kind: type | np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a binary column, and how many each has."""
    data, offsets = buffers(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def _let_go(spark: SparkSession) -> None:
    """Releases used shuffles and gives Spark's cleaner, which works beside, time to remove their files."""
    for _ in range(2):
        release(spark)
        time.sleep(1)


def _packed(docs: DataFrame, id_col: str, text_col: str, length: int, size: int) -> DataFrame:
    """Chunks of documents of about ``size`` bytes of text; a longer text is one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nulls, sizes, texts, held, n = [], [], [], [], 0, 0
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        names = ["chunk", "ids", "nulls", "sizes", "text", "segments"]

        def out() -> pa.RecordBatch:
            row = Chunk.row((TaskContext.get().partitionId() << 32) + n, ids, nulls, sizes, texts, length)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            missing = np.asarray(batch.column(0).is_null())
            doc = batch.column(0).fill_null(_LATE).to_numpy(zero_copy_only=False)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size - held, "right")) - 1)
                ids.append(doc[a:b].copy())
                nulls.append(missing[a:b].copy())
                sizes.append(np.diff(offsets[a : b + 1]))
                texts.append(data[offsets[a] : offsets[b]].copy())
                held += int(offsets[b] - offsets[a])
                if held >= size or b < batch.num_rows:
                    yield out()
                    ids, nulls, sizes, texts, held, n = [], [], [], [], 0, n + 1
                a = b
        if ids:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(pack, CHUNK)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, size: int | None = None, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept), a row for each row of ``docs``.

    ``spans`` are the places (start, end) of the UTF-8 bytes that go, ``kept`` is what is left, which may cut a
    character. ``size`` sets the bytes of a chunk and of a region, and decides the work only.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    size = size or span(total)
    regions = max(1, -(-total // size))
    chunks = cut(_packed(docs, id_col, text_col, length, size))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                key, seen, _ = Chunk(row, length).anchors()
                region, bounds = _slices(key, regions)
                yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(np.full(len(region), row["chunk"])), _cells(_short(key), bounds), _cells(seen, bounds)], ["region", "chunk", "keys", "seen"])

    def twice(packets: pa.Table) -> pa.Table:
        """Of each anchor sent: 0 if one document has it, 1 if more may, 2 if its strings have to go one by one."""
        short, sizes = _joined(packets.column("keys"), np.dtype(("V", 5)))
        key = np.zeros((len(short), 8), np.uint8)
        key[:, :5] = short.view(np.uint8).reshape(-1, 5)
        key = key.view(np.uint64).ravel()
        seen, _ = _joined(packets.column("seen"), np.uint8)
        order = np.argsort(key)
        k = key[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        first = np.flatnonzero(new)
        times = np.add.reduceat((seen[order] & 127).astype(np.int64), first)
        shared = (np.diff(np.append(first, len(k))) > 1) | (np.maximum.reduceat(seen[order], first) > 127)
        state = np.empty(len(k), np.uint8)
        state[order] = np.where(shared, np.where(times >= hot, 2, 1), 0).astype(np.uint8)[np.cumsum(new) - 1]
        ends = np.cumsum(sizes)
        return pa.table({"chunk": packets.column("chunk"), "turn": pa.array(np.ones(len(sizes), np.int32)), "region": packets.column("region"), "n": pa.array(sizes), "reply": pa.array([_zip(state[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary())})

    reply = "chunk long, turn int, region long, n long, reply binary"
    states = cut(chunks.mapInArrow(send_anchors, "region long, chunk long, keys binary, seen binary").groupBy("region").applyInArrow(twice, reply))
    _let_go(spark)

    def replies(right: pa.Table, turn: int, kind: type) -> np.ndarray:
        rows = sorted((r for r in right.to_pylist() if r["turn"] == turn), key=lambda r: r["region"])
        return np.concatenate([np.zeros(0, kind), *[_unzip(r["reply"], r["n"] * np.dtype(kind).itemsize).view(kind) for r in rows]])

    def again(left: pa.Table, right: pa.Table) -> tuple[Chunk, Entries]:
        chunk = Chunk(left.to_pylist()[0], length)
        return chunk, chunk.entries(replies(right, 1, np.uint8), chunk.anchors()[2])

    def send_segments(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, e = again(left, right)
        f = e.first
        region, bounds = _slices(e.key[f], regions)
        size = e.size[f]
        ends = np.concatenate([[0], np.cumsum(size)])
        text = chunk.data[np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(e.start[f], size)]
        at = ends[bounds]
        return pa.table({
            "region": pa.array(region), "chunk": pa.array(np.full(len(region), chunk.number)), "anchors": _cells(e.anchor[f].astype(np.uint8), bounds), "counts": _cells(e.count[f].astype(np.uint8), bounds), "docs": _cells(e.doc[f], bounds),
            "n_bytes": pa.array(np.diff(at)), "text": pa.array([_zip(text[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
        })

    def compare(packets: pa.Table) -> pa.Table:
        anchor, sizes = _joined(packets.column("anchors"), np.uint8)
        count = _joined(packets.column("counts"), np.uint8)[0].astype(np.int64)
        doc = _joined(packets.column("docs"), np.int64)[0]
        text = np.concatenate([_unzip(t.as_py(), n.as_py()) for t, n in zip(packets.column("text"), packets.column("n_bytes"), strict=True)])
        bits, ends = region_bits(anchor.astype(np.int64), count, doc, text, length, batch), np.cumsum(sizes)
        return pa.table({"chunk": packets.column("chunk"), "turn": pa.array(np.full(len(sizes), 2, np.int32)), "region": packets.column("region"), "n": pa.array(sizes), "reply": pa.array([_zip(bits[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary())})

    by_chunk = chunks.groupBy("chunk").cogroup(states.groupBy("chunk"))
    packets = by_chunk.applyInArrow(send_segments, "region long, chunk long, anchors binary, counts binary, docs binary, n_bytes long, text binary")
    bits = cut(packets.groupBy("region").applyInArrow(compare, reply))
    del by_chunk, packets
    _let_go(spark)

    def take_out(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, e = again(left, right)
        gone = e.marked(replies(right, 2, np.uint64), length, len(chunk.data))
        off = chunk.offsets
        before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        head = off[:-1][off[:-1] < len(gone)]
        before[head] = False
        starts = np.flatnonzero(gone & ~before)
        after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
        after[off[1:][off[1:] > 0] - 1] = False
        ends = np.flatnonzero(gone & ~after) + 1
        row = np.searchsorted(off, starts, "right") - 1
        bounds = np.searchsorted(starts, off)
        spans = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts - off[row]), pa.array(ends - off[row])], ["start", "end"]))
        left_over = np.concatenate([[0], np.cumsum(~gone)])[off]
        kept = _cells(chunk.data[~gone], left_over)
        return pa.table({"doc_id": pa.array(chunk.ids, mask=chunk.nulls), "n_bytes": pa.array(np.diff(off)), "spans": spans, "kept": kept})

    told = states.unionByName(bits)
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(take_out, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS MATERIALIZED (
  SELECT r, k, p, unhex(substr(h, 2 * p + 1, 100)) AS s FROM (SELECT r, k, h, unnest(range(length(h) // 2 - 49)) AS p FROM d)
), f AS (
  SELECT s, min(k) AS first FROM w GROUP BY s HAVING min(k) < max(k)
), m AS (
  SELECT r, p, p + 50 AS e FROM w JOIN f USING (s) WHERE k > first
), g AS (
  SELECT r, p, e, coalesce(p > max(e) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM m
), i AS (
  SELECT r, p, e, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS n FROM g
), span AS (
  SELECT r, n, min(p) AS a, max(e) AS b FROM i GROUP BY r, n
), part AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span
), gone AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM part JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
