"""Candidates of an exact set-similarity self-join: prefix, length, positional and signature filters.

Sets are sorted arrays of 64-bit token hashes, made from texts in the tasks. All tokens have one global order,
rare first, by the number of sets that hold them (``order_of``). Any total order gives the same result; what
tasks are sent of it has a fixed size whatever the input: a Bloom filter of the tokens in more than one set,
and the counts of about the ``HEAVY`` most frequent ones. A filter that has filled up only costs time.

1. Two sets with a Jaccard index of t or more share one of the first n - ceil(t n) + 1 tokens in that order
   (n of them in the set). Each of these that other sets have sends a row of bounded size (token, set, n,
   place, signature), packed with others of its bucket (``prefix_rows``).
2. A token in ``hot`` sets or more is cut into parts of that many; a row goes to its part's group with each
   part, so that every two parts meet in a group of bounded size. From ``PAIRED`` times that on, the key is
   the token with a later one: sets that differ and match share at least two tokens, and if the first is that
   frequent, so is the second; both are among the first n - ceil(t n) + 2. Such keys are far rarer, and need
   parts only for each ``PAIRED`` times ``hot`` sets.
3. Inside a group the length filter (sizes within t), the positional filter (what is left of both sets from
   the first token they share on) and the signature filter (``parities``) leave candidates; the group gives a forest that spans
   them (``forest``), not pairs. The components of these edges hold all matching pairs. As the signature
   bounds the tokens in which two sets differ, edges between sets that don't match are few, so components
   stay about as large as those of the matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import by_level, chunks, mix

#: Fixed sizes of what tasks are sent.
BLOOM_BITS, HEAVY, SLOTS = 1 << 26, 200_000, 1 << 20
#: Parts of the Bloom filter, each filled by one reducer, and tokens that a task gathers before it sends them.
REGIONS, GATHER = 1024, 1 << 21
#: Sets of a token from which it is cut into parts, and how many times that for two tokens to be the key.
HOT, PAIRED = 4096, 32
#: Tokens of the corpus for each bucket of prefix rows, about a fifth of them are in prefixes; and buckets of a task.
BUCKET, PER_TASK = 250_000, 32
#: Bytes of text whose rows are packed at once, and prefix rows of a bucket from which copies are taken out on the way.
PACK, ROWS = 1 << 23, 200_000
#: Rows of whole groups that are joined at once, and edges that a task gathers before it sends a forest of them.
RUN, EDGES = 1 << 16, 1 << 19


class Sets:
    """Sorted distinct tokens of a run of sets, one after the other, with the bounds of the sets."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        self.words, self.at = words, at

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def ids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A 64-bit hash of each set and the two words of its signature of 128 bits; zeros for empty sets."""
        full = np.flatnonzero(self.sizes)

        def total(x: np.ndarray, op) -> np.ndarray:
            out = np.zeros(len(self.at) - 1, np.uint64)
            if len(full):
                out[full] = op.reduceat(x, self.at[full])
            return out

        h = mix(total(mix(self.words + np.uint64(0x632BE59BD9B4E019)), np.add) + self.sizes.astype(np.uint64))
        bit = (self.words >> np.uint64(53)) & np.uint64(127)
        one = np.uint64(1) << (bit & np.uint64(63))
        return h, total(np.where(bit < 64, one, np.uint64(0)), np.bitwise_xor), total(np.where(bit < 64, np.uint64(0), one), np.bitwise_xor)

    def one(self, i: int) -> np.ndarray:
        return self.words[self.at[i] : self.at[i + 1]]


#: Takes batches whose column 0 is text; gives the sets of runs of their rows.
SetsOf = Callable[[Iterator[pa.RecordBatch]], Iterator[Sets]]


def needed(a, b, t: int):
    """Least intersection of sets of ``a`` and ``b`` tokens with 100 * intersection >= t * union."""
    return -(-t * (a + b) // (100 + t))


def width(n: int) -> int:
    """Bits of the signature of a set of ``n`` tokens: the power of two from ``n`` on, between 64 and 2048."""
    return min(max(64, 1 << (n - 1).bit_length()), 2048)


def extra(n: np.ndarray) -> np.ndarray:
    """64-bit words of a signature wider than 64 bits."""
    return np.array([0, 2, 4, 8, 16, 32])[np.searchsorted([64, 128, 256, 512, 1024], n)]


def parities(words: np.ndarray, bits: int) -> np.ndarray:
    """For each of ``bits`` classes of tokens whether the set has an odd number of them, packed in 64-bit words.

    Two sets differ in at least as many tokens as their signatures in bits. Exclusive or of the halves of a
    signature gives that of half the bits.
    """
    n = np.bincount(((words >> np.uint64(53)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((n & 1).astype(bool), bitorder="little").view(np.uint64)


def keys(h: np.ndarray, s: np.ndarray) -> pa.Array:
    """16-byte names of sets: the set's hash and the first half of its signature."""
    return binary(np.column_stack([h, s]).tobytes(), 16 * np.arange(len(h) + 1))


def binary(raw: bytes, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``PACK`` bytes of text, however long a batch's texts are."""
    for batch in batches:
        for first, end, _, _ in chunks(batch.column(0), PACK):
            yield batch.slice(first, end - first)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, iterator over the other columns' values, row by row) of rows that are sorted by column 0.

    The iterator of a group has to be used up before the next one is asked for.
    """

    def rows():
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    todo = rows()
    row = next(todo, None)

    while row is not None:
        now = row[0]

        def own():
            nonlocal row
            while row is not None and row[0] == now:
                yield row[1:]
                row = next(todo, None)

        yield now, own()


# The order of tokens


def _scatter(h: np.ndarray) -> np.ndarray:
    """A one-to-one image of token hashes that the order is kept by; the upper bits name the region."""
    return mix(h ^ np.uint64(0x5851F42D4C957F2D))


def _region(m: np.ndarray) -> np.ndarray:
    return (m >> np.uint64(54)).astype(np.int64)


def _places(m: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bits of each token in the Bloom filter, both in the token's region."""
    own = np.uint64(bits // REGIONS - 1)
    return [_region(m) * (bits // REGIONS) + ((m >> np.uint64(k)) & own).astype(np.int64) for k in (0, 22)]


def in_bloom(bloom: np.ndarray, m: np.ndarray) -> np.ndarray:
    a, b = _places(m, 8 * len(bloom))
    return (bloom[a >> 3] >> (a & 7).astype(np.uint8)) & (bloom[b >> 3] >> (b & 7).astype(np.uint8)) & 1


def bloom_of(hashes: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of the 64-bit column 0 of ``hashes``; ``bits`` bits whatever their number."""

    def words(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_places(_scatter(batch.column(0).to_numpy().view(np.uint64)), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["word", "bit"])

    bloom = np.zeros(bits >> 6, np.int64)
    for part in hashes.mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():
        bloom[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return bloom.view(np.uint8)


def in_bloom_of(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    return in_bloom(bloom, _scatter(h)).astype(bool)


class Order:
    """The order of tokens as tasks see it: ``level`` 0 for one set only, 1 for rare, 2 for not counted, more for frequent."""

    def __init__(self, bloom: np.ndarray, heavy: np.ndarray, count: np.ndarray, one_in: int, total: int):
        self.bloom, self.heavy, self.count, self.one_in = bloom, heavy, count, one_in
        self.total = total  # tokens of sets that are in other sets too
        # a slot by the lower bits holds the most frequent token that has these; others are searched for
        slot = (heavy & np.uint64(SLOTS - 1)).astype(np.int64)
        by = np.argsort(count, kind="stable")
        self.slot = np.full(SLOTS, -1, np.int32)
        self.slot[slot[by]] = by

    def level(self, h: np.ndarray) -> np.ndarray:
        if self.one_in > 1:
            known = np.flatnonzero(h % np.uint64(self.one_in) == 0)
            out = np.full(len(h), 2, np.int64)
            out[known] = self._level(_scatter(h[known]))
            return out
        return self._level(_scatter(h))

    def _level(self, m: np.ndarray) -> np.ndarray:
        if not len(self.heavy):
            return in_bloom(self.bloom, m).astype(np.int64)
        i = self.slot[(m & np.uint64(SLOTS - 1)).astype(np.int64)]
        level = np.where(self.heavy[i] == m, self.count[i], 0)
        rest = np.flatnonzero(level == 0)
        rest = rest[in_bloom(self.bloom, m[rest]).astype(bool)]
        m = m[rest]
        i = np.minimum(np.searchsorted(self.heavy, m), len(self.heavy) - 1)
        level[rest] = np.where(self.heavy[i] == m, self.count[i], 1)
        return level


def order_of(src: DataFrame, sets_of: SetsOf, one_in: int = 1, bits: int = BLOOM_BITS, heavy: int = HEAVY) -> Order:
    """Counts in how many sets each token is, copies counted, and gathers the fixed-size summary of it.

    With ``one_in``, only tokens whose hash is 0 modulo it are counted. Tasks send their counts packed by
    region; the region's reducer adds them and fills its part of the filter. Of its most frequent tokens it
    gives twice its share of ``heavy``.
    """

    def packed(gathered: list[np.ndarray]) -> pa.RecordBatch:
        m, n = np.unique(_scatter(np.concatenate(gathered)), return_counts=True)
        first = np.searchsorted(_region(m), np.arange(REGIONS + 1))
        some = np.flatnonzero(np.diff(first))
        ends = np.append(first[some], len(m))
        return pa.RecordBatch.from_arrays([pa.array(some), binary(m.tobytes(), 8 * ends), binary(n.astype(np.int32).tobytes(), 4 * ends)], ["region", "m", "n"])

    def send(batches):
        gathered, n = [], 0
        for sets in sets_of(batches):
            words = sets.words if one_in == 1 else sets.words[sets.words % np.uint64(one_in) == 0]
            gathered.append(words)
            n += len(words)
            if n >= GATHER:
                yield packed(gathered)
                gathered, n = [], 0
        if n:
            yield packed(gathered)

    def added(ms: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        m, inverse = np.unique(np.concatenate(ms), return_inverse=True)
        return m, np.bincount(inverse, weights=np.concatenate(ns), minlength=len(m)).astype(np.int64)

    def count(batches):
        for region, blobs in grouped(batches):
            ms, ns, size, kept = [], [], 0, 0
            for m, n in blobs:
                ms.append(np.frombuffer(m, np.uint64))
                ns.append(np.frombuffer(n, np.int32))
                size += len(ms[-1])
                if size > 2 * kept + ROWS:
                    m, n = added(ms, ns)
                    ms, ns, size, kept = [m], [n], len(m), len(m)
            m, n = added(ms, ns)
            m, n = m[n > 1], n[n > 1]
            own = np.zeros(bits // REGIONS, bool)
            for at in _places(m, bits):
                own[at - region * len(own)] = True
            top = np.sort(np.argsort(-n, kind="stable")[: max(1, 2 * heavy // REGIONS)])
            top = top[n[top] > 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([region]), pa.array([np.packbits(own, bitorder="little").tobytes()]), pa.array([m[top].tobytes()]), pa.array([n[top].tobytes()]), pa.array([int(n.sum())])], ["region", "bloom", "m", "n", "total"]
            )

    sent = src.mapInArrow(send, "region long, m binary, n binary").repartition("region").sortWithinPartitions("region")
    bloom, tops, counts, total = np.zeros(bits >> 3, np.uint8), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for r in sent.mapInArrow(count, "region long, bloom binary, m binary, n binary, total long").collect():  # at most REGIONS rows of bounded size
        own = np.frombuffer(r["bloom"], np.uint8)
        bloom[r["region"] * len(own) : (r["region"] + 1) * len(own)] = own
        tops.append(np.frombuffer(r["m"], np.uint64))
        counts.append(np.frombuffer(r["n"], np.int64))
        total += r["total"]
    top, count_ = np.concatenate(tops), np.concatenate(counts)
    by = np.argsort(top)
    return Order(bloom, top[by], count_[by], one_in, one_in * total)


# Prefix rows: key, set hash, signature of 64 bits, size << 32 | place; for sets of over 64 tokens a wider signature


class Rows:
    """Prefix rows, column by column; ``start`` says where in ``more`` a row's wider signature begins, if it has one."""

    def __init__(self, key: np.ndarray, h: np.ndarray, sign: np.ndarray, shape: np.ndarray, start: np.ndarray, more: np.ndarray):
        self.key, self.h, self.sign, self.shape, self.start, self.more = key, h, sign, shape, start, more

    def __len__(self) -> int:
        return len(self.key)

    @property
    def n(self) -> np.ndarray:
        return (self.shape >> np.uint64(32)).astype(np.int64)

    def wide(self, rows: np.ndarray, bits: int) -> np.ndarray:
        """The signatures of ``rows``, which have as many bits or more, in ``bits`` bits."""
        out, size = np.zeros((len(rows), bits // 64), np.uint64), extra(self.n[rows])
        for k in (2, 4, 8, 16, 32):
            own = np.flatnonzero(size == k)
            if len(own):
                whole = self.more[self.start[rows[own]][:, None] + np.arange(k)]
                out[own] = np.bitwise_xor.reduce(whole.reshape(len(own), -1, bits // 64), axis=1)
        return out

    def take(self, by: np.ndarray) -> Rows:
        """These rows in this order, with no more signatures than they need."""
        shape, old = self.shape[by], self.start[by]
        size = extra((shape >> np.uint64(32)).astype(np.int64))
        start = np.cumsum(size) - size
        more = np.empty(int(size.sum()), np.uint64)
        for k in (2, 4, 8, 16, 32):
            own = np.flatnonzero(size == k)
            if len(own):
                more[start[own][:, None] + np.arange(k)] = self.more[old[own][:, None] + np.arange(k)]
        return Rows(self.key[by], self.h[by], self.sign[by], shape, start, more)

    def between(self, low: int, high: int) -> Rows:
        return Rows(*(c[low:high] for c in (self.key, self.h, self.sign, self.shape, self.start)), self.more)

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        if len(parts) == 1:
            return parts[0]
        shift = np.cumsum([0, *(len(p.more) for p in parts)])
        columns = [np.concatenate([getattr(p, c) for p in parts]) for c in ("key", "h", "sign", "shape")]
        return Rows(*columns, np.concatenate([p.start + s for p, s in zip(parts, shift, strict=False)]), np.concatenate([p.more for p in parts]))

    def packed(self, low: int, high: int) -> bytes:
        """Rows ``low`` to ``high``, whose wider signatures follow each other."""
        end = self.start[high] if high < len(self) else len(self.more)
        return b"".join(c.tobytes() for c in (self.key[low:high], self.h[low:high], self.sign[low:high], self.shape[low:high], self.more[self.start[low] : end]))

    @staticmethod
    def unpacked(n: int, blob: bytes) -> Rows:
        whole = np.frombuffer(blob, np.uint64)
        key, h, sign, shape = (whole[k * n : (k + 1) * n] for k in range(4))
        size = extra((shape >> np.uint64(32)).astype(np.int64))
        return Rows(key, h, sign, shape, np.cumsum(size) - size, whole[4 * n :])

    def once(self) -> Rows:
        """The rows by key, size, place and set, without copies."""
        by = np.lexsort((self.h, self.shape, self.key))
        k, g = self.key[by], self.h[by]
        new = np.ones(len(by), bool)
        new[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
        return self.take(by[new])


def _pairs_of_hot(of: np.ndarray, word: np.ndarray, place: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(set, key, place and count of the first token) of every two of a set's tokens, if the first of them may come first."""
    out = [[], [], [], []]
    bounds = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else np.zeros(1, np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        i, j = np.triu_indices(b - a, 1)
        i, j = a + i, a + j
        i, j = i[first[i]], j[first[i]]
        for x, y in zip(out, (of[i], mix(word[i] ^ mix(word[j] + np.uint64(0x9E3779B97F4A7C15))), place[i], count[i]), strict=True):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, (np.int64, np.uint64, np.int64, np.int64), strict=True))


def prefixes(sets: Sets, order: Order, percent: int, hot: int, paired: int) -> Rows:
    """The prefix rows of a run of sets."""
    n = sets.sizes
    level = order.level(sets.words)
    by, place = by_level(level, sets.at)
    of = np.repeat(np.arange(len(n)), n)
    take = (n - -(-percent * n // 100) + 1)[of]
    pick = (place < take + 1) & (level[by] > 0)
    by, place, of, take = by[pick], place[pick], of[pick], take[pick]
    word, count = sets.words[by], level[by]
    twice = (count >= paired * hot) & (percent > 50)
    single = ~twice & (place < take)
    o2, key2, place2, count2 = _pairs_of_hot(of[twice], word[twice], place[twice], count[twice], (place < take)[twice])
    of, key, place = np.concatenate([of[single], o2]), np.concatenate([word[single], key2]), np.concatenate([place[single], place2])
    many = np.concatenate([-(-np.where(count[single] >= hot, count[single], 1) // hot), -(-count2 // (paired * hot))])
    h, s1, s2 = sets.ids()
    # a row goes to its part's group with each part
    again = np.repeat(np.arange(len(of)), many)
    part = (h[of] % many.astype(np.uint64)).astype(np.int64) if len(of) else np.zeros(0, np.int64)
    other = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
    a, b = np.minimum(part[again], other), np.maximum(part[again], other)
    key = np.where(many[again] > 1, mix(key[again] ^ mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))), key[again])
    of, place = of[again], place[again]
    start, more, at = np.full(len(n), -1, np.int64), [np.zeros(0, np.uint64)], 0
    for i in np.unique(of[n[of] > 64]).tolist():
        more.append(parities(sets.one(i), width(int(n[i]))))
        start[i] = at
        at += len(more[-1])
    shape = (n[of].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
    return Rows(key, h[of], (s1 ^ s2)[of], shape, start[of], np.concatenate(more))


def bucket_count(order: Order) -> int:
    return max(64, order.total // BUCKET)


def prefix_rows(src: DataFrame, sets_of: SetsOf, order: Order, percent: int, hot: int = HOT, paired: int = PAIRED) -> DataFrame:
    """(bucket, n, rows): n prefix rows of a bucket, packed, one row a run of texts and bucket."""
    buckets = bucket_count(order)
    shared = src.sparkSession.sparkContext.broadcast(order)

    def rows(batches):
        for batch in slices(batches):
            parts = [prefixes(sets, shared.value, percent, hot, paired) for sets in sets_of(iter([batch]))]
            if not parts:
                continue
            own = Rows.joined(parts)
            # copies of a set in this run send one row a key
            new = np.unique(mix(own.key) ^ own.h, return_index=True)[1]
            bucket = (own.key[new] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            bucket, own = bucket[by], own.take(new[by])
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            ends = np.append(first, len(bucket)).tolist()
            blobs = [own.packed(low, high) for low, high in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(np.diff(ends)), pa.array(blobs, pa.binary())], ["bucket", "n", "rows"])

    return src.select("text").mapInArrow(rows, "bucket long, n long, rows binary")


def forest(rows: Rows, t: int) -> list[tuple[int, int]]:
    """Index pairs that span the candidates of each key; rows are sorted by key, then by size."""
    key, sign, n, place = rows.key, rows.sign, rows.n, (rows.shape & np.uint64(0xFFFFFFFF)).astype(np.int64)
    label, moved = np.arange(len(key)), np.arange(len(key))
    # the first token that two sets share leaves as many as they need in both; in the smaller set these are more
    out, i, d = [], np.flatnonzero(n - place >= needed(n, n, t)), 1
    while True:
        i = i[i + d < len(key)]
        j = i + d
        i = i[(key[i] == key[j]) & (100 * n[i] >= t * n[j])]  # the sizes ahead only grow
        if not len(i):
            return out
        j = i + d
        need = needed(n[i], n[j], t)
        could = np.minimum(n[i] - place[i], n[j] - place[j])
        apart = np.bitwise_count(sign[i] ^ sign[j])
        hit = np.flatnonzero((could >= need) & (apart <= n[i] + n[j] - 2 * need) & (label[i] != label[j]))
        for bits in (128, 256, 512, 1024, 2048):
            both = np.flatnonzero(np.minimum(n[i[hit]], n[j[hit]]) > bits // 2)
            if len(both):
                own = hit[both]
                apart = np.bitwise_count(rows.wide(i[own], bits) ^ rows.wide(j[own], bits)).sum(axis=1, dtype=np.int64)
                hit = np.delete(hit, both[apart > (n[i] + n[j] - 2 * need)[own]])
        if len(hit):
            under: dict[int, int] = {}

            def top(x: int) -> int:
                while x in under:  # noqa: B023
                    x = under[x]  # noqa: B023
                return x

            for a, b, x, y in zip(i[hit].tolist(), j[hit].tolist(), label[i[hit]].tolist(), label[j[hit]].tolist(), strict=True):
                x, y = top(x), top(y)
                if x != y:
                    under[max(x, y)] = min(x, y)
                    out.append((a, b))
            moved[list(under)] = [top(x) for x in under]
            label = moved[label]
        d += 1


def candidate_edges(rows: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(a, b): edges between sets, by hash, whose components hold all matching pairs.

    Sets that share a hash count as one here, which only puts their components together. A task gets about
    ``PER_TASK`` of the ``buckets`` at most, whatever number of partitions the session has set.
    """

    def merged(blobs) -> Rows:
        """All rows of a bucket without copies; these go as the rows gather."""
        parts, n, kept = [], 0, 0
        for count, blob in blobs:
            parts.append(Rows.unpacked(count, blob))
            n += count
            if n > 2 * kept + ROWS:
                parts = [Rows.joined(parts).once()]
                n = kept = len(parts[0])
        return Rows.joined(parts).once()

    def spanning(edges: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Edges from each set to the least that these edges reach."""
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                up[x] = x = up.get(up[x], up[x])
            return x

        a, b = (np.concatenate(c) for c in zip(*edges, strict=True))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        return pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in up], pa.int64())], ["a", "b"])

    def join(batches):
        edges, n = [], 0
        for _, blobs in grouped(batches):
            own = merged(blobs)
            h = own.h.view(np.int64)
            first = np.flatnonzero(np.concatenate([[True], own.key[1:] != own.key[:-1]]))
            first = first[np.unique(first // RUN, return_index=True)[1]]
            for low, high in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
                pairs = forest(own.between(low, high), percent)
                if pairs:
                    a, b = (low + np.array(x) for x in zip(*pairs, strict=True))
                    edges.append((h[a], h[b]))
                    n += len(a)
            if n >= EDGES:
                yield spanning(edges)
                edges, n = [], 0
        if edges:
            yield spanning(edges)

    tasks = buckets // PER_TASK
    few = tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_bucket = (rows.repartition("bucket") if few else rows.repartition(tasks, "bucket")).sortWithinPartitions("bucket")
    return by_bucket.mapInArrow(join, "a long, b long").filter("a <> b").distinct()


def cut_if_any(df: DataFrame) -> DataFrame | None:
    """``df`` materialised, or None if it has no rows."""
    df = cut(df)
    return df if df.limit(1).count() else None
