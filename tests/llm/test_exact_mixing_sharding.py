import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.exact_dedup import exact_dedup
from tallyframe.llm.mixing import Mix, permute, permute_back, targets
from tallyframe.llm.sharding import RING, capacities, ring_owners, shard

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


ROWS = [
    (5, "a b", "en", "s", 3), (3, "ab", "en", "s", 2), (4, "a\tb", "en", "s", 3), (7, None, None, None, None),
    (8, "", "en", "s", 0), (9, " \n", "en", None, 2), (None, "a  b", "en", "s", 4), (5, "a b", "en", "s", 3), (6, "ü" * 9, "de", "t", 9),
]


@pytest.mark.parametrize("hash_fn", [F.md5, lambda c: F.lpad(F.hex(F.char_length(c)), 32, "0")])
def test_exact_dedup_against_brute_force(spark, hash_fn):
    got = sorted(map(repr, (tuple(r)[:4] for r in exact_dedup(docs(spark, ROWS).withColumn("kept", F.lit(1)), hash_fn=hash_fn).collect())))
    groups = defaultdict(list)
    for r in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    want = []
    for g in groups.values():
        best = max(g, key=lambda r: (len(r[1] or ""), r[0] is not None, -(r[0] or 0)))[0]
        want += [(r[0], best, len(g), r[0] == best) for r in g]
    assert got == sorted(map(repr, want))


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


def _mix_docs():
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(1 + (i * 37) % 90)), "en", f"s{i % 5}" if i % 3 else "big", 0) for i in range(300)]
    return rows + [(1000, None, None, "s1", None), (1001, "", None, None, None), (1002, "only\nfour  words here", None, None, None), (1002, "only\nfour  words here", None, None, None)]


def _water(sizes, weights, most):
    """Reshare the excess until none is above its cap."""
    left, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * level > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * level
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def test_targets(spark):
    sizes = [("b", 10), ("a", 1000), ("c", 3), ("d", 500), (None, 1), ("e", 0)]
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    want = _water([s for _, s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3)
    assert [got[n] for n, _ in order] == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1514)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select("id", permute(F.col("id"), F.lit(n), F.lit(5)).alias("p")).withColumn("back", permute_back(F.col("p"), F.lit(n), F.lit(5)))
    rows = df.collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_mix(spark):
    rows = _mix_docs()
    mix = Mix(docs(spark, rows).withColumn("sid", F.lit("x")).withColumn("taken", F.lit("y")), block=8, shard=64)
    taken = mix.taken().collect()
    assert Counter(r["id"] for r in taken) == Counter(r[0] for r in rows)
    src = {r[0]: r[3] for r in rows}
    assert all(r["taken"] <= 3 * r["size"] for r in taken)
    got, want = Counter(), {}
    for r in taken:
        got[src[r["id"]]] += r["taken"]
        want[src[r["id"]]] = r["target"]
    assert all(abs(got[s] - t) <= 0.5 for s, t in want.items())
    slots = mix.slots.collect()
    assert sorted(s["slot"] for s in slots) == list(range(len(slots)))
    assert len({(s["sid"], s["epoch"], s["block"]) for s in slots}) == len(slots)
    words = Counter()
    out = mix.documents(n_chars_col="n_chars").collect()
    for r in out:
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    by_id = Counter()
    for r in taken:
        by_id[r["id"]] += r["taken"]
    assert words == Counter({k: v for k, v in by_id.items() if v})
    texts = {r[0]: r[1] for r in rows}
    assert all(set(r["text"].split()) <= set(texts[r["doc_id"]].split()) for r in out)
    assert sorted(map(repr, mix.taken().collect())) == sorted(map(repr, taken))


def test_mix_of_nothing(spark):
    empty = Mix(docs(spark, []))
    assert empty.taken().count() == 0 and empty.slots.count() == 0
    none = Mix(docs(spark, [(1, None, None, None, None)]))
    assert [tuple(r) for r in none.taken().collect()] == [(1, 0, 0, 0.0, 0)]


def _brute_ring(keys, owners, caps):
    load, out = [0] * len(caps), {}
    for name, pos in keys:
        p = pos
        while load[owners[p]] >= caps[owners[p]]:
            p = (p + 1) % len(owners)
        out[name] = (owners[p], load[owners[p]])
        load[owners[p]] += 1
    return out


@pytest.mark.parametrize("epsilon", [0.0, 0.3])
def test_sharding_against_one_row_at_a_time(spark, epsilon):
    rows = [(i if i % 3 else 42, f"t{i}é", "en", "s", 1) for i in range(700)] + [(None, None, None, None, None)] * 3
    df = docs(spark, rows).withColumn("slot", F.lit(-1))
    got = shard(df, 5, epsilon=epsilon, ring=64, vnodes=4, steps=8).collect()
    assert len(got) == len(rows)
    assert all(r["size"] == len((r["row"]["text"] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((r["row"]["text"] or "").encode()) for r in got)
    text = F.coalesce("text", F.lit(""))
    keys = df.select("doc_id", text.alias("t"), F.pmod(F.xxhash64("doc_id", F.lit("place")), F.lit(64)).alias("pos"), F.pmod(F.xxhash64("doc_id", text, F.lit("wave")), F.lit(8)).alias("step"), F.xxhash64("doc_id", text, F.lit("turn")).alias("turn")).collect()
    keys = sorted(keys, key=lambda r: (r["step"], r["pos"], r["turn"]))
    caps = capacities(len(rows), 5, epsilon)
    want = _brute_ring([(i, r["pos"]) for i, r in enumerate(keys)], ring_owners(5, 4, 64), caps)
    assert sorted((repr(keys[i]["doc_id"]), keys[i]["t"], *v) for i, v in want.items()) == sorted((repr(r["row"]["doc_id"]), r["row"]["text"] or "", r["shard"], r["slot"]) for r in got)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) <= max(caps)
    if not epsilon:
        assert max(counts.values()) - min(counts.values()) <= 1


def test_one_more_shard_moves_few(spark):
    df = docs(spark, [(i, f"text {i}", "en", "s", 1) for i in range(4000)])
    at = [{r["row"]["doc_id"]: r["shard"] for r in shard(df, n, epsilon=0.25).collect()} for n in (8, 9)]
    moved = sum(at[0][k] != at[1][k] for k in at[0])
    assert moved < 0.3 * len(at[0])


def test_sharding_of_nothing(spark):
    assert shard(docs(spark, [])).count() == 0 and len(ring_owners(16)) == RING


def test_equal_rows_are_dealt_to_parts(spark):
    rows = [(None, None, None, None, None)] * 3000 + [(i, f"t{i}", "en", "s", 1) for i in range(200)]
    got = shard(docs(spark, rows).repartition(5), 7, hot=50, times=2).collect()
    assert len(got) == 3200 and Counter(r["row"]["doc_id"] for r in got) == Counter(r[0] for r in rows)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all({r["slot"] for r in got if r["shard"] == s} == set(range(n)) for s, n in counts.items())


def test_hot_cells_do_not_depend_on_the_layout(spark):
    rows = [(7, "hot", k % 50) for k in range(600)] + [(7, "hot", 99)] * 200 + [(i, f"t{i}", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other long")
    out = []
    for layout in (df.coalesce(1), df.repartition(7), df.orderBy(F.rand(3))):
        placed = shard(layout, 5, ring=16, steps=4, vnodes=4, hot=20, times=2)
        out.append(Counter(tuple(r) for r in placed.select("row.*", "shard", "slot").collect()))
    assert out[0] == out[1] == out[2]
    counts = Counter(k[3] for k in out[0].elements())
    assert max(counts.values()) - min(counts.values()) <= 1 and {k[4] for k in out[0] if k[3] == 0} == set(range(counts[0]))
