import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm.common import connected_components
from tallyframe.llm.jaccard_join import jaccard_components, join_sets


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def brute(rows, n, t):
    sets = [shingles(r[1], n) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= t * len(a | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if sets[i]:
            low.setdefault(find(i), []).append(r[0])
    best = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return [(r[0], len(sets[i]), best[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows)]


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows, shared = [], [rnd.choice(vocab) for _ in range(12)]
    for i in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 5, 30, 60, 90]))] + (shared if i % 2 else [])
        rows.append((len(rows), " ".join(words)))
        for _ in range(rnd.choice([0, 0, 1, 4, 9])):
            copy = list(words)
            for _ in range(rnd.choice([0, 1, 1, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows), rnd.choice([" ", "\n", " \t"]).join(copy).upper()))
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), (5, rows[5][1]), (3, "other"), (903, "É é x y z"), (904, "é É x y z")]
    return rows


@pytest.mark.parametrize("seed,n,t,most,hot,paired", [(1, 3, 90, 4096, 4096, 32), (2, 3, 70, 8, 4, 2), (3, 5, 80, 6, 2, 1), (4, 1, 60, 10, 3, 3), (5, 2, 75, 3, 4, 32)])
def test_against_brute_force(spark, seed, n, t, most, hot, paired):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set", F.lit(1)).withColumn("n", F.lit(2)).repartition(5)
    out, links = jaccard_components(docs, n, t, most=most, hot=hot, paired=paired)
    assert sorted(map(repr, map(tuple, out.drop("is_first").collect()))) == sorted(map(repr, brute(rows, n, t)))


def test_all_links_of_different_sets(spark):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = list({frozenset(shingles(r[1], 3)) for r in rows} - {frozenset()})
    want = sum(100 * len(a & b) >= 70 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    for most in (4096, 6):
        assert jaccard_components(docs, 3, 70, most=most, every=True)[1].distinct().count() == want


def test_trie_gives_one_link_a_group():
    base = np.arange(100, dtype=np.uint64)
    arrays = [np.sort(np.append(base, np.uint64(1000 + i))) for i in range(500)]
    assert len(join_sets(list(range(500)), arrays, 90, False)) == 499
    assert len(join_sets(list(range(500)), arrays, 90, True)) == 500 * 499 // 2


def test_empty_table(spark):
    out, links = jaccard_components(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and links.count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100)}
