import random
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.line_dedup import remove_lines


def words(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)))


def brute(rows, t, key):
    """Texts without lines like an earlier one; ``key`` is the hash of each text."""
    lines = [((r[0] is None, r[0] or 0, key[r[1]], k), words(x)) for r in rows if r[1] for k, x in enumerate(r[1].split("\n"))]
    lines = [x for x in lines if x[1]]
    gone = {p for p, s in lines if any(q < p and 100 * len(s & o) >= t * len(s | o) for q, o in lines)}
    out = []
    for r in rows:
        if r[1]:
            kept = [x for k, x in enumerate(r[1].split("\n")) if (r[0] is None, r[0] or 0, key[r[1]], k) not in gone]
            out.append((r[0], "\n".join(kept)))
        else:
            out.append((r[0], r[1]))
    return out


@pytest.mark.parametrize("seed,t,most,hot,paired", [(1, 80, 4096, 4096, 32), (2, 80, 6, 5, 2), (3, 60, 4, 3, 3), (4, 60, 4096, 2, 1), (5, 45, 4, 3, 2)])
def test_against_brute_force(spark, seed, t, most, hot, paired):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 4, 10, 30]))] for _ in range(25)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rnd.randint(1, 6)):
            line = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 2])):
                line[rnd.randrange(len(line))] = rnd.choice(vocab)
            text.append(rnd.choice([" ", "\t"]).join(line))
        rows.append((i, "\n".join(text)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, rows[3][1]), (5, rows[5][1]), (4, "W1 w2\nw2 W1\n\u00e9 x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set", F.lit(1)).repartition(3)
    key = {r["text"]: r["k"] for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}
    got = [(r["doc_id"], r["text"]) for r in remove_lines(docs, t, most=most, hot=hot, paired=paired).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, t, key)))


def test_empty_table(spark):
    assert remove_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
