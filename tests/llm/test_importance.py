"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tallyframe.llm import importance as im
from tallyframe.llm import queries


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def expected(docs, target):
    found = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in range(10000)]
    rows = []
    for (i, _), (w, f) in zip(docs, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], (1 << 63) if r[0] is None else r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_query(spark, tmp_path):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdeé9") for _ in range(rnd.randint(1, 6))) for _ in range(200)] + ["X" * 70, "Ünïcode", "the"]
    docs = [(i, rnd.choice([" ", "\n", "-"]).join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    docs += [(None, docs[1][1]), (None, docs[1][1]), (1, docs[1][1]), (500, None), (501, ""), (502, " ,;\x00"), (503, " ".join(rnd.choice(vocab) for _ in range(60_000)))]
    target = [" ".join(rnd.choice(vocab[:40]) for _ in range(20)) for _ in range(30)] + [None, ""]
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in queries.QUERIES["op12_importance"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == expected(docs, target)


def test_few_words_and_empty_tables(spark):
    few, none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert sorted(tuple(r)[:2] for r in im.resample(few, none).collect()) == [(1, 3), (2, 0)]
    assert im.resample(none, few).collect() == []


def test_run_lengths_and_stream():
    words = [b"a" * n for n in (1, 63, 64, 65, 200)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    got, n = im.stream(data, np.array([0, len(data)]), 10_000)
    pairs = [a + b" " + b for a, b in zip(words, words[1:], strict=False)]
    assert got[::2].tolist() == [zlib.crc32(w) % 10_000 for w in words] and got[1::2].tolist() == [zlib.crc32(w) % 10_000 for w in pairs] and n.tolist() == [5]
    value, times = im.run_lengths(np.array([7, 3, 7, 7], np.uint16))
    assert value.tolist() == [3, 7] and times.tolist() == [1, 3]
