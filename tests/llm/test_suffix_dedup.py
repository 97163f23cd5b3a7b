"""Removal of repeated passages against all strings of all texts."""

import hashlib
import random

import numpy as np
import pytest

from tallyframe.llm import queries
from tallyframe.llm import suffix_dedup as sd

DOC = "doc_id long, text string"


def late(i):
    return (1 << 63) - 1 if i is None else i


def expected(docs, length=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], 1 << 64), late(i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < late(i):
                gone[p : p + length] = b"\1" * length
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def texts(rnd, alphabet, n=120):
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(40, 200))) for _ in range(20)]
    docs = []
    for i in range(n):
        parts = [rnd.choice(base)[rnd.randint(0, 30) : rnd.randint(60, 200)] if rnd.random() < 0.5 else "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(rnd.randint(0, 5))]
        docs.append((rnd.choice([i, i, i, i % 7, None]), "".join(parts)))
    docs += [(500, "a" * 3000), (501, "a" * 100), (502, "a" * 49), (503, None), (504, ""), (505, "ab" * 400), (3, "x" * 20 + "a" * 60), (506, docs[0][1]), (506, docs[0][1])]
    rnd.shuffle(docs)
    return docs


def rows(df):
    removed = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()]
    return sorted(removed, key=repr)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é\0"])
def test_strings_one_by_one_and_many_regions(spark, alphabet):
    docs = texts(random.Random(8), alphabet)
    df = spark.createDataFrame(docs, DOC).repartition(3)
    assert rows(sd.repeated_passages(df)) == expected(docs)
    assert rows(sd.repeated_passages(df, size=2000, hot=5, batch=64)) == expected(docs)
    assert rows(sd.repeated_passages(df, length=20, size=3000)) == expected(docs, 20)


def test_query(spark, tmp_path):
    rnd = random.Random(9)
    docs = texts(rnd, "abcdefghijklmnop ")
    docs.append((600, "".join(rnd.choice("abcdefgh ") for _ in range(150_000)) + (docs[0][1] or "") + "b" * 70))
    docs.append((601, docs[-1][1][1000:90_000]))
    spark.createDataFrame([(*d, 1) for d in docs], DOC + ", chunk int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_suffix_dedup"](spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == expected(docs)


def test_empty_table(spark):
    assert sd.repeated_passages(spark.createDataFrame([], DOC)).collect() == []


def test_family_levels_double():
    rnd = np.random.default_rng(1)
    text = rnd.integers(97, 99, 4000).astype(np.uint8)
    family, first, at = sd.SuffixFamily(12), {}, rnd.permutation(3900)
    doc = np.arange(3900) // 10
    for k in range(0, 3900, 100):
        got = family.add(text, at[k : k + 100], doc[k : k + 100])
        for p, d, g in zip(at[k : k + 100], doc[k : k + 100], got, strict=True):
            assert first.setdefault(text[p : p + 12].tobytes(), d) == g
    ranks = [r for r, _, _ in family.levels]
    assert ranks == sorted(set(ranks), reverse=True) and len(ranks) <= 6
    assert sum(len(s) for _, s, _ in family.levels) == len(first) and all((s[1:] > s[:-1]).all() for _, s, _ in family.levels)
