import random
from collections import Counter

import corpus_pipeline as cp
from tallyframe.llm.sharding import capacities

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(400)]

    def text(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    rows = [(i, text(rnd.randint(40, 120)), "en", f"s{i % 4}" if i % 9 else None, 0) for i in range(120)]
    item = text(30)
    rows += [(200, rows[5][1] + " end", "en", "s1", 0), (201, rows[5][1].upper(), "en", "s2", 0), (202, "%%% $$$ ### " * 30, "en", "s1", 0), (203, f"{text(20)} {item} {text(20)}", "en", "s3", 0), (204, None, "en", "s1", None), (205, "", None, None, None)]
    return rows, [(i, 1, 0) for i in range(0, 120, 2)], [(1, item), (2, None)]


def test_each_stage_and_the_run(spark, tmp_path):
    rows, labels, bench = corpus()
    write(spark, str(tmp_path), rows, labels, bench)
    docs, seen = cp.read(spark, str(tmp_path), "documents"), {}
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema=stage(spark, docs, str(tmp_path)).schema)
        seen[name] = (before, docs.collect())
        assert docs.columns[:5] == list(cp.COLUMNS)
    ids = {name: {r["doc_id"] for r in after} for name, (_, after) in seen.items()}
    assert {202, 204, 205}.isdisjoint(ids["quality"]) and len(ids["quality"] & set(range(120))) >= 115
    assert {200}.isdisjoint(ids["near_duplicates"]) and ids["near_duplicates"] == ids["quality"] - {200, 201} | ({5} & ids["quality"])
    assert ids["decontamination"] == ids["near_duplicates"] - {203}
    before, after = seen["mixing"]
    words = Counter()
    for r in after:
        words[r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    total = sum(len(r["text"].split()) for r in before)
    assert abs(sum(words.values()) - total) <= 5
    final = seen["sharding"][1]
    counts = Counter(r["shard"] for r in final)
    assert sorted(counts.values()) == sorted(c for c in capacities(len(final), 16, 0) if c)
    assert all({r["slot"] for r in final if r["shard"] == s} == set(range(n)) for s, n in counts.items())
    assert sorted(map(repr, cp.run(spark, str(tmp_path)).collect())) == sorted(map(repr, final))


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    out = cp.run(spark, str(tmp_path))
    assert out.count() == 0 and "shard" in out.columns


def test_near_duplicates_by_id_and_text(spark):
    rnd = random.Random(8)
    a, b, c, d = (" ".join(f"{x}{rnd.randrange(500)}" for _ in range(60)) for x in "abcd")
    rows = [(1, a, "en", "s", 1), (2, a + " end", "en", "s", 1), (2, b, "en", "s", 1), (3, c, "en", "s", 1), (3, c, "en", "s", 1), (3, c, "de", None, 1), (None, d, "en", "s", 1), (None, d + " x", "en", "s", 1), (None, b, "en", "s", 1)]
    rows += [(4, None, "en", "s", None), (4, None, "en", "s", None), (5, "", None, None, 0)]
    got = cp.near_duplicates_stage(spark, spark.createDataFrame(rows, DOC), "").collect()
    kept = [rows[0], rows[2], (3, c, "de", None, 1), *rows[9:]]
    ends = [r for r in map(tuple, got) if r[0] is None]
    assert len(ends) == 1 and ends[0] in rows[6:8]
    assert sorted(map(repr, (tuple(r) for r in got if r["doc_id"] is not None))) == sorted(map(repr, kept))


def test_quality_stage_takes_clashing_columns(spark, tmp_path):
    rows, labels, bench = corpus()
    write(spark, str(tmp_path), rows, labels, bench)
    docs = cp.read(spark, str(tmp_path), "documents")
    wide = docs.selectExpr("*", "0 AS bad_id", "'x' AS bad_text", "1 AS bad_lang", "2 AS kept")
    got = cp.quality_stage(spark, wide, str(tmp_path))
    assert got.columns == list(cp.COLUMNS)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, cp.quality_stage(spark, docs, str(tmp_path)).collect()))
