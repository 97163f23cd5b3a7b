from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import features as fe
from tallyframe.operators import selection, splits
from tallyframe.operators.resample import fourier, resample
from tallyframe.sources import arff, files
from tallyframe.streaming import delayed
from tallyframe.streaming.knowledge import batch_features, stream_features


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, "ab"[i % 2], float(i % 4 == 0)) for i in range(60)]
    schema = "seq long, user long, item string, y double"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * (k + 1)], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream_features(src, "user", "item", "seq", "y").writeStream.format("memory").queryName("features").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(repr, map(tuple, spark.table("features").collect())))
    want = batch_features(spark.createDataFrame(rows, schema), "user", "item", "seq", "y").collect()
    assert got == sorted(map(repr, map(tuple, want)))


def test_labels_come_a_batch_later_and_after_a_restart(spark, tmp_path):
    rows = [(i, i % 4, None if i % 9 == 0 else "ab"[i % 2], None if i % 11 == 5 else float(i % 3 == 0), i // 12, datetime(2024, 1, 1, 0, i // 12)) for i in range(60)]
    schema = "seq long, user long, item string, y double, round long, at timestamp"
    whole = spark.createDataFrame(rows, schema)

    def put(k):
        whole.filter(f"round = {k}").coalesce(1).write.parquet(str(tmp_path / f"q/{k}"))
        whole.filter(f"round = {k - 1}").coalesce(1).write.parquet(str(tmp_path / f"a/{k}"))  # what was asked before is answered now

    def run():
        src = {s: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / s)) for s in "qa"}
        out = delayed.stream_features(src["q"], src["a"], "user", "item", "seq", "y", "at")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(100)

    for part in (range(2), range(2, 5)):  # the second run takes the state of the first
        for k in part:
            put(k)
        run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = delayed.batch_features(whole, "user", "item", "seq", "round", "y").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    assert {r["mean"] for r in got if r["seq"] < 12} == {delayed.PRIOR}


def test_answers_in_the_batch_of_their_question_and_expired_ones(spark, tmp_path):
    schema = "seq long, user long, item string, y double, at timestamp"
    day = [datetime(2024, 1, 1 + 10 * k) for k in range(4)]
    ask = [[(0, 1, "a", 0.0, day[0]), (1, 1, "a", 0.0, day[0])], [(2, 1, "a", 0.0, day[1])], [(9, 2, "a", 0.0, day[2])], [(3, 1, "a", 0.0, day[3])]]
    tell = [[(0, 1, None, 1.0, day[0]), (7, 1, None, 1.0, day[0])], [(8, 3, None, 1.0, day[1])], [(8, 3, None, 1.0, day[2])], [(1, 1, None, 1.0, day[3]), (1, 1, None, 1.0, day[3])]]
    for s, parts in (("q", ask), ("a", tell)):
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"{s}/{k}"))

    def run(name, days):
        src = {s: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / s)) for s in "qa"}
        out = delayed.stream_features(src["q"], src["a"], "user", "item", "seq", "y", "at", expire_ms=days * 86_400_000)
        assert out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(100)
        return {r["seq"]: (r["sum"], r["count"], r["attempts"]) for r in spark.table(name).collect()}

    # the answer to 0 came with it and counts a batch later, that to 1 once, that to 7 never
    want = {0: (0.0, 0, 0), 1: (0.0, 0, 1), 2: (1.0, 1, 2), 9: (0.0, 0, 0), 3: (2.0, 2, 3)}
    assert run("told", 100) == want
    assert run("expired", 5) == want | {3: (1.0, 1, 3)}  # question 1 was forgotten before its answer came


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), "a int, b string").collect()), key=repr) == [(1, "é"), (2, None)]
    files.write_parquet(df, str(tmp_path / "pq"))
    assert files.read_parquet(spark, str(tmp_path / "pq"), ["a"]).columns == ["a"]
    df.write.json(str(tmp_path / "js"))
    assert files.read_json(spark, str(tmp_path / "js"), "a int, b string").count() == 2
    both = files.read_many(spark, {"x": str(tmp_path / "csv")}, {"x": "a int, b string"})
    assert both["x"].count() == 2


def test_splits(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int")).withColumn("u", F.col("id") % 50)
    b = splits.balanced_sample(df, "y", ["id"]).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in b} == {0: 100, 1: 100}
    f = splits.k_fold(df, ["u"], 4)
    assert f.groupBy("u").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert splits.user_split(df, "u", ["id"], 2, 0.0).filter("is_valid").count() == 100


def test_quantile_edges_must_differ(spark):
    with pytest.raises(ValueError):
        fe.cut_quantiles(spark.range(10).withColumn("x", F.lit(1.0)), "x", 4, "b")


def test_box_cox(spark):
    df = spark.range(1, 500).withColumn("x", F.exp(F.col("id") / 60.0))
    assert abs(fe.boxcox_lambda(df, "x", [k / 10 for k in range(-5, 11)])) <= 0.3


def test_fourier_resampling(spark):
    t = np.arange(60) / 60
    wave = np.sin(2 * np.pi * 3 * t) + 0.5 * np.cos(2 * np.pi * 5 * t)
    want = np.sin(2 * np.pi * 3 * np.arange(40) / 40) + 0.5 * np.cos(2 * np.pi * 5 * np.arange(40) / 40)
    assert np.allclose(fourier(wave, 40), want) and np.allclose(fourier(wave, 60), wave)
    df = spark.createDataFrame([(k, i, float(v * (k + 1))) for k in range(2) for i, v in enumerate(wave)], "f long, i int, x double")
    got = resample(df, "f", "i", ["x"], 40).orderBy("key", "step").collect()
    assert np.allclose([r["x"] for r in got], np.concatenate([want, 2 * want]))


def test_selection(spark):
    df = spark.range(200).selectExpr("cast(id as double) as a", "cast(id * id % 17 as double) as b", "cast(id % 7 as double) as c").withColumn("y", F.col("a") * 2 + F.col("c"))
    score = selection.linear_r2(df, "y")
    assert selection.forward(["a", "b", "c"], score, 2) == ["a", "c"]
    assert sorted(selection.backward(["a", "b", "c"], score, 2)) == ["a", "c"]
    assert sorted(selection.exhaustive(["a", "b", "c"], score, 2)) == ["a", "c"]
    folds = df.withColumn("fold", (F.col("a") % 3).cast("int"))
    out = selection.out_of_fold_predictions(folds, "fold", 3, lambda train: (lambda m: lambda t: t.withColumn("p", F.lit(m)))(train.agg(F.avg("y")).first()[0]))
    assert out.count() == 200 and out.select("p").distinct().count() == 3


def test_arff_and_binary_task(spark, tmp_path):
    text = """% cars
@relation 'my cars'
@attribute 'buying price' {low, 'very high', med}
@attribute doors numeric
@ATTRIBUTE plate string
@attribute class {yes,no,maybe}
@data
low, 2, 11, yes
'very high',?,12.5,no
% a note
med,4,'it\\'s 5',yes
low,3,?,?
med,1,7,maybe
"""
    (tmp_path / "cars.arff").write_text(text)
    df = arff.read_arff(spark, str(tmp_path / "cars.arff"))
    assert [tuple(r) for r in df.collect()] == [("low", 2.0, "11", "yes"), ("very high", None, "12.5", "no"), ("med", 4.0, "it's 5", "yes"), ("low", 3.0, None, None), ("med", 1.0, "7", "maybe")]
    task, target, folds = arff.binary_task(df)
    assert target == "class" and folds == 2 and sorted(r["class"] for r in task.collect()) == [0, 0, 1, 1] and dict(task.dtypes)["plate"] == "string"
    task, target, _ = arff.binary_task(df.drop("class").filter("plate NOT LIKE 'it%'"))
    assert target == "plate" and {r["plate"] for r in task.collect()} == {0, 1}
    wide = arff.binary_task(df.filter("plate NOT LIKE 'it%'"))[0]
    assert dict(wide.dtypes)["plate"] == "double"
    with pytest.raises(ValueError):
        arff.binary_task(df.filter("class is null"))
