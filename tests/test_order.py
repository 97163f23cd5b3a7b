"""Places and quantiles of tables that count as large, and operators without a query of their own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.core import mapping
from tallyframe.core.order import numbered, order_statistics, quantiles
from tallyframe.functions import stats
from tallyframe.operators import encoders as en
from tallyframe.operators import features as fe
from tallyframe.operators import splits
from tallyframe.operators import target as ta


@pytest.mark.parametrize("most", [10_000, 5])
def test_numbered(spark, most):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1, 2, 3, 50]), f"k{i:04}") for i in range(2000)]
    rnd.shuffle(rows)
    got, small = numbered(spark.createDataFrame(rows, "a int, b string").repartition(7), ["a", "b"], "place", 3, most)
    want = {r[1]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 3)}
    assert small == (most > 2000) and {r["b"]: r["place"] for r in got.collect()} == want
    assert numbered(spark.createDataFrame([], "a int, b string"), ["a"], "place", most=most)[0].count() == 0


def test_codes_of_an_id_like_column(spark, monkeypatch):
    monkeypatch.setattr(mapping, "BROADCAST_ROWS", 100)
    rows = [(i, f"c{(i * 7919) % 3000}") for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, x string").repartition(5)
    out = {r["i"]: r["x"] for r in en.OrdinalEncoder(["x"], "i").fit_transform(df).collect()}
    assert out == {i: i + 1 for i in range(3000)}
    codes = {r["x"]: r["code"] for r in en.label_encode(df, "x", "code").collect()}
    assert codes == {x: k for k, x in enumerate(sorted(codes))}


def test_a_table_of_long_texts_is_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(mapping, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(mapping, "BROADCAST_ROWS", 20)
    assert mapping.fetched(spark.createDataFrame([("x" * 100_000, 1)], "cat string, n int")) is None
    assert mapping.fetched(spark.createDataFrame([("x", 1)], "cat string, n int")) == [("x", 1)]


@pytest.mark.parametrize("rows", [10, 100_000])
def test_quantiles(spark, rows):
    rnd = np.random.default_rng(2)
    values = np.concatenate([rnd.normal(size=5000), np.full(2500, 0.25), rnd.integers(0, 9, 500)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 9, "v double").repartition(6)
    shares = [0.0, 0.005, 0.25, 0.5, 0.51234, 0.995, 1.0]
    assert quantiles(df, F.col("v"), shares, rows) == pytest.approx(np.quantile(values, shares).tolist())
    assert order_statistics(df.filter("v is not null"), F.col("v"), [0, 17, 7999], rows) == np.sort(values)[[0, 17, 7999]].tolist()
    assert quantiles(df.filter("v is null"), F.col("v"), shares) is None


def test_folds_beyond_the_bound_are_refused(spark):
    df = spark.createDataFrame([(i, "a", 1.0) for i in range(5)] + [(None, "a", 0.0)], "fold int, x string, y double")
    with pytest.raises(ValueError):
        ta.test_mean_over_folds(df, "x", "y", "fold", lambda s, c, p: s / c, max_folds=3)
    with pytest.raises(ValueError):
        ta.nested_cv(df, "fold", lambda: ta.TargetEncoder("y", ["x"]), max_folds=3)
    got = ta.test_mean_over_folds(df, "x", "y", "fold", lambda s, c, p: s / c).first()["value"]
    assert got == pytest.approx((5 * 4 / 5 + 1) / 6)


def test_nested_cv_is_sensitive_to_folds(spark):
    rows = [(i, "ab"[i % 2], float(i * i % 7 == 1), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, x string, y double, fold int")
    out, (test,) = ta.nested_cv(df, "fold", lambda: ta.MEstimateEncoder("y", ["x"]), (df,))
    assert out.count() == 60 and out.filter("x is null").count() == 0
    assert out.select("x").distinct().count() > test.select("x").distinct().count()


def test_splits_and_types(spark):
    df = spark.createDataFrame([(i, i % 10, i % 2) for i in range(1000)], "i long, user long, y long")
    folds = splits.k_fold(df, ["user"], 3)
    assert folds.groupBy("user").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    valid = splits.user_split(df, "user", ["i"], 5, 0.0).filter("is_valid")
    assert valid.count() == 50 and valid.agg(F.min("i")).first()[0] == 950
    shrunk = stats.shrink_types(df)
    assert [t for _, t in shrunk.dtypes] == ["smallint", "tinyint", "tinyint"] and shrunk.exceptAll(df).count() == 0
    assert stats.drop_dominant(df.withColumn("one", F.lit(1)), ["y", "one"], 0.9).columns == ["i", "user", "y"]


def test_keep_first_and_history(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 2, "a"), (1, 3, "c"), (None, 9, "z")], "k int, t int, v string")
    assert sorted(map(repr, map(tuple, fe.keep_first(df, ["k"], ["t"]).collect()))) == ["(1, 2, 'a')", "(None, 9, 'z')"]
    with pytest.raises(KeyError):
        fe.history_by_slot(df, "k", "t", "v", ["nothing"], "h_")


def test_noise_is_seeded_and_on_training_rows_only(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], float(i % 2)) for i in range(300)], "i int, x string, y double")
    enc = ta.MEstimateEncoder("y", ["x"], sigma=0.1, seed=4).fit(df)
    a, b = ([r["x"] for r in enc.transform(df, training=True).orderBy("i").collect()] for _ in range(2))
    plain = [r["x"] for r in enc.transform(df).orderBy("i").collect()]
    ratio = np.array(a) / np.array(plain)
    assert a == b and len(set(plain)) <= 3 and abs(ratio.mean() - 1) < 0.03 and 0.08 < ratio.std() < 0.12


@pytest.mark.parametrize("hot", [10, 10_000])
def test_running_sums_in_two_levels(spark, hot):
    rnd = random.Random(5)
    rows = [(i, "hot" if rnd.random() < 0.6 else rnd.choice([None, "a", "b"]), rnd.choice([0.0, 1.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, x string, y double").repartition(6)
    seen, want, prior = {}, {}, sum(r[2] for r in rows) / len(rows)
    for i, x, y in rows:
        s, c = seen.get(x, (0.0, 0))
        want[i] = (s / c if c else prior, (s + prior) / (c + 1))
        seen[x] = (s + y, c + 1)
    mean = {r["i"]: r["m"] for r in ta.expanding_mean(df, "x", "y", "i", "m", hot).collect()}
    ordered = {r["i"]: r["x"] for r in ta.CatBoostEncoder("y", "i", ["x"], hot=hot).fit_transform(df).collect()}
    assert mean == pytest.approx({i: w[0] for i, w in want.items()}) and ordered == pytest.approx({i: w[1] for i, w in want.items()})
