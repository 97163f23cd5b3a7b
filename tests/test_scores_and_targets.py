"""Areas of many columns, gated odds, Box-Cox exponents, medians outside folds and classes in one pass."""

import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import metrics
from tallyframe.operators import encoders as en
from tallyframe.operators import features as fe
from tallyframe.operators import target as ta


def area(pairs):
    pos, neg = [p for y, p in pairs if y == 1], [p for y, p in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_areas_and_gate(spark):
    rnd = random.Random(1)
    rows = [(i, None if i == 3 else i % 2, rnd.choice([None, float("nan"), -5e6, 0.25, rnd.random() * 1e6]), float(i % 2) - rnd.random() * 1.2, 0.5, None) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, y int, a double, b double, c double, d double").repartition(3)
    got = {r["column"]: r["auc"] for r in metrics.auc_many(df, "y", ["a", "b", "c", "d"], bucket=7).collect()}
    for k, c in enumerate("abcd", 2):
        want = area([(r[1], r[k]) for r in rows if r[1] is not None and r[k] is not None and r[k] == r[k]])
        assert got[c] == (None if want is None else pytest.approx(want))
    test = spark.createDataFrame([(0, 0.2, 0.6, 0.9), (1, 0.1, 0.1, 0.1)], "i long, b double, c double, d double")
    every = spark.createDataFrame([(0,), (1,), (2,)], "i long")
    out = {r["i"]: r["target"] for r in metrics.gated_odds(df, "y", test, every, "i", ["b", "c", "d"], 0.6).collect()}
    assert out[2] == 0.0 and out[0] == pytest.approx((9 * 0.2 / 0.8 / 9) / (1 + 9 * 0.2 / 0.8 / 9))
    none = {r["i"]: r["target"] for r in metrics.gated_odds(df, "y", test, every, "i", ["b", "c", "d"], 2.0).collect()}
    assert none[1] == pytest.approx(0.1)


def test_box_cox_exponents(spark):
    rnd = np.random.default_rng(2)
    x = np.column_stack([np.exp(rnd.normal(size=800)), rnd.normal(10, 1, 800) ** 2, rnd.random(800) * 0.1])
    df = spark.createDataFrame([(*map(float, r),) for r in x], "a double, b double, c double")
    got = fe.boxcox_lambdas(df, ["a", "b", "c"])

    def ll(v, g):
        return (g - 1) * np.log1p(v).sum() - len(v) / 2 * np.log(np.var((1 + v) ** g / g))

    for k, c in enumerate("abc"):
        grid = np.linspace(got[c] - 0.5, got[c] + 0.5, 20_002)
        best = grid[np.argmax([ll(x[:, k], g) for g in grid])]
        assert abs(got[c] - best) < 2e-4, (c, got[c], best)


def test_spreads_of_a_grid_of_powers(spark):
    rnd = np.random.default_rng(8)
    x = np.exp(rnd.normal(size=500)) * 1e4
    grid = [-2.0, -1.0, 0.0, 1.0, 2.0]
    batches = [pa.RecordBatch.from_arrays([pa.array([*part.tolist(), None])], ["0"]) for part in np.split(x, [100, 101, 300])]
    (got,) = fe._power_spreads(iter(batches), [grid])
    for lam, r in zip(grid, got.to_pylist(), strict=True):
        y = np.log1p(x) if lam == 0 else (1 + x) ** lam / lam
        assert r["n"] == 500 and np.isclose(r["q"], ((y - y.mean()) ** 2).sum(), rtol=1e-8) and np.isclose(r["s"], np.log1p(x).sum())
    df = spark.createDataFrame([(v,) for v in x.tolist()], "a double").repartition(3)
    odd = df.unionByName(spark.createDataFrame([(None,), (float("nan"),)], "a double"))
    assert abs(fe.boxcox_lambdas(odd, ["a"])["a"] - fe.boxcox_lambdas(df, ["a"])["a"]) < 1e-9


def test_medians_outside_folds(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None, "rare"]) if i else "rare", rnd.randrange(4), None if rnd.random() < 0.1 else float(rnd.randint(0, 9)), i) for i in range(200)] + [("one", 2, 5.0, 900), ("one", 2, None, 901)]
    df = spark.createDataFrame(rows, "k string, fold int, y double, i long").repartition(3)
    whole = statistics.median(r[2] for r in rows if r[2] is not None)
    for r in ta.target_statistic(df, "k", "y", "fold", 4, {"median": F.median, "q": lambda c: F.percentile(c, F.lit(0.5))}).collect():
        rest = [y for k, f, y, _ in rows if k == r["k"] and f != r["fold"] and y is not None]
        want = statistics.median(rest) if rest else whole
        assert r["k_median"] == r["k_q"] == want


@pytest.mark.parametrize("make", [ta.TargetEncoder, ta.MEstimateEncoder, lambda y: ta.JamesSteinEncoder(y, model="pooled"), lambda y: ta.JamesSteinEncoder(y, model="binary")])
def test_classes_in_one_pass_equal_a_fit_each(spark, make):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("xyz"), rnd.choice(["a", "b", None, "c"]), str(i) if i % 5 else "s") for i in range(80)]
    df = spark.createDataFrame(rows, "i long, y string, a string, b string")
    got = {r["i"]: r for r in ta.multi_class(df, "y", ["a", "b"], make).collect()}
    assert list(next(iter(got.values())).asDict()) == ["i", "y", "a_y", "b_y", "a_z", "b_z"]
    for k in "yz":
        enc = make("__y")
        one = enc.fit(df.select("i", (F.col("y") == k).cast("int").alias("__y"), "a", "b")).transform(df.select("i", F.lit(0).alias("__y"), "a", "b"))
        for r in one.collect():
            assert got[r["i"]][f"a_{k}"] == pytest.approx(r["a"]) and got[r["i"]][f"b_{k}"] == pytest.approx(r["b"])


def test_many_small_groups_need_a_name(spark, monkeypatch):
    monkeypatch.setattr(en, "MERGED_NAMES", 3)
    df = spark.createDataFrame([(v,) for v in "aaaaabcdef"], "x string")
    with pytest.raises(ValueError):
        en.CountEncoder(["x"], min_group_size=2).fit(df)
    got = en.CountEncoder(["x"], min_group_size=2, min_group_name="rest").fit_transform(df)
    assert sorted(r["x"] for r in got.collect()) == [5] * 10
