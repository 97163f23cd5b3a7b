"""Golden values of the encoders and their policies."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import encoders as en
from tallyframe.operators import target as ta


def frame(spark, values, y=None):
    rows = [(i, v, None if y is None else float(y[i])) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i int, x string, y double")


def col(df, name="x", order="i"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_ordinal_codes_sentinels_and_inverse(spark):
    enc = en.OrdinalEncoder(["x"], "i").fit(frame(spark, ["chicago", "st louis"]))
    assert col(enc.transform(frame(spark, ["st louis", "chicago", None, "paris"]))) == [2, 1, -2, -1]
    seen = en.OrdinalEncoder(["x"], "i")
    assert col(seen.fit_transform(frame(spark, ["chicago", None]))) == [1, 2]
    assert col(seen.inverse_transform(seen.transform(frame(spark, [None, "chicago", "x"])))) == [None, "chicago", None]
    nan = en.OrdinalEncoder(["x"], "i", handle_unknown="return_nan", handle_missing="return_nan").fit(frame(spark, ["a", None]))
    assert col(nan.transform(frame(spark, ["a", "b", None]))) == [1, None, None]


def test_errors(spark):
    df = frame(spark, ["a", None])
    for enc in (en.OrdinalEncoder(["x"], "i", handle_missing="error"), ta.TargetEncoder("y", ["x"], handle_missing="error")):
        with pytest.raises(ValueError):
            enc.fit(df)
    enc = en.OrdinalEncoder(["x"], "i", handle_unknown="error").fit(frame(spark, ["a"]))
    with pytest.raises(Exception):
        enc.transform(frame(spark, ["b"])).collect()
    with pytest.raises(ValueError):
        en.OrdinalEncoder(["x"], "i").transform(df)
    with pytest.raises(ValueError):
        enc.transform(df.drop("y"))
    with pytest.raises(ValueError):
        en.OrdinalEncoder(["x"]).fit(df)
    with pytest.raises(ValueError):
        en.OrdinalEncoder(["x"], "i").get_feature_names()


def test_one_hot_names_and_sentinels(spark):
    train, test = frame(spark, ["a", "b"]).drop("y"), frame(spark, ["b", None, "c"]).drop("y")
    enc = en.OneHotEncoder(["x"], "i", use_cat_names=True).fit(train)
    assert enc.get_feature_names() == ["i", "x_a", "x_b"]
    assert [tuple(r)[1:] for r in enc.transform(test).orderBy("i").collect()] == [(0, 1), (0, 0), (0, 0)]
    ind = en.OneHotEncoder(["x"], "i", handle_unknown="indicator", handle_missing="indicator").fit(train)
    assert ind.get_feature_names() == ["i", "x_1", "x_2", "x_-2", "x_-1"]
    assert [tuple(r)[1:] for r in ind.transform(test).orderBy("i").collect()] == [(0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)]
    blank = en.OneHotEncoder(["x"], "i", handle_unknown="return_nan").fit(train).transform(test).orderBy("i").collect()
    assert blank[2]["x_1"] is None and blank[1]["x_1"] == 0


def test_base_n(spark):
    df = frame(spark, list("abcd")).drop("y")
    enc = en.BaseNEncoder(["x"], "i")
    assert [tuple(r)[1:] for r in enc.fit_transform(df).orderBy("i").collect()] == [(0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0)]
    for base in (1, 2, 3, 7):
        enc = en.BaseNEncoder(["x"], "i", base=base)
        assert col(enc.inverse_transform(enc.fit_transform(df))) == list("abcd")


def test_contrasts(spark):
    df = frame(spark, list("ABC")).drop("y")

    def rows(cls, data=df, **how):
        return [tuple(round(v, 5) for v in r if not isinstance(v, int)) for r in cls(["x"], "i", **how).fit(df).transform(data).orderBy("i").collect()]

    assert rows(en.HelmertEncoder) == [(-1, -1), (1, -1), (0, 2)]
    assert rows(en.HelmertEncoder, frame(spark, ["A", "D", None]).drop("y")) == [(-1, -1), (0, 0), (0, 0)]
    assert rows(en.BackwardDifferenceEncoder) == [(-0.66667, -0.33333), (0.33333, -0.33333), (0.33333, 0.66667)]
    assert rows(en.SumEncoder) == [(1, 0), (0, 1), (-1, -1)]
    assert rows(en.PolynomialEncoder) == [(-0.70711, 0.40825), (0, -0.8165), (0.70711, 0.40825)]
    one = en.SumEncoder(["x"], "i").fit_transform(frame(spark, ["A", "A"]).drop("y"))
    assert one.columns == ["intercept", "i"]


def test_count(spark):
    df = frame(spark, ["A"] * 7 + ["B"] * 3 + ["C"] * 6 + [None] * 4).drop("y")
    assert set(col(en.CountEncoder(["x"]).fit_transform(df))) == {7, 3, 6, 4}
    merged = en.CountEncoder(["x"], min_group_size=7).fit(df)
    assert {r["x"] for r in merged.transform(df).collect()} == {7, 13}
    assert {r["group"] for r in merged.tables["x"].collect()} == {None, "B_C_nan"}
    assert {r["x"] for r in en.CountEncoder(["x"], min_group_size=100).fit_transform(df).collect()} == {7, 3, 6, 4}
    assert {r["x"] for r in en.CountEncoder(["x"], min_group_size=0.35).fit_transform(df).collect()} == {7, 13}
    apart = en.CountEncoder(["x"], min_group_size=7, combine_min_nan_groups=False).fit_transform(df)
    assert {r["x"] for r in apart.collect()} == {7, 9, 4}


@pytest.mark.parametrize("method,n", [("md5", 8), ("sha1", 7), ("sha256", 3), ("sha512", 32), ("blake2b", 5)])
def test_hashing_against_hashlib(spark, method, n):
    import hashlib

    values = ["a", "bb", "", "ü", None]
    out = en.HashingEncoder(["x"], n, method).fit_transform(frame(spark, values)).orderBy("i").collect()
    for v, r in zip(values, out, strict=True):
        want = [0] * n
        if v is not None:
            want[int(hashlib.new(method, v.encode()).hexdigest(), 16) % n] = 1
        assert list(r)[:n] == want


def test_drop_invariant(spark):
    enc = en.OneHotEncoder(["x"], "i", drop_invariant=True)
    assert enc.fit_transform(frame(spark, ["A", "A"]).drop("y")).columns == ["i"]


def test_target(spark):
    df = frame(spark, "UP UP DOWN FLAT DOWN UP DOWN FLAT FLAT FLAT".split(), [1, 1, 0, 0, 1, 0, 0, 0, 1, 1])
    got = dict(zip(col(df), col(ta.TargetEncoder("y", ["x"], 2, 10).fit_transform(df)), strict=True))
    assert got == pytest.approx({"UP": 0.5874, "DOWN": 0.4125, "FLAT": 0.5}, abs=1e-4)


def test_leave_one_out(spark):
    df = frame(spark, list("aaabbb"), [1, 0, 0, 1, 0, 1])
    assert col(ta.LeaveOneOutEncoder("y", ["x"]).fit_transform(df)) == pytest.approx([0, 0.5, 0.5, 0.5, 1, 0.5])
    df = frame(spark, list("12223"), [1, 0, 1, 0, 1])
    assert col(ta.LeaveOneOutEncoder("y", ["x"]).fit_transform(df)) == pytest.approx([0.6, 0.5, 0, 0.5, 0.6])


@pytest.mark.parametrize("parts", [1, 5])
def test_ordered(spark, parts):
    df = frame(spark, list("ABBCA"), [1, 0, 1, 0, 1]).repartition(parts)
    enc = ta.CatBoostEncoder("y", "i", ["x"])
    assert col(enc.fit_transform(df)) == pytest.approx([0.6, 0.6, 0.3, 0.6, 0.8])
    assert col(enc.transform(frame(spark, list("BBA")))) == pytest.approx([1.6 / 3, 1.6 / 3, 2.6 / 3])
    df = frame(spark, ["A", "B", "B", "C", "A", None, None, None], [1, 0, 1, 0, 1, 0, 1, 0])
    assert col(ta.CatBoostEncoder("y", "i", ["x"]).fit_transform(df)) == pytest.approx([0.5, 0.5, 0.25, 0.5, 0.75, 0.5, 0.25, 0.5])


def test_m_estimate(spark):
    df = frame(spark, list("AABB"), [1, 1, 0, 1])
    for m, want in ((0, [1, 0.5, 0.75]), (1, [2.75 / 3, 1.75 / 3, 0.75])):
        assert col(ta.MEstimateEncoder("y", ["x"], m).fit(df).transform(frame(spark, list("ABC")))) == pytest.approx(want)


def test_woe(spark):
    df = frame(spark, list("aabb"), [1, 0, 0, 0])
    enc = ta.WOEEncoder("y", ["x"])
    assert col(enc.fit_transform(df)) == pytest.approx([0.5108256, 0.5108256, -0.5877867, -0.5877867])
    assert col(enc.transform(frame(spark, [None, "z"]))) == [0, 0]
    with pytest.raises(ValueError):
        ta.WOEEncoder("y", ["x"]).fit(frame(spark, list("ab"), [1, 2]))


@pytest.mark.parametrize("model", ["independent", "pooled", "beta", "binary"])
def test_james_stein(spark, model):
    ids = frame(spark, list("abcd"), [1, 0, 1, 0])
    assert set(col(ta.JamesSteinEncoder("y", ["x"], model).fit_transform(ids))) == {0.0 if model == "binary" else 0.5}
    df = frame(spark, list("aaaabbbbccccdddd"), [1, 1, 1, 1, 1, 1, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0])
    got = col(ta.JamesSteinEncoder("y", ["x"], model).fit_transform(df))
    assert got[0] >= got[4] >= got[8] >= got[12] and got[0] > got[12]


def test_noise_only_in_training(spark):
    df = frame(spark, list("aabb") * 20, [1, 0, 1, 1] * 20)
    enc = ta.MEstimateEncoder("y", ["x"], sigma=0.1, seed=3).fit(df)
    assert len(set(col(enc.transform(df)))) == 2 < len(set(col(enc.transform(df, training=True))))


@pytest.mark.parametrize("cls", [ta.TargetEncoder, ta.LeaveOneOutEncoder, ta.MEstimateEncoder, ta.WOEEncoder, ta.JamesSteinEncoder])
def test_renamed_categories_and_partitions_change_nothing(spark, cls):
    values, y = ["a", "b", "a", None, "c", "b", None, "a"], [1, 0, 0, 1, 1, 1, 0, 1]
    other = [None if v is None else "q" + v for v in values]
    a = col(cls("y", ["x"]).fit_transform(frame(spark, values, y)))
    assert a == pytest.approx(col(cls("y", ["x"]).fit_transform(frame(spark, other, y).repartition(7))))
    assert all(math.isfinite(v) for v in a)


def test_out_of_fold_leaves_own_fold_out(spark):
    df = frame(spark, list("aaaa"), [1, 0, 0, 0]).withColumn("fold", F.col("i") % 2)
    got = col(ta.out_of_fold(df, "x", "y", "fold", lambda s, c, p: s / c, "e"), "e")
    assert got == pytest.approx([0, 0.5, 0, 0.5])
