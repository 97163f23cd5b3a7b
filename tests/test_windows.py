"""Windows over long series and order statistics against pandas and plain Python."""

import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.core import frames
from tallyframe.core.order import placed
from tallyframe.operators import features as fe
from tallyframe.operators import history
from tallyframe.operators import windows as wi

SCHEMA = "id long, ts timestamp, k string, x double, n long"


@pytest.fixture(scope="module")
def series():
    rnd, start, rows = random.Random(4), pd.Timestamp("2024-01-01"), []
    for i in range(900):
        at = start + pd.Timedelta(seconds=rnd.choice([rnd.randint(0, 40_000), 7200, rnd.randint(90_000, 91_000)]))
        rows.append((i, None if rnd.random() < 0.02 else at.to_pydatetime(), rnd.choice("aab"), None if rnd.random() < 0.1 else rnd.choice([float(rnd.randint(0, 20)), rnd.random()]), rnd.randint(0, 9)))
    return rows


def same(a, b):
    return (a is None or a != a) if b is None or b != b else a is not None and abs(a - b) <= 1e-9 * max(1, abs(b))


def test_frames():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 7, 300):
        x = rnd.integers(0, max(1, n // 3) + 1, n)
        low = rnd.integers(0, n + 1, 200)
        high = np.minimum(n, low + rnd.integers(0, n + 1, 200))
        got, distinct = frames.medians(x.astype(float), low, high), frames.distinct_counts(x, low, high)
        for a, b, m, d in zip(low, high, got, distinct, strict=True):
            own = x[a:b].tolist()
            assert d == len(set(own)) and (m != m if not own else m == statistics.median(own))


def test_sums_and_extremes_of_frames():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        x = rnd.normal(size=n) * 10.0 ** rnd.integers(-3, 6, n)
        x[n // 2 :] = rnd.choice([0.1, 0.3], n - n // 2)
        low = rnd.integers(0, n + 1, 200)
        high = np.minimum(n, low + rnd.integers(0, n + 1, 200))
        least, most = frames.extremes(x, low, high, False), frames.extremes(x, low, high, True)
        got = np.column_stack(frames.power_sums(x, low, high, 3))
        for i, (a, b) in enumerate(zip(low, high, strict=True)):
            own = x[a:b]
            if len(own):
                d = own - own.mean()
                assert least[i] == own.min() and most[i] == own.max()
                assert np.allclose(got[i], [len(own), own.sum(), (d**2).sum(), (d**3).sum()], rtol=1e-9, atol=1e-9 * np.abs(own).max() ** 3)
            else:
                assert not got[i].any()


def test_no_frame_is_read_from_every_row(spark, series):
    df = spark.createDataFrame(series, SCHEMA)
    made = wi.framed(df, ["k"], ["id"], "n", ["min", "max", "sum", "mean", "std", "skew", "count"], "w_", -300, -1, False, 2)
    timed = wi.time_windows(df, "ts", "x", 10**9, ["min", "max", "sum", "mean", "std", "skew", "count"], "w_")
    back = [fe.bfill(df, ["k"], ["id"], "x"), fe.nearest_flag(df.withColumn("f", F.lit(1)), ["k"], "ts", "f"), wi.filled_back(df.filter("ts is not null"), ["ts", "id"], ["x"])]
    for out in (made, timed, *back):
        plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "unboundedfollowing$()))" not in plan.replace("unboundedpreceding$(), unboundedfollowing$()", "") and "rangeframe, -" not in plan
    assert [made.schema[f"w_{s}"].dataType.simpleString() for s in ("min", "max", "sum", "mean", "std", "skew", "count")] == ["bigint"] * 3 + ["double"] * 3 + ["bigint"]
    pdf = pd.DataFrame(series, columns=["id", "ts", "k", "x", "n"])
    got = made.orderBy("id").toPandas()
    for i, k, c in zip(got["id"], got["k"], got["w_count"], strict=True):
        own = pdf[(pdf["k"] == k) & (pdf["id"] >= i - 300) & (pdf["id"] < i)]["n"]
        assert c == len(own)
        for s in ("min", "max", "sum", "mean", "std", "skew"):
            want = getattr(own, s)() if len(own) > 1 else None
            assert same(got[f"w_{s}"][i], want), (i, s)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_time_windows(spark, series, keys):
    df = spark.createDataFrame(series, SCHEMA).repartition(3)
    span, stats = 900, ["median", "nunique", "mean", "count", "max"]
    got = {r["id"]: r for r in wi.time_windows(df, "ts", "x", span * 1_000_000, stats, "w_", keys, 2).collect()}
    assert len(got) == len(series)
    for i, ts, k, _, _ in series:
        own = [r[3] for r in series if ts and r[1] and 0 < (ts - r[1]).total_seconds() <= span and r[3] is not None and (not keys or r[2] == k)]
        want = {"median": statistics.median(own), "nunique": len(set(own)), "mean": statistics.mean(own), "max": max(own)} if len(own) > 1 else dict.fromkeys(stats)
        assert got[i]["w_count"] == len(own) and all(same(got[i][f"w_{s}"], want[s]) for s in stats if s != "count"), (i, got[i], want)


def test_row_windows_shifts_running_and_fill(spark, series):
    series = [(i, ts, k, x, n) for i, ts, k, x, n in series if ts]
    df = spark.createDataFrame(series, SCHEMA).repartition(3)
    by = sorted(series, key=lambda r: (r[1], r[0]))
    pdf = pd.DataFrame(by, columns=["id", "ts", "k", "x", "n"])
    order = ["ts", "id"]
    for rows in (7, 64, 1 << 20):
        got = wi.row_windows(df, order, "x", 9, ["median", "nunique", "sum"], "w_", 3, rows).orderBy(*order).toPandas()
        roll = pdf["x"].rolling(9, min_periods=3)
        assert np.allclose(got["w_median"], roll.median(), equal_nan=True) and np.allclose(got["w_sum"], roll.sum(), equal_nan=True)
        assert np.allclose(got["w_nunique"], roll.apply(lambda v: pd.Series(v).nunique()), equal_nan=True)
        got = wi.shifted(df, order, {"a": ("x", 3), "b": ("n", -20)}, rows).orderBy(*order).toPandas()
        assert np.allclose(got["a"], pdf["x"].shift(3), equal_nan=True) and np.allclose(got["b"], pdf["n"].shift(-20), equal_nan=True)
        got = wi.running(df, order, "x", ["count", "sum", "mean", "std", "min", "max", "nunique"], "r_", rows=rows).orderBy(*order).toPandas()
        ex = pdf["x"].expanding()
        for s in ("count", "sum", "mean", "std", "min", "max"):
            assert np.allclose(got[f"r_{s}"], getattr(ex, s)(), equal_nan=True), s
        seen, want = set(), []
        for v in pdf["x"]:
            seen |= set() if v != v else {v}
            want.append(len(seen))
        assert got["r_nunique"].fillna(0).tolist() == want
        got = wi.filled_back(df, order, ["x"], rows).orderBy(*order).toPandas()
        assert np.allclose(got["x"], pdf["x"].bfill(), equal_nan=True) and list(got.columns) == df.columns


def test_expanding_median_of_keys_and_texts(spark, series):
    df = spark.createDataFrame(series, SCHEMA)
    got = wi.framed(df, ["k"], ["id"], "x", ["median", "nunique"], "e_", None, 0, True).orderBy("id").toPandas()
    for k, own in pd.DataFrame(series, columns=["id", "ts", "k", "x", "n"]).groupby("k"):
        assert np.allclose(got[got["k"] == k]["e_median"], own["x"].expanding().median(), equal_nan=True)
    texts = wi.framed(df.withColumn("one", F.lit(1)), ["one"], ["id"], "k", ["nunique"], "t_", -2, 0, True).orderBy("id").toPandas()
    ks = [r[2] for r in series]
    assert texts["t_nunique"].tolist() == [len(set(ks[max(0, i - 2) : i + 1])) for i in range(len(ks))]


def test_places_split_ties_and_empty(spark):
    df = spark.range(1000).withColumn("x", F.lit(1))
    assert sorted(r["p"] for r in placed(df, ["x"], "p").collect()) == list(range(1000))
    none = df.filter("id < 0")
    assert wi.row_windows(none, ["id"], "x", 3, ["sum"], "w_").collect() == [] and wi.running(none, ["id"], "x", ["mean"], "r_").collect() == []
    assert wi.filled_back(none, ["id"], ["x"]).collect() == []


def test_moments_of_values_that_differ_by_their_last_digit(spark):
    near = 7.000000000000001
    rows = [(7.0, 7.0, 7.0, 7.0, near), (7.0, near, near, 7.0, 7.0), (36.0, 8.0, 2.0, 7.0, 6.0), (7.0, 7.0, 7.0, 7.0, 7.0), (7.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = [(r["h_skew"], r["h_kurt"]) for r in fe.horizontal_moments(df, list("abcde"), "h_").collect()]
    want = [(5**0.5, 5.0), (-0.7347778569623428, 2.0), (2.0771227960910488, 4.495641351988352), (0.0, 0.0), (None, None)]  # the second: DuckDB's figures
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True)), got


def test_history_of_slots_in_buckets(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "a", "b", None]), rnd.randint(0, 14), rnd.choice([None, float(rnd.randint(0, 6)), rnd.random()])) for _ in range(500)]
    df, stats = spark.createDataFrame(rows, "slot string, d int, x double").repartition(3), ["median", "nunique", "std", "skew", "count", "mean", "min"]
    for low, high in ((None, -1), (None, 0), (-3, -1), (-2, 0)):
        for bucket in (16, 1 << 20):
            got = {(r["slot"], r["d"]): r for r in history.slot_history(df, stats, low, high, bucket).collect()}
            assert got.keys() == {r[:2] for r in rows}
            for (slot, d), r in got.items():
                own = pd.Series([x for s, t, x in rows if s == slot and t <= d + high and (low is None or t >= d + low) and x is not None], dtype=float)
                want = [own.median(), own.nunique() if len(own) else None, own.std(), own.skew(), len(own), own.mean(), own.min()]
                assert all(same(r[s], w) or (s == "skew" and abs(r[s] - w) < 1e-6) for s, w in zip(stats, want, strict=True)), (slot, d, r, want)
