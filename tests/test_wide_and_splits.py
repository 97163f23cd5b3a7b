"""Anchors, cross products, sweeps, many columns at once, quotas and balanced folds against plain Python."""

import random
import re
from collections import Counter
from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import gram, stats
from tallyframe.operators import features as fe
from tallyframe.operators import splits, wide


@pytest.mark.parametrize("closed", ["left", "neither"])
def test_anchor_statistics(spark, closed):
    rnd, start = random.Random(1), date(2024, 1, 1)
    rows = [(rnd.choice(["a", "b", None]), None if rnd.random() < 0.02 else start + timedelta(days=rnd.randint(0, 200)), None if rnd.random() < 0.1 else float("nan") if rnd.random() < 0.05 else 1e6 + rnd.random()) for _ in range(500)]
    dates, spans, names = [start + timedelta(days=k) for k in (-5, 0, 3, 60, 61, 150, 900)], [1, 14, 365], ["sum", "count", "mean", "std", "min", "max"]
    df, anchors = spark.createDataFrame(rows, "k string, day date, x double"), spark.createDataFrame([(d,) for d in dates], "anchor date")
    got = {(r["anchor"], r["k"]): r for r in fe.anchor_windows(df, anchors, ["k"], "day", "x", spans, names, closed).collect()}
    want = {}
    for a in dates:
        for k in ("a", "b", None):
            own = {s: [x for q, d, x in rows if q == k and d and (a - timedelta(days=s) < d or (closed == "left" and a - timedelta(days=s) == d)) and d < a] for s in spans}
            if own[365]:
                want[a, k] = own
    assert set(got) == set(want)
    for key, own in want.items():
        for s in spans:
            x = [v for v in own[s] if v is not None and v == v]
            r = {n: got[key][f"x_{n}_{s}"] for n in names}
            assert r["count"] == len(x) and (r["sum"] is None) == (not x)
            if x:
                assert np.allclose([r["sum"], r["mean"], r["min"], r["max"]], [sum(x), np.mean(x), min(x), max(x)], rtol=1e-12)
            assert (r["std"] is None) if len(x) < 2 else abs(r["std"] - np.std(x, ddof=1)) < 1e-6
    assert fe.anchor_windows(df.limit(0), anchors, ["k"], "day", "x", spans, names).collect() == []


def test_rows_shuffled_do_not_depend_on_the_anchors(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 50).cast("int")).alias("day"), F.col("id").cast("double").alias("x"))
    plans = []
    for n in (1, 58):
        anchors = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=k),) for k in range(n)], "anchor date")
        plan = fe.anchor_windows(df, anchors, ["k"], "day", "x", [7], ["mean"])._jdf.queryExecution().executedPlan().toString()
        plans.append((plan.count("Exchange"), plan.count("Join"), plan.count("Generate")))
    assert plans[0] == plans[1] and plans[0][1:] == (0, 0)


def test_two_hundred_columns_and_their_pairs(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 200)) + 1e6
    x[:, 7] = x[:, 3] * 2 + rnd.normal(size=400) * 1e-3
    x[:, 9] = 5.0
    x[rnd.random(x.shape) < 0.05] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(200)])
    df = spark.createDataFrame(pdf).repartition(3)
    got = {(r["a"], r["b"]): r["r"] for r in gram.correlation_pairs(df, list(pdf.columns)).collect()}
    assert len(got) == 199 * 100 and got["c3", "c9"] is None and got["c3", "c7"] > 0.999
    for a, b in random.Random(2).sample(sorted(got), 200):
        if "c9" not in (a, b):
            assert abs(got[a, b] - pdf[a].corr(pdf[b])) < 1e-9
    assert {(r["a"], r["b"]) for r in stats.correlations(df.select("c1", "c2"), ["c1", "c2"]).collect()} == {("c1", "c2")}


def test_sweeps_equal_least_squares(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 6)) + 100
    x[:, 5] = x[:, 0] + x[:, 1]  # told by others
    y = 3 * x[:, 2] - x[:, 4] + 0.5 * x[:, 0] + rnd.normal(size=300)
    cols = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*cols, "y"])).repartition(2)
    df = df.unionByName(df.limit(3).withColumn("c1", F.lit(None).cast("double")))
    fit = gram.Regressions(df, cols, "y")

    def r2(subset):
        a = np.column_stack([np.ones(300), x[:, list(subset)]])
        return 1 - ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    assert fit.rows == 300
    for n in (1, 2, 3):
        assert abs(fit.exhaustive(n)[1] - max(r2(s) for s in combinations(range(6), n))) < 1e-9
    steps, chosen = fit.forward(4), []
    for c, r in steps:
        best = max((i for i in range(6) if i not in chosen), key=lambda i: r2([*chosen, i]))
        chosen.append(best)
        assert c == f"c{best}" and abs(r - r2(chosen)) < 1e-9
    back = gram.Regressions(df, cols[:5], "y").backward(2)
    left = [0, 1, 2, 3, 4]
    for c, r in back:
        worst = max(left, key=lambda i: r2([j for j in left if j != i]))
        left.remove(worst)
        assert c == f"c{worst}" and abs(r - r2(left)) < 1e-9
    assert abs(fit.r2(["c0", "c1", "c5"]) - r2([0, 1])) < 1e-9


def test_many_columns_both_ways(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["x", "y", None]), rnd.choice([1, 2, 3, None]), rnd.choice([0.5, float("nan"), 2.0]), float(i % 3 == 0)) for i in range(60)]
    df, cols = spark.createDataFrame(rows, "i long, a string, b int, c double, y double").repartition(3), ["a", "b", "c"]
    table = wide.ordinal(df, cols, "i")
    small = wide.looked_up(df, cols, table, "code", -1).orderBy("i").collect()
    assert small == wide.looked_up(df, cols, table, "code", -1, most=0).orderBy("i").collect()
    for k, c in enumerate(cols, 1):
        seen = []
        for r, got in zip(rows, small, strict=True):
            v = None if r[k] is None or r[k] != r[k] else r[k]
            if v is not None and v not in seen:
                seen.append(v)
            assert got[c] == (-1 if v is None else seen.index(v) + 1)
    mean = wide.looked_up(df, ["a"], wide.means(df, ["a"], "y", 2.0), "value").orderBy("i").first()["a"]
    own = [r[4] for r in rows if r[1] == rows[0][1]]
    assert abs(mean - (sum(own) + 2 * 20 / 60) / (len(own) + 2)) < 1e-12
    flags = stats.unique_row_flag(spark.createDataFrame([(1, "a", 5), (1, "b", 5), (2, "b", None), (3, None, 5)], "p int, q string, r int"), ["p", "q", "r"], "u")
    assert sorted(flags.collect(), key=repr) == sorted([(1, "a", 5, True), (1, "b", 5, False), (2, "b", None, True), (3, None, 5, True)], key=repr)


def test_many_columns_come_in_one_and_in_methods_that_are_compiled(spark):
    cols = [f"c{i}" for i in range(60)]
    made = [F.expr(f"concat('v', cast((id * {i + 3} + id) % {i + 5} as string))").alias(c) for i, c in enumerate(cols)]
    df = spark.range(100).select("id", (F.col("id") % 2 == 0).cast("int").alias("y"), *made)
    table = wide.means(df, cols, "y")

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the code of a plan is made as it runs else
    try:
        for out in (table, wide.looked_up(df, cols, table, "value")):
            plan = out._jdf.queryExecution().executedPlan()
            code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
            assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", code))
            assert [n.children().apply(0).output().size() for n in nodes(plan) if n.nodeName() == "MapInArrow"] in ([2], [3])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_means_of_many_columns_over_many_chunks(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(i, *[rnd.choice(["", "a", "b", "\x00", None]) for _ in range(5)], rnd.choice([0, 1, None])) for i in range(400)]
    cols = list("abcde")
    df = spark.createDataFrame(rows, "i long, a string, b string, c string, d string, e string, y int").repartition(3)
    monkeypatch.setattr(wide, "CHUNK", 50)
    with_label = [r[6] for r in rows if r[6] is not None]
    prior, want = sum(with_label) / len(with_label), {}
    for k in range(5):
        for v in {r[k + 1] for r in rows}:
            own = [r[6] for r in rows if r[k + 1] == v and r[6] is not None]
            want[k, v] = (sum(own) + 2 * prior) / (len(own) + 2)
    table = wide.means(df, cols, "y", 2.0)
    got = {(r["c"], r["v"]): r["value"] for r in table.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    for r, x in zip(rows, wide.looked_up(df, cols, table, "value").orderBy("i").collect(), strict=True):
        assert all(abs(x[c] - want[k, r[k + 1]]) < 1e-12 for k, c in enumerate(cols)) and x["y"] == r[6]
    one = wide.looked_up(df.select("a"), ["a"], table.filter("c = 0 AND v = 'a'"), "value", -1.0)
    assert {x["a"] for x in one.collect()} == {-1.0, one.agg(F.max("a")).first()[0]}


def test_quotas(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([None, *range(40)]) if i % 3 else 7) for i in range(1500)]
    df = spark.createDataFrame(rows, "i long, u long").repartition(3)
    for bucket in (4, 1 << 20):
        out = splits.quota_split(df, "u", "i", 900, 200, bucket=bucket, hot=100).collect()
        assert len(out) == len(rows) and out[0].asDict().keys() == {"i", "u", "part"}
        n = Counter(r["part"] for r in out)
        sizes = Counter(r["u"] for r in out)
        assert 200 <= n["valid"] <= 200 + max(sizes.values()) and 900 < n["train"] <= 900 + max(sizes.values())
        for u in sizes:
            parts = [r["part"] for r in sorted(out, key=lambda r: r["i"]) if r["u"] == u]
            assert parts == sorted(parts, key=lambda p: p or "") and (None not in parts or set(parts) == {None})


def test_balanced_group_folds(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([None, *range(200)]) if rnd.random() < 0.7 else 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "i long, g long").repartition(3)
    sizes = sorted(Counter(g for _, g in rows).values(), reverse=True)
    for head in (10, 10_000):
        out = splits.balanced_group_fold(df, "g", 3, head=head, bucket=16).collect()
        folds = Counter(r["fold"] for r in out)
        assert len(out) == 4000 and all(len({r["fold"] for r in out if r["g"] == g}) == 1 for g in {r["g"] for r in out})
        top = out and {r["fold"] for r in out if r["g"] == 5}
        rest = [n for f, n in folds.items() if f not in top or sizes[0] <= 4000 / 3]
        assert set(folds) == {0, 1, 2} and max(rest) - min(rest) <= 2 * (sizes[10] if head == 10 else 40)
    assert splits.balanced_group_fold(df.limit(0), "g", 3).collect() == []


def test_groups_are_dealt_one_by_one_however_many(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.choice([None, *range(60), *[1000 + int(rnd.random() ** 3 * 400) for _ in range(40)]])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, g long").repartition(3)
    for k in (1, 3, 7):
        loads, want = [0] * k, {}
        for g, n in sorted(Counter(g for _, g in rows).items(), key=lambda x: (-x[1], x[0] is not None, x[0] or 0)):
            want[g] = loads.index(min(loads))
            loads[want[g]] += n
        for head in (10, 10_000):
            assert {r["g"]: r["fold"] for r in splits.balanced_group_fold(df, "g", k, head=head).collect()} == want
