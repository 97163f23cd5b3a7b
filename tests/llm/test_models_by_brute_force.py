"""Whole predictions of the learned operators against plain Python."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import html_extract as he
from tallyframe.llm import language as la
from tallyframe.llm import url_filter as uf


def test_url_verdicts_by_all_splits(spark):
    weights = {"cat": 5.0, "cats": 2.0, "at": 1.0, "scat": 0.5, "news": 3.0, "new": 1.0, "slot": 2.0, "slots": 2.0, "a": 0.1}
    labelled = {"block": [["slots", "win"], ["slot", "slot", "cats"]], "allow": [["news", "cat"], ["cats", "77"], ["new"]]}
    low, total = min(weights.values()), sum(weights.values())

    def score(word):
        return math.log(weights[word] / total) if word in weights else math.log(low / total) - 2 * math.log(10) - math.log(10) * (len(word) - 1)

    def split(run):
        cuts = [c for n in range(len(run)) for c in combinations(range(1, len(run)), n)]
        parts = [[run[a:b] for a, b in zip((0, *c), (*c, len(run)), strict=True)] for c in cuts]
        return max(parts, key=lambda p: sum(map(score, p)))

    words = {w for v in labelled.values() for u in v for w in u}
    n = {v: Counter(w for u in labelled[v] for w in u) for v in labelled}
    size = {v: sum(n[v].values()) + len(words) for v in n}
    judge = uf.Judge(weights, labelled, 0.3)
    rnd = random.Random(1)
    hosts = ["catsnews", "slotscat", "newslots", "scatsat", "xqcats", "www"] + ["".join(rnd.choice(["cat", "s", "news", "slot", "a", "q"]) for _ in range(3))[:11] for _ in range(25)]
    for host in hosts:
        want = split(host)
        got, odds = judge.judge(f"{host}.77", "/Cats/slot-1")
        assert sum(map(score, got[:-1])) == pytest.approx(sum(map(score, want))) and got[-1] == "77"
        tokens = [*got, "cats", "slot", "1"]
        both = [math.log(p) + sum(math.log((n[v][t] + 1) / size[v]) for t in tokens if t in words) for v, p in (("block", 0.3), ("allow", 0.7))]
        assert odds == pytest.approx(both[0] - both[1])
    df = spark.createDataFrame([(1, "http://casinoslots.net/"), (2, "http://citylibrary.net/books")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in uf.filter_urls(df, vocabulary=None).collect()} == {1: "block", 2: "allow"}


def test_a_step_is_the_gradient_of_the_likelihood():
    rnd = np.random.default_rng(2)
    feats = [np.array(sorted(rnd.choice(8, 3, replace=False))) for _ in range(5)]
    labels, t = [0, 1, 1, 0, 1], rnd.normal(size=(2, 2))
    w = np.zeros(he.FEATURES)
    w[:8] = rnd.normal(size=8)

    def likelihood(w, t):
        def value(ys):
            return sum(w[f].sum() * y for f, y in zip(feats, ys, strict=True)) + sum(t[a, b] for a, b in zip(ys, ys[1:], strict=False))

        return value(labels) - np.logaddexp.reduce([value(ys) for ys in product((0, 1), repeat=5)])

    rate, eps = 1e-3, 1e-6
    field = he.Field(w, t)
    field.learn(feats, labels, rate)
    for k in range(8):
        up = w.copy()
        up[k] += eps
        slope = (likelihood(up, t) - likelihood(w, t)) / eps
        assert (field.w[k] / (1 - rate * he.DECAY) - w[k]) / rate * len(labels) ** 0.5 == pytest.approx(slope, abs=1e-4)
    for a, b in product((0, 1), repeat=2):
        up = t.copy()
        up[a, b] += eps
        assert (field.t[a, b] - t[a, b]) / rate * len(labels) == pytest.approx((likelihood(w, up) - likelihood(w, t)) / eps, abs=1e-4)


def test_language_model_from_its_parts(spark):
    rnd = random.Random(3)
    letters = {"aa": "abcdeé", "bb": "bcdefa", "cc": "abcdfñ"}
    rows = [(i, " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 4))), lang) for i, lang in enumerate(rnd.choices(list(letters), k=120))]
    rows.append((500, "123", "aa"))
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(3)
    model = la.train(df)

    def features(text):
        line = np.frombuffer(text.encode(), np.uint8)
        got = next(iter(la._features(line, np.array([0, len(line)]), len(model.idf))))
        return got

    seen = [f for _, text, _ in rows if (f := features(text)) is not None]
    times = Counter(k for f, _ in seen for k in f.tolist())
    for k in random.Random(4).sample(sorted(times), 50) + [next(i for i in range(len(model.idf)) if i not in times)]:
        assert model.idf[k] == pytest.approx(math.log((1 + len(seen)) / (1 + times.get(k, 0))) + 1)

    def vector(text):
        f, n = features(text)
        x = [(1 + math.log(c)) * model.idf[k] for k, c in zip(f.tolist(), n.tolist(), strict=True)]
        return f, np.array(x) / math.sqrt(sum(v * v for v in x))

    shards = max(la.SHARDS, len(letters) // 16)
    turns = {r["id"]: (r["t"], r["s"]) for r in df.select("id", F.xxhash64("id", F.lit("turn")).alias("t")).withColumn("s", F.pmod(F.xxhash64("t", F.lit("shard")), F.lit(shards))).collect()}
    parts, out = defaultdict(list), []
    for i, text, lang in sorted(rows, key=lambda r: turns[r[0]][0]):
        if features(text) is not None:
            f, x = vector(text)
            row = (model.langs.index(lang), f, x.astype(np.float32).astype(float))
            (parts[turns[i][1]] if turns[i][0] % 5 else out).append(row)
    z = n = np.zeros((len(model.idf), 3))
    for _ in range(la.EPOCHS):
        after = [la.ftrl(p, z, n) for p in parts.values()]
        z, n = (np.mean([a[k] for a in after], axis=0) for k in (0, 1))
    assert np.allclose(la._weights(z, n), model.weights, atol=1e-9)

    def chances(f, x, heat):
        s = [math.fsum(x * model.weights[f, c]) / heat for c in range(3)]
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    losses = [sum(-math.log(max(chances(f, x, h)[y], 1e-300)) for y, f, x in out) for h in la.HEATS]
    assert losses[int(np.argmin(np.abs(la.HEATS - model.heat)))] == pytest.approx(min(losses), rel=1e-4)
    for r in la.predict(df.select("id", "text"), model).collect():
        text = next(t for i, t, _ in rows if i == r["id"])
        if features(text) is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            p = chances(*vector(text), model.heat)
            assert r["lang_pred"] == model.langs[int(np.argmax(p))] and r["score"] == pytest.approx(max(p), rel=1e-6)
