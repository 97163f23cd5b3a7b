"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; everything but letters is one gap between words. N-grams of 1 to ``LONGEST``
characters are hashed to ``BUCKETS`` features, weighted by (1 + log tf) * idf and scaled to length 1. From 64
languages on there are fewer features, so that features times languages, the size of the training's state,
stay within ``STATE``; no language is left out, and more than ``LANGUAGES`` raise an error.
Document frequencies are counted over every document that may be learnt from. The weights are trained by
follow-the-regularised-leader with an elastic-net penalty on a bounded sample, at most about ``PER_LANG``
documents a language (their ids' hashes decide): ``SHARDS`` tasks (one for 16 languages, if that is more) run over their part from one state, the
states are averaged, block by block of features, ``EPOCHS`` times. A fifth of the sample is kept out of that and sets the temperature
that the scores are divided by, the one of ``HEATS`` with the least log loss.

Only id and label pick the documents to learn from; predictions take the text alone. A null or empty text,
one without any letter, and every text if there is nothing to learn from, is ``und`` with score 0. A null id
is neither learnt from nor held out. Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import code_points
from .common import cut, read
from .words import chunks, mix

LONGEST, BUCKETS, PER_LANG, SHARDS, EPOCHS = 3, 1 << 16, 1000, 4, 3
ALPHA, BETA, L1, L2 = 0.5, 0.1, 0.02, 0.01
HEATS = np.geomspace(0.02, 20, 121)
#: Cells of the training's state (16 bytes each), the blocks it is averaged in, and most languages.
STATE, BLOCKS, LANGUAGES = BUCKETS << 6, 64, 16_384

_tables: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """The lower-case form of each code point that is a letter; 0 for what isn't one."""
    if not _tables:
        out = np.zeros(0x110000, np.uint32)
        for p in range(0x110000):
            if not 0xD800 <= p < 0xE000 and chr(p).isalpha():
                low = chr(p).lower()
                out[p] = ord(low) if len(low) == 1 else p
        _tables.append(out)
    return _tables[0]


def buckets_for(langs: int) -> int:
    """Features for so many languages: a power of two."""
    return min(BUCKETS, 1 << (STATE // max(langs, 1)).bit_length() - 1)


def _features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(features, counts) of each row, None for a row without letters."""
    points, bounds = code_points(data, offsets)
    low = _lower()[points]
    starts = np.zeros(len(low), bool)
    starts[bounds[:-1][bounds[:-1] < len(low)]] = True
    keep = (low > 0) | starts | np.concatenate([[True], low[:-1] > 0])[: len(low)]
    at = np.concatenate([[0], np.cumsum(keep)])[bounds]
    letters = np.concatenate([[0], np.cumsum(low > 0)])[bounds]
    line = np.concatenate([low[keep], np.zeros(LONGEST, np.uint32)]).astype(np.uint64)
    grams, h = [], np.zeros(len(line) - LONGEST, np.uint64)
    for k in range(LONGEST):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + line[k : len(h) + k] + np.uint64(1))
        grams.append((h & np.uint64(buckets - 1)).astype(np.int64))
    for r in range(len(at) - 1):
        if letters[r + 1] == letters[r]:
            yield None
            continue
        a, b = at[r], at[r + 1]
        own = np.concatenate([grams[k][a : max(a, b - k)] for k in range(LONGEST)])
        if len(own) < 2000:
            yield np.unique(own, return_counts=True)
        else:
            n = np.bincount(own, minlength=buckets)
            f = np.flatnonzero(n)
            yield f, n[f]


def _vector(f: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[f]
    return x / max(np.sqrt(x @ x), 1e-12)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights of a state: 0 where the L1 penalty holds them."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state after (class, features, values) one by one; state arrays are features x classes."""
    z, n = z.copy(), n.copy()
    for y, f, x in rows:
        zf, nf = z[f], n[f]
        w = _weights(zf, nf)
        p = _softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p[None, :]
        n[f] = nf + g * g
        z[f] = zf + g - (np.sqrt(n[f]) - np.sqrt(nf)) / ALPHA * w
    return z, n


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, heat: float = 1.0):
        self.langs, self.idf, self.weights, self.heat = langs, idf, weights, heat


def train(learn: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """A model of (id, text, lang), null texts and languages left out beforehand."""
    spark = learn.sparkSession
    counts = {r["lang"]: r["c"] for r in learn.groupBy("lang").agg(F.count("*").alias("c")).limit(LANGUAGES + 1).collect()}
    langs = sorted(counts)
    if not langs:
        return None
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    buckets = buckets_for(len(langs))

    def seen(batches):
        df, docs = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                for got in _features(data, offsets, buckets):
                    if got is not None:
                        df[got[0]] += 1
                        docs += 1
        f = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1)), pa.array(np.append(df[f], docs))], ["f", "n"])

    df = learn.select("text").mapInArrow(seen, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n = df.column("f").to_numpy(), df.column("n").to_numpy().astype(float)
    docs = n[f == -1].sum()
    idf = np.full(buckets, np.log(1 + docs) + 1)
    idf[f[f >= 0]] = np.log((1 + docs) / (1 + n[f >= 0])) + 1

    share = spark.createDataFrame([(lang, i, min(1.0, per_lang / counts[lang])) for i, lang in enumerate(langs)], "of string, y long, share double")
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    sample = learn.join(F.broadcast(share), F.col("lang") == F.col("of")).filter(draw < F.col("share"))  # at most LANGUAGES rows
    sample = sample.select("text", "y", F.xxhash64("id", F.lit("turn")).alias("turn"))

    def vectors(batches):
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(0)):
                own = batch.slice(first, end - first)
                for y, turn, got in zip(own.column(1).to_pylist(), own.column(2).to_pylist(), _features(data, offsets, buckets), strict=True):
                    if got is not None:
                        x = _vector(*got, idf).astype(np.float32)
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((y, pa.int64()), (turn, pa.int64()), (got[0].astype(np.int32).tobytes(), pa.binary()), (x.tobytes(), pa.binary()))], ["y", "turn", "f", "x"])

    vecs = cut(sample.mapInArrow(vectors, "y long, turn long, f binary, x binary"))
    fit = vecs.filter(F.pmod("turn", F.lit(5)) > 0).withColumn("shard", F.pmod(F.xxhash64("turn", F.lit("shard")), F.lit(max(SHARDS, len(langs) // 16))))
    z, n = np.zeros((buckets, len(langs))), np.zeros((buckets, len(langs)))
    size = buckets // BLOCKS

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], **{k: [np.mean([np.frombuffer(x, float) for x in pdf[k]], axis=0).tobytes()] for k in ("z", "n")}})

    for _ in range(EPOCHS):
        state = spark.sparkContext.broadcast((z, n))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = [(r.y, np.frombuffer(r.f, np.int32), np.frombuffer(r.x, np.float32).astype(float)) for r in pdf.sort_values("turn").itertuples()]
            after = ftrl(rows, *state.value)
            return pd.DataFrame([(b, *(a[b * size : (b + 1) * size].tobytes() for a in after)) for b in range(BLOCKS)], columns=["block", "z", "n"])

        kinds = "block long, z binary, n binary"
        z, n = z.copy(), n.copy()
        for r in fit.groupBy("shard").applyInPandas(one, kinds).groupBy("block").applyInPandas(mean, kinds).collect():  # one state
            for k, a in (("z", z), ("n", n)):
                a[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r[k], float).reshape(size, -1)
    weights = _weights(z, n)
    shared = spark.sparkContext.broadcast(weights)

    def losses(batches):
        total = np.zeros(len(HEATS))
        for batch in batches:
            for y, f, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = np.frombuffer(x, np.float32) @ shared.value[np.frombuffer(f, np.int32)]
                total -= np.log(np.maximum(_softmax(s[None, :] / HEATS[:, None])[:, y], 1e-300))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(HEATS))), pa.array(total)], ["k", "loss"])

    kept_out = vecs.filter(F.pmod("turn", F.lit(5)) == 0)
    loss = kept_out.select("y", "f", "x").mapInArrow(losses, "k long, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).orderBy("loss", "k").first()
    heat = float(HEATS[loss["k"]]) if loss and loss["loss"] > 0 else 1.0
    return Model(langs, idf, weights, heat)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without text, with lang_pred and score."""
    keys = [c for c in docs.columns if c != "text"]
    if model is None:
        return docs.select(*keys, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def name(batches):
        m = shared.value
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(0)):
                langs, scores = [], []
                for got in _features(data, offsets, len(m.idf)):
                    if got is None:
                        langs.append("und")
                        scores.append(0.0)
                    else:
                        p = _softmax(_vector(*got, m.idf) @ m.weights[got[0]] / m.heat)
                        langs.append(m.langs[int(p.argmax())])
                        scores.append(float(p.max()))
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*own.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keys, "lang_pred", "score"])

    names = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.select("text", *keys).mapInArrow(name, f"{names}, lang_pred string, score double")


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row a document; documents of fold 2 are held out of training."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), fold(F.col(id_col)).alias("fold"))
    model = train(src.filter("fold <> 2 and lang is not null and text is not null").select("id", "text", "lang"), per_lang)
    held = F.coalesce(F.col("fold") == 2, F.lit(False))
    return predict(src.select(F.col("id").alias("doc_id"), held.alias("held_out"), "text"), model)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
