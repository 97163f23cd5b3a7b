"""Metrics and ensemble arithmetic as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.order import placed, summed_before


def regression(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """One row: rmse, rmsle, mae."""
    return df.agg(F.sqrt(F.avg(F.pow(y - p, 2))).alias("rmse"), F.sqrt(F.avg(F.pow(F.log1p(y) - F.log1p(p), 2))).alias("rmsle"), F.avg(F.abs(y - p)).alias("mae"))


def binary(df: DataFrame, y: Column, p: Column, cut: float = 0.5) -> DataFrame:
    """One row: accuracy, f1, mcc, brier, logloss, focal (gamma 2)."""
    hit = (p >= cut).cast("double")
    tp, tn = F.sum(y * hit), F.sum((1 - y) * (1 - hit))
    fp, fn = F.sum((1 - y) * hit), F.sum(y * (1 - hit))
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    pt = F.when(y == 1, q).otherwise(1 - q)
    return df.agg(
        F.avg((y == hit).cast("double")).alias("accuracy"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        F.avg(F.pow(y - p, 2)).alias("brier"), F.avg(-F.ln(pt)).alias("logloss"), F.avg(-F.pow(1 - pt, 2) * F.ln(pt)).alias("focal"),
    )


def focal_loss(y: Column, raw: Column, alpha: float, gamma: float) -> dict[str, Column]:
    """loss, grad and hess of the focal loss of a raw score, with class weights ``alpha`` and 1 - ``alpha``; derivatives in closed form."""
    p = 1 / (1 + F.exp(-raw))
    pt, weight, sign = F.when(y == 1, p).otherwise(1 - p), F.when(y == 1, F.lit(alpha)).otherwise(1 - alpha), F.when(y == 1, 1.0).otherwise(-1.0)
    away, log = F.pow(1 - pt, F.lit(gamma)), F.ln(pt)
    inner = gamma * pt * log - (1 - pt)
    return {"loss": -weight * away * log, "grad": sign * weight * away * inner, "hess": weight * pt * away * ((1 - pt) * (gamma * log + gamma + 1) - gamma * inner)}


def auc(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """One row: the exact area under the ROC curve, from ranks with ties at their mean.

    Scores are first grouped, so the running count is over distinct scores, in range-partitioned parts.
    """
    g = df.select(y.cast("double").alias("y"), p.alias("p")).groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    parts = g.withColumn("part", F.floor(F.col("p") * 1024))
    sums = parts.groupBy("part").agg(F.sum("neg").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0.0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    r = parts.join(sums, "part").withColumn("below", F.col("before") + F.coalesce(F.sum("neg").over(inside), F.lit(0.0)))
    return r.agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def auc_many(df: DataFrame, y: str, scores: list[str], bucket: int = 1 << 20) -> DataFrame:
    """(column, auc): the exact area of every score column, null where one class is missing; scores of any range.

    All columns are unpivoted and grouped by score, put in the order of (column, score) by ranges, and the negatives
    before each score are one running sum in two levels, less what the columns before have. Rows without a score or
    label are left out of a column.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("p")) for i, c in enumerate(scores)])
    g = df.select(F.col(y).cast("double").alias("y"), F.inline(cells)).filter("y is not null and p is not null and not isnan(p)")
    g = g.groupBy("c", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    at = summed_before(placed(g, ["c", "p"], "__p"), "__p", F.col("neg"), "before", bucket)
    one = at.groupBy("c").agg(F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2)).alias("s"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("before").alias("start"))
    auc = F.try_divide(F.col("s") - F.col("start") * F.col("pos"), F.col("pos") * F.col("neg"))
    names = F.array(*map(F.lit, scores))
    every = df.sparkSession.range(len(scores)).select(F.col("id").cast("int").alias("k"))
    return every.join(F.broadcast(one), F.col("k") == F.col("c"), "left").select(names[F.col("k")].alias("column"), auc.alias("auc"))


def f1_threshold(df: DataFrame, y: Column, p: Column, grid: list[float]) -> DataFrame:
    """(threshold, f1) of every threshold, in one aggregation."""
    one = df.agg(*[F.struct(F.sum(y * (p > t).cast("double")).alias("tp"), F.sum((p > t).cast("double")).alias("hits"), F.sum(y).alias("pos")).alias(f"c{i}") for i, t in enumerate(grid)])
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.try_divide(2.0 * F.col(f"c{i}.tp"), F.col(f"c{i}.hits") + F.col(f"c{i}.pos")).alias("f1")) for i, t in enumerate(grid)])
    return one.select(F.inline(cells))


def ndcg(df: DataFrame, truth: str, ranked: str, k: int = 5) -> DataFrame:
    """One row: the mean NDCG@k for one right class a row; ``ranked`` is an array, best first."""
    at = F.array_position(F.slice(F.col(ranked), 1, k), F.col(truth))
    return df.agg(F.avg(F.when(at > 0, 1 / F.log2(at + 1)).otherwise(0.0)).alias("ndcg"))


def top_k(scores: dict[str, Column], k: int) -> Column:
    """The names of the k largest scores, ties by name."""
    pairs = F.array(*[F.struct((-s).alias("s"), F.lit(n).alias("n")) for n, s in scores.items()])
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: x["n"])


def match_score(truth: Column, guess: Column) -> Column:
    """1 for the same code, 1/7 for the same letter, 1/3 for the same digit, else 0 (codes like ``A_1``)."""
    a, b = F.split(truth, "_"), F.split(guess, "_")
    return F.when(truth == guess, 1.0).when(a[0] == b[0], 1 / 7).when(a[1] == b[1], 1 / 3).otherwise(0.0)


def odds_product(probabilities: list[Column], factor: float = 9.0) -> Column:
    """The product of the odds factor * p / (1 - p), over ``factor``; taken as a sum of logarithms."""
    logs = [F.ln(factor * p / (1 - p)) for p in probabilities]
    return F.exp(reduce(lambda a, b: a + b, logs)) / factor


def gated_odds(train: DataFrame, y: str, test: DataFrame, every: DataFrame, key: str, models: list[str], least: float = 0.5, factor: float = 9.0) -> DataFrame:
    """(key, target): for each row of ``every`` the probability from the product of odds of ``models`` in ``test``, 0 where it has no row.

    Models whose area on ``train`` is under ``least`` are left out; without any the odds are 1 / ``factor``.
    """
    good = {r["column"] for r in auc_many(train, y, models).filter(F.col("auc") >= least).collect()}
    chosen = [F.col(m) for m in models if m in good]
    odds = odds_product(chosen, factor) if chosen else F.lit(1 / factor)
    told = test.select(F.col(key), (odds / (1 + odds)).alias("target"))
    return every.select(key).join(told, key, "left").select(key, F.coalesce("target", F.lit(0.0)).alias("target"))


def blend(columns: list[Column], weights: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [c * w for c, w in zip(columns, weights, strict=True)]) / sum(weights)
