"""The operators as named queries over the test tables, each with DuckDB SQL for the same result.

Floating results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import gram, metrics, stats
from ..functions.calendar import calendar, packed_hour, recency_weight
from ..operators import columns
from ..operators import encoders as en
from ..operators import features as fe
from ..operators import joins as jo
from ..operators import selection, splits
from ..operators import target as ta
from ..operators import wide
from ..operators import windows as wi
from ..sources import arff
from ..streaming.delayed import batch_features as delayed_batch_features
from ..streaming.knowledge import batch_features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def orders(spark, d):
    """Key, category and 0/1 target of each order."""
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))


def customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment")


ORD = "WITH o AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders), g AS (SELECT o_orderpriority AS cat, sum(y)::DOUBLE AS s, count(*) AS c, var_samp(y) AS v FROM o GROUP BY 1), p AS (SELECT avg(y) AS prior, count(*) AS n, sum(y)::DOUBLE AS ts, var_samp(y) AS tv, (SELECT count(*) FROM g) AS k FROM o) "
CODES = "WITH f AS (SELECT c_mktsegment AS cat, min(c_custkey) AS seen FROM customer GROUP BY 1), k AS (SELECT cat, row_number() OVER (ORDER BY seen, cat) AS code, (SELECT count(*) FROM f) AS n FROM f), c AS (SELECT c_custkey, code, n FROM customer JOIN k ON c_mktsegment IS NOT DISTINCT FROM cat) "


# encoders without a target

@query(CODES + "SELECT c_custkey, code::INT AS c_mktsegment FROM c")
def enc_ordinal(spark, d):
    return en.OrdinalEncoder(order_col="c_custkey").fit_transform(customers(spark, d))


@query("WITH s AS (SELECT c_mktsegment AS cat, min(c_custkey) AS seen FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING' GROUP BY 1), k AS (SELECT cat, row_number() OVER (ORDER BY seen, cat) AS code FROM s) SELECT c_custkey, coalesce(code, CASE WHEN x IS NULL THEN -2 ELSE -1 END)::INT AS c_mktsegment FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS x FROM customer) LEFT JOIN k ON x IS NOT DISTINCT FROM cat")
def enc_ordinal_unseen(spark, d):
    c = customers(spark, d)
    enc = en.OrdinalEncoder(order_col="c_custkey").fit(c.filter("c_custkey % 2 = 0 and c_mktsegment <> 'BUILDING'"))
    return enc.transform(c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def enc_ordinal_inverse(spark, d):
    enc = en.OrdinalEncoder(order_col="c_custkey")
    c = customers(spark, d)
    return enc.inverse_transform(enc.fit_transform(c))


@query(CODES + "SELECT c_custkey, " + ", ".join(f"(code = {i})::INT AS c_mktsegment_{i}" for i in range(1, 6)) + " FROM c")
def enc_onehot(spark, d):
    return en.OneHotEncoder(order_col="c_custkey").fit_transform(customers(spark, d))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def enc_onehot_inverse(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    enc = en.OneHotEncoder(order_col="o_orderkey", use_cat_names=True)
    return enc.inverse_transform(enc.fit_transform(o))


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INT AS o_orderstatus_{v}" for v in "FOP") + " FROM orders")
def enc_dummies(spark, d):
    return en.get_dummies(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"(l_returnflag = '{v}' OR l_linestatus = '{v}')::INT AS flag_{v}" for v in "ANRFO") + " FROM lineitem")
def enc_shared_dummies(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return en.shared_dummies(li, ["l_returnflag", "l_linestatus"], "flag", list("ANRFO")).drop("l_returnflag", "l_linestatus")


def _digits(base: int, width: int) -> str:
    return CODES + "SELECT c_custkey, " + ", ".join(f"((code // {base ** (width - 1 - i)}) % {base})::INT AS c_mktsegment_{i}" for i in range(width)) + " FROM c"


@query(_digits(2, 4))
def enc_basen2(spark, d):
    return en.BaseNEncoder(order_col="c_custkey", base=2).fit_transform(customers(spark, d))


@query(_digits(3, 3))
def enc_basen3(spark, d):
    return en.BaseNEncoder(order_col="c_custkey", base=3).fit_transform(customers(spark, d))


@query(_digits(2, 4))
def enc_binary(spark, d):
    return en.BinaryEncoder(order_col="c_custkey").fit_transform(customers(spark, d))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def enc_basen_inverse(spark, d):
    enc = en.BaseNEncoder(order_col="c_custkey", base=3)
    return enc.inverse_transform(enc.fit_transform(customers(spark, d)))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS p_brand, count(*) OVER (PARTITION BY p_type) AS p_type FROM part")
def enc_count(spark, d):
    return en.CountEncoder().fit_transform(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"))


@query("SELECT p_partkey, round(count(*) OVER (PARTITION BY p_brand) / (count(*) OVER ())::DOUBLE, 6) AS p_brand FROM part")
def enc_count_norm(spark, d):
    return rounded(en.CountEncoder(normalize=True).fit_transform(table(spark, d, "part").select("p_partkey", "p_brand")))


@query("WITH g AS (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1), m AS (SELECT avg(n) AS least FROM g), w AS (SELECT b, n, n < least AS small, sum(CASE WHEN n < least THEN n END) OVER () AS merged, count(*) FILTER (n < least) OVER () AS k, count(*) FILTER (n >= least) OVER () AS large FROM g, m) SELECT p_partkey, (CASE WHEN small AND k >= 2 AND large > 0 THEN merged ELSE n END)::BIGINT AS p_brand FROM part JOIN w ON p_brand = b")
def enc_count_min_group(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    least = p.groupBy("p_brand").count().agg(F.avg("count")).first()[0]
    return en.CountEncoder(min_group_size=least).fit_transform(p)


def _hex_mod(digest: str, n: int, length: int) -> str:
    out = "0"
    for k in range(0, length, 8):
        out = f"(({out}) * {(1 << 32) % n} + ('0x' || substr({digest}, {k + 1}, 8))::BIGINT) % {n}"
    return out


@query("WITH h AS (SELECT o_orderkey, " + _hex_mod("md5(o_orderpriority)", 8, 32) + " AS a, " + _hex_mod("md5(o_orderstatus)", 8, 32) + " AS b FROM orders) SELECT o_orderkey, " + ", ".join(f"((a = {i})::INT + (b = {i})::INT)::INT AS col_{i}" for i in range(8)) + " FROM h")
def enc_hash_md5(spark, d):
    return en.HashingEncoder(["o_orderpriority", "o_orderstatus"]).fit_transform(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"))


def _contrast(m) -> str:
    cells = ", ".join("round(CASE code " + " ".join(f"WHEN {i + 1} THEN {float(v)!r}" for i, v in enumerate(m[:, j])) + f" END::DOUBLE, 6) AS c_mktsegment_{j}" for j in range(m.shape[1]))
    return CODES + f"SELECT 1 AS intercept, c_custkey, {cells} FROM c"


@query(CODES + "SELECT 1 AS intercept, c_custkey, " + ", ".join(f"(CASE WHEN code <= {j + 1} THEN -1 WHEN code = {j + 2} THEN {j + 1} ELSE 0 END)::DOUBLE AS c_mktsegment_{j}" for j in range(4)) + " FROM c")
def enc_helmert(spark, d):
    return en.HelmertEncoder(order_col="c_custkey").fit_transform(customers(spark, d))


@query(CODES + "SELECT 1 AS intercept, c_custkey, " + ", ".join(f"round(CASE WHEN code <= {j + 1} THEN ({j + 1} - n) / n::DOUBLE ELSE {j + 1} / n::DOUBLE END, 6) AS c_mktsegment_{j}" for j in range(4)) + " FROM c")
def enc_backdiff(spark, d):
    return rounded(en.BackwardDifferenceEncoder(order_col="c_custkey").fit_transform(customers(spark, d)))


@query(CODES + "SELECT 1 AS intercept, c_custkey, " + ", ".join(f"(CASE WHEN code = n THEN -1 WHEN code = {j + 1} THEN 1 ELSE 0 END)::DOUBLE AS c_mktsegment_{j}" for j in range(4)) + " FROM c")
def enc_sum(spark, d):
    return en.SumEncoder(order_col="c_custkey").fit_transform(customers(spark, d))


@query(_contrast(en.polynomial(5)))
def enc_poly(spark, d):
    return rounded(en.PolynomialEncoder(order_col="c_custkey").fit_transform(customers(spark, d)))


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS code FROM part")
def enc_label_sorted(spark, d):
    return en.label_encode(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "code").drop("p_type")


@query("WITH a AS (SELECT DISTINCT o_custkey AS cat FROM orders), b AS (SELECT DISTINCT user_id AS cat FROM events), u AS (SELECT cat FROM a UNION SELECT cat FROM b), k AS (SELECT cat, CASE WHEN cat IN (SELECT cat FROM a) AND cat IN (SELECT cat FROM b) THEN 0 WHEN cat IN (SELECT cat FROM a) THEN 1 ELSE 2 END AS part FROM u) SELECT cat, (row_number() OVER (ORDER BY part, cat) - 1)::INT AS code FROM k")
def enc_same_set(spark, d):
    return en.same_set_codes(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), table(spark, d, "events").select(F.col("user_id").alias("id")), "id")


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type) < 16 THEN 'OTHER' ELSE p_type END AS p_type FROM part")
def feat_rare_fold(spark, d):
    return en.fold_rare(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", 16)


@query("SELECT p_partkey, concat_ws('_', p_brand, p_type, p_size::VARCHAR) AS brand_type_size FROM part")
def feat_cross_category(spark, d):
    return fe.cross_category(table(spark, d, "part"), ["p_brand", "p_type", "p_size"], "brand_type_size").select("p_partkey", "brand_type_size")


@query("SELECT o_orderkey, (CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 5 WHEN '2' THEN 4 WHEN '3' THEN 3 WHEN '4' THEN 2 ELSE 1 END)::INT AS rank FROM orders")
def enc_manual_map(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("rank"))
    return en.OrdinalEncoder(["rank"], mapping={"rank": {"1": 5, "2": 4, "3": 3, "4": 2, "5": 1}}).fit_transform(o)


# encoders with a target

@query(ORD + "SELECT o_orderkey, round(CASE WHEN c = 1 THEN prior ELSE prior * (1 - 1 / (1 + exp(-(c - 1)))) + s / c * (1 / (1 + exp(-(c - 1)))) END, 6) AS o_orderpriority, y FROM o JOIN g ON o_orderpriority = cat, p")
def enc_target(spark, d):
    return rounded(ta.TargetEncoder("y").fit_transform(orders(spark, d)))


@query(ORD + "SELECT o_orderkey, round(CASE WHEN c > 1 THEN (s - y) / (c - 1) ELSE prior END, 6) AS o_orderpriority, y FROM o JOIN g ON o_orderpriority = cat, p")
def enc_loo_train(spark, d):
    return rounded(ta.LeaveOneOutEncoder("y").fit_transform(orders(spark, d)))


@query(ORD + "SELECT o_orderkey, round(CASE WHEN c > 1 THEN s / c ELSE prior END, 6) AS o_orderpriority, y FROM o JOIN g ON o_orderpriority = cat, p")
def enc_loo_test(spark, d):
    o = orders(spark, d)
    return rounded(ta.LeaveOneOutEncoder("y").fit(o).transform(o))


@query("WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders), p AS (SELECT avg(y) AS prior FROM o) SELECT o_orderkey, round((coalesce(sum(y) OVER w, 0) + prior) / (count(*) OVER w + 1), 6) AS o_custkey, y FROM o, p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def enc_ordered_train(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(ta.CatBoostEncoder("y", "o_orderkey", cols=["o_custkey"]).fit_transform(o))


@query(ORD + "SELECT o_orderkey, round(CASE WHEN c > 1 THEN (s + prior) / (c + 1) ELSE prior END, 6) AS o_orderpriority, y FROM o JOIN g ON o_orderpriority = cat, p")
def enc_ordered_test(spark, d):
    o = orders(spark, d)
    return rounded(ta.CatBoostEncoder("y", "o_orderkey").fit(o).transform(o))


@query(ORD + "SELECT o_orderkey, round((s + prior * 2) / (c + 2), 6) AS o_orderpriority, y FROM o JOIN g ON o_orderpriority = cat, p")
def enc_mest(spark, d):
    return rounded(ta.MEstimateEncoder("y", m=2.0).fit_transform(orders(spark, d)))


@query(ORD + "SELECT o_orderkey, round(CASE WHEN c = 1 THEN 0 ELSE ln(((s + 1) / (ts + 2)) / ((c - s + 1) / (n - ts + 2))) END, 6) AS o_orderpriority, y FROM o JOIN g ON o_orderpriority = cat, p")
def enc_woe(spark, d):
    return rounded(ta.WOEEncoder("y").fit_transform(orders(spark, d)))


@query(ORD + ", b AS (SELECT cat, s / c AS m, greatest(0, least(1, 1 - (CASE WHEN c > 1 THEN v ELSE 0 END) / nullif(tv + (CASE WHEN c > 1 THEN v ELSE 0 END), 0) * (k - 3) / (k - 1)::DOUBLE)) AS w FROM g, p) SELECT o_orderkey, round(w * m + (1 - w) * prior, 6) AS o_orderpriority, y FROM o JOIN b ON o_orderpriority = cat, p")
def enc_js_independent(spark, d):
    return rounded(ta.JamesSteinEncoder("y").fit_transform(orders(spark, d)))


@query(ORD + ", t AS (SELECT avg(c) AS size, sum((s / c - prior) ** 2) AS sse FROM g, p), b AS (SELECT least(1, greatest(0, (k - 3) * tv / size / sse)) AS b FROM p, t) SELECT o_orderkey, round(prior + (1 - b) * (s / c - prior), 6) AS o_orderpriority, y FROM o JOIN g ON o_orderpriority = cat, p, b")
def enc_js_pooled(spark, d):
    return rounded(ta.JamesSteinEncoder("y", model="pooled").fit_transform(orders(spark, d)))


@query(ORD + "SELECT o_orderkey, round(c / (c + n)::DOUBLE * s / c + (1 - c / (c + n)::DOUBLE) * prior, 6) AS o_orderpriority, y FROM o JOIN g ON o_orderpriority = cat, p")
def enc_js_beta(spark, d):
    return rounded(ta.JamesSteinEncoder("y", model="beta").fit_transform(orders(spark, d)))


@query("WITH RECURSIVE o AS (SELECT o_orderkey, o_orderpriority AS cat, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders), t AS (SELECT sum(y)::DOUBLE AS ts, count(*)::DOUBLE AS n FROM o), g AS (SELECT cat, sum(y)::DOUBLE AS s, count(*) - sum(y)::DOUBLE AS f FROM o GROUP BY 1), m AS (SELECT cat, ln((s + 0.5) * (n - ts - f + 0.5) / ((ts - s + 0.5) * (f + 0.5))) AS mu, 1 / (s + 0.5) + 1 / (ts - s + 0.5) + 1 / (f + 0.5) + 1 / (n - ts - f + 0.5) AS v FROM g, t), k AS (SELECT count(*) AS k FROM m), b AS (SELECT 0 AS i, 0::DOUBLE AS low, (1 << 20)::DOUBLE AS high UNION ALL SELECT i + 1, CASE WHEN (SELECT sum(mu * mu / ((low + high) / 2 + v)) - sum(mu / ((low + high) / 2 + v)) ** 2 / sum(1 / ((low + high) / 2 + v)) - count(*) + 1 FROM m) > 0 THEN (low + high) / 2 ELSE low END, CASE WHEN (SELECT sum(mu * mu / ((low + high) / 2 + v)) - sum(mu / ((low + high) / 2 + v)) ** 2 / sum(1 / ((low + high) / 2 + v)) - count(*) + 1 FROM m) > 0 THEN high ELSE (low + high) / 2 END FROM b WHERE i < 90), x AS (SELECT low AS sig FROM b WHERE i = 90), z AS (SELECT sum(mu / (sig + v)) / sum(1 / (sig + v)) AS mean FROM m, x) SELECT o_orderkey, round(mean + (1 - greatest(0, least(1, (k - 3) * v / ((k - 1) * (sig + v))))) * (mu - mean), 6) AS o_orderpriority, y FROM o JOIN m USING (cat), k, x, z")
def enc_js_binary(spark, d):
    return rounded(ta.JamesSteinEncoder("y", model="binary").fit_transform(orders(spark, d)))


def _multi(k: str) -> str:
    return f"(SELECT o_orderpriority AS cat, CASE WHEN count(*) = 1 THEN any_value(p) ELSE any_value(p) * (1 - 1 / (1 + exp(-(count(*) - 1)))) + avg((o_orderstatus = '{k}')::INT) * (1 / (1 + exp(-(count(*) - 1)))) END AS v FROM orders, (SELECT avg((o_orderstatus = '{k}')::INT) AS p FROM orders) GROUP BY 1)"


@query(f"SELECT o_orderkey, o_orderstatus, round(a.v, 6) AS \"o_orderpriority_O\", round(b.v, 6) AS \"o_orderpriority_P\" FROM orders JOIN {_multi('O')} a ON o_orderpriority = a.cat JOIN {_multi('P')} b ON o_orderpriority = b.cat")
def enc_multiclass_target(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return rounded(ta.multi_class(o, "o_orderstatus", ["o_orderpriority"], ta.TargetEncoder))


FOLD = "WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS fold, o_custkey AS cat, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders), r AS (SELECT o_orderkey, sum(y) OVER c - sum(y) OVER cf AS s, count(*) OVER c - count(*) OVER cf AS n, (sum(y) OVER a - sum(y) OVER f) / (count(*) OVER a - count(*) OVER f)::DOUBLE AS prior FROM o WINDOW c AS (PARTITION BY cat), cf AS (PARTITION BY cat, fold), a AS (), f AS (PARTITION BY fold)) "


def _folded(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return splits.modulo_fold(o, "o_orderkey", 5)


@query(FOLD + "SELECT o_orderkey, round(CASE WHEN n > 0 THEN (s + prior) / (n + 1) ELSE prior END, 6) AS enc FROM r")
def enc_oof_target(spark, d):
    return rounded(ta.out_of_fold(_folded(spark, d), "o_custkey", "y", "fold", lambda s, c, p: (s + p) / (c + 1), "enc").select("o_orderkey", "enc"))


@query(FOLD + "SELECT o_orderkey, round(CASE WHEN n > 0 THEN prior / (1 + exp(n - 2)) + (1 - 1 / (1 + exp(n - 2))) * s / n ELSE prior END, 6) AS enc FROM r")
def enc_mean_kfold(spark, d):
    return rounded(ta.out_of_fold(_folded(spark, d), "o_custkey", "y", "fold", ta.logistic_weight(), "enc").select("o_orderkey", "enc"))


@query("WITH o AS (SELECT o_orderkey % 5 AS fold, o_custkey AS cat, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders), c AS (SELECT DISTINCT cat FROM o), f AS (SELECT fold, (SELECT avg(y) FROM o b WHERE b.fold <> a.fold) AS prior FROM (SELECT DISTINCT fold FROM o) a), t AS (SELECT cat, sum(y) AS ts, count(*) AS tc FROM o GROUP BY 1), x AS (SELECT cat, fold, sum(y) AS s, count(*) AS n FROM o GROUP BY 1, 2), r AS (SELECT t.cat, prior, ts - coalesce(s, 0) AS s, tc - coalesce(n, 0) AS n FROM t CROSS JOIN f LEFT JOIN x ON x.cat = t.cat AND x.fold = f.fold) SELECT cat, round(avg(CASE WHEN n > 0 THEN prior / (1 + exp(n - 2)) + (1 - 1 / (1 + exp(n - 2))) * s / n ELSE prior END), 6) AS value FROM r GROUP BY 1")
def enc_mean_test(spark, d):
    return rounded(ta.test_mean_over_folds(_folded(spark, d), "o_custkey", "y", "fold", ta.logistic_weight()))


@query("WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS fold, o_orderpriority AS cat, o_totalprice AS y FROM orders), s AS (SELECT f.fold, cat, max(y) AS mx, min(y) AS mn, avg(y) AS av, median(y) AS md, stddev_samp(y) AS sd FROM o, (SELECT unnest([0, 1, 2, 3]) AS fold) f WHERE o.fold <> f.fold GROUP BY 1, 2) SELECT o_orderkey, round(mx, 6) AS o_orderpriority_max, round(mn, 6) AS o_orderpriority_min, round(av, 6) AS o_orderpriority_mean, round(md, 6) AS o_orderpriority_median, round(sd, 6) AS o_orderpriority_std FROM o JOIN s USING (fold, cat)")
def enc_target_stats(spark, d):
    o = splits.modulo_fold(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey", 4)
    out = ta.target_statistic(o, "o_orderpriority", "o_totalprice", "fold", 4, {"max": F.max, "min": F.min, "mean": F.avg, "median": F.median, "std": F.stddev_samp})
    return rounded(out.drop("fold", "o_totalprice", "o_orderpriority"))


@query("WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders) SELECT o_orderkey, round(coalesce(avg(y) OVER w, (SELECT avg(y) FROM o)), 6) AS enc FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def enc_expanding_mean(spark, d):
    return rounded(ta.expanding_mean(_folded(spark, d), "o_custkey", "y", "o_orderkey", "enc").select("o_orderkey", "enc"))


# aggregations

@query("SELECT user_id, event_type, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(sum(value), 6) AS sum, count(value) AS count, round(stddev_samp(value), 6) AS std, count(DISTINCT value) AS nunique FROM events GROUP BY 1, 2")
def feat_group_bundle(spark, d):
    return rounded(stats.bundle(table(spark, d, "events"), ["user_id", "event_type"], "value", ["min", "max", "mean", "median", "sum", "count", "std", "nunique"]))


@query("SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS skew, round(kurtosis(l_extendedprice), 6) AS kurt FROM lineitem GROUP BY 1")
def stat_moments(spark, d):
    return rounded(stats.bundle(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", ["skew", "kurt"]))


@query("WITH m AS (SELECT l_returnflag, avg(l_quantity) AS a FROM lineitem GROUP BY 1) SELECT l_returnflag, round(avg(abs(l_quantity - a)), 6) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1")
def stat_mad(spark, d):
    return rounded(stats.mean_absolute_deviation(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "mad"))


@query("WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment AS top FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def stat_mode(spark, d):
    return stats.mode(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", "top")


@query("SELECT event_type AS value, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS n FROM events GROUP BY 1")
def stat_value_counts(spark, d):
    return rounded(stats.value_counts(table(spark, d, "events"), "event_type", normalize=True))


@query("WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS a, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS b FROM orders) SELECT 'a' AS \"column\", count(*) - count(a) AS n_missing, round((count(*) - count(a)) / count(*)::DOUBLE, 6) AS share FROM o UNION ALL SELECT 'b', count(*) - count(b), round((count(*) - count(b)) / count(*)::DOUBLE, 6) FROM o")
def stat_missing(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("a"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("b"))
    return rounded(stats.missing_report(o))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(max(n) / sum(n)::DOUBLE, 6) AS share FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})" for c in ("l_returnflag", "l_linestatus", "l_discount")))
def stat_invariant(spark, d):
    return rounded(stats.dominant_share(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_discount"]))


@query("SELECT p_partkey, (count(*) OVER (PARTITION BY p_retailprice) = 1 OR count(*) OVER (PARTITION BY p_type, p_size) < 0) AS is_real FROM part")
def feat_unique_row_flag(spark, d):
    return stats.unique_row_flag(table(spark, d, "part"), ["p_retailprice"], "is_real").select("p_partkey", "is_real")


NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, b in enumerate(NUM) for a in NUM[:i]))
def stat_corr(spark, d):
    return rounded(stats.correlations(table(spark, d, "lineitem"), list(NUM)))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def stat_corr_drop(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", (2 * F.col("l_quantity") + F.col("l_tax")).alias("twice"))
    return li.drop(*stats.drop_correlated(li, ["l_quantity", "l_discount", "twice"], 0.8))


@query("WITH r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", corr({c}, l_quantity) AS r FROM lineitem" for c in ("l_extendedprice", "l_discount", "l_tax")) + ") SELECT \"column\", round(r, 6) AS r FROM r ORDER BY r.r DESC, 1 LIMIT 1")
def stat_top_correlated(spark, d):
    return rounded(stats.top_correlated(table(spark, d, "lineitem"), ["l_extendedprice", "l_discount", "l_tax"], "l_quantity", 1))


@query("WITH t AS (SELECT p_brand AS feature, sum(p_retailprice) AS importance FROM part GROUP BY 1), c AS (SELECT feature, importance, sum(importance) OVER (ORDER BY importance DESC, feature) / sum(importance) OVER () AS cum FROM t) SELECT feature, round(importance, 6) AS importance, round(cum, 6) AS cum, cum <= 0.93 AS keep FROM c")
def stat_cumulative_importance(spark, d):
    return rounded(stats.cumulative_importance(table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))))


@query("WITH e AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_orderkey % 2 AS side, (l_extendedprice > e[1])::INT + (l_extendedprice > e[2])::INT + (l_extendedprice > e[3])::INT + (l_extendedprice > e[4])::INT AS bin FROM lineitem, e), s AS (SELECT side, bin, count(*) / (sum(count(*)) OVER (PARTITION BY side))::DOUBLE AS p FROM b GROUP BY 1, 2) SELECT round(sum((q.p - t.p) * (ln(q.p) - ln(t.p))), 6) AS psi FROM s q JOIN s t ON q.bin = t.bin AND q.side = 0 AND t.side = 1")
def stat_psi(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice")
    return rounded(stats.psi(li.filter("l_orderkey % 2 = 0"), li.filter("l_orderkey % 2 = 1"), "l_extendedprice"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c})::DOUBLE AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def stat_describe(spark, d):
    return rounded(stats.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]))


# windows, time and other features

EV = "WITH e AS (SELECT event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS day, epoch_us(ts) AS us FROM events) "


def events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", F.to_date("ts").alias("day"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type), 6) AS t_mean, round(median(value) OVER (PARTITION BY event_type), 6) AS t_median, round(stddev_samp(value) OVER (PARTITION BY event_type), 6) AS t_std FROM events")
def feat_transform_stats(spark, d):
    return rounded(fe.transform_stats(events(spark, d), ["event_type"], "value", ["mean", "median", "std"], "t_").select("event_id", "t_mean", "t_median", "t_std"))


@query("WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events), f AS (SELECT *, coalesce(v, median(v) OVER (PARTITION BY user_id)) AS v1 FROM e) SELECT event_id, round(coalesce(v1, median(v1) OVER (PARTITION BY event_type)), 6) AS value FROM f")
def feat_transform_fill(spark, d):
    e = events(spark, d).withColumn("value", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    return rounded(fe.fill_from_groups(e, "value", [["user_id"], ["event_type"]]).select("event_id", "value"))


@query("WITH s AS (SELECT * FROM events WHERE event_id % 3 = 0), a AS (SELECT user_id, event_type, avg(value) AS m FROM s GROUP BY 1, 2), b AS (SELECT user_id, avg(value) AS m FROM s GROUP BY 1), c AS (SELECT event_type, avg(value) AS m FROM s GROUP BY 1) SELECT event_id, round(coalesce(a.m, b.m, c.m), 6) AS filled FROM events e LEFT JOIN a ON a.user_id = e.user_id AND a.event_type = e.event_type LEFT JOIN b ON b.user_id = e.user_id LEFT JOIN c ON c.event_type = e.event_type")
def feat_cascade_fill(spark, d):
    e = events(spark, d)
    return rounded(fe.cascade(e, "value", [["user_id", "event_type"], ["user_id"], ["event_type"]], "filled", e.filter("event_id % 3 = 0")).select("event_id", "filled"))


@query("SELECT event_id, round(lag(value, 1) OVER w, 6) AS value_lag1, round(value - lag(value, 1) OVER w, 6) AS value_diff1, round(lag(value, 2) OVER w, 6) AS value_lag2, round(value - lag(value, 2) OVER w, 6) AS value_diff2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def feat_lag_diff(spark, d):
    return rounded(fe.lag_diff(events(spark, d), ["user_id"], ["ts", "event_id"], "value", [1, 2]).drop("ts", "user_id", "event_type", "value", "day"))


@query("WITH l AS (SELECT event_id, value AS x0, lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), u AS (SELECT event_id, unnest([x0, x1, x2]) AS x FROM l), m AS (SELECT event_id, avg(x) AS a FROM u GROUP BY 1) SELECT event_id, round(any_value(a), 6) AS h_mean, round(min(x), 6) AS h_min, round(max(x), 6) AS h_max, round(median(x), 6) AS h_median, round(stddev_samp(x), 6) AS h_std, round(avg(abs(x - a)), 6) AS h_mad FROM u JOIN m USING (event_id) GROUP BY 1")
def feat_horizontal_stats(spark, d):
    e = fe.lag_diff(events(spark, d), ["user_id"], ["ts", "event_id"], "value", [1, 2])
    return rounded(fe.horizontal_stats(e, ["value", "value_lag1", "value_lag2"], "h_").select("event_id", "h_mean", "h_min", "h_max", "h_median", "h_std", "h_mad"))


@query("SELECT event_id, round(avg(value) OVER w, 9) AS x_mean, round(median(value) OVER w, 9) AS x_median, round(max(value) OVER w, 9) AS x_max, round(sum(value) OVER w, 9) AS x_sum FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def feat_expanding(spark, d):
    # means of cents over 2^k rows end in a 5 that 6 decimals would have to round
    e = fe.expanding(events(spark, d), ["user_id"], ["ts", "event_id"], "value", ["mean", "median", "max", "sum"], "x_")
    return e.select("event_id", *[F.round(c, 9).alias(c) for c in ("x_mean", "x_median", "x_max", "x_sum")])


@query(EV + "SELECT event_id, round(avg(value) OVER w, 6) AS r_mean, round(median(value) OVER w, 6) AS r_median, round(min(value) OVER w, 6) AS r_min, CASE WHEN count(value) OVER w >= 1 THEN round(stddev_samp(value) OVER w, 6) END AS r_std, count(value) OVER w AS r_count FROM e WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 5400000000 PRECEDING AND 1 PRECEDING)")
def feat_rolling_range(spark, d):
    return rounded(fe.rolling_time(events(spark, d), ["event_type"], "ts", "value", 90 * 60_000_000, ["mean", "median", "min", "std", "count"], "r_").select("event_id", "r_mean", "r_median", "r_min", "r_std", "r_count"))


@query(EV + ", b AS (SELECT hour(ts) AS slot, day, sum(value) AS s, count(value) AS c, max(value) AS m FROM e GROUP BY 1, 2) SELECT slot::INT AS slot, day, round(sum(s) OVER w / sum(c) OVER w, 6) AS h_mean, round(max(m) OVER w, 6) AS h_max, coalesce(sum(c) OVER w, 0)::BIGINT AS h_count FROM b WINDOW w AS (PARTITION BY slot ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def feat_hist_by_hour(spark, d):
    e = events(spark, d).withColumn("slot", F.hour("ts"))
    return rounded(fe.history_by_slot(e, "slot", "day", "value", ["mean", "max", "count"], "h_"))


@query(EV + ", b AS (SELECT hour(ts) AS slot, day, epoch(day) // 86400 AS dn, sum(value) AS s, count(value) AS c FROM e GROUP BY 1, 2, 3) SELECT slot::INT AS slot, day, round(sum(s) OVER w, 6) AS k_sum, coalesce(sum(c) OVER w, 0)::BIGINT AS k_count FROM b WINDOW w AS (PARTITION BY slot ORDER BY dn RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)")
def feat_last_days_by_hour(spark, d):
    e = events(spark, d).withColumn("slot", F.hour("ts"))
    return rounded(fe.history_by_slot(e, "slot", "day", "value", ["sum", "count"], "k_", same_day=True, days=3))


@query(EV + ", m AS (SELECT max(day) AS last FROM e) SELECT user_id, " + ", ".join(f"round(sum(value * pow({r}, last - day)) / sum(pow({r}, last - day)), 6) AS w{i}" for i, r in enumerate((0.9, 0.95, 0.985))) + " FROM e, m GROUP BY 1")
def feat_decay_mean(spark, d):
    e = events(spark, d)
    last = e.agg(F.max("day")).first()[0]
    return rounded(fe.decayed_mean(e, ["user_id"], "value", F.datediff(F.lit(last), F.col("day")), [0.9, 0.95, 0.985], "w"))


@query("WITH r AS (SELECT user_id, value, pow(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / (count(*) OVER (PARTITION BY user_id))::DOUBLE, 5) AS w FROM events) SELECT user_id, round(sum(value * w) / sum(w), 6) AS wmean FROM r GROUP BY 1")
def feat_position_weighted(spark, d):
    return rounded(fe.position_weighted_mean(events(spark, d), ["user_id"], ["ts", "event_id"], "value", "wmean"))


@query(EV + ", m AS (SELECT max(day) AS last FROM e), a AS (SELECT (last - k * 7)::DATE AS anchor FROM m, (SELECT unnest([0, 1, 2]) AS k)) SELECT anchor, event_type, " + ", ".join(f"round(avg(CASE WHEN anchor - day <= {s} THEN value END), 6) AS value_mean_{s}, count(CASE WHEN anchor - day <= {s} THEN value END) AS value_count_{s}" for s in (7, 14)) + " FROM a JOIN e ON day < anchor AND anchor - day <= 14 GROUP BY 1, 2")
def feat_anchor_windows(spark, d):
    e = events(spark, d)
    anchors = e.agg(F.max("day").alias("last")).select(F.explode(F.array(*[F.date_sub("last", 7 * k) for k in range(3)])).alias("anchor"))
    return rounded(fe.anchor_windows(e, anchors, ["event_type"], "day", "value", [7, 14], ["mean", "count"]))


@query(EV + "SELECT event_type, " + ", ".join(f"round(avg(CASE WHEN isodow(day) = {k + 1} THEN value END), 6) AS d{k}_mean, count(CASE WHEN isodow(day) = {k + 1} THEN value END) AS d{k}_count" for k in range(7)) + " FROM e GROUP BY 1")
def feat_dow_pivot(spark, d):
    return rounded(fe.weekday_pivot(events(spark, d), ["event_type"], "day", "value", ["mean", "count"]))


@query(EV + ", s AS (SELECT event_type, day, sum(value) AS v FROM e GROUP BY 1, 2) SELECT a.event_type, a.day, round(a.v, 6) AS v, round(b.v, 6) AS prev, round(a.v - b.v, 6) AS prev_diff FROM s a JOIN s b ON a.event_type = b.event_type AND a.day = b.day + 7")
def feat_shift_selfjoin(spark, d):
    s = events(spark, d).groupBy("event_type", "day").agg(F.sum("value").alias("v"))
    return rounded(fe.shifted_self_join(s, ["event_type"], "day", "v", 7, "prev"))


@query(EV + ", s AS (SELECT event_type, day, (count(*) % 3 = 0)::INT AS flag FROM e GROUP BY 1, 2) SELECT event_type, day, flag, coalesce(max(CASE WHEN flag = 1 THEN day END) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(day) OVER (PARTITION BY event_type)) AS last_flag, coalesce(min(CASE WHEN flag = 1 THEN day END) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(day) OVER (PARTITION BY event_type)) AS next_flag FROM s")
def feat_holiday_nearest(spark, d):
    s = events(spark, d).groupBy("event_type", "day").agg((F.count("*") % 3 == 0).cast("int").alias("flag"))
    return fe.nearest_flag(s, ["event_type"], "day", "flag")


@query("WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events) SELECT event_id, round(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS value FROM e")
def feat_bfill(spark, d):
    e = events(spark, d).withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return rounded(fe.bfill(e, ["user_id"], ["ts", "event_id"], "value").select("event_id", "value"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def feat_tail_n(spark, d):
    return fe.tail_n(events(spark, d), ["user_id"], ["ts", "event_id"], 3).select("event_id", "user_id")


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS rank FROM part")
def feat_rank(spark, d):
    return fe.average_rank(table(spark, d, "part"), ["p_brand"], "p_size", "rank").select("p_partkey", "rank")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1)::INT AS raw, least(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1, 4)::INT AS attempts FROM events")
def feat_attempts(spark, d):
    e = fe.attempts(events(spark, d), ["user_id", "event_type"], ["event_id"], "attempts")
    return fe.attempts(e, ["user_id", "event_type"], ["event_id"], "raw", 1 << 30).select("event_id", F.col("raw").cast("int").alias("raw"), F.col("attempts").cast("int").alias("attempts"))


@query("WITH e AS (SELECT event_id, user_id, event_type, (value > 50)::INT::DOUBLE AS y FROM events) SELECT user_id AS key, event_type AS item, event_id AS seq, y AS label, coalesce(sum(y) OVER w, 0)::DOUBLE AS sum, count(y) OVER w AS count, round(avg(y) OVER w, 6) AS mean, least(count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4)::INT AS attempts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def feat_user_expanding_acc(spark, d):
    e = events(spark, d).withColumn("y", (F.col("value") > 50).cast("int"))
    return rounded(batch_features(e, "user_id", "event_type", "event_id", "y"))


@query(EV + ", s AS (SELECT event_type, min(day) AS a, max(day) AS b FROM e GROUP BY 1), g AS (SELECT event_type, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM s), v AS (SELECT event_type, day, sum(value) AS value FROM e GROUP BY 1, 2) SELECT event_type, day, round(coalesce(value, 0), 6) AS value FROM g LEFT JOIN v USING (event_type, day)")
def feat_densify(spark, d):
    return rounded(fe.densify(events(spark, d), "event_type", "day", "value"))


@query("WITH r AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part), c AS (SELECT p_partkey, least(greatest(ceil((p_retailprice - a) / ((b - a) / 8)), 1), 8)::INT AS bin, a, b FROM part, r) SELECT p_partkey, bin, round(CASE WHEN bin = 1 THEN a - 0.001 * (b - a) ELSE a + (bin - 1) * ((b - a) / 8) END, 6) AS bin_left FROM c")
def feat_cut(spark, d):
    return rounded(fe.cut_width(table(spark, d, "part"), "p_retailprice", 8, "bin").select("p_partkey", "bin", "bin_left"))


@query("WITH e AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS e FROM orders) SELECT o_orderkey, ((o_totalprice > e[1])::INT + (o_totalprice > e[2])::INT + (o_totalprice > e[3])::INT + 1)::INT AS bin FROM orders, e")
def feat_qcut(spark, d):
    return fe.cut_quantiles(table(spark, d, "orders"), "o_totalprice", 4, "bin").select("o_orderkey", "bin")


@query("SELECT p_partkey, ((p_size > 10)::INT + (p_size > 20)::INT + (p_size > 40)::INT)::INT AS bin FROM part")
def feat_cut_edges(spark, d):
    return fe.cut_edges(table(spark, d, "part"), "p_size", [10, 20, 40], "bin").select("p_partkey", "bin")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / (l_extendedprice + 0.01), 6) AS l_quantity_over_l_extendedprice, round(l_extendedprice / (l_quantity + 0.01), 6) AS l_extendedprice_over_l_quantity, round(l_quantity + l_extendedprice, 6) AS l_quantity_plus_l_extendedprice, round(l_quantity * l_extendedprice, 6) AS l_quantity_times_l_extendedprice, round(l_quantity - l_extendedprice, 6) AS l_quantity_minus_l_extendedprice FROM lineitem")
def feat_crosses(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(fe.pair_features(li, ["l_quantity", "l_extendedprice"]).drop("l_quantity", "l_extendedprice"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_size) AS p_size_count, count(*) OVER (PARTITION BY round_even(p_size / 1.0, -1)) AS \"p_size_count_-1\" FROM part")
def feat_count_resolutions(spark, d):
    return fe.count_resolutions(table(spark, d, "part"), "p_size", [-1]).select("p_partkey", "p_size_count", "p_size_count_-1")


KINDS = ("click", "view", "purchase")


@query("WITH e AS (SELECT user_id, event_type, abs(value) AS s FROM events), b AS (SELECT *, least(floor(ln(1 + s)), 14) AS b FROM e), c AS (SELECT user_id, count(*) AS n_unique, avg(n) AS c_mean, stddev_pop(n) AS c_std FROM (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1) SELECT user_id, " + ", ".join(f"(count(*) FILTER (event_type = '{k}')) AS n_{k}, round(ln(1 + coalesce(sum(s) FILTER (event_type = '{k}'), 0)), 6) AS t_{k}" for k in KINDS) + ", " + ", ".join(f"(count(*) FILTER (b = {i})) AS h_{i}" for i in range(15)) + ", round(ln(1 + sum(s)), 6) AS log_sum, round(ln(1 + avg(s)), 6) AS log_mean, round(ln(1 + stddev_samp(s)), 6) AS log_std, round(ln(1 + median(s)), 6) AS log_median, any_value(n_unique) AS n_unique, round(any_value(c_mean), 6) AS c_mean, round(any_value(c_std), 6) AS c_std FROM b JOIN c USING (user_id) GROUP BY 1")
def feat_session_profile(spark, d):
    return rounded(fe.session_profile(events(spark, d), "user_id", "event_type", list(KINDS), F.abs("value")))


@query("WITH r AS (SELECT min(value) AS a, max(value) AS b FROM events WHERE user_id % 10 = 0 AND event_id % 50 = 0) SELECT event_id FROM events, r WHERE value BETWEEN a AND b")
def feat_range_filter(spark, d):
    e = events(spark, d)
    return fe.range_filter(e, "value", e.filter("user_id % 10 = 0 and event_id % 50 = 0")).select("event_id")


@query("WITH q AS (SELECT quantile_cont(o_totalprice, [0.005, 0.995]) AS q FROM orders) SELECT o_orderkey, round(CASE WHEN o_totalprice <= q[1] THEN o_totalprice * 0.77 WHEN o_totalprice >= q[2] THEN o_totalprice * 1.1 ELSE o_totalprice END, 4) AS o_totalprice FROM orders, q")
def feat_scale_tails(spark, d):
    return fe.scale_tails(table(spark, d, "orders"), "o_totalprice").select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS o_totalprice FROM orders")
def feat_standardise(spark, d):
    return rounded(fe.scale(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


@query("SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS o_totalprice FROM orders")
def feat_minmax(spark, d):
    return rounded(fe.scale(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "minmax"))


@query("WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS day, (isodow(d) - 1)::INT AS weekday, (isodow(d) >= 6)::INT AS is_weekend, (last_day(d) - d)::INT AS to_month_end, (day(d) - 1)::INT AS from_month_start, CASE WHEN month(d) * 100 + day(d) BETWEEN 321 AND 620 THEN 'spring' WHEN month(d) * 100 + day(d) BETWEEN 621 AND 922 THEN 'summer' WHEN month(d) * 100 + day(d) BETWEEN 923 AND 1220 THEN 'autumn' ELSE 'winter' END AS season, strftime(d, '%Y%m%d')::INT AS packed FROM o")
def feat_calendar(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.withColumns(calendar(F.col("d"))).drop("d")


@query("WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS last FROM orders) SELECT o_orderkey, round(CASE WHEN last - CAST(o_orderdate AS DATE) > 365 THEN 1 ELSE pow(0.9, floor((365 - (last - CAST(o_orderdate AS DATE))) / 60)) END, 6) AS weight FROM orders, m")
def feat_recency_weight(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    last = o.agg(F.max("d")).first()[0]
    return rounded(o.select("o_orderkey", recency_weight(F.datediff(F.lit(last), F.col("d")), 0.9).alias("weight")))


@query("SELECT l_suppkey, CAST(l_shipdate AS DATE) AS due_day, count(*) AS n, round(sum(l_quantity), 6) AS total, round(avg(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE)), 6) AS days_ahead FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def feat_reservations(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(fe.reservation_features(j, "l_suppkey", "o_orderdate", "l_shipdate", "l_quantity"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def feat_unpivot_counts(spark, d):
    wide = events(spark, d).groupBy("user_id").pivot("event_type", ["click", "view", "purchase", "signup", "logout", "login", "error", "scroll", "search", "cart"]).count()
    return wide.unpivot("user_id", [c for c in wide.columns if c != "user_id"], "event_type", "n").filter("n is not null")


# metrics, splits, ensembles

SCORES = "WITH s AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS p FROM orders) "


def scores(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) / 1000.0).alias("p"))


@query(SCORES + ", r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6) AS auc FROM r")
def metric_auc(spark, d):
    return rounded(metrics.auc(scores(spark, d), F.col("y"), F.col("p")))


@query(SCORES + ", t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7]) AS threshold) SELECT threshold::DOUBLE AS threshold, round(2.0 * sum(CASE WHEN p > threshold THEN y ELSE 0 END) / (count(CASE WHEN p > threshold THEN 1 END) + sum(y))::DOUBLE, 6) AS f1 FROM s, t GROUP BY 1")
def metric_f1_threshold(spark, d):
    return rounded(metrics.f1_threshold(scores(spark, d), F.col("y"), F.col("p"), [0.1, 0.3, 0.5, 0.7]))


@query(SCORES + ", c AS (SELECT y, p, (p >= 0.5)::INT AS h, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM s), a AS (SELECT sum(y * h)::DOUBLE AS tp, sum((1 - y) * (1 - h))::DOUBLE AS tn, sum((1 - y) * h)::DOUBLE AS fp, sum(y * (1 - h))::DOUBLE AS fn, avg((y = h)::INT) AS accuracy, avg((y - p) ** 2) AS brier, avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)) AS logloss, avg(-1 * ((1 - CASE WHEN y = 1 THEN q ELSE 1 - q END) ** 2) * ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)) AS focal FROM c) SELECT round(accuracy, 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(brier, 6) AS brier, round(logloss, 6) AS logloss, round(focal, 6) AS focal FROM a")
def metric_binary(spark, d):
    return rounded(metrics.binary(scores(spark, d), F.col("y"), F.col("p")))


@query("SELECT round(sqrt(avg((l_quantity - 50 * l_discount * 10) ** 2)), 6) AS rmse, round(sqrt(avg((ln(1 + l_quantity) - ln(1 + 50 * l_discount * 10)) ** 2)), 6) AS rmsle, round(avg(abs(l_quantity - 50 * l_discount * 10)), 6) AS mae FROM lineitem")
def metric_regression(spark, d):
    return rounded(metrics.regression(table(spark, d, "lineitem"), F.col("l_quantity"), 50 * F.col("l_discount") * 10))


@query("WITH r AS (SELECT o_orderstatus AS t, CASE WHEN o_orderkey % 3 = 0 THEN ['F', 'O', 'P'] WHEN o_orderkey % 3 = 1 THEN ['O', 'P', 'F'] ELSE ['P', 'F', 'O'] END AS a FROM orders) SELECT round(avg(CASE WHEN list_position(a[1:2], t) > 0 THEN 1 / log2(list_position(a[1:2], t) + 1) ELSE 0 END), 6) AS ndcg FROM r")
def metric_ndcg(spark, d):
    k = F.col("o_orderkey") % 3
    lists = [F.array(*map(F.lit, x)) for x in ("FOP", "OPF", "PFO")]
    o = table(spark, d, "orders").select("o_orderstatus", F.when(k == 0, lists[0]).when(k == 1, lists[1]).otherwise(lists[2]).alias("ranked"))
    return rounded(metrics.ndcg(o, "o_orderstatus", "ranked", 2))


@query("SELECT round(avg(CASE WHEN a = b THEN 1 WHEN a[1] = b[1] THEN 1 / 7.0 WHEN a[3] = b[3] THEN 1 / 3.0 ELSE 0 END), 6) AS score FROM (SELECT l_returnflag || '_' || l_linenumber % 3 AS a, l_returnflag || '_' || l_orderkey % 3 AS b FROM lineitem UNION ALL SELECT l_returnflag || '_' || l_linenumber % 3, l_linestatus || '_' || l_orderkey % 3 FROM lineitem)")
def metric_match_score(spark, d):
    li = table(spark, d, "lineitem")
    a = F.concat_ws("_", "l_returnflag", (F.col("l_linenumber") % 3).cast("string")).alias("a")
    pairs = [li.select(a, F.concat_ws("_", c, (F.col("l_orderkey") % 3).cast("string")).alias("b")) for c in ("l_returnflag", "l_linestatus")]
    return rounded(pairs[0].unionAll(pairs[1]).agg(F.avg(metrics.match_score(F.col("a"), F.col("b"))).alias("score")))


@query(SCORES + "SELECT o_orderkey, round(exp(ln(9 * (0.05 + p * 0.1) / (0.95 - p * 0.1)) + ln(9 * 0.1 / 0.9)) / 9, 6) AS odds, round((p * 2 + 0.5 * 1) / 3, 6) AS mixed FROM s")
def ens_odds(spark, d):
    s = scores(spark, d)
    odds = metrics.odds_product([0.05 + F.col("p") * 0.1, F.lit(0.1)])
    return rounded(s.select("o_orderkey", odds.alias("odds"), metrics.blend([F.col("p"), F.lit(0.5)], [2, 1]).alias("mixed")))


@query("SELECT o_orderstatus, fold, n FROM (SELECT o_orderstatus, unnest(generate_series(0, 4))::INT AS fold, c FROM (SELECT o_orderstatus, count(*) AS c FROM orders GROUP BY 1)) t, LATERAL (SELECT (c // 5 + CASE WHEN fold < c % 5 THEN 1 ELSE 0 END)::BIGINT AS n)")
def split_stratified(spark, d):
    o = splits.stratified_fold(table(spark, d, "orders"), "o_orderstatus", [F.xxhash64("o_orderkey")], 5)
    return o.groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"))


@query("SELECT y, (SELECT least(sum(b.y), count(*) - sum(b.y)) FROM (SELECT (o_orderstatus = 'F')::INT AS y FROM orders) b)::BIGINT AS n FROM (SELECT unnest([0, 1])::INT AS y)")
def sample_balanced(spark, d):
    return splits.balanced_sample(orders(spark, d), "y", ["o_orderkey"]).groupBy("y").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-06-01' AS is_train FROM orders")
def split_time(spark, d):
    return splits.time_split(table(spark, d, "orders"), "o_orderdate", "1996-06-01").select("o_orderkey", "is_train")


# strings, arrays and joins

@query("SELECT p_partkey, " + ", ".join(f"coalesce(string_split(p_type, ' ')[{i + 1}], '') AS t{i}" for i in range(4)) + " FROM part")
def feat_split_tokens(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", *[c.alias(n) for n, c in ar.split_tokens(F.col("p_type"), " ", 4, "t").items()])


@query("SELECT c_custkey, " + ", ".join(f"nullif(substr(c_mktsegment, {i + 1}, 1), '') AS c{i}" for i in range(12)) + " FROM customer")
def feat_char_positions(spark, d):
    c = customers(spark, d)
    return c.select("c_custkey", *[x.alias(n) for n, x in ar.char_positions(F.col("c_mktsegment"), 12, "c").items()])


@query("WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS a FROM events GROUP BY 1) SELECT user_id, array_to_string(a, ',') AS kinds, array_to_string(list_concat(a, ['-', '-', '-', '-'])[1:4], ',') AS padded, (coalesce(list_position(a, 'view'), 0) - 1)::INT AS at FROM a")
def feat_user_arrays(spark, d):
    a = events(spark, d).groupBy("user_id").agg(ar.sorted_unique(F.col("event_type")).alias("a"))
    return a.select("user_id", F.array_join("a", ",").alias("kinds"), F.array_join(ar.pad(F.col("a"), 4, F.lit("-")), ",").alias("padded"), ar.find(F.col("a"), F.array(F.lit("view"))).cast("int").alias("at"))


@query("WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1950 + c_custkey % 40 WHEN c_custkey % 3 = 1 THEN c_custkey % 120 END AS age FROM customer), f AS (SELECT c_custkey, CASE WHEN age BETWEEN 1900 AND 2015 THEN 2015 - age ELSE age END AS x FROM a) SELECT c_custkey, CASE WHEN x BETWEEN 15 AND 100 THEN x END AS age FROM f")
def feat_repair_age(spark, d):
    k = F.col("c_custkey")
    age = F.when(k % 3 == 0, 1950 + k % 40).when(k % 3 == 1, k % 120)
    return customers(spark, d).select("c_custkey", ar.repair_age(age, 2015).alias("age"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def join_semi_anti(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    building = customers(spark, d).filter("c_mktsegment = 'BUILDING'")
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return jo.drop_listed(jo.keep_listed(o, building, ["c_custkey"]), returned, ["o_orderkey"]).select("o_orderkey")


@query("SELECT c_custkey, n_name AS c_nationkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def join_map_values(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey < 3")
    return jo.map_values(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", n, "n_nationkey", "n_name")


@query("SELECT c_nationkey AS n_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_left_merge(spark, d):
    return jo.left_merge(table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")), table(spark, d, "nation"), ["n_nationkey"])


@query(EV + ", f AS (SELECT day, (count(*) % 2)::INT AS flag FROM e GROUP BY 1) SELECT a.day, a.flag, b.flag AS \"flag_-1\", c.flag AS flag_1 FROM f a LEFT JOIN f b ON b.day = a.day - 1 LEFT JOIN f c ON c.day = a.day + 1")
def join_shifted_dimension(spark, d):
    f = events(spark, d).groupBy("day").agg((F.count("*") % 2).cast("int").alias("flag"))
    return jo.shifted_dimension(f, f, "day", "flag", [-1, 1])


@query("WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders), b AS (SELECT DISTINCT user_id AS v FROM events), u AS (SELECT a.v AS x, b.v AS y FROM a FULL JOIN b ON a.v = b.v) SELECT CASE WHEN x IS NULL THEN 'second' WHEN y IS NULL THEN 'first' ELSE 'both' END AS part, count(*) AS n FROM u GROUP BY 1")
def stat_membership(spark, d):
    return jo.membership_audit(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), table(spark, d, "events").select(F.col("user_id").alias("id")), "id")


@query(EV + "SELECT user_id, day, count(*) AS share_n, round(count(*) / (sum(count(*)) OVER (PARTITION BY user_id))::DOUBLE, 6) AS share FROM e GROUP BY 1, 2")
def feat_count_ratio(spark, d):
    return rounded(jo.count_ratio(events(spark, d), ["user_id"], ["day"], "share"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def stat_crosstab(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)


# out-of-fold wrapper, fold averages

@query("WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS fold, o_orderpriority AS cat, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders), f AS (SELECT DISTINCT fold FROM o), g AS (SELECT f.fold, cat, sum(y) AS s, count(*) AS c FROM o JOIN f ON o.fold <> f.fold GROUP BY 1, 2), t AS (SELECT fold, sum(s) AS ts, sum(c) AS n FROM g GROUP BY 1) SELECT o_orderkey, round(CASE WHEN coalesce(c, 1) = 1 THEN 0 ELSE ln(((s + 1) / (ts + 2)) / ((c - s + 1) / (n - ts + 2))) END, 6) AS o_orderpriority FROM o JOIN t USING (fold) LEFT JOIN g USING (fold, cat)")
def enc_oof_woe(spark, d):
    o = splits.modulo_fold(orders(spark, d), "o_orderkey", 5)
    return rounded(ta.nested_cv(o, "fold", lambda: ta.WOEEncoder("y", ["o_orderpriority"]))[0].select("o_orderkey", "o_orderpriority"))


@query(ORD + ", t AS (SELECT cat, (s + prior) / (c + 1) AS v FROM g, p) SELECT o_orderkey, o_orderkey % 7 AS part, round(v, 6) AS o_orderpriority FROM o JOIN t ON o_orderpriority = cat WHERE o_orderkey % 7 < 2".replace(") , t", "), t"))
def enc_oof_tests(spark, d):
    o = orders(spark, d)
    tests = tuple(o.filter(F.col("o_orderkey") % 7 == k) for k in (0, 1))
    a, b = ta.nested_cv(splits.modulo_fold(o, "o_orderkey", 2), "fold", lambda: ta.MEstimateEncoder("y", ["o_orderpriority"]), tuple(splits.modulo_fold(t, "o_orderkey", 2) for t in tests))[1]
    return rounded(a.unionByName(b).select("o_orderkey", (F.col("o_orderkey") % 7).alias("part"), "o_orderpriority"))


@query("WITH o AS (SELECT o_orderkey % 4 AS fold, o_custkey AS cat, o_totalprice AS y FROM orders), f AS (SELECT unnest([0, 1, 2, 3]) AS fold), s AS (SELECT f.fold, cat, max(y) AS mx, avg(y) AS av, median(y) AS md, stddev_samp(y) AS sd FROM o JOIN f ON o.fold <> f.fold GROUP BY 1, 2), w AS (SELECT max(y) AS gmx, avg(y) AS gav, median(y) AS gmd, stddev_samp(y) AS gsd FROM o), c AS (SELECT DISTINCT cat FROM s) SELECT cat, round(avg(coalesce(mx, gmx)), 6) AS \"max\", round(avg(coalesce(av, gav)), 6) AS \"mean\", round(avg(coalesce(md, gmd)), 6) AS \"median\", round(avg(coalesce(sd, gsd)), 6) AS \"std\" FROM c CROSS JOIN f LEFT JOIN s USING (cat, fold), w GROUP BY cat")
def enc_target_stats_test(spark, d):
    o = splits.modulo_fold(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 4)
    out = ta.test_target_statistic(o, "o_custkey", "o_totalprice", "fold", 4, {"max": F.max, "mean": F.avg, "median": F.median, "std": F.stddev_samp})
    return out.select("cat", *[r6(c).alias(c) for c in ("max", "mean", "median", "std")])


# statistics across columns and dates

LINES = "SELECT l_orderkey, l_linenumber, [l_quantity, l_discount * 100, l_tax * 100, l_linenumber::DOUBLE, l_suppkey % 10] AS a FROM lineitem"


@query(f"WITH x AS ({LINES}) SELECT l_orderkey, l_linenumber, round(CASE WHEN list_aggregate(a, 'var_pop') = 0 THEN 0 ELSE list_aggregate(a, 'skewness') END, 4) AS h_skew, round(CASE WHEN list_aggregate(a, 'var_pop') = 0 THEN 0 ELSE list_aggregate(a, 'kurtosis') END, 4) AS h_kurt, round(list_aggregate(a, 'quantile_cont', 0.25), 4) AS h_q1, round(list_aggregate(a, 'quantile_cont', 0.75), 4) AS h_q3, round(list_aggregate(a, 'stddev_samp') / nullif(list_aggregate(a, 'avg'), 0), 4) AS h_cv FROM x")
def feat_horizontal_moments(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 100).alias("b"), (F.col("l_tax") * 100).alias("c"), (F.col("l_suppkey") % 10).alias("e"))
    out = fe.horizontal_moments(li, ["l_quantity", "b", "c", "l_linenumber", "e"], "h_")
    return out.select("l_orderkey", "l_linenumber", *[F.round(f"h_{c}", 4).alias(f"h_{c}") for c in ("skew", "kurt", "q1", "q3", "cv")])


@query("WITH x AS (SELECT user_id, ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1, 2), n AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM x)), y AS (SELECT user_id, i, v FROM x JOIN n USING (day)), z AS (SELECT a.user_id, a.v - b.v AS diff FROM y a LEFT JOIN y b ON a.user_id = b.user_id AND a.i = b.i + 1) SELECT user_id, round(avg(abs(diff)), 6) AS d_abs_mean, round(stddev_samp(diff), 6) AS d_std, round(max(diff), 6) AS d_max, round(min(diff), 6) AS d_min FROM z GROUP BY 1")
def feat_date_diff_stats(spark, d):
    return rounded(fe.date_difference_stats(table(spark, d, "events"), ["user_id"], "ts", "value", "d_"))


@query("SELECT o_custkey, date_diff('day', min(o_orderdate)::DATE, DATE '1998-12-31')::INT AS first_days, date_diff('day', max(o_orderdate)::DATE, DATE '1998-12-31')::INT AS last_days, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)::INT AS run_days, count(DISTINCT o_orderdate::DATE) AS active_days FROM orders GROUP BY 1")
def feat_activity_span(spark, d):
    return fe.activity_span(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", F.lit("1998-12-31").cast("date"))


@query("WITH x AS (SELECT o_custkey, o_totalprice AS v, date_diff('day', o_orderdate::DATE, DATE '1998-12-31') / 100.0 AS age FROM orders) SELECT o_custkey, round(sum(v * 0.9 ** age) / sum(0.9 ** age), 4) AS w0, round(sum(v * (0.9::DOUBLE * 0.95) ** age) / sum(0.95 ** age), 4) AS w1, round(sum(v * (0.9::DOUBLE * 0.95 * 0.99) ** age) / sum(0.99 ** age), 4) AS w2 FROM x GROUP BY 1")
def feat_double_decay(spark, d):
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.to_date("o_orderdate")) / 100
    out = fe.double_decayed_mean(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", age, [0.9, 0.95, 0.99], "w")
    return out.select("o_custkey", *[F.round(f"w{i}", 4).alias(f"w{i}") for i in range(3)])


@query("WITH x AS (SELECT event_type, ts::DATE AS day, value FROM events), k AS (SELECT DISTINCT event_type, day FROM x) SELECT k.event_type, k.day, round(median(value), 6) AS h_median, round(stddev_samp(value), 6) AS h_std FROM k LEFT JOIN x ON x.event_type = k.event_type AND x.day < k.day GROUP BY 1, 2")
def feat_history_all_rows(spark, d):
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    return rounded(fe.history_by_slot(e, "event_type", "day", "value", ["median", "std"], "h_"))


@query("SELECT p_partkey, round((p_retailprice - (SELECT median(p_retailprice) FROM part)) / (SELECT quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) FROM part), 6) AS p_retailprice FROM part")
def feat_scale_robust(spark, d):
    return rounded(fe.scale(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], "robust"))


@query("SELECT o_orderkey, round(((1 + o_totalprice) ** 0.25 - 1) / 0.25, 4) AS p25, round(ln(1 + o_totalprice), 4) AS p0 FROM orders")
def feat_boxcox(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(fe.boxcox1p(F.col("o_totalprice"), 0.25), 4).alias("p25"), F.round(fe.boxcox1p(F.col("o_totalprice"), 0.0), 4).alias("p0"))


@query("WITH g AS (SELECT unnest([-0.5, 0.25, 0.5, 1.0, 2.0]) AS lam), l AS (SELECT lam, (lam - 1) * sum(ln(1 + o_totalprice)) - count(*) / 2 * ln(var_pop(((1 + o_totalprice) ** lam - 1) / lam)) AS ll FROM orders, g GROUP BY 1) SELECT lam::DOUBLE AS lam FROM l ORDER BY ll DESC LIMIT 1")
def stat_boxcox_lambda(spark, d):
    lam = fe.boxcox_lambda(table(spark, d, "orders"), "o_totalprice", [-0.5, 0.25, 0.5, 1.0, 2.0])
    return spark.range(1).select(F.lit(lam).alias("lam"))


@query("WITH u AS (SELECT column_name AS \"column\", v FROM (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) WHERE v IS NOT NULL), c AS (SELECT \"column\", v, count(*) AS n FROM u GROUP BY 1, 2) SELECT \"column\", sum(n)::BIGINT AS count, count(*) AS \"unique\", first(v ORDER BY n DESC, v) AS top, max(n) AS freq FROM c GROUP BY 1")
def stat_describe_text(spark, d):
    return stats.describe_text(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderpriority, round(sum((o_totalprice - m) ** 3) / count(*) / (sum((o_totalprice - m) ** 2) / count(*)) ** 1.5, 5) AS skew FROM orders JOIN (SELECT o_orderpriority AS p, avg(o_totalprice) AS m FROM orders GROUP BY 1) ON p = o_orderpriority GROUP BY 1")
def stat_population_skew(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.skewness("o_totalprice"), 5).alias("skew"))


@query("SELECT p_partkey::BIGINT AS p_partkey, p_size::TINYINT AS p_size FROM part")
def stat_shrink_types(spark, d):
    p = stats.shrink_types(table(spark, d, "part").select("p_partkey", "p_size"))
    return p.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_size")


# first rows, joins, packing

@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def feat_first_in_group(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return fe.keep_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "right").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, dow FROM supplier CROSS JOIN (SELECT unnest(range(7))::INT AS dow)")
def join_grid(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dow"))


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n_lines, round(avg(l_quantity), 6) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), e AS (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY 1) SELECT c_custkey, n_name, n_orders, spent, n_lines, quantity, n_events FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey LEFT JOIN e ON e.k = c_custkey")
def join_feature_blocks(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    a = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    b = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_lines"), r6(F.avg("l_quantity")).alias("quantity"))
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n_events"))
    base = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")
    return jo.assemble(base, [a, b, e], ["c_custkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'large' WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_totalprice < 20000 THEN 'small' ELSE 'other' END AS kind FROM orders")
def feat_rule_ladder(spark, d):
    rules = [(((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)), "large"), (F.col("o_orderpriority").like("1%"), "urgent"), (F.col("o_totalprice") < 20000, "small")]
    return table(spark, d, "orders").select("o_orderkey", ar.ladder(rules, "other").alias("kind"))


@query("SELECT l_orderkey, l_linenumber, ((l_returnflag = 'R')::INT)::VARCHAR || ',' || ((l_linestatus = 'O')::INT)::VARCHAR || ',' || ((l_quantity > 25)::INT)::VARCHAR AS labels FROM lineitem")
def feat_pack_columns(spark, d):
    li = table(spark, d, "lineitem")
    packed = F.array((F.col("l_returnflag") == "R").cast("int"), (F.col("l_linestatus") == "O").cast("int"), (F.col("l_quantity") > 25).cast("int"))
    return li.select("l_orderkey", "l_linenumber", F.array_join(packed, ",").alias("labels"))


@query("SELECT o_custkey, " + ", ".join(f"count(*) FILTER (WHERE o_orderkey % 5 = {k})::INT AS b{k}" for k in range(4)) + " FROM orders GROUP BY 1")
def arr_bincount(spark, d):
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list((F.col("o_orderkey") % 5).cast("int")).alias("a"))
    return a.select("o_custkey", *[F.get(ar.bincount(F.col("a"), 4), F.lit(k)).alias(f"b{k}") for k in range(4)])


@query("SELECT event_id, date_trunc('hour', ts) AS at FROM events")
def cal_packed_hour(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", packed_hour(F.date_format(F.col("ts").cast("timestamp"), "yyMMddHH")).cast("timestamp_ntz").alias("at"))


# scores

@query("SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_sort([{'s': -l_quantity, 'n': 'quantity'}, {'s': -(l_partkey % 50)::DOUBLE, 'n': 'size'}, {'s': -(l_tax * 500), 'n': 'tax'}])[1:2], lambda x: x.n), ',') AS best FROM lineitem")
def metric_top_k(spark, d):
    best = metrics.top_k({"quantity": F.col("l_quantity").cast("double"), "size": (F.col("l_partkey") % 50).cast("double"), "tax": (F.col("l_tax") * 500).cast("double")}, 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(best, ",").alias("best"))


@query("WITH x AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice / 100000 - 1.5 AS r FROM orders), p AS (SELECT y, CASE WHEN y = 1 THEN 1 / (1 + exp(-r)) ELSE 1 - 1 / (1 + exp(-r)) END AS pt, CASE WHEN y = 1 THEN 0.3 ELSE 0.7 END AS a, CASE WHEN y = 1 THEN 1 ELSE -1 END AS s FROM x) SELECT round(avg(-a * (1 - pt) ** 2 * ln(pt)), 6) AS loss, round(avg(s * a * (1 - pt) ** 2 * (2 * pt * ln(pt) - (1 - pt))), 6) AS grad, round(avg(a * pt * (1 - pt) ** 2 * ((1 - pt) * (2 * ln(pt) + 3) - 2 * (2 * pt * ln(pt) - (1 - pt)))), 6) AS hess FROM p")
def metric_focal(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 100000 - 1.5).alias("r"))
    return o.agg(*[r6(F.avg(c)).alias(n) for n, c in metrics.focal_loss(F.col("y"), F.col("r"), 0.3, 2.0).items()])


@query("WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS fold, o_orderpriority AS cat, o_totalprice AS y FROM orders) SELECT o_orderkey, round((SELECT avg(y) FROM o b WHERE b.fold <> o.fold AND b.cat = o.cat), 4) AS pred FROM o")
def ens_stacking(spark, d):
    o = splits.modulo_fold(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey", 4)

    def means(train):
        by_class = train.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("pred"))
        return lambda test: test.join(by_class, "o_orderpriority", "left")

    return selection.out_of_fold_predictions(o, "fold", 4, means).select("o_orderkey", F.round("pred", 4).alias("pred"))


# windows over the whole table as one series

SERIES = ["ts", "event_id"]


@query("SELECT event_id, round(avg(value) OVER w, 6) AS s_mean, round(median(value) OVER w, 6) AS s_median, max(value) OVER w AS s_max, min(value) OVER w AS s_min, round(stddev_samp(value) OVER w, 6) AS s_std, count(value) OVER w AS s_count FROM events WINDOW w AS (ORDER BY epoch_us(ts) RANGE BETWEEN 5400000000 PRECEDING AND 1 PRECEDING)")
def feat_series_time_windows(spark, d):
    e = events(spark, d).select("event_id", "ts", "value")
    return rounded(wi.time_windows(e, "ts", "value", 90 * 60_000_000, ["mean", "median", "max", "min", "std", "count"], "s_").drop("ts", "value"))


@query("SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(median(value) OVER w, 6) END AS w_median, CASE WHEN count(value) OVER w >= 5 THEN count(DISTINCT floor(value)) OVER w END AS w_nunique, CASE WHEN count(value) OVER w >= 5 THEN max(value) OVER w END AS w_max FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def feat_series_row_windows(spark, d):
    e = events(spark, d).select("event_id", "ts", "value").withColumn("whole", F.floor("value"))
    out = wi.row_windows(e, SERIES, "value", 50, ["median", "max"], "w_", 5, rows=4096)
    return rounded(wi.row_windows(out, SERIES, "whole", 50, ["nunique"], "w_", 5, rows=4096).select("event_id", "w_median", "w_nunique", "w_max"))


@query("SELECT event_id, lag(value, 1) OVER w AS lag1, round(value - lag(value, 1) OVER w, 6) AS diff1, lag(value, 60) OVER w AS lag60, lead(value, 2) OVER w AS lead2 FROM events WINDOW w AS (ORDER BY ts, event_id)")
def feat_series_shift(spark, d):
    e = events(spark, d).select("event_id", "ts", "value")
    return rounded(wi.shifted(e, SERIES, {"lag1": ("value", 1), "lag60": ("value", 60), "lead2": ("value", -2)}, rows=4096).select("event_id", "lag1", (F.col("value") - F.col("lag1")).alias("diff1"), "lag60", "lead2"))


@query("SELECT event_id, count(value) OVER w AS x_count, round(ln(avg(value) OVER w), 6) AS x_log_mean, round(stddev_samp(value) OVER w, 6) AS x_std, min(value) OVER w AS x_min, max(value) OVER w AS x_max, count(DISTINCT value) OVER w AS x_nunique FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def feat_series_expanding(spark, d):
    e = events(spark, d).select("event_id", "ts", "value")
    out = wi.running(e, SERIES, "value", ["count", "mean", "std", "min", "max", "nunique"], "x_", rows=4096)
    # the logarithm, as means of cents may end in a 5 that rounding would have to decide on
    return out.select("event_id", "x_count", r6(F.ln("x_mean")).alias("x_log_mean"), r6("x_std").alias("x_std"), "x_min", "x_max", "x_nunique")


@query("WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN value END AS v, CASE WHEN event_id % 11 = 3 THEN event_type END AS t FROM events) SELECT event_id, first_value(v IGNORE NULLS) OVER w AS value, first_value(t IGNORE NULLS) OVER w AS event_type FROM e WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
def feat_series_bfill(spark, d):
    e = events(spark, d).select("event_id", "ts", F.when(F.col("event_id") % 7 == 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 11 == 3, F.col("event_type")).alias("event_type"))
    return wi.filled_back(e, SERIES, ["value", "event_type"], rows=4096).drop("ts")


@query(EV + "SELECT event_id, round(median(value) OVER w, 6) AS k_median, count(DISTINCT user_id) OVER w AS k_nunique FROM e WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 7200000000 PRECEDING AND 1 PRECEDING)")
def feat_rolling_order_statistics(spark, d):
    e = events(spark, d)
    out = wi.time_windows(e, "ts", "value", 120 * 60_000_000, ["median"], "k_", ["event_type"])
    return rounded(wi.time_windows(out, "ts", "user_id", 120 * 60_000_000, ["nunique"], "k_", ["event_type"], 0).select("event_id", "k_median", "k_nunique"))


@query("WITH e AS (SELECT event_id, user_id, event_type, event_id // 500 AS round, (value > 50)::INT::DOUBLE AS y FROM events) SELECT user_id AS key, event_type AS item, event_id AS seq, coalesce(sum(y) OVER w, 0)::DOUBLE AS sum, count(y) OVER w AS count, round(coalesce(avg(y) OVER w, 0.68), 6) AS mean, least(count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4)::INT AS attempts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY round RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def feat_delayed_labels(spark, d):
    e = events(spark, d).withColumn("y", (F.col("value") > 50).cast("int")).withColumn("round", F.floor(F.col("event_id") / 500))
    return rounded(delayed_batch_features(e, "user_id", "event_type", "event_id", "round", "y"))


SPANS = (1000, 56, 28, 14)


@query(EV + ", m AS (SELECT max(day) AS last FROM e), a AS (SELECT (last - k * 7)::DATE AS anchor FROM m, (SELECT unnest(range(58))::INT AS k)) SELECT anchor, event_type, " + ", ".join(f"round(sum(value) FILTER (anchor - day <= {s}), 6) AS value_sum_{s}, count(value) FILTER (anchor - day <= {s}) AS value_count_{s}, round(stddev_samp(value) FILTER (anchor - day <= {s}), 6) AS value_std_{s}, min(value) FILTER (anchor - day <= {s}) AS value_min_{s}, max(value) FILTER (anchor - day <= {s}) AS value_max_{s}" for s in SPANS) + " FROM a JOIN e ON day < anchor AND anchor - day <= 1000 GROUP BY 1, 2")
def feat_anchor_grid(spark, d):
    e = events(spark, d)
    anchors = e.agg(F.max("day").alias("last")).select(F.explode(F.array(*[F.date_sub("last", 7 * k) for k in range(58)])).alias("anchor"))
    return rounded(fe.anchor_windows(e, anchors, ["event_type"], "day", "value", list(SPANS), ["sum", "count", "std", "min", "max"]))


WIDE = {f"c{i}": f"(l_orderkey * {i + 3} + l_partkey * {2 * i + 1} + l_suppkey * l_linenumber) % {11 + i}" for i in range(60)}


@query("WITH w AS (SELECT " + ", ".join(f"({x})::DOUBLE AS {c}" for c, x in WIDE.items()) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT 'c{i}' AS a, unnest([{', '.join(repr(f'c{j}') for j in range(i + 1, 60))}]) AS b, unnest([{', '.join(f'round(corr(c{i}, c{j}), 6)' for j in range(i + 1, 60))}]) AS r FROM w" for i in range(59)))
def stat_corr_wide(spark, d):
    wide = table(spark, d, "lineitem").select(*[F.expr(x).cast("double").alias(c) for c, x in WIDE.items()])
    return rounded(gram.correlation_pairs(wide, list(WIDE)).select("a", "b", "r"))


CANDIDATES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
SUBSETS = "WITH s AS (SELECT " + ", ".join(f"pow(corr(l_extendedprice, {c}), 2) AS q_{c}, corr(l_extendedprice, {c}) AS y_{c}" for c in CANDIDATES) + ", " + ", ".join(f"corr({a}, {b}) AS x_{a}_{b}" for i, b in enumerate(CANDIDATES) for a in CANDIDATES[:i]) + " FROM lineitem), one AS (" + " UNION ALL ".join(f"SELECT '{c}' AS a, q_{c} AS r2 FROM s" for c in CANDIDATES) + "), two AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, (y_{a} * y_{a} + y_{b} * y_{b} - 2 * y_{a} * y_{b} * x_{a}_{b}) / (1 - x_{a}_{b} * x_{a}_{b}) AS r2 FROM s" for i, b in enumerate(CANDIDATES) for a in CANDIDATES[:i]) + ") "


def _regressions(spark, d, cols=CANDIDATES):
    return gram.Regressions(table(spark, d, "lineitem"), list(cols), "l_extendedprice")


@query(SUBSETS + ", f AS (SELECT * FROM one ORDER BY r2 DESC LIMIT 1), p AS (SELECT CASE WHEN two.a = f.a THEN two.b ELSE two.a END AS a, two.r2 FROM two, f WHERE f.a IN (two.a, two.b) ORDER BY two.r2 DESC LIMIT 1) SELECT 1::BIGINT AS step, a AS \"column\", round(r2, 6) AS r2 FROM f UNION ALL SELECT 2, a, round(r2, 6) FROM p")
def sel_forward(spark, d):
    return spark.createDataFrame([(k, c, round(r, 6)) for k, (c, r) in enumerate(_regressions(spark, d).forward(2), 1)], "step long, column string, r2 double")


@query(SUBSETS + ", p AS (SELECT * FROM two WHERE 'l_linenumber' NOT IN (a, b) ORDER BY r2 DESC LIMIT 1), q AS (SELECT one.* FROM one, p WHERE one.a IN (p.a, p.b) ORDER BY one.r2 DESC LIMIT 1) SELECT 1::BIGINT AS step, c AS \"column\", round(p.r2, 6) AS r2 FROM p, (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS c) WHERE c NOT IN (p.a, p.b) UNION ALL SELECT 2, CASE WHEN q.a = p.a THEN p.b ELSE p.a END, round(q.r2, 6) FROM p, q")
def sel_backward(spark, d):
    return spark.createDataFrame([(k, c, round(r, 6)) for k, (c, r) in enumerate(_regressions(spark, d, CANDIDATES[:3]).backward(1), 1)], "step long, column string, r2 double")


@query(SUBSETS + "SELECT a, b, round(r2, 6) AS r2 FROM two ORDER BY r2 DESC LIMIT 1")
def sel_exhaustive(spark, d):
    (a, b), r2 = _regressions(spark, d).exhaustive(2)
    return spark.createDataFrame([(a, b, round(r2, 6))], "a string, b string, r2 double")


@query("WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), o AS (SELECT user_id, n, CASE WHEN user_id * 31 % 1000 < 250 THEN 0 ELSE user_id * 17 % n END AS cut, row_number() OVER (ORDER BY user_id * 7919 % 10007, user_id) AS p FROM u), v AS (SELECT *, coalesce(sum(n - cut) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS valid FROM o), f AS (SELECT *, CASE WHEN valid < 2000 THEN cut ELSE n END AS first FROM v), t AS (SELECT *, coalesce(sum(first) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS train FROM f), e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) SELECT event_id, CASE WHEN i < first THEN 'train' WHEN first IS NOT NULL THEN 'valid' END AS part FROM e LEFT JOIN t ON t.user_id = e.user_id AND train <= 6000")
def split_quota(spark, d):
    u = F.col("user_id")
    out = splits.quota_split(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 6000, 2000, turn=u * 7919 % 10007, fresh=u * 31 % 1000 < 250, offset=u * 17 % F.col("n"))
    return out.select("event_id", "part")


@query("WITH RECURSIVE g AS (SELECT l_suppkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS i FROM lineitem GROUP BY 1), r AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, -1 AS fold UNION ALL SELECT g.i, list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + n ELSE x END), list_position(loads, list_min(loads)) - 1 FROM r JOIN g ON g.i = r.i + 1) SELECT l_orderkey, l_linenumber, r.fold::INT AS fold FROM lineitem JOIN g USING (l_suppkey) JOIN r USING (i)")
def split_balanced_groups(spark, d):
    return splits.balanced_group_fold(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", 5).select("l_orderkey", "l_linenumber", "fold")


KINDS_WIDE = {f"k{i}": f"(l_partkey * {i + 1} + l_suppkey * {i}) % {i + 3}" for i in range(50)}


def _kinds(spark, d):
    li, texts = table(spark, d, "lineitem"), F.lit([f"v{i}" for i in range(len(KINDS_WIDE) + 2)])
    # the texts are there already; only remainders below 0 have to be made
    kinds = [F.coalesce(F.get(texts, F.expr(f"cast({x} as int)")), F.expr(f"concat('v', cast({x} as string))")).alias(c) for c, x in KINDS_WIDE.items()]
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), (F.col("l_returnflag") == "R").cast("int").alias("y"), *kinds)


def _by_column(df, cols):
    sums = wide.column_values(df, cols, {"rows": ("sum", "one"), "row_sum": ("sum", "row")}, {"one": F.lit(1), "row": F.col("row")}, text=False)
    return sums.select(F.array(*map(F.lit, cols))[F.col("c")].alias("column"), F.col("v").alias("value"), "rows", "row_sum")


K_WIDE = "WITH w AS (SELECT l_orderkey * 10 + l_linenumber AS row, (l_returnflag = 'R')::INT AS y, " + ", ".join(f"'v' || ({x}) AS {c}" for c, x in KINDS_WIDE.items()) + " FROM lineitem), u AS (UNPIVOT w ON " + ", ".join(KINDS_WIDE) + " INTO NAME \"column\" VALUE v)"


@query(K_WIDE + ", f AS (SELECT \"column\", v, min(row) AS first FROM u GROUP BY 1, 2), k AS (SELECT \"column\", v, row_number() OVER (PARTITION BY \"column\" ORDER BY first, v) AS value FROM f) SELECT \"column\", value, count(*) AS rows, sum(row)::BIGINT AS row_sum FROM u JOIN k USING (\"column\", v) GROUP BY 1, 2")
def enc_wide_ordinal(spark, d):
    w, cols = _kinds(spark, d), list(KINDS_WIDE)
    return _by_column(wide.looked_up(w, cols, wide.ordinal(w, cols, "row"), "code", -1), cols)


@query(K_WIDE + ", p AS (SELECT avg(y) AS prior FROM w), k AS (SELECT \"column\", v, (sum(y) + any_value(prior) * 5) / (count(y) + 5) AS value FROM u, p GROUP BY 1, 2) SELECT \"column\", round(value, 6) AS value, count(*) AS rows, sum(row)::BIGINT AS row_sum FROM u JOIN k USING (\"column\", v) GROUP BY 1, 2")
def enc_wide_target(spark, d):
    w, cols = _kinds(spark, d), list(KINDS_WIDE)
    means = wide.means(w, cols, "y", 5.0).withColumn("value", F.round("value", 6))  # a value's mean, not each row's
    return _by_column(wide.looked_up(w, cols, means, "value"), cols)


MANY = {f"p{i}": (f"((o_orderkey * {i * 37 + 11} + o_custkey * {i}) % {101 + i}) * {'-' if i % 3 == 0 else ''}1.5 + CASE WHEN o_orderstatus = 'F' THEN {i % 7 - 3} ELSE 0 END") for i in range(50)}
MANY_SQL = "WITH s AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y, " + ", ".join(f"({x})::DOUBLE AS {c}" for c, x in MANY.items()) + " FROM orders), u AS (UNPIVOT s ON " + ", ".join(MANY) + " INTO NAME \"column\" VALUE p), r AS (SELECT \"column\", y, rank() OVER (PARTITION BY \"column\" ORDER BY p) + (count(*) OVER (PARTITION BY \"column\", p) - 1) / 2.0 AS r FROM u), a AS (SELECT \"column\", (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc FROM r GROUP BY 1) "


def _many(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), *[F.expr(f"cast({x} AS double)").alias(c) for c, x in MANY.items()])


@query(MANY_SQL + "SELECT \"column\", round(auc, 6) AS auc FROM a")
def metric_auc_many(spark, d):
    return rounded(metrics.auc_many(_many(spark, d), "y", list(MANY)))


@query(MANY_SQL + ", g AS (SELECT \"column\" FROM a WHERE auc >= 0.5), o AS (SELECT o_orderkey, exp(sum(ln(9 * q / (1 - q)))) / 9 AS odds FROM (SELECT o_orderkey, 0.05 + abs(p) / 1000 AS q FROM u SEMI JOIN g USING (\"column\") WHERE o_orderkey % 3 <> 0) GROUP BY 1) SELECT orders.o_orderkey, round(coalesce(odds / (1 + odds), 0), 6) AS target FROM orders LEFT JOIN o USING (o_orderkey)")
def ens_gated_odds(spark, d):
    s = _many(spark, d)
    test = s.filter("o_orderkey % 3 <> 0").select("o_orderkey", *[(0.05 + F.abs(c) / 1000).alias(c) for c in MANY])
    return rounded(metrics.gated_odds(s, "y", test, s, "o_orderkey", list(MANY)))


POWERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("WITH x AS (SELECT unnest(['" + "', '".join(POWERS) + "']) AS \"column\", unnest([" + ", ".join(POWERS) + "]) AS x FROM lineitem), c AS (SELECT \"column\", lam, (lam - 1) * sum(ln(1 + x)) - count(*) / 2 * ln(var_pop(pow(1 + x, lam) / lam)) AS ll FROM x, (SELECT k / 20.0 + 0.0001 AS lam FROM range(-160, 41) AS t(k)) GROUP BY 1, 2), b AS (SELECT \"column\", arg_max(lam, ll) AS lam FROM c GROUP BY 1), f AS (SELECT \"column\", lam, (lam - 1) * sum(ln(1 + x)) - count(*) / 2 * ln(var_pop(pow(1 + x, lam) / lam)) AS ll FROM (SELECT b.\"column\", lam + k / 1000.0 AS lam FROM b, range(-60, 61) AS t(k)) JOIN x USING (\"column\") GROUP BY 1, 2) SELECT \"column\", round(arg_max(lam, ll), 1) AS lam FROM f GROUP BY 1")
def stat_boxcox_lambdas(spark, d):
    found = fe.boxcox_lambdas(table(spark, d, "lineitem"), list(POWERS))
    return spark.createDataFrame([(c, round(x, 1)) for c, x in found.items()], "column string, lam double")


@query(ORD + "SELECT o.o_orderkey, y, round(CASE WHEN g.c = 1 THEN prior ELSE prior * (1 - 1 / (1 + exp(-(g.c - 1)))) + g.s / g.c * (1 / (1 + exp(-(g.c - 1)))) END, 6) AS \"mean__o_orderpriority\", g.c AS \"n__o_orderpriority\" FROM o JOIN g ON o_orderpriority IS NOT DISTINCT FROM cat, p")
def enc_columns(spark, d):
    both = columns.ColumnEncoders([("mean", lambda c: ta.TargetEncoder("y", c), ["o_orderpriority"]), ("n", lambda c: en.CountEncoder(c), ["o_orderpriority"])])
    o = orders(spark, d)
    return rounded(both.fit(o).transform(o))


@query(ORD + "SELECT o.o_orderkey, round((g.s + prior) / (g.c + 1.0), 6) AS o_orderpriority, f.n AS o_orderstatus FROM o JOIN g ON o_orderpriority IS NOT DISTINCT FROM cat JOIN orders r USING (o_orderkey) JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) f ON f.o_orderstatus = r.o_orderstatus, p")
def enc_pipeline(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    stages = [columns.EncoderStage(lambda: ta.MEstimateEncoder("y", ["o_orderpriority"])), columns.EncoderStage(lambda: en.CountEncoder(["o_orderstatus"]))]
    return rounded(Pipeline(stages=stages).fit(o).transform(o).drop("y"))


@query("WITH p AS (SELECT p_partkey, p_name, p_size::VARCHAR AS size, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS \"Class\" FROM part), s AS (SELECT * FROM p WHERE \"Class\" IS NOT NULL), c AS (SELECT \"Class\" AS k, count(*) AS n FROM s GROUP BY 1), t AS (SELECT first(k ORDER BY n DESC, k) AS k, max(n) AS n, sum(n) AS total FROM c) SELECT p_partkey, size::DOUBLE AS size, (\"Class\" = k)::INT AS \"Class\", least(n, total - n, 10)::BIGINT AS folds FROM s, t")
def arff_binary_task(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("string").alias("size"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand")).alias("Class"))
    task, _, folds = arff.binary_task(p)
    return task.select("p_partkey", "size", "Class", F.lit(folds).cast("long").alias("folds"))
