"""Folds, splits and samples, decided by hashes of keys, so that they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.mapping import quoted
from ..core.order import placed, summed_before, sums_before

#: Users or groups of a bucket of running sums, and largest groups that are dealt one by one.
BUCKET, HEAD = 1 << 20, 10_000


def key_hash(keys: list[str], seed: int = 0) -> Column:
    return F.xxhash64(*map(quoted, keys), F.lit(seed))


def k_fold(df: DataFrame, keys: list[str], k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """Folds by key: rows of one key are in one fold (with a group as key, group folds)."""
    return df.withColumn(out, F.pmod(key_hash(keys, seed), F.lit(k)).cast("int"))


def modulo_fold(df: DataFrame, key: str, k: int, out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.pmod(quoted(key), F.lit(k)).cast("int"))


def stratified_fold(df: DataFrame, label: str, order: list[Column], k: int, out: str = "fold") -> DataFrame:
    """Folds that split every class evenly: the class's rows are dealt in ``order``.

    Rows of a class are numbered inside 256 hash buckets and dealt on from there, so no task holds a class.
    """
    bucket = F.pmod(F.xxhash64(*order), F.lit(256))
    b = df.withColumn("__b", bucket)
    sizes = b.groupBy(quoted(label).alias("__l"), F.col("__b").alias("__c")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("__l").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__l", "__c", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"))
    j = b.join(starts, quoted(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__c")))
    turn = Window.partitionBy(quoted(label), "__b").orderBy(*order)
    return j.withColumn(out, F.pmod(F.col("__start") + F.row_number().over(turn) - 1, F.lit(k)).cast("int")).drop("__b", "__l", "__c", "__start")


def time_split(df: DataFrame, ts: str, start: str) -> DataFrame:
    """``is_train``: before ``start``."""
    return df.withColumn("is_train", quoted(ts) < F.lit(start).cast("timestamp"))


def balanced_sample(df: DataFrame, label: str, keys: list[str], seed: int = 0) -> DataFrame:
    """All rows of the rarer class of a 0/1 label and as many of the other, those with the smallest hashes.

    The cut is a hash value found from counts by leading bits, then by rank among the rows that share them.
    """
    h = df.withColumn("__h", key_hash(keys, seed)).withColumn("__top", F.shiftright("__h", 48))
    counts = h.groupBy(quoted(label).alias("l")).agg(F.count("*").alias("n")).collect()
    n = {r["l"]: r["n"] for r in counts}
    want = min(n.get(0, 0), n.get(1, 0))
    large = 0 if n.get(0, 0) > n.get(1, 0) else 1
    tops = h.filter(quoted(label) == large).groupBy("__top").agg(F.count("*").alias("n"))
    cum = tops.withColumn("cum", F.sum("n").over(Window.orderBy("__top")))
    edge = cum.filter(F.col("cum") >= want).orderBy("__top").first() if want else None
    rest = h.filter(quoted(label) == 1 - large).drop("__h", "__top")
    if edge is None:
        return rest.limit(0) if not want else h.drop("__h", "__top")
    below = h.filter((quoted(label) == large) & (F.col("__top") < edge["__top"])).drop("__h", "__top")
    order = Window.partitionBy("__top").orderBy("__h", *map(quoted, keys))
    at = h.filter((quoted(label) == large) & (F.col("__top") == edge["__top"])).withColumn("__r", F.row_number().over(order))
    at = at.filter(F.col("__r") <= want - (edge["cum"] - edge["n"])).drop("__h", "__top", "__r")
    return rest.unionByName(below).unionByName(at)


def user_split(df: DataFrame, user: str, order: list[str], last: int, new_users: float = 0.25, seed: int = 0) -> DataFrame:
    """``is_valid``: the last rows of a user; all rows of a share of users, who are new to training."""
    w = Window.partitionBy(quoted(user)).orderBy(*[quoted(o).desc() for o in order])
    fresh = F.pmod(key_hash([user], seed), F.lit(1000)) < int(1000 * new_users)
    return df.withColumn("is_valid", fresh | (F.row_number().over(w) <= last))


def quota_split(df: DataFrame, user: str, order: str, train_rows: int, valid_rows: int, new_users: float = 0.25, seed: int = 0, turn: Column | None = None, fresh: Column | None = None, offset: Column | None = None, bucket: int = BUCKET, hot: int | None = None) -> DataFrame:
    """``part``: train, valid or null, by quotas of rows that users fill in random order.

    While the validation rows of the users before are short of ``valid_rows``, a user is new (all rows are valid;
    ``new_users`` of them are) or is cut at a random offset, the rows before it train and the others valid. After that
    users train. Users after the one that takes the training rows over ``train_rows`` get no part. ``turn``,
    ``fresh`` and ``offset`` (an expression of the user and ``n``, its rows) replace the hashes that decide.

    Only users, one row each, are put in order, by ranges; sums over them have two levels. Null is a user.
    """
    turn = key_hash([user], seed) if turn is None else turn
    fresh = F.pmod(key_hash([user], seed + 1), F.lit(1000)) < int(1000 * new_users) if fresh is None else fresh
    offset = F.pmod(key_hash([user], seed + 2), F.col("n")) if offset is None else offset
    users = df.groupBy(quoted(user)).agg(F.count("*").alias("n"))
    users = users.select(quoted(user), "n", turn.alias("__turn"), F.when(fresh, F.lit(0)).otherwise(offset).cast("long").alias("__offset"))
    users = summed_before(placed(users, ["__turn", user], "__p"), "__p", F.col("n") - F.col("__offset"), "__valid", bucket)
    users = users.withColumn("__first", F.when(F.col("__valid") < valid_rows, F.col("__offset")).otherwise(F.col("n")))
    users = summed_before(users, "__p", F.col("__first"), "__train", bucket).filter(F.col("__train") <= train_rows)
    largest = users.agg(F.max("n")).first()[0] or 0
    told = users.select(quoted(user).alias("__user"), "__first")
    rows = sums_before(df, quoted(user), order, {"__i": F.lit(1)}, largest, hot)
    both = rows.join(told, quoted(user).eqNullSafe(F.col("__user")), "left")
    return both.withColumn("part", F.when(F.col("__i") < F.col("__first"), "train").when(F.col("__first").isNotNull(), "valid")).drop("__i", "__user", "__first")


def _turns(loads: list[int], n: int, m: int) -> list[tuple[int, list[int]]]:
    """(place, folds): from that place on, ``m`` groups of ``n`` rows go to ``folds`` in turn; ``loads`` are updated.

    Each goes to the fold with the fewest rows, the first of equal ones. A fold takes part from the level (a whole
    number of groups) of its load on, so there are as many stretches as folds at most, however many the groups.
    """
    k = len(loads)
    levels = sorted({x // n for x in loads})
    out, place = [], 0
    for i, level in enumerate(levels):
        cycle = sorted((f for f in range(k) if loads[f] // n <= level), key=lambda f: (loads[f] % n, f))
        out.append((place, cycle))
        take = m - place if i + 1 == len(levels) else min(m - place, (levels[i + 1] - level) * len(cycle))
        rounds, rest = divmod(take, len(cycle))
        for j, f in enumerate(cycle):
            loads[f] += n * (rounds + (j < rest))
        place += take
        if place == m:
            break
    return out


def balanced_group_fold(df: DataFrame, group: str, k: int, seed: int = 0, head: int = HEAD, out: str = "fold", bucket: int = BUCKET) -> DataFrame:
    """Folds of about equal size that split no group; null is a group.

    Groups go one after the other, largest first and equal ones by their key, to the fold with the fewest rows; so
    folds are within the largest group of each other at most. Groups of one size take turns over the folds, so the
    loads follow from how many groups have each size (some root of the rows' number of sizes, as they add up to the
    rows): the driver gets these, and each group's turn comes from its place in the order, by ranges.
    ``seed``, ``head`` and ``bucket`` are of an earlier method, and have no effect.
    """
    name, spark = quoted(group), df.sparkSession
    sizes = df.groupBy(name.alias("__g")).agg(F.count("*").alias("__n")).withColumn("__less", -F.col("__n"))
    at = placed(sizes, ["__less", "__g"], "__p")
    loads, turns = [0] * k, []
    for n, m, first in sorted(at.groupBy("__n").agg(F.count("*"), F.min("__p")).collect(), reverse=True):  # a row a size
        turns.append((n, [(first + place, cycle) for place, cycle in _turns(loads, n, m)]))
    told = spark.createDataFrame(turns, "__size long, __turns array<struct<start:long,folds:array<int>>>")
    own = at.join(told, F.col("__n") == F.col("__size"))
    turn = F.element_at(F.filter("__turns", lambda t: t["start"] <= F.col("__p")), -1)
    own = own.withColumn("__t", turn).select("__g", F.get("__t.folds", ((F.col("__p") - F.col("__t.start")) % F.size("__t.folds")).cast("int")).alias("__f"))
    return df.join(own, name.eqNullSafe(F.col("__g")), "left").withColumn(out, F.col("__f")).drop("__g", "__f")
