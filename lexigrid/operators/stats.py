"""Resampling tests on two groups of values; every draw is an MD5 value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from lexigrid.operators.sampling import hash_rank

#: Bootstrap draws that one task should make.
TASK_DRAWS = 2_000_000


def permutation(values: DataFrame, n_perm: int = 200, seed=42) -> DataFrame:
    """(difference, p_value) of the mean difference of group x and group y; values: (id, grp 'x' or 'y', v).

    Every replicate ranks all values by hash (over hash ranges, not in one task); the first n_x are its x.
    """
    sizes = values.agg(F.count_if(F.col("grp") == "x").alias("n_x"), F.avg(F.when(F.col("grp") == "x", F.col("v"))).alias("m_x"), F.avg(F.when(F.col("grp") == "y", F.col("v"))).alias("m_y"))
    reps = values.select("id", "v", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("rep"))
    ranked = hash_rank(reps, ["rep"], F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), "id")), F.col("id"))
    cut = F.broadcast(sizes)  # one row
    ranked = ranked.join(cut, how="cross")
    diff = ranked.groupBy("rep").agg((F.avg(F.when(F.col("rank") <= F.col("n_x"), F.col("v"))) - F.avg(F.when(F.col("rank") > F.col("n_x"), F.col("v")))).alias("d"), F.max(F.col("m_x") - F.col("m_y")).alias("observed"))
    return diff.agg(F.round(F.max("observed"), 9).alias("difference"), F.round((F.count_if(F.abs("d") >= F.abs("observed") - 1e-12) + 1) / (F.count("*") + 1), 9).alias("p_value"))


def bootstrap(values: DataFrame, n_boot: int = 200, seed=43, broadcast_rows: int = 200_000) -> DataFrame:
    """(low, high): the 2.5 and 97.5 percentiles of the mean difference over resamples with replacement.

    values as in permutation; a null id has the last place of its group. The draws (n_boot times the values) are a range
    over many tasks and are never broadcast; up to broadcast_rows values go to the draws, more are joined by shuffle.
    """
    spark = values.sparkSession
    sizes = {r.grp: r.n for r in values.where("grp IN ('x', 'y')").groupBy("grp").agg(F.count("*").alias("n")).collect()}  # two rows
    n_x, n_y = sizes.get("x", 0), sizes.get("y", 0)
    n_draws = (n_x + n_y) * n_boot
    # keys: the places of x, then those of y
    placed = hash_rank(values.where("grp IN ('x', 'y')"), ["grp"], F.coalesce(F.md5("id"), F.lit("g")), F.col("id"), "place")
    placed = placed.select((F.col("place") + F.when(F.col("grp") == "x", 0).otherwise(n_x)).alias("key"), "grp", "v")
    placed = F.broadcast(placed) if n_x + n_y <= broadcast_rows else placed.hint("shuffle_hash")  # a hash table of the values, so that the draws are not sorted
    tasks = max(2 * max(4, spark.sparkContext.defaultParallelism), -(-n_draws // TASK_DRAWS))
    draws = spark.range(n_draws, numPartitions=tasks).select((F.col("id") % n_boot + 1).alias("rep"), F.expr(f"id DIV {n_boot}").alias("k"))
    in_x = F.col("k") < n_x
    j = F.col("k") - F.when(in_x, 0).otherwise(n_x) + 1
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.when(in_x, "x").otherwise("y"), F.col("rep").cast("string"), j.cast("string"))), 1, 8), 16, 10).cast("bigint")
    draws = draws.select("rep", (F.when(in_x, number % n_x).otherwise(number % n_y + n_x) + 1).alias("key"))
    got = draws.join(placed, "key")
    means = got.groupBy("rep").agg((F.avg(F.when(F.col("grp") == "x", F.col("v"))) - F.avg(F.when(F.col("grp") == "y", F.col("v")))).alias("d"))
    p = lambda q: F.round(F.percentile("d", F.lit(q)), 9)
    return means.agg(p(0.025).alias("low"), p(0.975).alias("high"))


def cliffs_delta(values: DataFrame, buckets: int = 1024) -> DataFrame:
    """(n_x, n_y, delta): share of pairs x > y less share of pairs x < y, from counts by value instead of pairs.

    v in 0..1; the order is taken over value ranges first and inside a range second.
    """
    c = values.groupBy("v").agg(F.count_if(F.col("grp") == "x").alias("x"), F.count_if(F.col("grp") == "y").alias("y")).withColumn("b", F.floor(F.col("v") * buckets))
    per = c.groupBy("b").agg(F.sum("y").alias("by"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most buckets + 1 rows
    per = per.withColumn("below", F.coalesce(F.sum("by").over(before), F.lit(0))).select("b", "below")
    inside = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    c = c.join(per, "b").withColumn("less", F.col("below") + F.coalesce(F.sum("y").over(inside), F.lit(0)))
    t = c.agg(F.sum("x").alias("n_x"), F.sum("y").alias("n_y"), F.sum(F.col("x") * F.col("less")).alias("more"), F.sum(F.col("x") * F.col("y")).alias("ties"))
    return t.select("n_x", "n_y", F.round(F.try_divide((2 * F.col("more") + F.col("ties") - F.col("n_x") * F.col("n_y")).cast("double"), F.col("n_x") * F.col("n_y")), 9).alias("delta"))


def holm(tests: DataFrame, p: str = "p_value", name: str = "metric") -> DataFrame:
    """tests with holm_p: rank times p, running maximum, at most 1 (a handful of planned tests)."""
    w = Window.orderBy(p, name)
    m = F.count("*").over(Window.partitionBy())
    raw = tests.withColumn("__raw", (m - F.row_number().over(w) + 1) * F.col(p))
    return raw.withColumn("holm_p", F.round(F.least(F.lit(1.0), F.max("__raw").over(w.rowsBetween(Window.unboundedPreceding, 0))), 9)).drop("__raw")
