"""Deterministic orders, samples and splits from MD5 values: the same on every run and in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def key(seed, *cols) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def hash_rank(df: DataFrame, by: list, hashed: Column, tie: Column, out: str = "rank") -> DataFrame:
    """df with the rank (from 1) of each row by its hash within `by`.

    Ranks come from the sizes of 256 hash ranges and the order inside a range, so that a group of any size, or
    the whole table (by = []), is never ordered in one task.
    """
    groups = [F.col(c) for c in by] or [F.lit(0)]
    names = [f"__g{i}" for i in range(len(groups))]
    d = df.withColumns({n: g for n, g in zip(names, groups)}).withColumn("__h", hashed).withColumn("__b", F.substring("__h", 1, 2))
    sizes = d.groupBy(*names, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(n).alias(f"{n}o") for n in names], F.col("__b").alias("__bo"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*names, "__b").orderBy("__h", tie)
    d = d.withColumn("__r", F.row_number().over(inside))
    on = F.col("__b") == F.col("__bo")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}o"))
    j = d.join(offsets, on).withColumn(out, (F.col("__off") + F.col("__r")).cast("bigint"))
    return j.drop(*names, *[f"{n}o" for n in names], "__h", "__b", "__bo", "__off", "__r")


def sample(df: DataFrame, n: int, seed, id_col: str) -> DataFrame:
    """A simple random sample of n rows: those first in hash order (a distributed top n)."""
    return df.withColumn("__h", key(seed, F.col(id_col).cast("string"))).orderBy("__h", id_col).limit(n).drop("__h")


def batches(df: DataFrame, size: int, seed, id_col: str) -> DataFrame:
    """Every row with its place in a full shuffle and its batch number (from 1)."""
    d = hash_rank(df, [], key(seed, F.col(id_col).cast("string")), F.col(id_col), "place")
    return d.withColumn("batch_no", (F.floor((F.col("place") - 1) / size) + 1).cast("bigint"))


def stratified_split(df: DataFrame, label: str, id_col: str, test_share: float = 0.2, seed=42) -> DataFrame:
    """df with part 'train' or 'test': in each label the first test_share in hash order are test."""
    n = df.groupBy(label).agg(F.count("*").alias("__n")).withColumnRenamed(label, "__label")
    d = hash_rank(df, [label], key(seed, F.col(id_col).cast("string")), F.col(id_col)).join(n, F.col(label).eqNullSafe(F.col("__label")))
    return d.withColumn("part", F.when(F.col("rank") <= F.floor(F.col("__n") * test_share), "test").otherwise("train")).drop("__n", "__label", "rank")


def stratified_sample(df: DataFrame, n: int, strata: list, id_col: str, seed=42) -> DataFrame:
    """max(1, n // groups) rows of each stratum, topped up from the rest and cut to n, all in hash order.

    The strata are the few values of label columns, so counting them on the driver is bounded by the label set.
    """
    groups = df.select(*strata).distinct().count()
    base = max(1, n // max(1, groups))
    h = key(seed, F.col(id_col).cast("string"))
    d = hash_rank(df, strata, h, F.col(id_col)).withColumn("first", F.col("rank") <= base)
    d = d.withColumn("__h", h).orderBy(F.desc("first"), "__h", id_col).limit(n)
    return d.drop("__h", "rank")
