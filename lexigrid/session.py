"""Session helpers shared by every module."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def builder(app: str = "lexigrid", master: str | None = None, shuffle: int | None = None):
    """A SparkSession builder with the settings the engine relies on: UTC, AQE, Arrow."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    return b


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory (a file or a folder of Parquet files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where the session names none, a temporary folder on a single machine and an
    error on a cluster, whose executors don't share one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = os.path.join(tempfile.gettempdir(), "lexigrid-checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives the loss of an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A side table for a join: written once, and broadcast if it is found to have at most that many rows.

    A larger one is joined by shuffle; adaptive execution then splits the partitions of hot keys.
    """
    df = cut(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of (compressed) input that one task of a text stage should take.
TASK_BYTES = 64 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads, as the planner knows them; unknown sources count as 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    return sum(x for x in sizes if x < 1 << 60)


def spread(df: DataFrame, *keys) -> DataFrame:
    """Rows over enough tasks for an expensive stage.

    A scan that is wide enough stays as it is, without a shuffle; a narrow one (few small files) is spread over
    twice the cores, a large plan over tasks of TASK_BYTES of input.
    """
    least = 2 * max(4, df.sparkSession.sparkContext.defaultParallelism)
    size = input_bytes(df)
    if not keys and size // (128 << 20) >= least:
        return df
    return df.repartition(max(least, -(-size // TASK_BYTES)), *keys)


def wide(spark: SparkSession, sf_dir: str, name: str, *keys) -> DataFrame:
    """An input table, spread for an expensive stage."""
    return spread(table(spark, sf_dir, name), *keys)
