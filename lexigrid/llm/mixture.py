"""Problem 9: mixing sources to target weights.

Method: every record gets a hash-random key; within each source the records are range-sorted by it, and a
distributed prefix sum of their token counts (sums of key ranges first, then the order inside a range) cuts the
source at its exact budget. A budget beyond a source's tokens repeats the source as whole epochs and cuts the
last one; no record is used more than the source's max_repeats times.

The total is the largest at which every listed source that has tokens gives its share within its repeats; a
listed source without tokens gives none, is reported with 0, and the others keep their proportions. A total can
be given instead; a source that can't reach its budget then gives all its repeats and the report shows it.

The ranges of the keys (`RANGES` per source) bound what one task sorts: a source with a third of all rows is
spread over all ranges. Only the sums per range and source and the sources' table are small and broadcast-free.

Defined results: records without tokens (null and empty texts) and of unlisted or null sources are left out;
the record at the cut is taken if that brings the source nearer to its budget; ties of keys are broken by id;
a row delivered twice counts once; targets with a null or non-positive share or repeats give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from lexigrid.llm.encode import TOKENIZER, count_udf
from lexigrid.session import cut, spread

RANGES = 4096


def sized(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 42, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, key, range) of the records of listed sources that have tokens."""
    listed = targets.where("source IS NOT NULL").select("source").distinct()
    rows = documents.select("doc_id", "source", "text").where("text IS NOT NULL AND text <> ''").join(listed, "source", "left_semi").dropDuplicates()
    key = F.xxhash64(F.lit(seed), "doc_id", "source")
    counted = rows.withColumn("n_tokens", count_udf(tokenizer, path)("text")).where("n_tokens > 0")
    return counted.select("doc_id", "source", "n_tokens", key.alias("key")).withColumn("range", F.shiftright("key", 52) + RANGES // 2)


def budgets(records: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget): one row per listed source."""
    have = records.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
    usable = (F.col("available") > 0) & (F.coalesce("target_share", F.lit(0.0)) > 0) & (F.coalesce("max_repeats", F.lit(0)) > 0)
    everywhere = Window.partitionBy(F.lit(1))  # one row per listed source
    t = t.withColumn("usable", usable).withColumn("weight", F.when(F.col("usable"), F.col("target_share")).otherwise(0.0))
    t = t.withColumn("weight", F.try_divide("weight", F.sum("weight").over(everywhere)))
    most = F.min(F.when(F.col("usable"), F.col("max_repeats") * F.col("available") / F.col("weight"))).over(everywhere)
    t = t.withColumn("total", F.lit(float(total)) if total is not None else most)
    want = F.least(F.floor(F.col("weight") * F.col("total") + 1e-6), F.col("max_repeats").cast("bigint") * F.col("available"))
    return t.select("source", "target_share", "max_repeats", "available", F.when(F.col("usable"), want).otherwise(0).cast("bigint").alias("budget"))


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 42, total: float | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, report): chosen (doc_id, source, n_tokens, copies); report one row per listed source."""
    records = cut(sized(spread(documents), targets, tokenizer, seed, path))
    plan = cut(budgets(records, targets, total))
    sums = records.groupBy("source", "range").agg(F.sum("n_tokens").alias("in_range"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("in_range").over(earlier), F.lit(0))).select("source", "range", "offset")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = records.join(offsets, ["source", "range"]).withColumn("upto", F.col("offset") + F.sum("n_tokens").over(inside))
    p = placed.join(plan.where("budget > 0"), "source")
    whole = F.floor(F.col("budget") / F.col("available"))
    rest = F.col("budget") - whole * F.col("available")
    taken = (F.col("upto") + F.col("upto") - F.col("n_tokens") <= 2 * rest) & (rest > 0)
    chosen = p.withColumn("copies", (whole + F.when(taken, 1).otherwise(0)).cast("int")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    chosen = cut(chosen)
    got = chosen.groupBy("source").agg(F.count("*").alias("n_records"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    everywhere = Window.partitionBy(F.lit(1))
    report = plan.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "available", "budget",
        F.coalesce("n_records", F.lit(0)).cast("bigint").alias("n_records"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), F.coalesce("most_copies", F.lit(0)).cast("int").alias("most_copies"),
    ).withColumn("reached_share", F.coalesce(F.try_divide(F.col("n_tokens").cast("double"), F.sum("n_tokens").over(everywhere)), F.lit(0.0)))
    return chosen, report
