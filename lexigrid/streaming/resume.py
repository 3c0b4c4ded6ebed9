"""Continuous annotation: new items are labelled once and appended, however often a batch is repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigrid.operators import annotate
from lexigrid.sources import sinks


def stream(spark, folder: str, schema, log_path: str, checkpoint: str, label=None, once: bool = True):
    """Starts a query that reads item files as they arrive and appends an ok row for each item not yet in the log.

    label: Column function of target_text; the offline rule by default. once: take what is there, then stop.
    """
    label = label or annotate.rule_label

    def land(batch: DataFrame, number: int) -> None:
        items = batch.dropDuplicates(["item_id"])
        if sinks.exists(spark, log_path):
            items = annotate.pending(items, spark.read.parquet(log_path))
        rows = items.select("item_id", label(F.col("target_text")).alias("primary_label"), F.lit(1.0).alias("confidence"), F.lit("ok").alias("annotation_status"), (F.lit(number).cast("decimal(18,0)") * F.expr("CAST(9223372036854775808 AS DECIMAL(19,0))") + F.monotonically_increasing_id()).cast("decimal(38,0)").alias("append_seq"))
        rows.write.mode("append").parquet(log_path)

    w = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, by, n, total): counts and sums per time window with a watermark; batch or streaming."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late) if events.isStreaming else e
    g = e.groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), by, "n", "total")
