"""Queries of sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexigrid.operators import annotate
from lexigrid.sources import files, sinks
from lexigrid.session import checkpoint_dir, table
from lexigrid.streaming import resume


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def sink_roundtrip(spark, sf):
    """Rows and text lengths of the articles after a write and a read in each format."""
    a = table(spark, sf, "articles")
    folder = _folder(spark, "sink")
    out = None
    for fmt in sinks.FORMATS:
        sinks.write(a, f"{folder}/{fmt}", fmt)
        back = files.csv(spark, f"{folder}/{fmt}") if fmt == "csv" else spark.read.format(fmt).load(f"{folder}/{fmt}")
        one = back.agg(F.count("*").alias("n"), F.sum(F.length("title")).cast("bigint").alias("title_chars"), F.count_distinct("url").alias("n_urls")).select(F.lit(fmt).alias("format"), "n", "title_chars", "n_urls")
        out = one if out is None else out.unionByName(one)
    return out


def stream_resume(spark, sf):
    """Labels by game after the item stream was taken twice: the second time adds nothing."""
    folder = _folder(spark, "stream")
    path = f"{sf}/annotation_items.parquet"
    items = spark.read.parquet(path)
    items.select("item_id", "game", "target_text").write.parquet(f"{folder}/in")
    for turn in ("a", "b"):
        resume.stream(spark, f"{folder}/in", "item_id string, game string, target_text string", f"{folder}/log", f"{folder}/{turn}").awaitTermination()
    log = annotate.latest_ok(spark.read.parquet(f"{folder}/log"))
    games = items.select("item_id", "game").dropDuplicates(["item_id"])
    return games.join(log, "item_id").groupBy("game", "primary_label").agg(F.count("*").alias("n"))


def event_windows(spark, sf):
    return resume.windowed_counts(table(spark, sf, "events")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def version_candidates(spark, sf):
    return files.version_candidates(spark, 10, 12)


def queries() -> dict:
    return {n: globals()[n] for n in ("sink_roundtrip", "stream_resume", "event_windows", "version_candidates")}


def oracle_sql() -> dict[str, str]:
    from lexigrid.plans.annotation import LABEL

    return {
        "sink_roundtrip": "SELECT format, count(*) AS n, CAST(sum(length(title)) AS BIGINT) AS title_chars, count(DISTINCT url) AS n_urls FROM articles, (VALUES ('parquet'), ('json'), ('csv')) f(format) GROUP BY format",
        "stream_resume": f"SELECT game, {LABEL} AS primary_label, count(*) AS n FROM (SELECT item_id, any_value(game) AS game, any_value(target_text) AS target_text FROM annotation_items GROUP BY item_id) i GROUP BY ALL",
        "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
        "version_candidates": "SELECT major || '.' || minor || suffix AS version, format(style, major, minor, suffix) AS slug FROM range(10, 13) a(major), range(1, 25) b(minor), (VALUES (''), ('b'), ('c')) c(suffix), (VALUES ('patch-{}-{}{}-notes'), ('patch-{}-{}{}')) d(style)",
    }
