"""Queries of problem 4: one UTC moment per record."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import timestamps
from lexigrid.session import table


def records(spark, sf):
    """(field, record_key, value, time_zone, date_order) of both tables; each record once."""
    sites = table(spark, sf, "sites").select("site_host", "time_zone", "date_order")
    a = table(spark, sf, "articles").select(F.lit("published_at").alias("field"), F.col("url").alias("record_key"), "url", F.col("published_at").alias("value"))
    p = table(spark, sf, "page_manifest").select(F.lit("date_text").alias("field"), F.col("output_id").alias("record_key"), "url", F.col("date_text").alias("value"))
    rows = a.unionByName(p).where(F.col("value").isNotNull())
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return rows.withColumn("site_host", host).drop("url").dropDuplicates().join(sites, "site_host", "left")


def p4_found(spark, sf):
    out = timestamps.to_utc_micros(records(spark, sf), "value", "time_zone", "date_order")
    return out.where(F.col("utc_micros").isNotNull()).select("field", "record_key", "utc_micros").distinct()


def queries() -> dict:
    return {"p4_found": p4_found}


def oracle_sql() -> dict[str, str]:
    return {}
