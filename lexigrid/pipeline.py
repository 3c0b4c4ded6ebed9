"""The whole annotation pipeline as one chain of DataFrames: corpus, items, labels, shares, descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigrid.operators import annotate as A, corpus as C, shares as S
from lexigrid.session import cut
from lexigrid.sources import sinks


def run(documents: DataFrame, folder: str, label=None, min_words: int = 20, window: int = 5, overwrite: bool = False) -> dict[str, DataFrame]:
    """Builds, writes and returns the tables of a run.

    documents: the columns of a corpus; label: Column function of target_text (the offline rule by default). The
    corpus and the items are written once and read again, so no later stage repeats them.
    """
    label = label or A.rule_label
    corpus = cut(C.build(documents, min_words))
    items = cut(C.items(corpus, window=window))
    log = items.select("item_id", label(F.col("target_text")).alias("primary_label"), F.lit(1.0).alias("confidence"), F.lit("ok").alias("annotation_status"), F.lit(0).cast("bigint").alias("append_seq"))
    m = S.merged(items, log)
    spark = documents.sparkSession
    tables = {
        "corpus": corpus, "corpus_summary": C.summary(corpus), "units": C.units(corpus), "items": items, "annotations": log, "label_shares": S.label_shares(m, A.label_dim(spark)),
        "metric_shares": S.metric_shares(m, ["game"]), "document_shares": S.metric_shares(m, ["document_id", "game", "patch_id", "year", "title"]), "corpus_stats": S.describe_corpus(corpus), "target_stats": S.describe_targets(items),
    }
    sinks.write_all(tables, folder, overwrite=overwrite)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in tables}
