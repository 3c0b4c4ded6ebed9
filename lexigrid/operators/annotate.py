"""The annotation step: packets, pluggable annotator, response parsing, validation, resume and append log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lexigrid.operators import sampling

#: The labels of the codebook in their order, with their names.
LABELS = [
    ("change_specification", "Change specification"), ("corrective_maintenance", "Corrective maintenance"), ("design_rationale", "Design rationale"), ("audience_engagement", "Audience engagement"),
    ("future_monitoring", "Future monitoring"), ("promotional_context", "Promotional context"), ("non_substantive", "Non-substantive"),
]
#: The metrics of the codebook and their labels.
METRICS = [
    ("change_documentation", ("change_specification", "corrective_maintenance")),
    ("developer_intent_communication", ("design_rationale", "audience_engagement", "future_monitoring")),
    ("other_context", ("promotional_context", "non_substantive")),
]
NAMES = [k for k, _ in LABELS]

#: The offline annotator: ordered (label, pattern); the first that matches wins, else the last label.
RULES = [
    ("future_monitoring", r"(?i)keep an eye|later patch"), ("corrective_maintenance", r"(?i)fixed|crash|bug"), ("audience_engagement", r"(?i)players|happy to hear|thank"), ("design_rationale", r"(?i)we want|felt|so that|because"),
    ("promotional_context", r"(?i)join |follow |free today"), ("change_specification", r"(?i)→|=>|->|now|no longer|raised|lowered|reduced|adjusted"),
]


def rule_label(text: Column) -> Column:
    out = F.lit("non_substantive")
    for label, pattern in reversed(RULES):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), label).otherwise(out)
    return out


def label_dim(spark) -> DataFrame:
    return spark.createDataFrame([(k, n, 10 * (i + 1)) for i, (k, n) in enumerate(LABELS)], "primary_label string, label_name string, label_order int")


def metric_dim(spark) -> DataFrame:
    return spark.createDataFrame([(m, k) for m, ks in METRICS for k in ks], "metric string, primary_label string")


def payload(item_no: Column) -> Column:
    """The four fields of an item that the annotator sees, under a neutral id."""
    field = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return F.struct(F.format_string("item_%03d", item_no).alias("prompt_id"), field("context_before"), field("target_text"), field("context_after"))


def item_prompt(number: int = 1) -> Column:
    """The prompt that an item alone would be sent in, as JSON text."""
    return F.to_json(F.struct(F.array(payload(F.lit(number))).alias("items")))


def joined_back(answers: DataFrame, sent: DataFrame) -> DataFrame:
    """Answers under neutral ids (batch_no, prompt_id, ...) with the item_id that was sent under them; others have none."""
    ids = sent.select("batch_no", F.format_string("item_%03d", "item_no").alias("prompt_id"), "item_id")
    return answers.join(ids, ["batch_no", "prompt_id"], "left")


def answer_schema(labels: list[str] = NAMES) -> dict:
    """The JSON schema of an answer: every field required, labels of the code book only."""
    one = {"type": "string", "enum": list(labels)}
    fields = {"primary_label": one, "secondary_labels": {"type": "array", "items": one}, "confidence": {"type": "number"}, "evidence_quote": {"type": "string"}, "reason_short": {"type": "string"}}
    item = {"type": "object", "additionalProperties": False, "properties": {"prompt_id": {"type": "string"}, **fields}, "required": ["prompt_id", *fields]}
    return {"type": "object", "additionalProperties": False, "properties": {"items": {"type": "array", "items": item}}, "required": ["items"]}


def packets(items: DataFrame, batch_size: int = 12, seed=42) -> DataFrame:
    """(batch_no, n_items, approx_tokens, prompt): shuffled items in batches, each as one JSON text."""
    b = sampling.batches(items, batch_size, seed, "item_id")
    b = b.withColumn("item_no", (F.col("place") - (F.col("batch_no") - 1) * batch_size).cast("int"))
    words = F.size(F.filter(F.split(F.concat_ws(" ", "context_before", "target_text", "context_after"), r"[\t-\r ]+"), lambda x: x != ""))
    g = b.select("batch_no", "item_no", payload(F.col("item_no")).alias("p"), words.alias("w")).groupBy("batch_no")
    packed = g.agg(F.count("*").alias("n_items"), F.floor(F.sum("w") * 1.4).cast("bigint").alias("approx_tokens"), F.transform(F.array_sort(F.collect_list(F.struct("item_no", "p"))), lambda x: x["p"]).alias("items"))
    return packed.select("batch_no", "n_items", "approx_tokens", F.to_json(F.struct("items")).alias("prompt"))


ANSWER = "STRUCT<primary_label: STRING, secondary_labels: ARRAY<STRING>, confidence: STRING, evidence_quote: STRING, reason_short: STRING>"


def parse_answer(text: Column) -> Column:
    """A response as a struct: the text itself as JSON, or what stands from its first { to its last }; else null."""
    whole = F.from_json(text, ANSWER)
    part = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), ANSWER)
    ok = lambda a: F.when(a["primary_label"].isNotNull(), a)
    return F.coalesce(ok(whole), ok(part))


def validated(answers: DataFrame, batch: str = "batch_no", text: str = "response", labels=NAMES) -> DataFrame:
    """answers with label, secondary labels (known ones other than the label), confidence in 0..1 and status.

    One unknown label or unreadable answer fails its whole batch, as batches are accepted or repeated as one.
    """
    known = F.array(*[F.lit(x) for x in labels])
    a = answers.withColumn("__a", parse_answer(F.col(text)))
    bad = F.col("__a").isNull() | ~F.array_contains(known, F.coalesce("__a.primary_label", F.lit("")))
    a = a.withColumn("__bad", F.max(F.coalesce(bad, F.lit(True))).over(Window.partitionBy(batch)))
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("__a.confidence").try_cast("double"), F.lit(0.0))))
    second = F.filter(F.coalesce("__a.secondary_labels", F.array().cast("array<string>")), lambda x: F.array_contains(known, x) & (x != F.col("__a.primary_label")))
    return a.select(
        *answers.columns, F.when(~F.col("__bad"), F.col("__a.primary_label")).alias("primary_label"), F.when(~F.col("__bad"), F.array_join(second, ",")).alias("secondary_labels"),
        F.when(~F.col("__bad"), conf).alias("confidence"), F.when(F.col("__bad"), "error").otherwise("ok").alias("annotation_status"),
    )


def pending(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items that no ok row of the log answers."""
    return items.join(log.where("annotation_status = 'ok'").select("item_id").distinct(), "item_id", "left_anti")


def latest_ok(log: DataFrame) -> DataFrame:
    """The last ok row of each item; a partial aggregate instead of a window."""
    return log.where("annotation_status = 'ok'").groupBy("item_id").agg(F.max_by(F.struct("primary_label", "confidence"), "append_seq").alias("a"), F.max("append_seq").alias("append_seq")).select("item_id", "a.*", "append_seq")


def annotate(items: DataFrame, annotator: Callable, schema: str, batch_size: int = 12, seed=42) -> DataFrame:
    """Runs a user's annotator (pandas frame of one batch -> pandas frame) on each batch; a failing batch gives
    rows with status 'error', the others are unaffected."""
    cols = items.columns

    def run(pdf):
        import pandas as pd

        try:
            return annotator(pdf[cols])
        except Exception as e:  # noqa: BLE001
            return pd.DataFrame({"item_id": pdf["item_id"], "annotation_status": "error", "error": str(e)})

    b = sampling.batches(items, batch_size, seed, "item_id")
    names = [f.split()[0] for f in schema.split(", ")]

    def framed(pdf):
        out = run(pdf).reindex(columns=names).astype(object)
        return out.where(out.notna(), None)

    return b.groupBy("batch_no").applyInPandas(framed, schema)
