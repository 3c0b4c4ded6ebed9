"""Attaching source texts to annotations by ids in several written forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.functions import text as X

TEXT_COLUMNS = ("content", "text", "body", "normalizedBody", "clean_text", "document", "post_text")
PREFIXES = ("t3_", "t1_")


def variants(c) -> Column:
    """The forms an id may be written in: as it is, bare, and with either prefix."""
    raw = F.trim(c.cast("string"))
    bare = F.regexp_replace(raw, r"^t[13]_", "")
    return F.when((raw == "") | (F.lower(raw) == "nan"), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(raw, bare, *[F.concat(F.lit(p), bare) for p in PREFIXES])))


def text_column(df: DataFrame, preferred: str | None = None) -> str | None:
    """The text column of a table: the preferred name, else the first candidate whatever its case (plan time only)."""
    if preferred in df.columns:
        return preferred
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[c.lower()] for c in TEXT_COLUMNS if c.lower() in by_lower), None)


def rehydrate(annotations: DataFrame, source: DataFrame, id_col: str = "id", source_id: str = "source_id", pos: str = "source_pos") -> DataFrame:
    """annotations with the first source row (by pos) that shares a form of their id; without one: nulls.

    Both sides are exploded to at most four forms and joined by form; the first row is a partial aggregate, so a
    form that many source rows share is combined before the shuffle.
    """
    forms = annotations.select(F.col(id_col).alias("__id"), F.explode(variants(F.col(id_col))).alias("__form")).distinct()
    rest = [c for c in source.columns if c != source_id]
    rows = source.select(F.explode(variants(F.col(source_id))).alias("__form"), F.struct(F.col(pos), F.col(source_id), *[F.col(c) for c in rest if c != pos]).alias("__row"))
    best = rows.groupBy("__form").agg(F.min_by("__row", F.col(f"__row.{pos}")).alias("__row"))
    hit = forms.join(best, "__form").groupBy("__id").agg(F.min_by("__row", F.struct(F.col(f"__row.{pos}"), F.col(f"__row.{source_id}"))).alias("__row"))
    out = annotations.join(hit, annotations[id_col] == hit["__id"], "left")
    clash = set(annotations.columns)
    return out.select(*annotations.columns, *[F.col(f"__row.{c}").alias(f"{c}_source" if c in clash else c) for c in [pos, source_id, *[c for c in rest if c != pos]]])


def with_category(df: DataFrame, key: str, dim: DataFrame, dim_key: str, value: str, order: str) -> DataFrame:
    """df with the dimension's value for its key, case ignored; of several rows of a key the first by order."""
    d = dim.groupBy(F.lower(F.trim(dim_key)).alias("__k")).agg(F.min_by(value, order).alias(value))
    return df.join(d, F.lower(F.trim(key)) == F.col("__k"), "left").drop("__k")


def label_value(c) -> Column:
    """1 or 0 from the written forms of a yes/no label; an error for anything else."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("1", "1.0", "true", "yes", "story"), 1).when(t.isin("0", "0.0", "false", "no", "no_story", "no story"), 0).otherwise(F.raise_error(F.concat(F.lit("no label: "), F.coalesce(t, F.lit("null")))).cast("int"))


def prepare(df: DataFrame, text: str, label: str, min_chars: int = 50) -> DataFrame:
    """Cleaned texts of at least min_chars with their 0/1 label and its name."""
    d = df.withColumn("clean_text", X.post_clean(F.col(text))).where(F.length("clean_text") >= min_chars)
    return d.withColumn("story_label", label_value(F.col(label))).withColumn("label_name", F.when(F.col("story_label") == 1, "story").otherwise("no_story"))
