"""Readers: CSV with byte-order marks, whole files, JSON lines (plain or zipped), URL lists, configurations."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lexigrid.functions import text as X, urls as U
from lexigrid.operators import hydrate


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **isin) -> DataFrame:
    """A CSV with header; names without byte-order mark and spaces; keyword lists filter columns (pushed into the scan)."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    df = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    for name, values in isin.items():
        if values is not None:
            df = df.where(F.col(name).isin(list(values)))
    return df


def labelled(spark: SparkSession, path: str, text: str = "text", label: str = "label") -> DataFrame:
    """(text, label) of a CSV; the text column falls back to title; missing columns are an error."""
    df = csv(spark, path)
    name = text if text in df.columns else "title" if "title" in df.columns else hydrate.text_column(df)
    if name is None or label not in df.columns:
        raise ValueError(f"no text or label column in {df.columns}")
    return df.select(F.col(name).cast("string").alias("text"), F.col(label).cast("string").alias("label"))


def whole_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, stem, content): one row per file below a folder."""
    reader = spark.read.option("recursiveFileLookup", True).option("wholetext", True)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    df = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return df.withColumn("stem", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z0-9]+$", ""))


def documents(spark: SparkSession, path: str, suffix: str, excluded: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, skipped): files with the version of their name; skipped ones with the reason."""
    f = whole_files(spark, path, suffix).withColumn("patch_id", X.version_of(F.regexp_replace("stem", r"[_-]", ".")))
    reason = F.when(F.lower("stem").isin("index", "home", "patches"), "index page").when(F.col("patch_id").isNull(), "no version in name").when(F.col("patch_id").isin(*excluded) if excluded else F.lit(False), "excluded version").when(F.length(F.trim("content")) == 0, "empty")
    f = f.withColumn("reason", reason)
    return f.where("reason IS NULL").drop("reason"), f.where("reason IS NOT NULL").select("path", "patch_id", "reason")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; lines that aren't JSON are left out. Splittable."""
    s = T._parse_datatype_string(schema)
    df = spark.read.text(path).select(F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    return df.where(F.try_parse_json("value").isNotNull()).select("r.*")


def json_lines_zip(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the .json and .jsonl members of zip archives, streamed line by line, with source_pos in each archive.

    A zip can't be split, so an archive is one task, which opens it by its path in the worker (a local or mounted folder);
    neither the archive, of any size, nor its lines are ever held together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zipfile
        from urllib.parse import unquote, urlparse

        for pdf in batches:
            for name in pdf["path"]:
                pos, rows = 0, []
                with zipfile.ZipFile(unquote(urlparse(name).path)) as z:
                    for member in sorted(z.namelist()):
                        if not member.endswith((".json", ".jsonl")):
                            continue
                        with z.open(member) as lines:
                            for line in lines:
                                rows.append((name, pos, line.decode("utf-8", "replace")))
                                pos += 1
                                if len(rows) == 10_000:
                                    yield pd.DataFrame(rows, columns=["archive", "source_pos", "value"])
                                    rows = []
                yield pd.DataFrame(rows, columns=["archive", "source_pos", "value"])

    raw = spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, "archive string, source_pos bigint, value string")
    ok = raw.where(F.try_parse_json("value").isNotNull())
    return ok.select("archive", "source_pos", F.from_json("value", schema).alias("r")).select("archive", "source_pos", "r.*")


def url_list(spark: SparkSession, path: str, pattern: str = r"patch-[0-9]+-[0-9]+") -> DataFrame:
    """(url, version) of a list file: blanks and # comments left out, one of each, newest version first."""
    t = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' AND url NOT LIKE '#%'").where(F.col("url").rlike(pattern))
    t = t.select(U.canonical(F.col("url")).alias("url")).distinct().withColumn("version", X.version_of(F.replace(U.last_part(F.col("url")), F.lit("_"), F.lit("-"))))
    return t.orderBy(F.desc(X.version_key(F.col("version"))), "url")


def version_candidates(spark: SparkSession, first: int, last: int, minors: int = 24, suffixes=("", "b", "c"), styles=("patch-{}-{}{}-notes", "patch-{}-{}{}")) -> DataFrame:
    """(version, slug): every candidate of a version range, newest first."""
    df = spark.range(first, last + 1).select(F.col("id").cast("int").alias("major")).withColumn("minor", F.explode(F.sequence(F.lit(1), F.lit(minors)))).withColumn("suffix", F.explode(F.array(*map(F.lit, suffixes))))
    slug = F.array(*[F.format_string(s.replace("{}", "%s"), F.col("major").cast("string"), F.col("minor").cast("string"), F.col("suffix")) for s in styles])
    return df.select(F.concat(F.col("major").cast("string"), F.lit("."), F.col("minor").cast("string"), "suffix").alias("version"), F.posexplode(slug).alias("style", "slug"), "major", "minor", "suffix").orderBy(F.desc("major"), F.desc("minor"), "suffix", "style").select("version", "slug")


def page_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(stem, title, date_text, canonical_url) of page JSON files: metadata first, then the record, bad files null."""
    f = whole_files(spark, path, ".json")
    get = lambda *ps: F.coalesce(*[F.get_json_object("content", p) for p in ps])
    ok = F.try_parse_json("content").isNotNull()
    return f.where(ok).select("stem", get("$.metadata.title", "$.record.title").alias("title"), get("$.metadata.date_text", "$.record.published_at").alias("date_text"), get("$.metadata.canonical_url", "$.record.canonical_url", "$.final_url", "$.url").alias("canonical_url"))


def codebook(path: str) -> dict:
    """A codebook: its labels in order and its metrics; empty when the file is missing."""
    p = Path(path)
    if not p.exists():
        return {"labels": {}, "main_metrics": {}, "global_instructions": []}
    book = json.loads(p.read_text(encoding="utf-8"))
    labels = book.get("labels", {})
    book["labels"] = dict(sorted(labels.items(), key=lambda kv: (kv[1].get("order", 10**6), kv[0])))
    return {"main_metrics": {}, "global_instructions": [], **book}


def batch_config(path: str) -> dict:
    """A batch configuration: an object whose scalars become lists where a grid needs them."""
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(config, dict):
        raise ValueError("a batch configuration must be a JSON object")
    grid = ("models", "champions", "skins", "skinlines", "regions", "universes", "seeds", "tokens", "top_k", "temperature", "sentence_mode", "deduplicate")
    return {k: (v if isinstance(v, list) else [v]) if k in grid else v for k, v in config.items()}


def system_prompt(book: dict, examples: int = 2) -> str:
    """The annotator's instructions from a codebook: general ones, then each label with up to two examples either way."""
    out = ["You label short texts. Answer with strict JSON only.", *book.get("global_instructions", [])]
    for key, x in book.get("labels", {}).items():
        out.append(f"{key}: {x.get('description', '')}")
        for name in ("positive", "negative"):
            ex = x.get(f"{name}_examples", [])[:examples]
            if ex:
                out.append(f"  {name}: " + " | ".join(ex))
    return "\n".join(out)


def resolve(explicit: str | None, known: tuple, root: str, pattern: str) -> str:
    """The path of a source: the one given, else the first known place, else the first in order below a folder; a missing
    source is an error."""
    if explicit:
        if not Path(explicit).exists():
            raise FileNotFoundError(explicit)
        return explicit
    for p in known:
        if Path(p).exists():
            return str(p)
    below = sorted(map(str, Path(root).rglob(pattern))) if Path(root).exists() else []
    if not below:
        raise FileNotFoundError(f"{pattern} below {root}")
    return below[0]


def reuse(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """A table that was written before, or, where it is missing or `force`, the one that build() gives, written first."""
    from lexigrid.sources import sinks

    if force or not sinks.exists(spark, path):
        sinks.write(build(), path, overwrite=force)
    return spark.read.parquet(path)


def json_values(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): JSON files as valid UTF-8, bad bytes replaced; files that are no JSON have null."""
    f = spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return f.select("path", F.when(F.try_parse_json("content").isNotNull(), F.col("content")).alias("content"))


def comma_list(c) -> Column:
    """The parts of a comma list, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def html_or_text(spark: SparkSession, html_path: str, text_path: str) -> DataFrame:
    """(stem, kind, content): HTML files, and for stems that have none the text files."""
    h = whole_files(spark, html_path, ".html").select("stem", F.lit("html").alias("kind"), "content")
    t = whole_files(spark, text_path, ".txt").select("stem", F.lit("text").alias("kind"), "content")
    return h.unionByName(t.join(h.select("stem"), "stem", "left_anti"))
