"""Writers: guarded tables, append logs, run folders, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FORMATS = ("parquet", "json", "csv")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False) -> None:
    """One table; an existing path is an error unless overwritten. Arrays and structs become JSON text in CSV."""
    if fmt == "csv":
        df = df.select([F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.option("header", True).option("quoteAll", True).option("escape", '"').csv if fmt == "csv" else getattr(w, fmt))(path)


def write_all(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", overwrite: bool = False) -> None:
    """Several tables of one run under one folder, which must be new unless overwritten."""
    spark = next(iter(tables.values())).sparkSession
    if not overwrite and exists(spark, folder):
        raise FileExistsError(folder)
    for name, df in tables.items():
        write(df, f"{folder}/{name}", fmt, overwrite)


def append(df: DataFrame, path: str, seq: str = "append_seq") -> None:
    """Appends rows to a log with numbers that rise from run to run."""
    spark = df.sparkSession
    start = (spark.read.parquet(path).agg(F.max(seq)).collect()[0][0] or 0) + 1 if exists(spark, path) else 0
    df.withColumn(seq, F.monotonically_increasing_id() + F.lit(start)).write.mode("append").parquet(path)


def merge_schemas(frames: list[DataFrame]) -> DataFrame:
    """Rows of several tables under the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def run_id(stamp: str, n_topics: int, seed: int, encoder: str) -> str:
    import re

    slug = re.sub(r"-+", "-", re.sub(r"[^A-Za-z0-9._-]+", "-", encoder)).strip("-").lower()
    return f"{stamp}_topics{n_topics}_seed{seed}_{slug}"


def markdown(df: DataFrame, title: str = "", digits: int = 4) -> str:
    """A result table as Markdown, every row of it: for reports that were aggregated before."""
    rows = df.collect()
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("\n", " ").replace("|", "\\|")
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def unified_manifest(pages: DataFrame, scrapes: DataFrame) -> DataFrame:
    """Rows of both manifests under the union of their columns, each marked with its origin, each delivery once."""
    return merge_schemas([pages.dropDuplicates().withColumn("manifest", F.lit("page")), scrapes.dropDuplicates().withColumn("manifest", F.lit("scrape"))])


def checkpointed_manifest(rows: DataFrame, path: str) -> DataFrame:
    """Appends the rows of one step of a run to a manifest and returns the manifest; what earlier steps wrote stays, so a
    run that was cut short goes on where it ended (rows whose output_id is there already are left out)."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select("output_id"), "output_id", "left_anti")
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def corpus_tables(corpus: DataFrame, skipped: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """The tables beside a corpus: an audit without the texts, the skipped files, and the items to look at by hand (change-like
    texts of two words or fewer)."""
    return {"corpus": corpus, "corpus_audit": corpus.drop("clean_text"), "skipped": skipped, "manual_review": items.where("target_word_count <= 2")}


def run_metadata(spark: SparkSession, inputs: list[str], **settings) -> DataFrame:
    """One row: the UTC time of the run, its settings as JSON, and the hashes of its input files."""
    import json

    hashes = [file_hashes(spark, p) for p in inputs]
    every = hashes[0] if hashes else spark.createDataFrame([], "path string, length bigint, sha256 string")
    for h in hashes[1:]:
        every = every.unionByName(h)
    return every.agg(F.array_sort(F.collect_list(F.struct("path", "length", "sha256"))).alias("inputs")).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.lit(json.dumps(settings, sort_keys=True, default=str)).alias("settings"), "inputs")


def page_folder(source_kind) -> Column:
    """The sub-folder of a page's kind; an unknown kind is an error."""
    kinds = (("patch_page", "patches"), ("newsentry", "news"), ("microsite", "microsites"))
    out = F.raise_error(F.concat(F.lit("unknown source kind: "), F.coalesce(source_kind, F.lit("null"))))
    for kind, folder in reversed(kinds):
        out = F.when(source_kind == kind, folder).otherwise(out)
    return out


def page_paths(source_kind, output_id) -> Column:
    """A struct of the four artefacts' paths of a page."""
    at = page_folder(source_kind)
    path = lambda root, end: F.concat(F.lit(root + "/"), at, F.lit("/"), output_id, F.lit(end))
    return F.struct(path("raw_html", ".html").alias("raw_html_path"), path("article_html", ".html").alias("article_html_path"), path("text", ".txt").alias("text_path"), path("structured/pages", ".json").alias("structured_path"))
