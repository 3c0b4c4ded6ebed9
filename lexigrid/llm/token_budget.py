"""Problem 2: token budget per source, language and host.

Method: a ledger in a shared folder keeps, for one tokenizer, a count table keyed by the SHA-256 of the content
(one folder per tokenizer hash), the last state of the documents and the cube. An update encodes only contents
that the count table lacks, compares the new state with the last one into signed rows (+1 new, -1 gone; a
changed document is both), and adds the signed sums to the cube, so removed documents leave it again. The cube
holds the finest cells; totals by one column come from it by grouping sets.

Every step is keyed by content hash or document, both free of hot keys; the cube's keys are pre-aggregated
before the shuffle. Each version is written once and named in the folder only when it is whole, so a lost
executor or a repeated update can't count anything twice.

Defined results: null, empty and blank targets count as empty (null and empty ones have 0 tokens, a
blank one has the tokens of its spaces); an empty table has no totals; a missing url or a host outside the sites table is counted
under '(unknown)' for what isn't known; a row delivered twice counts once; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexigrid.llm.encode import TOKENIZER, replay, tokenizer_path
from lexigrid.session import checkpoint_dir

UNKNOWN = "(unknown)"
DIMS = ["game", "site_lang", "site_host"]
COUNT = T.StructType([T.StructField("hash", T.StringType()), T.StructField("n_tokens", T.LongType())])


def file_hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


class Ledger:
    """The count table, the last state and the cube of one folder and tokenizer."""

    def __init__(self, spark: SparkSession, folder: str | None = None, tokenizer: str = TOKENIZER, path: str | None = None):
        self.spark = spark
        self.path = path or tokenizer_path(tokenizer)
        self.folder = f"{folder or f'{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}'}/{file_hash(self.path)}"
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last whole version; 0 before the first update."""
        if not self.fs.exists(self.fs_path(f"{self.folder}/cube")):
            return 0
        names = [x.getPath().getParent().getName() for x in self.fs.globStatus(self.fs_path(f"{self.folder}/cube/v=*/_SUCCESS"))]
        return max((int(n.split("=")[1]) for n in names), default=0)

    def _read(self, part: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{part}/v={version}")

    def counts(self, version: int) -> DataFrame | None:
        """(hash, n_tokens) of all contents encoded up to a version."""
        parts = [f"{self.folder}/counts/v={v}" for v in range(1, version + 1)]
        return self.spark.read.parquet(*parts) if parts else None

    def cube(self) -> DataFrame:
        return self._read("cube", self.version())

    def encode_unseen(self, contents: DataFrame, version: int) -> DataFrame:
        """Writes and returns the counts of the (hash, text) that no earlier version has."""
        known = self.counts(version - 1)
        unseen = contents if known is None else contents.join(known.select("hash"), "hash", "left_anti")
        path = self.path

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bpe = replay(path)
            for pdf in batches:
                yield pd.DataFrame({"hash": pdf["hash"], "n_tokens": bpe.count_batch(pdf["text"])})

        unseen.dropDuplicates(["hash"]).mapInPandas(run, COUNT).write.mode("overwrite").parquet(f"{self.folder}/counts/v={version}")
        return self.counts(version)

    def update(self, docs: DataFrame) -> DataFrame:
        """Brings the cube to docs (key, text, and the cube's columns); returns the signed delta of the cube."""
        last = self.version()
        now = last + 1
        hashed = docs.select("key", *DIMS, F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.sha2("text", 256))
        counts = self.encode_unseen(hashed.where("text <> ''").select("hash", "text"), now)
        empty = (F.trim(F.regexp_replace("text", r"(?U)\s+", "")) == "").alias("empty")
        state = hashed.select("key", *DIMS, "hash", empty).dropDuplicates()
        state.write.mode("overwrite").parquet(f"{self.folder}/state/v={now}")
        state = self._read("state", now)
        signed = state.withColumn("sign", F.lit(1))
        if last:
            was = self._read("state", last).withColumn("sign", F.lit(-1))
            signed = signed.unionByName(was).groupBy("key", *DIMS, "hash", "empty").agg(F.sum("sign").alias("sign")).where("sign <> 0")
        delta = (
            signed.join(counts, "hash", "left")
            .groupBy(*DIMS)
            .agg(
                F.sum("sign").cast("bigint").alias("n_items"),
                F.sum(F.when(F.col("empty"), F.col("sign")).otherwise(0)).cast("bigint").alias("n_empty"),
                F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("bigint").alias("n_tokens"),
            )
        )
        delta.write.mode("overwrite").parquet(f"{self.folder}/delta/v={now}")
        delta = self._read("delta", now)
        cube = delta
        if last:
            cube = delta.unionByName(self._read("cube", last)).groupBy(*DIMS).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n_items", "n_empty", "n_tokens")]).where("n_items <> 0 OR n_tokens <> 0")
        cube.write.mode("overwrite").parquet(f"{self.folder}/cube/v={now}")
        return delta


def items(annotation_items: DataFrame, sites: DataFrame, text: str = "target_text") -> DataFrame:
    """(key, game, site_lang, site_host, text) of the items; the sites table is small and fixed."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    known = sites.select(F.lower("site_host").alias("__host"), F.col("site_lang").alias("__lang")).dropDuplicates(["__host"])
    rows = annotation_items.select(F.col("item_id").alias("key"), F.coalesce("game", F.lit(UNKNOWN)).alias("game"), F.coalesce(host, F.lit("")).alias("__h"), F.col(text).alias("text"))
    joined = rows.join(known, rows["__h"] == known["__host"], "left")
    return joined.select("key", "game", F.coalesce("__lang", F.lit(UNKNOWN)).alias("site_lang"), F.coalesce("__host", F.lit(UNKNOWN)).alias("site_host"), "text")


def totals(cube: DataFrame) -> DataFrame:
    """The cube's cells and its totals: by game, by language, by host and overall ('level' names the grouping)."""
    cube = cube.select(*DIMS, "n_items", "n_empty", "n_tokens")
    cube.createOrReplaceTempView("__token_cube")
    return cube.sparkSession.sql(
        """
        SELECT CASE grouping_id(game, site_lang, site_host) WHEN 0 THEN 'cell' WHEN 3 THEN 'game' WHEN 5 THEN 'site_lang' WHEN 6 THEN 'site_host' ELSE 'all' END AS level,
               game, site_lang, site_host,
               CAST(coalesce(sum(n_items), 0) AS BIGINT) AS n_items, CAST(coalesce(sum(n_empty), 0) AS BIGINT) AS n_empty, CAST(coalesce(sum(n_tokens), 0) AS BIGINT) AS n_tokens
        FROM __token_cube
        GROUP BY GROUPING SETS ((game, site_lang, site_host), (game), (site_lang), (site_host), ())
        """
    )


def budget(annotation_items: DataFrame, sites: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """The totals after one update of the ledger in folder (a new one by default)."""
    ledger = Ledger(annotation_items.sparkSession, folder, tokenizer)
    ledger.update(items(annotation_items, sites))
    return totals(ledger.cube())


def item_counts(annotation_items: DataFrame, sites: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(item_id, game, site_lang, site_host, empty, n_tokens) of each item after one update of the ledger."""
    ledger = Ledger(annotation_items.sparkSession, folder, tokenizer)
    ledger.update(items(annotation_items, sites))
    now = ledger.version()
    state = ledger._read("state", now).join(ledger.counts(now), "hash", "left")
    return state.select(F.col("key").alias("item_id"), *DIMS, "empty", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
