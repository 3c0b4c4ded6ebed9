"""Problem 1: lines repeated across the documents of one source.

Method: distributed PrefixSpan over line-identifier sequences of each source. A line's identifier
stands for its wording (its letters, lower-cased). Level 1 keeps the identifiers with enough distinct
documents of the source; each further level grows every frequent sequence by the line that follows it
(sequences are contiguous among the lines that hold a letter) inside its projected database. Every
line of an occurrence of a frequent sequence, single lines included, is deleted.

Support is counted over distinct documents with partial aggregation, so a source with a third of all
rows is spread by (source, line) and never gathered in one task.

Defined results: null and empty texts have no lines but their documents count in the source's total;
a row delivered twice counts once; a null source is a source of its own; an empty table gives no rows;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from lexigrid.session import bounded, cut

NOT_LETTER = r"\P{L}"


def lines(corpus: DataFrame, text="clean_text", doc="document_id", source="game") -> DataFrame:
    """(source, doc, line_no, item, seq): one row per line with a letter; item is the MD5 of its wording."""
    cols = corpus.select(F.col(source).alias("source"), F.col(doc).alias("doc"), F.col(text).alias("text"))
    # whole texts cross the network once, by document: what follows by document and line needs no other shuffle
    exploded = cols.where(F.col("doc").isNotNull()).repartition("source", "doc").select("source", "doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    wording = F.lower(F.regexp_replace("line", NOT_LETTER, ""))
    return (
        exploded.select("source", "doc", "line_no", wording.alias("wording"))
        .where(F.col("wording") != "")
        .select("source", "doc", "line_no", F.md5("wording").alias("item"))
        .dropDuplicates(["source", "doc", "line_no", "item"])
    )


def thresholds(corpus: DataFrame, doc="document_id", source="game", min_docs=4, min_share="0.08") -> DataFrame:
    """(source, need): the distinct documents that a sequence needs in each source."""
    share = Fraction(str(min_share))
    n = corpus.select(F.col(source).alias("source"), F.col(doc).alias("doc")).groupBy("source").agg(F.countDistinct("doc").alias("n_docs"))
    need = F.ceil(F.expr(f"n_docs * {share.numerator}BD / {share.denominator}BD"))
    return n.select("source", F.greatest(F.lit(int(min_docs)), need).cast("bigint").alias("need"))


def prefix_span(items: DataFrame, need: DataFrame, max_len: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Frequent sequences and their occurrences.

    items: (source, doc, line_no, item); need: (source, need). Returns
    patterns (source, length, pattern, n_docs) and occurrences (source, doc, pattern, length, first, last,
    line_nos). Levels grow until none is frequent. max_len bounds the reported sequences' length; it can't lose a
    deletion, as every line of a longer frequent sequence is frequent alone (support never grows with length).
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    need = bounded(need.select(F.col("source").alias("need_source"), "need"))

    def frequent(proj: DataFrame, length: int) -> DataFrame:
        """Pairs of pattern and document are made distinct first, then counted."""
        counted = proj.select("source", "pattern", "doc").distinct().groupBy("source", "pattern").agg(F.count("*").alias("n_docs"))
        return (
            counted.join(need, same("source", "need_source"))
            .where(F.col("n_docs") >= F.col("need"))
            .select("source", "pattern", F.lit(length).alias("length"), "n_docs")
        )

    # level 1; seq numbers the lines with a letter, so blank lines don't part a sequence
    order = Window.partitionBy("source", "doc").orderBy("line_no", "item")
    base = items.withColumn("seq", F.lit(0) if max_len == 1 else F.row_number().over(order))
    first = cut(frequent(items.withColumn("pattern", F.col("item")), 1))
    kept = base.join(
        first.select(F.col("source").alias("f_source"), F.col("pattern").alias("f_item")),
        same("source", "f_source") & (F.col("item") == F.col("f_item")),
        "left_semi",
    )
    kept = cut(kept)
    proj = kept.select("source", "doc", F.col("item").alias("pattern"), F.col("seq").alias("last"), F.array("line_no").alias("line_nos"))
    patterns, occurrences = [first], [proj.withColumn("length", F.lit(1))]
    follow = kept.select(F.col("source").alias("n_source"), F.col("doc").alias("n_doc"), F.col("seq").alias("n_seq"), F.col("item").alias("n_item"), F.col("line_no").alias("n_line"))
    for length in count(2) if max_len is None else range(2, max_len + 1):
        grown = proj.join(follow, same("source", "n_source") & (F.col("doc") == F.col("n_doc")) & (F.col("last") + 1 == F.col("n_seq"))).select(
            "source", "doc", F.concat_ws(" ", "pattern", "n_item").alias("pattern"), F.col("n_seq").alias("last"), F.concat("line_nos", F.array("n_line")).alias("line_nos")
        )
        level = cut(frequent(grown, length))
        if level.isEmpty():
            break
        proj = grown.join(
            level.select(F.col("source").alias("f_source"), F.col("pattern").alias("f_pattern")),
            same("source", "f_source") & (F.col("pattern") == F.col("f_pattern")),
            "left_semi",
        )
        proj = cut(proj)
        patterns.append(level)
        occurrences.append(proj.withColumn("length", F.lit(length)))
    return reduce(DataFrame.unionByName, patterns), reduce(DataFrame.unionByName, occurrences)


def mine(corpus: DataFrame, text="clean_text", doc="document_id", source="game", min_docs=4, min_share="0.08", max_len=None):
    """Patterns and occurrences of the frequent line sequences of each source."""
    return prefix_span(lines(corpus, text, doc, source), thresholds(corpus, doc, source, min_docs, min_share), max_len)


def found(corpus: DataFrame, text="clean_text", doc="document_id", source="game", max_len=None, **kw) -> DataFrame:
    """(document_id, line_no): the lines that occurrences of frequent sequences of every length cover.

    A longer sequence has at most the support of each of its lines, so any max_len gives the same rows, max_len=1 for the
    least work."""
    _, occ = mine(corpus, text, doc, source, max_len=max_len, **kw)
    return occ.select(F.col("doc").alias("document_id"), F.explode("line_nos").alias("line_no")).distinct()


def cleaned(corpus: DataFrame, text="clean_text", doc="document_id", source="game", max_len=None, **kw) -> DataFrame:
    """(document_id, game, clean_text, n_removed): each document once, without the found lines; null stays null."""
    _, occ = mine(corpus, text, doc, source, max_len=max_len, **kw)
    gone = (
        occ.select("source", "doc", F.explode("line_nos").alias("line_no"))
        .distinct()
        .groupBy("source", "doc")
        .agg(F.collect_set("line_no").alias("gone"))
        .select(F.col("source").alias("g_source"), F.col("doc").alias("g_doc"), "gone")
    )
    docs = corpus.select(F.col(doc).alias("document_id"), F.col(source).alias("game"), F.col(text).alias("text")).dropDuplicates()
    joined = docs.join(gone, docs.game.eqNullSafe(gone.g_source) & (docs.document_id == gone.g_doc), "left")
    keep = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("gone"), i))
    return joined.select(
        "document_id", "game", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n")).alias("clean_text"), F.coalesce(F.size("gone"), F.lit(0)).cast("int").alias("n_removed")
    ).withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
