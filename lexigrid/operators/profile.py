"""Descriptors of text groups under several token pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lexigrid.functions import text as X

#: English function words of the default profile.
FUNCTION_WORDS = (
    "a about after again all also although an and any are as at be because been before but by can could did do does for from had has have he her his how i if in into is it its "
    "just me more most my no not now of on one or our out over she should so some such than that the their them then there these they this those to too until up us was we were "
    "what when where which while who will with would you your"
).split()


@dataclass(frozen=True)
class Pipeline:
    """One way from tokens to kept tokens. lemma: a Column function (default none is known offline)."""

    label: str
    stop: bool = False
    punct: bool = False
    lower: bool = False
    symbols: bool = True
    control: bool = True
    lemma: object = None


RAW = Pipeline("RAW / minimal cleaning")
PLL = Pipeline("PLL: punctuation + lowercase", punct=True, lower=True)
ALL = Pipeline("ALL: punctuation + stopwords + lowercase", stop=True, punct=True, lower=True)
PIPELINES = (RAW, PLL, ALL)


def kept_tokens(tokens: Column, p: Pipeline) -> Column:
    out = tokens
    if p.control:
        out = F.filter(out, lambda t: ~X.has_control(t))
    if p.symbols or p.punct:
        out = F.filter(out, lambda t: ~X.symbols_only(t))
    if p.stop:
        out = F.filter(out, lambda t: ~F.lower(t).isin(*FUNCTION_WORDS))
    if p.lemma is not None:
        out = F.transform(out, p.lemma)
    return F.transform(out, lambda t: F.lower(t)) if p.lower else out


def _ratio(a, b) -> Column:
    return a / F.greatest(b, F.lit(1))


def per_text(df: DataFrame, text: str, group: str, pipelines=PIPELINES) -> DataFrame:
    """One row per text and pipeline: the kept tokens and the text's own measures. The text is tokenised once."""
    base = df.select(F.col(group).alias("genre"), F.col(text).alias("text")).where(F.col("text").isNotNull()).withColumn("toks", X.profile_tokens(F.col("text")))
    plain = F.filter("toks", lambda t: ~X.symbols_only(t))
    function_share = _ratio(F.size(F.filter(plain, lambda t: F.lower(t).isin(*FUNCTION_WORDS))), F.size(plain))
    base = base.withColumn("n_sents", F.greatest(F.size(X.sentences(F.col("text"))), F.lit(1))).withColumn("function_share", function_share)
    rows = F.array(*[F.struct(F.lit(p.label).alias("processing"), kept_tokens(F.col("toks"), p).alias("tokens")) for p in pipelines])
    exploded = base.select("genre", F.length("text").alias("n_chars"), "n_sents", "function_share", F.explode(rows).alias("p")).select("genre", "n_chars", "n_sents", "function_share", "p.processing", "p.tokens")
    n = F.size("tokens")
    hundred = F.slice("tokens", 1, 100)
    return exploded.select(
        "processing", "genre", "n_chars", "function_share", "tokens", n.alias("n_tokens"),
        _ratio(F.size(F.array_distinct("tokens")), n).alias("ttr"),
        _ratio(F.size(F.array_distinct(hundred)), F.size(hundred)).alias("ttr_100"),
        (n / F.col("n_sents")).alias("sent_len"),
    )


def descriptors(df: DataFrame, text: str = "text", group: str = "kind", pipelines=PIPELINES) -> DataFrame:
    """The descriptor table: per pipeline, each group and all texts together (genre 'ALL').

    Macro means and sample deviations are over texts; types, tokens and characters per token are pooled.
    """
    t = per_text(df, text, group, pipelines)
    r = lambda c: F.round(c, 6)
    level = F.when(F.grouping("genre") == 1, "ALL").otherwise(F.coalesce("genre", F.lit("(none)"))).alias("g")
    macro = t.rollup("processing", "genre").agg(
        F.grouping("processing").alias("top"), level, F.count("*").alias("n_texts"), r(F.avg("n_chars")).alias("avg_text_chars"), r(F.avg("n_tokens")).alias("avg_tokens_per_text"),
        F.sum("n_tokens").cast("bigint").alias("total_tokens"), r(F.avg("ttr")).alias("mean_ttr"), r(F.stddev_samp("ttr")).alias("sd_ttr"), r(F.avg("ttr_100")).alias("mean_ttr_first_100"),
        r(F.stddev_samp("ttr_100")).alias("sd_ttr_first_100"), r(F.avg("sent_len")).alias("avg_sent_len"), r(F.stddev_samp("sent_len")).alias("sd_sent_len"),
        r(F.avg("function_share") * 100).alias("function_word_pct"), r(F.stddev_samp("function_share") * 100).alias("sd_function_word_pct"),
    ).where("top = 0").drop("top", "genre")
    words = t.select("processing", "genre", F.explode("tokens").alias("token")).groupBy("processing", "genre", "token").agg(F.count("*").alias("n"))
    pooled = words.rollup("processing", "genre").agg(F.grouping("processing").alias("top"), level, F.count_distinct("token").alias("total_types"), r(F.sum(F.col("n") * F.length("token")) / F.sum("n")).alias("avg_chars_per_token")).where("top = 0").drop("top", "genre")
    return macro.join(pooled, ["processing", "g"], "left").withColumnRenamed("g", "genre").na.fill({"total_types": 0, "avg_chars_per_token": 0.0})


def top_tokens(df: DataFrame, text: str = "text", group: str = "kind", pipeline: Pipeline = ALL, n: int = 10) -> DataFrame:
    """(genre, rank, token, n): the most frequent tokens of each group; ties in alphabetical order."""
    t = per_text(df, text, group, (pipeline,)).select(F.coalesce("genre", F.lit("(none)")).alias("genre"), F.explode("tokens").alias("token"))
    counts = t.groupBy("genre", "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy("genre").orderBy(F.desc("n"), "token")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("genre", "rank", "token", "n")


def metric_long(summary: DataFrame, metrics) -> DataFrame:
    """(genre, dataset, metric, value): the plot form of a descriptor table."""
    return summary.select("genre", F.col("processing").alias("dataset"), *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["genre", "dataset"], list(metrics), "metric", "value")


def sentiment(df: DataFrame, lexicon: DataFrame, key: str, text: str = "text", group: str = "kind") -> DataFrame:
    """Lexicon sentiment of each text and of its sentences: compound s / sqrt(s * s + 15).

    lexicon: (token, weight). It is joined by token, so its size is free; a small one is broadcast by the planner.
    """
    sents = df.select(F.col(key).alias("key"), F.col(group).alias("genre"), F.posexplode(X.sentences(F.col(text))).alias("sent_no", "sent"))
    toks = sents.select("key", "genre", "sent_no", F.explode_outer(X.all_matches(F.lower("sent"), r"[\p{L}]+")).alias("token"))
    scored = toks.join(lexicon.select(F.col("token").alias("lex_token"), "weight"), F.col("token") == F.col("lex_token"), "left")
    per_sent = scored.groupBy("key", "genre", "sent_no").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s")).withColumn("score", F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15))
    per_doc = per_sent.groupBy("key", "genre").agg(F.sum("s").alias("total"), F.avg("score").alias("sent_mean"), F.avg(F.abs("score")).alias("sent_intensity_mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sent_std"), F.min("score").alias("sent_min"), F.max("score").alias("sent_max"))
    return per_doc.withColumn("compound", F.col("total") / F.sqrt(F.col("total") * F.col("total") + 15)).withColumn("intensity", F.abs("compound")).drop("total")


def entities(df: DataFrame, text: str = "text", group: str = "kind", annotator=None) -> DataFrame:
    """Entities per 1,000 words by group. annotator: Column of text -> array of entities; by default runs of
    capitalised words after the first word of a sentence."""
    found = annotator(F.col(text)) if annotator else X.all_matches(F.coalesce(F.col(text), F.lit("")), r"[a-z,] (\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)")
    t = df.where(F.col(text).isNotNull()).select(F.coalesce(group, F.lit("(none)")).alias("genre"), F.size(found).alias("n_ents"), F.size(F.filter(X.profile_tokens(F.col(text)), lambda x: ~X.symbols_only(x))).alias("n"))
    density = t.withColumn("ents_per_1000", F.when(F.col("n") > 0, F.col("n_ents") * 1000.0 / F.col("n")).otherwise(0.0))
    return density.groupBy("genre").agg(F.round(F.avg("ents_per_1000"), 6).alias("mean"), F.round(F.stddev_samp("ents_per_1000"), 6).alias("std"), F.count("*").alias("n_texts"))
