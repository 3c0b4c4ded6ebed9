"""Word-weighted shares, descriptive tables, validation measures and inspection of annotated items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lexigrid.functions import text as X
from lexigrid.operators import annotate as A


def merged(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items with the label of their last ok annotation, and the words of their target."""
    return items.join(A.latest_ok(log).drop("append_seq"), "item_id").withColumn("words", X.word_count(F.col("target_text")))


def label_shares(m: DataFrame, dim: DataFrame) -> DataFrame:
    """Per game every label, zeros included: items, words, share of the game's words."""
    got = m.groupBy("game", "primary_label").agg(F.count("*").alias("n_items"), F.sum("words").alias("label_words"))
    names = [r.primary_label for r in dim.select("primary_label").collect()]  # the codebook's few labels
    games = m.select("game").distinct().select("game", F.explode(F.array(*[F.lit(x) for x in names])).alias("primary_label"))
    full = games.join(got, ["game", "primary_label"], "left").join(dim, "primary_label")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    full = full.select("game", "primary_label", "label_name", "label_order", n("n_items").alias("n_items"), n("label_words").alias("label_words"))
    w = Window.partitionBy("game")
    return full.withColumn("total_words", F.sum("label_words").over(w)).withColumn("total_items", F.sum("n_items").over(w)).withColumn("word_share", F.round(F.coalesce(F.try_divide("label_words", "total_words"), F.lit(0.0)), 6)).withColumn("item_share", F.round(F.coalesce(F.try_divide("n_items", "total_items"), F.lit(0.0)), 6))


def metric_shares(m: DataFrame, by: list) -> DataFrame:
    """Words and word share of each metric, per group of `by`."""
    cols = [F.count("*").alias("n_items"), F.sum("words").cast("bigint").alias("annotated_words")]
    for name, labels in A.METRICS:
        w = F.sum(F.when(F.col("primary_label").isin(*labels), F.col("words")).otherwise(0)).cast("bigint")
        cols += [w.alias(f"words_{name}"), F.round(F.coalesce(F.try_divide(w.cast("double"), F.sum("words")), F.lit(0.0)), 6).alias(f"share_{name}")]
    return m.groupBy(*by).agg(*cols)


def summary(c, name: str) -> list[Column]:
    """Mean, median, quartiles, extremes and sample deviation (0 for one value) of a column."""
    r = lambda x: F.round(x, 6)
    d = F.col(c).cast("double")
    return [r(F.avg(d)).alias(f"{name}_mean"), r(F.median(d)).alias(f"{name}_median"), F.min(d).alias(f"{name}_min"), r(F.percentile(d, F.lit(0.25))).alias(f"{name}_q25"), r(F.percentile(d, F.lit(0.75))).alias(f"{name}_q75"), F.max(d).alias(f"{name}_max"), r(F.coalesce(F.stddev_samp(d), F.lit(0.0))).alias(f"{name}_std")]


def year_range(c: str) -> Column:
    return F.when(F.min(c).isNull(), "").when(F.min(c) == F.max(c), F.min(c).cast("string")).otherwise(F.concat_ws("–", F.min(c).cast("string"), F.max(c).cast("string")))


def lexical(df: DataFrame, by, text: str) -> DataFrame:
    """Tokens, types and their ratio per group, over lower-cased words pooled."""
    by = [by] if isinstance(by, str) else by
    t = df.select(*by, F.explode(X.words(F.coalesce(text, F.lit("")))).alias("w")).groupBy(*by, F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    return t.groupBy(*by).agg(F.sum("n").cast("bigint").alias("tokens"), F.count("*").alias("types")).withColumn("ttr", F.round(F.col("types") / F.col("tokens"), 6))


def describe_corpus(corpus: DataFrame) -> DataFrame:
    d = corpus.groupBy("game").agg(F.count("*").alias("n_rows"), F.count_distinct("document_id").alias("n_documents"), year_range("year").alias("years"), F.sum("word_count").cast("bigint").alias("n_words"), *summary("word_count", "words"), *summary("line_count", "lines"))
    return d.join(lexical(corpus, "game", "clean_text"), "game", "left")


def describe_targets(items: DataFrame) -> DataFrame:
    """Targets by document: counts, shares of types and first attributes."""
    t = items.withColumn("words", X.word_count(F.col("target_text")))
    stat = F.col("target_type") == "stat_or_list_line"
    return t.groupBy("game", "document_id").agg(
        F.count("*").alias("n_items"), F.sum("words").cast("bigint").alias("n_words"), F.count_if(stat).alias("n_stat"), F.round(F.avg(stat.cast("double")), 6).alias("share_stat"),
        F.min_by("title", "item_order").alias("title"), *summary("words", "item_words"),
    )


def describe_targets_by(items: DataFrame, *by: str) -> DataFrame:
    """Targets per group: documents, targets and words in all and by type with their shares, summaries of the words of all,
    prose and list targets, and the words' variety over the pooled texts."""
    prose, stat = F.col("target_type") == "prose_sentence", F.col("target_type") == "stat_or_list_line"
    words = F.coalesce(F.col("target_word_count"), F.lit(0))
    t = items.withColumn("w", words).withColumn("pw", F.when(prose, words)).withColumn("sw", F.when(stat, words))
    share = lambda k: F.round(F.avg(k.cast("double")), 6)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    d = t.groupBy(*by).agg(
        F.count_distinct("document_id").alias("n_documents"), F.count("*").alias("n_targets"), F.count_if(prose).alias("n_prose"), F.count_if(stat).alias("n_stat"), total("w").alias("n_words"), total("pw").alias("n_prose_words"), total("sw").alias("n_stat_words"),
        share(prose).alias("prose_share"), share(stat).alias("stat_share"), *summary("w", "words"), *summary("pw", "prose_words"), *summary("sw", "stat_words"),
    )
    return d.join(lexical(items, list(by), "target_text"), list(by), "left")


def describe_units(units: DataFrame) -> DataFrame:
    """Context units per game: all, targets and context only with their words, shares, summary and variety of words."""
    on = F.col("included")
    share = lambda k: F.round(F.avg(k.cast("double")), 6)
    d = units.groupBy("game").agg(
        F.count("*").alias("n_units"), F.count_if(on).alias("n_targets"), F.count_if(~on).alias("n_context"), F.sum("word_count").cast("bigint").alias("n_words"), F.coalesce(F.sum(F.when(on, F.col("word_count"))), F.lit(0)).cast("bigint").alias("n_target_words"),
        F.coalesce(F.sum(F.when(~on, F.col("word_count"))), F.lit(0)).cast("bigint").alias("n_context_words"), share(on).alias("target_share"), share(~on).alias("context_share"), *summary("word_count", "words"),
    )
    return d.join(lexical(units, ["game"], "text"), "game", "left")


def describe_unit_types(units: DataFrame) -> DataFrame:
    """Context units per game, type and whether they are targets."""
    return units.groupBy("game", "unit_type", "included").agg(F.count("*").alias("n_units"), F.sum("word_count").cast("bigint").alias("n_words"), *summary("word_count", "words"))


def describe_labels(m: DataFrame, dim: DataFrame) -> DataFrame:
    s = label_shares(m, dim)
    words = m.groupBy("game", "primary_label").agg(F.round(F.avg("words"), 6).alias("mean_words"), F.median("words").cast("double").alias("median_words"))
    return s.join(words, ["game", "primary_label"], "left")


def describe_metrics(m: DataFrame, mdim: DataFrame) -> DataFrame:
    """Per game and metric: items, words and their shares (a small dimension is joined by label)."""
    j = m.join(mdim, "primary_label")
    g = j.groupBy("game", "metric").agg(F.count("*").alias("n_items"), F.sum("words").cast("bigint").alias("n_words"), F.round(F.avg("words"), 6).alias("mean_words"))
    w = Window.partitionBy("game")
    return g.withColumn("item_share", F.round(F.col("n_items") / F.sum("n_items").over(w), 6)).withColumn("word_share", F.round(F.try_divide(F.col("n_words").cast("double"), F.sum("n_words").over(w)), 6))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def label_scores(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every label seen on either side (0 where undefined)."""
    long = conf.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")))).alias("x")).select("x.*")
    g = long.groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    z = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    g = g.withColumn("precision", z(F.col("hit"), F.col("said"))).withColumn("recall", z(F.col("hit"), F.col("support")))
    return g.withColumn("f1", z(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support", "hit")


def accuracy(scores: DataFrame, n_manual: Column) -> DataFrame:
    n = F.sum("support")
    r = lambda c: F.round(c, 6)
    return scores.agg(n.alias("n_evaluated"), r(F.sum("hit") / n).alias("accuracy"), r(F.avg("f1")).alias("macro_f1"), r(F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1")).withColumn("n_manual", n_manual.cast("bigint")).withColumn("coverage", r(F.col("n_evaluated") / F.col("n_manual")))


SEARCHED = ("item_id", "title", "target_text", "context_before", "context_after")


def search(items: DataFrame, terms: list, game: str | None = None, patch: str | None = None) -> DataFrame:
    """Items that hold one of the terms in one of five columns (as written, case ignored)."""
    hit = F.lit(False)
    for t in terms:
        for c in SEARCHED:
            hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t.lower()))
    out = items.where(hit)
    if game:
        out = out.where(F.lower("game") == game.lower())
    if patch:
        out = out.where(F.contains(F.lower("patch_id"), F.lit(patch.lower())))
    return out


def neighbours(items: DataFrame, matches: DataFrame, window: int = 2) -> DataFrame:
    """(item_id, match_id, distance): up to `window` items on either side of each match in its document.

    The places around a match are spelled out, so the join is an equality on document and place; an item near
    several matches belongs to the first of them.
    """
    place = Window.partitionBy("document_id").orderBy("item_order", "item_id")
    placed = items.select("document_id", "item_id", "item_order").withColumn("rn", F.row_number().over(place))
    m = placed.join(matches.select("item_id"), "item_id", "left_semi").select("document_id", F.col("item_id").alias("match_id"), F.col("rn").alias("match_rn"))
    wanted = m.select("document_id", "match_id", "match_rn", F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("distance")).withColumn("rn", F.col("match_rn") + F.col("distance"))
    j = wanted.join(placed, ["document_id", "rn"])
    own = j.groupBy("item_id").agg(F.min_by(F.struct("match_id", "distance"), F.struct("match_rn", "match_id")).alias("x"))
    return own.select("item_id", "x.match_id", "x.distance")


def confusion_matrix(pairs: DataFrame, labels: list[str], manual: str = "manual", model: str = "primary_label") -> DataFrame:
    """(manual, one column per label in label order): the dense matrix, labels that nothing has as zeros."""
    rows = pairs.sparkSession.createDataFrame([(k, i) for i, k in enumerate(labels)], "__label string, label_order int")
    counted = pairs.groupBy(F.col(manual).alias("__label")).agg(*[F.count_if(F.col(model) == k).alias(k) for k in labels])
    return F.broadcast(rows).join(counted, "__label", "left").select(F.col("__label").alias("manual"), "label_order", *[F.coalesce(k, F.lit(0).cast("bigint")).alias(k) for k in labels])


def with_annotations(items: DataFrame, latest: DataFrame) -> DataFrame:
    """Items with their annotation, also those without one."""
    return items.join(latest.select("item_id", "primary_label", "confidence"), "item_id", "left")


def inspection_text(df: DataFrame) -> DataFrame:
    """(item_id, markdown): each item with its context, label and target as a section of a report."""
    some = lambda c, other: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(other))
    head = F.concat(F.lit("## "), "item_id", F.lit("\n\n- game: "), some("game", ""), F.lit("\n- patch: "), some("patch_id", ""), F.lit("\n- label: "), some("primary_label", "(none)"))
    part = lambda name, c: F.concat(F.lit(f"\n\n### {name}\n\n"), some(c, "(empty)"))
    return df.select("item_id", F.concat(head, part("Context before", "context_before"), part("Target", "target_text"), part("Context after", "context_after"), F.lit("\n")).alias("markdown"))
