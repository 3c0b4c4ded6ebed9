"""Bags of words, topic models, classification and topic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from lexigrid.operators.profile import FUNCTION_WORDS

WORDS = r"[\p{L}\p{N}_]{2,}"


def bag_tokens(text):
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0)), lambda w: ~w.isin(*FUNCTION_WORDS))


def vocabulary(df: DataFrame, key: str, text: str, min_df: int = 5, max_df: float = 0.95, max_features: int = 1000) -> DataFrame:
    """(word, n_docs, n): the max_features most frequent words in at least min_df texts and max_df of all."""
    docs = df.select(F.col(key).alias("k"), bag_tokens(F.col(text)).alias("ws"))
    n = docs.agg(F.count("*").alias("n_all"))
    each = docs.select("k", F.explode("ws").alias("word")).groupBy("k", "word").agg(F.count("*").alias("c"))
    words = each.groupBy("word").agg(F.count("*").alias("n_docs"), F.sum("c").alias("n"))
    kept = words.join(F.broadcast(n), how="cross").where((F.col("n_docs") >= min_df) & (F.col("n_docs") <= F.col("n_all") * max_df))  # one row
    return kept.orderBy(F.desc("n"), "word").limit(max_features).select("word", "n_docs", "n")


def lda(df: DataFrame, text: str, k: int = 10, features: int = 1000, min_df: int = 5, max_df: float = 0.95, seed: int = 42, max_iter: int = 10):
    """A fitted bag-of-words and LDA pipeline; every iteration reads every document (the online optimizer draws a sample)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer, SQLTransformer

    stop = ", ".join("'" + w + "'" for w in FUNCTION_WORDS)
    toks = SQLTransformer(statement=f"SELECT *, filter(regexp_extract_all(lower(coalesce({text}, '')), r'{WORDS}', 0), w -> w NOT IN ({stop})) AS tokens FROM __THIS__")
    return Pipeline(stages=[toks, CountVectorizer(inputCol="tokens", outputCol="features", minDF=min_df, maxDF=max_df, vocabSize=features), LDA(k=k, optimizer="em", seed=seed, maxIter=max_iter, featuresCol="features")]).fit(df)


def topic_words(model, n: int = 10) -> DataFrame:
    """(topic, rank, word, weight) of a fitted pipeline."""
    vocab = model.stages[1].vocabulary
    t = model.stages[2].describeTopics(n)
    v = F.array(*[F.lit(w) for w in vocab])
    z = t.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "x"))
    return z.select("topic", (F.col("rank") + 1).alias("rank"), F.get(v, F.col("x.termIndices")).alias("word"), F.col("x.termWeights").alias("weight"))


def forest(df: DataFrame, text: str, label: str, k: int = 8, trees: int = 20, folds: int = 0, grid: dict | None = None, seed: int = 42):
    """Bag of words, LDA topics and a random forest; with folds, the best of the grid by cross-validation."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.clustering import LDA
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import CountVectorizer, SQLTransformer, StringIndexer
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    stop = ", ".join("'" + w + "'" for w in FUNCTION_WORDS)
    toks = SQLTransformer(statement=f"SELECT *, filter(regexp_extract_all(lower(coalesce({text}, '')), r'{WORDS}', 0), w -> w NOT IN ({stop})) AS tokens FROM __THIS__")
    cv = CountVectorizer(inputCol="tokens", outputCol="features", minDF=5, maxDF=0.95, vocabSize=1000)
    topics = LDA(k=k, optimizer="em", seed=seed, maxIter=10, featuresCol="features", topicDistributionCol="topics")
    rf = RandomForestClassifier(featuresCol="topics", labelCol="label_index", numTrees=trees, maxDepth=10, seed=seed)
    pipe = Pipeline(stages=[toks, cv, topics, StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep"), rf])
    if not folds:
        return pipe.fit(df)
    params = ParamGridBuilder()
    for name, values in (grid or {}).items():
        stage, param = name.split(".")
        params = params.addGrid(getattr({"cv": cv, "lda": topics, "rf": rf}[stage], param), values)
    return CrossValidator(estimator=pipe, estimatorParamMaps=params.build(), evaluator=MulticlassClassificationEvaluator(labelCol="label_index", metricName="accuracy"), numFolds=folds, seed=seed, parallelism=2).fit(df).bestModel


def nmf(weights: DataFrame, k: int = 8, seed: int = 42, max_iter: int = 10):
    """Non-negative factors of a sparse (doc INT, term INT, weight) table."""
    from pyspark.ml.recommendation import ALS

    return ALS(rank=k, maxIter=max_iter, nonnegative=True, userCol="doc", itemCol="term", ratingCol="weight", seed=seed, coldStartStrategy="drop").fit(weights)


def long_scores(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """(key, more..., topic, score): one row per component of a topic vector."""
    return df.select(key, *more, F.posexplode(vector).alias("topic", "score")).withColumn("score", F.col("score").cast("double"))


def label_means(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    return long_scores(df, key, vector, label).groupBy(label, "topic").agg(F.round(F.avg("score"), 6).alias("mean_score"))


def dominant(df: DataFrame, vector: str) -> DataFrame:
    """df with the first largest component and its score."""
    return df.withColumn("dominant_topic", (F.array_position(vector, F.array_max(vector)) - 1).cast("int")).withColumn("dominant_score", F.array_max(vector).cast("double"))


def document_table(df: DataFrame, vector: str, k: int, text: str, keep: list, snippet: int = 350) -> DataFrame:
    """The kept columns, one column for each of k topics, the dominant topic with its score and the text's start."""
    d = dominant(df, vector)
    cols = [F.get(vector, F.lit(i)).cast("double").alias(f"topic_{i:02d}") for i in range(k)]
    return d.select(*keep, *cols, "dominant_topic", "dominant_score", F.substring(text, 1, snippet).alias("snippet"))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts of row by the given values of col, zeros filled."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(f"{col}_{v}") for v in values])


def contrast(df: DataFrame, key: str, vector: str, label: str, a, b) -> DataFrame:
    """Mean topic score under two labels, their difference and its size."""
    m = long_scores(df.where(F.col(label).isin(a, b)), key, vector, label).groupBy("topic").agg(F.avg(F.when(F.col(label) == a, F.col("score"))).alias("a"), F.avg(F.when(F.col(label) == b, F.col("score"))).alias("b"))
    r = lambda c: F.round(c, 6)
    return m.select("topic", r(F.col("a")).alias("mean_a"), r(F.col("b")).alias("mean_b"), r(F.col("b") - F.col("a")).alias("difference"), r(F.abs(F.col("b") - F.col("a"))).alias("abs_difference"))


def representatives(df: DataFrame, key: str, vector: str, label: str, n: int = 3) -> DataFrame:
    """The n highest texts of each topic, overall and within each label. Window-group limits cut early."""
    long = long_scores(df, key, vector, label)
    one = lambda subset, *by: long.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key))).where(F.col("rank") <= n).withColumn("subset", F.lit(subset))
    return one("overall", "topic").unionByName(one("within_label", "topic", label)).select("topic", "subset", "rank", label, key, F.round("score", 6).alias("score"))


def roc(scored: DataFrame, buckets: int = 1024) -> DataFrame:
    """(threshold, tpr, fpr) at each score: positives and negatives at or above it; scored: (score in 0..1, y 0/1).

    The running sums are taken over score ranges first and inside a range second.
    """
    c = scored.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn("b", F.floor(F.col("score") * buckets))
    per = c.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    up = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # at most buckets + 1 rows
    z = lambda x: F.coalesce(x, F.lit(0))
    every = Window.partitionBy()
    per = per.select("b", z(F.sum("bp").over(up)).alias("ap"), z(F.sum("bn").over(up)).alias("an"), F.sum("bp").over(every).alias("tp_all"), F.sum("bn").over(every).alias("fp_all"))
    inside = Window.partitionBy("b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    j = c.join(per, "b")
    return j.select(F.col("score").alias("threshold"), F.round(F.try_divide((F.col("ap") + F.sum("pos").over(inside)).cast("double"), F.col("tp_all")), 9).alias("tpr"), F.round(F.try_divide((F.col("an") + F.sum("neg").over(inside)).cast("double"), F.col("fp_all")), 9).alias("fpr"))


def save_pipeline(model, path: str, overwrite: bool = False) -> None:
    """A fitted pipeline on disk; an existing one is an error unless overwritten."""
    (model.write().overwrite() if overwrite else model.write()).save(path)


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
