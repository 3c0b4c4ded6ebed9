"""Queries of the corpus profile."""

from __future__ import annotations

from lexigrid.functions import text as X
from lexigrid.operators import profile
from lexigrid.session import wide

#: A small lexicon for the query and the tests.
LEXICON = [("good", 1.9), ("happy", 2.7), ("fair", 1.3), ("kinder", 2.0), ("strong", 2.3), ("safe", 1.9), ("promised", 1.3), ("unfair", -2.1), ("confusing", -0.9), ("weak", -1.9), ("crash", -1.7), ("rare", -0.3), ("problem", -1.7), ("fehler", -1.5), ("slow", -1.0)]
METRICS = ("avg_tokens_per_text", "mean_ttr", "avg_sent_len", "function_word_pct")


def profile_descriptors(spark, sf):
    return profile.descriptors(wide(spark, sf, "documents"))


def profile_metric_long(spark, sf):
    return profile.metric_long(profile.descriptors(wide(spark, sf, "documents")), METRICS)


def profile_top_tokens(spark, sf):
    return profile.top_tokens(wide(spark, sf, "documents"))


def profile_sentiment(spark, sf):
    from pyspark.sql import functions as F

    lex = spark.createDataFrame(LEXICON, "token string, weight double")
    s = profile.sentiment(wide(spark, sf, "documents"), lex, "doc_id")
    return s.select(F.col("key").alias("doc_id"), "genre", *[F.round(c, 6).alias(c) for c in ("compound", "intensity", "sent_mean", "sent_intensity_mean", "sent_std", "sent_min", "sent_max")])


def profile_sentiment_groups(spark, sf):
    from pyspark.sql import functions as F

    return profile_sentiment(spark, sf).groupBy("genre").agg(F.round(F.avg("compound"), 4).alias("mean"), F.round(F.stddev_samp("compound"), 4).alias("std"), F.count("*").alias("n_texts"))


def profile_entities(spark, sf):
    return profile.entities(wide(spark, sf, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("profile_")}


def q(s: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + s.replace("'", "''") + "'"


STOP = ", ".join(q(w) for w in profile.FUNCTION_WORDS)
SENTS = f"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, {q(X.WS)}, ' ', 'g')), {q(X.SENTENCE_CUT)}, '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
BASE = f"""
base AS (
  SELECT doc_id, kind AS genre, text, regexp_extract_all(text, {q(X.PROFILE_TOKEN)}) AS toks, greatest(len({SENTS}), 1) AS n_sents
  FROM documents WHERE text IS NOT NULL),
kept AS (
  SELECT *, list_filter(toks, lambda t: NOT regexp_matches(t, {q(X.SYMBOLS_ONLY)})) AS plain FROM base),
pipes AS (
  SELECT 'RAW / minimal cleaning' AS processing, *, list_filter(plain, lambda t: NOT regexp_matches(t, {q(X.CONTROL)})) AS tokens FROM kept
  UNION ALL SELECT 'PLL: punctuation + lowercase', *, list_transform(list_filter(plain, lambda t: NOT regexp_matches(t, {q(X.CONTROL)})), lambda t: lower(t)) FROM kept
  UNION ALL SELECT 'ALL: punctuation + stopwords + lowercase', *, list_transform(list_filter(plain, lambda t: NOT regexp_matches(t, {q(X.CONTROL)}) AND lower(t) NOT IN ({STOP})), lambda t: lower(t)) FROM kept)
"""
DESCRIPTORS = f"""
WITH {BASE},
m AS (
  SELECT processing, genre, length(text) AS n_chars, len(tokens) AS n, len(list_distinct(tokens)) * 1.0 / greatest(len(tokens), 1) AS ttr,
    len(list_distinct(tokens[1:100])) * 1.0 / greatest(len(tokens[1:100]), 1) AS ttr_100, len(tokens) * 1.0 / n_sents AS sent_len,
    len(list_filter(plain, lambda t: lower(t) IN ({STOP}))) * 1.0 / greatest(len(plain), 1) AS fw
  FROM pipes),
macro AS (
  SELECT processing, CASE WHEN grouping(genre) = 1 THEN 'ALL' ELSE genre END AS genre, count(*) AS n_texts, round(avg(n_chars), 6) AS avg_text_chars, round(avg(n), 6) AS avg_tokens_per_text,
    CAST(sum(n) AS BIGINT) AS total_tokens, round(avg(ttr), 6) AS mean_ttr, round(stddev_samp(ttr), 6) AS sd_ttr, round(avg(ttr_100), 6) AS mean_ttr_first_100, round(stddev_samp(ttr_100), 6) AS sd_ttr_first_100,
    round(avg(sent_len), 6) AS avg_sent_len, round(stddev_samp(sent_len), 6) AS sd_sent_len, round(avg(fw) * 100, 6) AS function_word_pct, round(stddev_samp(fw) * 100, 6) AS sd_function_word_pct
  FROM m GROUP BY GROUPING SETS ((processing, genre), (processing))),
toks2 AS (SELECT processing, genre, unnest(tokens) AS token FROM pipes),
pooled AS (
  SELECT processing, CASE WHEN grouping(genre) = 1 THEN 'ALL' ELSE genre END AS genre, count(DISTINCT token) AS total_types, round(sum(length(token)) * 1.0 / count(*), 6) AS avg_chars_per_token
  FROM toks2 GROUP BY GROUPING SETS ((processing, genre), (processing)))
SELECT macro.*, coalesce(total_types, 0) AS total_types, coalesce(avg_chars_per_token, 0) AS avg_chars_per_token FROM macro LEFT JOIN pooled USING (processing, genre)
"""
LEX = ", ".join(f"({q(t)}, CAST({w} AS DOUBLE))" for t, w in LEXICON)
SENTIMENT = f"""
WITH lex(token, weight) AS (VALUES {LEX}),
s0 AS (SELECT doc_id, kind AS genre, {SENTS} AS sents FROM documents WHERE text IS NOT NULL),
s1 AS (SELECT doc_id, genre, i AS sent_no, sents[i + 1] AS sent FROM s0, range(len(sents)) r(i)),
s2 AS (SELECT doc_id, genre, sent_no, sent, unnest(regexp_extract_all(lower(sent), '[\\p{{L}}]+')) AS token FROM s1),
s3 AS (SELECT doc_id, genre, sent_no, sum(weight) AS s FROM s2 JOIN lex USING (token) GROUP BY ALL),
s4 AS (SELECT s1.doc_id, s1.genre, s1.sent_no, coalesce(s, 0) AS s, coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) AS score FROM s1 LEFT JOIN s3 USING (doc_id, sent_no)),
d AS (SELECT doc_id, genre, sum(s) / sqrt(sum(s) * sum(s) + 15) AS compound, avg(score) AS sent_mean, avg(abs(score)) AS sent_intensity_mean, coalesce(stddev_samp(score), 0) AS sent_std, min(score) AS sent_min, max(score) AS sent_max FROM s4 GROUP BY doc_id, genre)
SELECT doc_id, genre, round(compound, 6) AS compound, round(abs(compound), 6) AS intensity, round(sent_mean, 6) AS sent_mean, round(sent_intensity_mean, 6) AS sent_intensity_mean, round(sent_std, 6) AS sent_std, round(sent_min, 6) AS sent_min, round(sent_max, 6) AS sent_max FROM d
"""


def oracle_sql() -> dict[str, str]:
    values = ", ".join(f"('{m}')" for m in METRICS)
    case = " ".join(f"WHEN '{m}' THEN {m}" for m in METRICS)
    return {
        "profile_descriptors": DESCRIPTORS,
        "profile_metric_long": f"SELECT genre, processing AS dataset, metric, CAST(CASE metric {case} END AS DOUBLE) AS value FROM ({DESCRIPTORS}) d, (VALUES {values}) m(metric)",
        "profile_top_tokens": f"""
            WITH {BASE}, t AS (SELECT genre, unnest(tokens) AS token FROM pipes WHERE processing LIKE 'ALL%'),
            c AS (SELECT genre, token, count(*) AS n FROM t GROUP BY genre, token)
            SELECT genre, CAST(rank AS INTEGER) AS rank, token, n FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY n DESC, token) AS rank FROM c) x WHERE rank <= 10""",
        "profile_sentiment": SENTIMENT,
        "profile_sentiment_groups": f"SELECT genre, round(avg(compound), 4) AS mean, round(stddev_samp(compound), 4) AS std, count(*) AS n_texts FROM ({SENTIMENT}) s GROUP BY genre",
        "profile_entities": f"""
            SELECT genre, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, count(*) AS n_texts FROM (
              SELECT genre, CASE WHEN n > 0 THEN e * 1000.0 / n ELSE 0 END AS d FROM (
                SELECT kind AS genre, len(regexp_extract_all(text, '[a-z,] (\\p{{Lu}}\\p{{Ll}}+(?: \\p{{Lu}}\\p{{Ll}}+)*)')) AS e,
                  len(list_filter(regexp_extract_all(text, {q(X.PROFILE_TOKEN)}), lambda t: NOT regexp_matches(t, {q(X.SYMBOLS_ONLY)}))) AS n
                FROM documents WHERE text IS NOT NULL) a) b GROUP BY genre""",
    }
