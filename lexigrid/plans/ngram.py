"""Queries of the n-gram language model."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions import text as X
from lexigrid.operators import ngram as N
from lexigrid.plans.profile import q
from lexigrid.session import cut, table

ORDER = 3
GRID = {"region": ["Demra", ""], "seed": ["the", "i am", "one"], "top_k": [4, 8], "temperature": [0.5, 1.0, 2.0], "backoff": [True, False], "sentence_mode": False}
DIMENSIONS = ("champion_name", "skin_name", "champion_skin", "skinline_name", "effective_region", "skin_universe")


def recs(spark, sf):
    return N.records(table(spark, sf, "voicelines"))


def counts(spark, sf):
    return N.continuous_counts(recs(spark, sf), ORDER, "effective_region")


def asked(spark, sf):
    """The five most frequent two-word histories of each region: the requests of the queries below."""
    c = counts(spark, sf).where(F.col("ord") == ORDER).groupBy("cond", "history").agg(F.sum("cnt").alias("n"))
    w = Window.partitionBy("cond").orderBy(F.desc("n"), "history")
    best = c.withColumn("r", F.row_number().over(w)).where("r <= 5")
    return best.select(F.concat_ws("|", "cond", "history").alias("req"), "cond", "history")


def lm_records(spark, sf):
    return recs(spark, sf).withColumn("tokens", F.array_join("tokens", " "))


def lm_distinct_values(spark, sf):
    """Distinct values by dimension, with and without the empty value, and the vocabulary."""
    r = recs(spark, sf)
    long = r.unpivot(["record_id"], list(DIMENSIONS), "dimension", "value").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    dims = long.groupBy("dimension").agg(F.count("*").alias("n_values"), F.count_if(F.col("value") != "").alias("n_named"))
    vocab = r.select(F.explode("tokens").alias("t")).distinct().agg(F.count("*").alias("n_values")).select(F.lit("vocabulary").alias("dimension"), "n_values", F.col("n_values").alias("n_named"))
    return dims.unionByName(vocab)


def lm_select(spark, sf):
    """Quotes of one region, deduplicated by wording, the first kept."""
    r = recs(spark, sf)
    top = r.where("effective_region <> ''").groupBy("effective_region").count().orderBy(F.desc("count"), "effective_region").limit(1).collect()
    region = top[0][0] if top else "none"
    return N.select(r, region=region).select("record_id", "champion_name", "quote")


def lm_ngrams_continuous(spark, sf):
    return counts(spark, sf)


def lm_ngrams_sentence(spark, sf):
    return N.sentence_counts(recs(spark, sf), ORDER, "effective_region")


def lm_mle(spark, sf):
    m = N.mle(counts(spark, sf))
    return m.select("cond", "ord", "history", "token", "cnt", F.round("p", 9).alias("p"))


def _dist(spark, sf, backoff):
    return N.distributions(asked(spark, sf), N.mle(counts(spark, sf)), ORDER, backoff)


def lm_backoff_interpolate(spark, sf):
    return _dist(spark, sf, "interpolate").select("req", "token", F.round("p", 9).alias("p"))


def lm_backoff_fallback(spark, sf):
    return _dist(spark, sf, "fallback").select("req", "token", F.round("p", 9).alias("p"))


def lm_topk_temperature(spark, sf):
    d = N.temperature(N.top_k(_dist(spark, sf, "interpolate"), 8), 0.5)
    return d.select("req", "token", F.round("p", 9).alias("p"))


def lm_perplexity(spark, sf):
    return N.perplexity(N.mle(counts(spark, sf)), ORDER)


def lm_greedy(spark, sf):
    """Greedy continuation of each region's most frequent history, by a recursive query over the arg-max table."""
    c = counts(spark, sf).where(F.col("ord") == ORDER)
    best = cut(c.groupBy("cond", "history").agg(F.min_by("token", F.struct(-F.col("cnt"), F.col("token"))).alias("token"), F.sum("cnt").alias("n")))
    view = f"lm_best_{uuid.uuid4().hex}"  # a name of its own, so that callers don't overwrite each other's
    best.createOrReplaceTempView(view)
    return spark.sql(
        f"""
        WITH RECURSIVE start AS (SELECT cond, min_by(history, struct(-n, history)) AS history FROM {view} GROUP BY cond),
        walk(cond, step, history, token) AS (
          SELECT cond, 0, history, CAST(NULL AS STRING) FROM start
          UNION ALL
          SELECT w.cond, w.step + 1, concat(substring_index(w.history, ' ', -1), ' ', b.token), b.token
          FROM walk w JOIN {view} b ON w.cond = b.cond AND w.history = b.history WHERE w.step < 20)
        SELECT cond, step, token FROM walk WHERE step > 0
        """
    )


def lm_batch_grid(spark, sf):
    g = N.grid(spark, **GRID)
    return g.withColumn("summary", F.when(F.col("region") != "", F.concat(F.lit("region="), "region")).otherwise("global"))


def lm_generate(spark, sf):
    """Sampled texts: three seeds in each region, twelve words, top 8, interpolated back-off."""
    r = recs(spark, sf)
    conds = r.select(F.col("effective_region").alias("cond")).distinct()
    req = conds.withColumn("seed", F.explode(F.array(F.lit("the"), F.lit("I was"), F.lit("")))).withColumn("random_seed", F.lit(7))
    req = req.withColumn("req", F.concat_ws("|", "cond", "seed"))
    return N.generate(req, cut(N.mle(counts(spark, sf))), ORDER, 12).select("req", "text", F.round("perplexity", 6).alias("perplexity"))


def lm_generated_metrics(spark, sf):
    g = table(spark, sf, "generated_texts").dropDuplicates().withColumn("m", N.text_metrics(F.col("text")))
    return g.groupBy("model_name", "temperature").agg(F.count("*").alias("n_texts"), F.round(F.avg("m.unique_token_ratio"), 6).alias("unique_token_ratio"), F.round(F.avg("m.punctuation_ratio"), 6).alias("punctuation_ratio"), F.round(F.avg("m.sentence_end_count"), 6).alias("sentence_ends"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("lm_")}


def strip(c: str) -> str:
    return f"regexp_replace({c}, {q(X.ENDS)}, '', 'g')"


def meta(c: str) -> str:
    value = strip(f"coalesce({c}, '')")
    return f"CASE WHEN lower({value}) IN ('', 'nan', 'none', 'null') THEN '' ELSE {value} END"


def cm(c: str) -> str:
    return strip(f"regexp_replace({meta(c)}, '^\\|-\\|\\s*', '')")


def first(*cs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({meta(c)}, '')" for c in cs) + ", '')"


PLAIN = "('classic', 'original', 'human form')"
RECORDS = f"""
v0 AS (SELECT record_id, quote, {", ".join(f"{cm(c)} AS {c}" for c in ("champion_name", "resolved_skin_name", "voiceover_set", "resolved_skinline_name", "champion_region", "runeterra_region", "skin_region", "skin_universe", "region_notes"))} FROM voicelines),
v1 AS (SELECT record_id, {meta("quote")} AS quote, champion_name, {first("resolved_skin_name", "voiceover_set")} AS skin0, CASE WHEN lower(resolved_skinline_name) IN {PLAIN} THEN '' ELSE resolved_skinline_name END AS line,
  {first("champion_region", "runeterra_region")} AS champion_region, skin_region, {first("skin_universe", "region_notes")} AS skin_universe FROM v0),
v2 AS (SELECT *, CASE WHEN lower(skin0) IN {PLAIN} THEN '' ELSE skin0 END AS skin_name, regexp_extract_all(lower(quote), {q(X.LM_TOKEN)}) AS tokens FROM v1),
recs AS (SELECT record_id, quote, champion_name, skin_name, CASE WHEN champion_name <> '' THEN champion_name ELSE 'unknown' END || '::' || CASE WHEN skin_name <> '' THEN skin_name ELSE 'unknown' END AS champion_skin,
  CASE WHEN line <> '' THEN line WHEN contains(skin_name, ':') THEN trim(string_split(skin_name, ':')[1]) ELSE skin_name END AS skinline_name,
  champion_region, skin_region, {first("skin_region", "champion_region")} AS effective_region, skin_universe, tokens FROM v2 WHERE quote <> '' AND len(tokens) > 0)
"""
COUNTS = f"""
{RECORDS},
tk AS (SELECT effective_region AS cond, record_id, i AS pos, tokens[i + 1] AS t0 FROM recs, range(len(tokens)) r(i)),
ld AS (SELECT cond, t0, lead(t0, 1) OVER w AS t1, lead(t0, 2) OVER w AS t2 FROM tk WINDOW w AS (PARTITION BY cond ORDER BY record_id, pos)),
counts AS (
  SELECT cond, 1 AS ord, '' AS history, t0 AS token, count(*) AS cnt FROM ld GROUP BY ALL
  UNION ALL SELECT cond, 2, t0, t1, count(*) FROM ld WHERE t1 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT cond, 3, t0 || ' ' || t1, t2, count(*) FROM ld WHERE t2 IS NOT NULL GROUP BY ALL),
mle AS (SELECT *, cnt * 1.0 / sum(cnt) OVER (PARTITION BY cond, ord, history) AS p FROM counts)
"""
ASKED = f"""
{COUNTS},
hist AS (SELECT cond, history, sum(cnt) AS n FROM counts WHERE ord = 3 GROUP BY cond, history),
asked AS (SELECT cond || '|' || history AS req, cond, history FROM (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY n DESC, history) AS r FROM hist) h WHERE r <= 5),
sub AS (SELECT req, cond, 3 AS ord, history FROM asked UNION ALL SELECT req, cond, 2, string_split(history, ' ')[2] FROM asked UNION ALL SELECT req, cond, 1, '' FROM asked),
hits AS (SELECT req, ord, token, p FROM sub JOIN mle USING (cond, ord, history)),
inter0 AS (SELECT req, token, sum(p * pow(0.4, 3 - ord)) AS s FROM hits GROUP BY req, token),
inter AS (SELECT req, token, s / sum(s) OVER (PARTITION BY req) AS p FROM inter0)
"""


def oracle_sql() -> dict[str, str]:
    dims = " UNION ALL ".join(f"SELECT '{d}' AS dimension, count(DISTINCT {d}) AS n_values, count(DISTINCT nullif({d}, '')) AS n_named FROM recs" for d in DIMENSIONS)
    values = ", ".join
    grid = f"""
        SELECT region, seed, CAST(top_k AS INTEGER) AS top_k, CAST(temperature AS DOUBLE) AS temperature, backoff, false AS sentence_mode, CASE WHEN region <> '' THEN 'region=' || region ELSE 'global' END AS summary
        FROM (VALUES {values(f"({q(x)})" for x in GRID['region'])}) a(region), (VALUES {values(f"({q(x)})" for x in GRID['seed'])}) b(seed), (VALUES {values(f"({x})" for x in GRID['top_k'])}) c(top_k),
          (VALUES {values(f"({x})" for x in GRID['temperature'])}) d(temperature), (VALUES (true), (false)) e(backoff)"""
    return {
        "lm_records": f"WITH {RECORDS} SELECT * EXCLUDE (tokens), array_to_string(tokens, ' ') AS tokens FROM recs",
        "lm_distinct_values": f"WITH {RECORDS} {dims} UNION ALL SELECT 'vocabulary', count(DISTINCT t), count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM recs) x",
        "lm_select": f"""WITH {RECORDS}, top AS (SELECT effective_region FROM recs WHERE effective_region <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
            SELECT record_id, champion_name, quote FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(quote)) ORDER BY record_id) AS n FROM recs WHERE lower(effective_region) = (SELECT lower(effective_region) FROM top)) x WHERE n = 1""",
        "lm_ngrams_continuous": f"WITH {COUNTS} SELECT cond, CAST(ord AS INTEGER) AS ord, history, token, cnt FROM counts",
        "lm_ngrams_sentence": f"""
            WITH {RECORDS}, pad AS (SELECT effective_region AS cond, k, list_concat(list_concat(list_transform(range(k - 1), lambda x: '<BOS>'), tokens), ['<EOS>']) AS p FROM recs, range(1, 4) r(k)),
            g AS (SELECT cond, k AS ord, array_to_string(p[i:i + k - 2], ' ') AS history, p[i + k - 1] AS token FROM pad, range(1, len(p) - k + 2) r(i))
            SELECT cond, CAST(ord AS INTEGER) AS ord, history, token, count(*) AS cnt FROM g GROUP BY ALL""",
        "lm_mle": f"WITH {COUNTS} SELECT cond, CAST(ord AS INTEGER) AS ord, history, token, cnt, round(p, 9) AS p FROM mle",
        "lm_backoff_interpolate": f"WITH {ASKED} SELECT req, token, round(p, 9) AS p FROM inter",
        "lm_backoff_fallback": f"WITH {ASKED} SELECT req, token, round(p, 9) AS p FROM hits h WHERE ord = (SELECT max(ord) FROM hits x WHERE x.req = h.req)",
        "lm_topk_temperature": f"""
            WITH {ASKED}, k0 AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY p DESC, token) AS r FROM inter), k1 AS (SELECT req, token, p / sum(p) OVER (PARTITION BY req) AS p FROM k0 WHERE r <= 8)
            SELECT req, token, round(pow(p, 2.0) / sum(pow(p, 2.0)) OVER (PARTITION BY req), 9) AS p FROM k1""",
        "lm_perplexity": f"WITH {COUNTS} SELECT cond, CAST(sum(cnt) AS BIGINT) AS n_tokens, round(exp(-sum(cnt * ln(greatest(p, 1e-12))) / sum(cnt)), 6) AS perplexity FROM mle WHERE ord = 3 GROUP BY cond",
        "lm_greedy": f"""
            WITH RECURSIVE {COUNTS},
            best AS (SELECT cond, history, n, token FROM (SELECT *, sum(cnt) OVER (PARTITION BY cond, history) AS n, row_number() OVER (PARTITION BY cond, history ORDER BY cnt DESC, token) AS r FROM counts WHERE ord = 3) x WHERE r = 1),
            start AS (SELECT cond, history FROM (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY n DESC, history) AS r FROM best) x WHERE r = 1),
            walk(cond, step, history, token) AS (
              SELECT cond, 0, history, CAST(NULL AS VARCHAR) FROM start
              UNION ALL SELECT w.cond, w.step + 1, string_split(w.history, ' ')[2] || ' ' || b.token, b.token FROM walk w JOIN best b ON w.cond = b.cond AND w.history = b.history WHERE w.step < 20)
            SELECT cond, CAST(step AS INTEGER) AS step, token FROM walk WHERE step > 0""",
        "lm_batch_grid": grid,
        "lm_generated_metrics": f"""
            WITH g AS (SELECT DISTINCT * FROM generated_texts), t AS (SELECT model_name, temperature, coalesce(regexp_extract_all(lower(text), {q(X.LM_TOKEN)}), []) AS k FROM g)
            SELECT model_name, temperature, count(*) AS n_texts, round(avg(CASE WHEN len(k) > 0 THEN len(list_distinct(k)) * 1.0 / len(k) ELSE 0 END), 6) AS unique_token_ratio,
              round(avg(CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda x: regexp_matches(x, '^[.!?,;:]$'))) * 1.0 / len(k) ELSE 0 END), 6) AS punctuation_ratio, round(avg(len(list_filter(k, lambda x: regexp_matches(x, '^[.!?]$')))), 6) AS sentence_ends
            FROM t GROUP BY model_name, temperature""",
    }
