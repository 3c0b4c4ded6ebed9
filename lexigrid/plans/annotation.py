"""Queries of the annotation, share, validation, inspection and test operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import text as X
from lexigrid.operators import annotate as A, sampling, shares as S, stats
from lexigrid.plans.profile import q
from lexigrid.session import cut, table

GAMES = ("emberfall", "duskline")
TERMS = ["keep an eye", "crash"]


def items(spark, sf):
    return table(spark, sf, "annotation_items").dropDuplicates(["item_id"])


def log(spark, sf):
    """An append log for the items: a first attempt that fails for some, and a second for those and some others."""
    i = items(spark, sf).select("item_id", A.rule_label(F.col("target_text")).alias("primary_label"), X.md5_unit(F.lit("log"), F.col("item_id")).alias("m"))
    conf = F.round(F.col("m") % 1000 / 1000.0, 3)
    one = i.select("item_id", "primary_label", conf.alias("confidence"), F.when(F.col("m") % 5 == 0, "error").otherwise("ok").alias("annotation_status"), (F.col("m") * 2).alias("append_seq"))
    two = i.where("m % 10 = 0 OR m % 11 = 0").select("item_id", F.when(F.col("m") % 11 == 0, "non_substantive").otherwise(F.col("primary_label")).alias("primary_label"), conf.alias("confidence"), F.lit("ok").alias("annotation_status"), (F.col("m") * 2 + 1).alias("append_seq"))
    return one.unionByName(two)


def merged(spark, sf):
    return S.merged(items(spark, sf), log(spark, sf))


def packets_batches(spark, sf):
    return A.packets(items(spark, sf))


def responses(spark, sf):
    """Synthetic answers: most plain JSON, some inside other text, some with an unknown label or unreadable."""
    b = sampling.batches(items(spark, sf).select("item_id", A.rule_label(F.col("target_text")).alias("l")), 12, 42, "item_id").withColumn("m", X.md5_unit(F.lit("answer"), F.col("item_id")))
    label = F.when(F.col("m") % 97 == 0, "unheard_of").otherwise(F.col("l"))
    conf = F.when(F.col("m") % 7 == 0, "1.7").when(F.col("m") % 7 == 1, '"x"').otherwise("0.5")
    body = F.concat(F.lit('{"primary_label":"'), label, F.lit('","secondary_labels":["design_rationale","nonsense"],"confidence":'), conf, F.lit(',"evidence_quote":"","reason_short":"r"}'))
    text = F.when(F.col("m") % 89 == 0, "no answer").when(F.col("m") % 3 == 0, F.concat(F.lit("Here it is: "), body, F.lit(" done"))).otherwise(body)
    return b.select("item_id", "batch_no", text.alias("response"))


def annotation_parse(spark, sf):
    return A.validated(responses(spark, sf)).drop("response")


def annotation_resume(spark, sf):
    return A.pending(items(spark, sf), log(spark, sf)).select("item_id", "document_id")


def annotation_latest(spark, sf):
    return A.latest_ok(log(spark, sf))


def validation_sample(spark, sf):
    m = merged(spark, sf).select("item_id", "game", "primary_label")
    return sampling.stratified_sample(m, 250, ["game", "primary_label"], "item_id")


def _manual(spark, sf):
    """Manual labels: the rule's label, but another for one item in six; one in nine is left open."""
    m = merged(spark, sf).select("item_id", F.col("primary_label").alias("guess"), A.rule_label(F.col("target_text")).alias("r"), X.md5_unit(F.lit("manual"), F.col("item_id")).alias("m"))
    return m.select("item_id", "guess", F.when(F.col("m") % 9 == 0, F.lit(None)).when(F.col("m") % 6 == 0, "design_rationale").otherwise(F.col("r")).alias("truth"))


def validation_confusion(spark, sf):
    return S.confusion(_manual(spark, sf).where("truth IS NOT NULL"), "truth", "guess")


def validation_labels(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return S.label_scores(validation_confusion(spark, sf)).select("label", r("precision"), r("recall"), r("f1"), "support")


def validation_metrics(spark, sf):
    m = cut(_manual(spark, sf))
    return S.accuracy(S.label_scores(S.confusion(m.where("truth IS NOT NULL"), "truth", "guess")), F.lit(m.count()))


def label_word_shares(spark, sf):
    s = S.label_shares(merged(spark, sf), A.label_dim(spark))
    return s.withColumn("shown", X.percent(F.col("word_share")))


def metric_word_shares(spark, sf):
    return S.metric_shares(merged(spark, sf), ["game"])


def document_metric_shares(spark, sf):
    return S.metric_shares(merged(spark, sf), ["document_id", "game", "patch_id", "year", "title"])


def inspect_search(spark, sf):
    return S.search(items(spark, sf), TERMS, game=GAMES[0], patch="1").select("item_id", "game", "patch_id")


def inspect_window(spark, sf):
    i = items(spark, sf)
    return S.neighbours(i, i.where(F.contains(F.lower("target_text"), F.lit(TERMS[0]))))


def describe_corpus(spark, sf):
    return S.describe_corpus(table(spark, sf, "patchnote_corpus").dropDuplicates(["document_id", "text_sha256"]))


def describe_targets(spark, sf):
    return S.describe_targets(items(spark, sf))


def describe_labels(spark, sf):
    return S.describe_labels(merged(spark, sf), A.label_dim(spark))


def describe_metrics(spark, sf):
    return S.describe_metrics(merged(spark, sf), A.metric_dim(spark))


def _values(spark, sf, metric="change_documentation"):
    d = document_metric_shares(spark, sf).where(F.col("game").isin(*GAMES))
    return cut(d.groupBy(F.col("document_id").alias("id"), "game").agg(F.max(f"share_{metric}").alias("v")).select("id", F.when(F.col("game") == GAMES[0], "x").otherwise("y").alias("grp"), "v"))


def stats_permutation(spark, sf):
    return stats.permutation(_values(spark, sf))


def stats_bootstrap(spark, sf):
    return stats.bootstrap(_values(spark, sf))


def stats_cliffs_delta(spark, sf):
    return stats.cliffs_delta(_values(spark, sf))


def stats_holm(spark, sf):
    t = None
    for name, _ in A.METRICS[:2]:
        one = stats.permutation(_values(spark, sf, name)).select(F.lit(name).alias("metric"), "p_value")
        t = one if t is None else t.unionByName(one)
    return stats.holm(t)


def stratified_split(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "kind")
    return sampling.stratified_split(d, "kind", "doc_id")


def queries() -> dict:
    names = (
        "packets_batches annotation_parse annotation_resume annotation_latest validation_sample validation_confusion validation_labels validation_metrics label_word_shares metric_word_shares document_metric_shares "
        "inspect_search inspect_window describe_corpus describe_targets describe_labels describe_metrics stats_permutation stats_bootstrap stats_cliffs_delta stats_holm stratified_split"
    )
    return {n: globals()[n] for n in names.split()}


UNIT = lambda *p: f"CAST('0x' || substr(md5({' || chr(124) || '.join(p)}), 1, 8) AS BIGINT)"
LABEL = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(target_text, ''), {q(p)}) THEN {q(k)}" for k, p in A.RULES) + " ELSE 'non_substantive' END"
LOG = f"""
items AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id) AS dup FROM annotation_items) x WHERE dup = 1),
lab AS (SELECT item_id, {LABEL} AS primary_label, {UNIT("'log'", "item_id")} AS m FROM items),
log AS (
  SELECT item_id, primary_label, round(m % 1000 / 1000.0, 3) AS confidence, CASE WHEN m % 5 = 0 THEN 'error' ELSE 'ok' END AS annotation_status, m * 2 AS append_seq FROM lab
  UNION ALL SELECT item_id, CASE WHEN m % 11 = 0 THEN 'non_substantive' ELSE primary_label END, round(m % 1000 / 1000.0, 3), 'ok', m * 2 + 1 FROM lab WHERE m % 10 = 0 OR m % 11 = 0),
latest AS (SELECT item_id, primary_label, confidence, append_seq FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY append_seq DESC) AS n FROM log WHERE annotation_status = 'ok') x WHERE n = 1),
m AS (SELECT i.*, l.primary_label, len(regexp_extract_all(coalesce(target_text, ''), {q(X.WORD)})) AS words FROM items i JOIN latest l USING (item_id))
"""
DIM = "dim(primary_label, label_name, label_order) AS (VALUES " + ", ".join(f"({q(k)}, {q(n)}, {10 * (i + 1)})" for i, (k, n) in enumerate(A.LABELS)) + ")"
MDIM = "mdim(metric, primary_label) AS (VALUES " + ", ".join(f"({q(a)}, {q(k)})" for a, ks in A.METRICS for k in ks) + ")"
SHARES = f"""
{LOG}, {DIM},
got AS (SELECT game, primary_label, count(*) AS n_items, sum(words) AS label_words FROM m GROUP BY ALL),
fl AS (SELECT g.game, d.primary_label, d.label_name, d.label_order, coalesce(n_items, 0) AS n_items, CAST(coalesce(label_words, 0) AS BIGINT) AS label_words FROM (SELECT DISTINCT game FROM m) g, dim d LEFT JOIN got ON got.game = g.game AND got.primary_label = d.primary_label),
shares AS (SELECT *, CAST(sum(label_words) OVER w AS BIGINT) AS total_words, CAST(sum(n_items) OVER w AS BIGINT) AS total_items, round(coalesce(label_words / nullif(sum(label_words) OVER w, 0), 0), 6) AS word_share, round(coalesce(n_items / nullif(sum(n_items) OVER w, 0), 0), 6) AS item_share FROM fl WINDOW w AS (PARTITION BY game))
"""


def metric_cols() -> str:
    out = "count(*) AS n_items, CAST(sum(words) AS BIGINT) AS annotated_words"
    for name, labels in A.METRICS:
        w = f"sum(CASE WHEN primary_label IN ({', '.join(map(q, labels))}) THEN words ELSE 0 END)"
        out += f", CAST({w} AS BIGINT) AS words_{name}, round(coalesce({w} / nullif(sum(words), 0), 0), 6) AS share_{name}"
    return out


def summ(c: str, n: str) -> str:
    d = f"CAST({c} AS DOUBLE)"
    return f"round(avg({d}), 6) AS {n}_mean, round(median({d}), 6) AS {n}_median, min({d}) AS {n}_min, round(quantile_cont({d}, 0.25), 6) AS {n}_q25, round(quantile_cont({d}, 0.75), 6) AS {n}_q75, max({d}) AS {n}_max, round(coalesce(stddev_samp({d}), 0), 6) AS {n}_std"


def values(metric: str = "change_documentation") -> str:
    return f"""vals AS (SELECT document_id AS id, CASE WHEN game = '{GAMES[0]}' THEN 'x' ELSE 'y' END AS grp, max(share_{metric}) AS v
      FROM (SELECT document_id, game, patch_id, year, title, {metric_cols()} FROM m WHERE game IN ('{GAMES[0]}', '{GAMES[1]}') GROUP BY ALL) d GROUP BY document_id, game)"""


def perm(n: int) -> str:
    return f"""sizes AS (SELECT count(*) FILTER (grp = 'x') AS n_x, avg(v) FILTER (grp = 'x') - avg(v) FILTER (grp = 'y') AS observed FROM vals),
      rk AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY md5('42|' || CAST(rep AS VARCHAR) || '|' || id), id) AS rank FROM vals, range(1, {n + 1}) r(rep)),
      df AS (SELECT rep, avg(v) FILTER (rank <= n_x) - avg(v) FILTER (rank > n_x) AS d, max(observed) AS observed FROM rk, sizes GROUP BY rep),
      res AS (SELECT round(max(observed), 9) AS difference, round((count(*) FILTER (abs(d) >= abs(observed) - 1e-12) + 1) / (count(*) + 1), 9) AS p_value FROM df)"""


CONF = f"""
{LOG},
man AS (SELECT item_id, guess, CASE WHEN u % 9 = 0 THEN NULL WHEN u % 6 = 0 THEN 'design_rationale' ELSE r END AS truth FROM (SELECT item_id, primary_label AS guess, {LABEL} AS r, {UNIT("'manual'", "item_id")} AS u FROM m) x),
conf AS (SELECT truth, guess, count(*) AS n FROM man WHERE truth IS NOT NULL GROUP BY ALL),
lb AS (SELECT truth AS label FROM conf UNION SELECT guess FROM conf),
sc0 AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM conf WHERE truth = label) AS support, (SELECT coalesce(sum(n), 0) FROM conf WHERE guess = label) AS said, (SELECT coalesce(sum(n), 0) FROM conf WHERE truth = label AND guess = label) AS hit FROM lb),
sc AS (SELECT label, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, CAST(support AS BIGINT) AS support, hit FROM sc0),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM sc)
"""
PLACED = f"{LOG}, placed AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || item_id), item_id) AS place FROM items), b AS (SELECT *, (place - 1) // 12 + 1 AS batch_no, (place - 1) % 12 + 1 AS item_no FROM placed)"


def oracle_sql() -> dict[str, str]:
    payload = "'{\"prompt_id\":\"item_' || lpad(CAST(item_no AS VARCHAR), 3, '0') || '\",\"context_before\":' || to_json(coalesce(context_before, '')) || ',\"target_text\":' || to_json(coalesce(target_text, '')) || ',\"context_after\":' || to_json(coalesce(context_after, '')) || '}'"
    known = ", ".join(map(q, A.NAMES))
    term = " OR ".join(f"contains(lower(coalesce({c}, '')), {q(t)})" for t in TERMS for c in S.SEARCHED)
    return {
        "packets_batches": f"""WITH {PLACED}
            SELECT batch_no, count(*) AS n_items, CAST(floor(sum(len(list_filter(regexp_split_to_array(concat_ws(' ', context_before, target_text, context_after), '[\\t-\\r ]+'), lambda x: x <> ''))) * CAST(1.4 AS DOUBLE)) AS BIGINT) AS approx_tokens,
              '{{"items":[' || string_agg({payload}, ',' ORDER BY item_no) || ']}}' AS prompt FROM b GROUP BY batch_no""",
        "annotation_parse": f"""WITH {PLACED},
            a AS (SELECT item_id, batch_no, {LABEL} AS l, {UNIT("'answer'", "item_id")} AS u FROM b),
            c AS (SELECT *, u % 89 = 0 OR u % 97 = 0 AS bad0 FROM a), d AS (SELECT *, bool_or(bad0) OVER (PARTITION BY batch_no) AS bad FROM c)
            SELECT item_id, batch_no, CASE WHEN NOT bad THEN l END AS primary_label, CASE WHEN NOT bad THEN CASE WHEN l = 'design_rationale' THEN '' ELSE 'design_rationale' END END AS secondary_labels,
              CASE WHEN NOT bad THEN CAST(CASE WHEN u % 7 = 0 THEN 1.0 WHEN u % 7 = 1 THEN 0.0 ELSE 0.5 END AS DOUBLE) END AS confidence, CASE WHEN bad THEN 'error' ELSE 'ok' END AS annotation_status FROM d""",
        "annotation_resume": f"WITH {LOG} SELECT item_id, document_id FROM items WHERE item_id NOT IN (SELECT item_id FROM log WHERE annotation_status = 'ok')",
        "annotation_latest": f"WITH {LOG} SELECT item_id, primary_label, confidence, append_seq FROM latest",
        "validation_sample": f"""WITH {LOG}, g AS (SELECT greatest(1, 250 // count(*)) AS base FROM (SELECT DISTINCT game, primary_label FROM m) x),
            r AS (SELECT item_id, game, primary_label, md5('42|' || item_id) AS h, row_number() OVER (PARTITION BY game, primary_label ORDER BY md5('42|' || item_id), item_id) AS rank FROM m)
            SELECT item_id, game, primary_label, rank <= base AS first FROM r, g ORDER BY rank <= base DESC, h, item_id LIMIT 250""",
        "validation_confusion": f"WITH {CONF} SELECT * FROM conf",
        "validation_labels": f"WITH {CONF} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f",
        "validation_metrics": f"WITH {CONF} SELECT CAST(sum(support) AS BIGINT) AS n_evaluated, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, (SELECT count(*) FROM man) AS n_manual, round(sum(support) / (SELECT count(*) FROM man), 6) AS coverage FROM f",
        "label_word_shares": f"WITH {SHARES} SELECT *, CASE WHEN word_share = 0 THEN '0%' WHEN word_share < 0.001 THEN '<0.1%' ELSE format('{{:.1f}}%', word_share * 100) END AS shown FROM shares",
        "metric_word_shares": f"WITH {LOG} SELECT game, {metric_cols()} FROM m GROUP BY game",
        "document_metric_shares": f"WITH {LOG} SELECT document_id, game, patch_id, year, title, {metric_cols()} FROM m GROUP BY document_id, game, patch_id, year, title",
        "inspect_search": f"WITH {LOG} SELECT item_id, game, patch_id FROM items WHERE ({term}) AND lower(game) = '{GAMES[0]}' AND contains(lower(patch_id), '1')",
        "inspect_window": f"""WITH {LOG}, p AS (SELECT document_id, item_id, target_text, row_number() OVER (PARTITION BY document_id ORDER BY item_order, item_id) AS rn FROM items),
            mt AS (SELECT document_id, item_id AS match_id, rn AS match_rn FROM p WHERE contains(lower(target_text), {q(TERMS[0])})),
            j AS (SELECT p.item_id, match_id, match_rn, rn - match_rn AS distance, row_number() OVER (PARTITION BY p.item_id ORDER BY match_rn, match_id) AS n FROM p JOIN mt ON p.document_id = mt.document_id AND abs(rn - match_rn) <= 2)
            SELECT item_id, match_id, CAST(distance AS INTEGER) AS distance FROM j WHERE n = 1""",
        "describe_corpus": f"""WITH d AS (SELECT document_id, any_value(game) AS game, any_value(year) AS year, any_value(clean_text) AS clean_text, any_value(word_count) AS word_count, any_value(line_count) AS line_count FROM patchnote_corpus GROUP BY document_id, text_sha256),
            t AS (SELECT game, lower(unnest(regexp_extract_all(coalesce(clean_text, ''), {q(X.WORD)}))) AS w FROM d), lx AS (SELECT game, count(*) AS tokens, count(DISTINCT w) AS types, round(count(DISTINCT w) / count(*), 6) AS ttr FROM t GROUP BY game)
            SELECT d.game, count(*) AS n_rows, count(DISTINCT document_id) AS n_documents, CASE WHEN min(year) IS NULL THEN '' WHEN min(year) = max(year) THEN CAST(min(year) AS VARCHAR) ELSE min(year) || '–' || max(year) END AS years, CAST(sum(word_count) AS BIGINT) AS n_words,
              {summ("word_count", "words")}, {summ("line_count", "lines")}, any_value(tokens) AS tokens, any_value(types) AS types, any_value(ttr) AS ttr FROM d LEFT JOIN lx ON d.game = lx.game GROUP BY d.game""",
        "describe_targets": f"""WITH {LOG}, t AS (SELECT *, len(regexp_extract_all(coalesce(target_text, ''), {q(X.WORD)})) AS words FROM items)
            SELECT game, document_id, count(*) AS n_items, CAST(sum(words) AS BIGINT) AS n_words, count(*) FILTER (target_type = 'stat_or_list_line') AS n_stat, round(avg(CAST(target_type = 'stat_or_list_line' AS DOUBLE)), 6) AS share_stat, min_by(title, item_order) AS title, {summ("words", "item_words")} FROM t GROUP BY game, document_id""",
        "describe_labels": f"WITH {SHARES}, w AS (SELECT game, primary_label, round(avg(words), 6) AS mean_words, CAST(median(words) AS DOUBLE) AS median_words FROM m GROUP BY ALL) SELECT s.*, mean_words, median_words FROM shares s LEFT JOIN w USING (game, primary_label)",
        "describe_metrics": f"WITH {LOG}, {MDIM}, g AS (SELECT game, metric, count(*) AS n_items, CAST(sum(words) AS BIGINT) AS n_words, round(avg(words), 6) AS mean_words FROM m JOIN mdim USING (primary_label) GROUP BY ALL) SELECT *, round(n_items / sum(n_items) OVER (PARTITION BY game), 6) AS item_share, round(n_words / sum(n_words) OVER (PARTITION BY game), 6) AS word_share FROM g",
        "stats_permutation": f"WITH {LOG}, {values()}, {perm(200)} SELECT * FROM res",
        "stats_bootstrap": f"""WITH {LOG}, {values()}, pl AS (SELECT grp, v, row_number() OVER (PARTITION BY grp ORDER BY md5(id), id) AS place FROM vals), n AS (SELECT grp, count(*) AS n FROM vals GROUP BY grp),
            dr AS (SELECT grp, rep, {UNIT("'43'", "grp", "CAST(rep AS VARCHAR)", "CAST(j AS VARCHAR)")} % n + 1 AS place FROM n, range(1, 201) r(rep), range(1, n + 1) s(j)),
            mn AS (SELECT rep, avg(v) FILTER (grp = 'x') - avg(v) FILTER (grp = 'y') AS d FROM dr JOIN pl USING (grp, place) GROUP BY rep)
            SELECT round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high FROM mn""",
        "stats_cliffs_delta": f"WITH {LOG}, {values()} SELECT (SELECT count(*) FROM vals WHERE grp = 'x') AS n_x, (SELECT count(*) FROM vals WHERE grp = 'y') AS n_y, round(avg(sign(a.v - b.v)), 9) AS delta FROM vals a, vals b WHERE a.grp = 'x' AND b.grp = 'y'",
        "stats_holm": "WITH " + LOG + ", " + ", ".join(f"r{i} AS (WITH {values(n)}, {perm(200)} SELECT '{n}' AS metric, p_value FROM res)" for i, (n, _) in enumerate(A.METRICS[:2])) + """,
            t AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1), k AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_value, metric) + 1) * p_value AS raw FROM t)
            SELECT metric, p_value, round(least(1.0, max(raw) OVER (ORDER BY p_value, metric ROWS UNBOUNDED PRECEDING)), 9) AS holm_p FROM k""",
        "stratified_split": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, kind, CASE WHEN row_number() OVER (PARTITION BY kind ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) <= floor(count(*) OVER (PARTITION BY kind) * 0.2) THEN 'test' ELSE 'train' END AS part FROM documents""",
    }
