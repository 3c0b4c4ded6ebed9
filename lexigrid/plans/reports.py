"""Queries of descriptive tables, inspection, batch generation and saved models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexigrid.functions import text as X
from lexigrid.operators import annotate as A, corpus as C, ngram as N, shares as S
from lexigrid.plans import annotation as P, corpus as PC, ngram as PN
from lexigrid.plans.profile import q
from lexigrid.session import checkpoint_dir, table, wide

#: Names of two games for reports; others are shown as they are.
GAME_NAMES = {"emberfall": "Emberfall", "duskline": "Duskline"}


def units(spark, sf):
    d = wide(spark, sf, "patchnote_corpus", "document_id").dropDuplicates(["document_id", "text_sha256"])
    return C.units(d)


def describe_targets_game(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in GAME_NAMES.items() for x in kv])
    return S.describe_targets_by(P.items(spark, sf), "game").withColumn("game_label", F.coalesce(names[F.col("game")], "game"))


def describe_targets_type(spark, sf):
    return S.describe_targets_by(P.items(spark, sf), "game", "target_type").select("game", "target_type", "n_documents", "n_targets", "n_words", "words_mean", "words_median", "words_std", "tokens", "types", "ttr")


def describe_units_game(spark, sf):
    return S.describe_units(units(spark, sf))


def describe_units_type(spark, sf):
    return S.describe_unit_types(units(spark, sf))


def inspect_join(spark, sf):
    """Every item with the last accepted annotation, also those without one."""
    return S.with_annotations(P.items(spark, sf), A.latest_ok(P.log(spark, sf))).select("item_id", "game", "primary_label", "confidence")


def inspect_report(spark, sf):
    """The sections of a report on the items that name one of the terms."""
    found = S.search(P.items(spark, sf), P.TERMS, game=P.GAMES[0])
    return S.inspection_text(S.with_annotations(found, A.latest_ok(P.log(spark, sf))))


def inspect_prompts(spark, sf):
    """The prompt of each found item alone."""
    return S.search(P.items(spark, sf), P.TERMS, game=P.GAMES[1]).select("item_id", A.item_prompt().alias("prompt"))


def validation_matrix(spark, sf):
    """The dense confusion matrix of first answers against rule labels, in label order."""
    m = P.merged(spark, sf).select("item_id", "primary_label")
    manual = P.items(spark, sf).select("item_id", A.rule_label(F.col("target_text")).alias("manual"))
    return S.confusion_matrix(manual.join(m, "item_id"), A.NAMES)


def corpus_sorted(spark, sf):
    """(pos, document_id): the corpus in its order of game, year (missing last), patch, title and document."""
    from pyspark.sql.window import Window

    d = table(spark, sf, "patchnote_corpus").select("document_id", "game", "year", "patch_id", "title").dropDuplicates(["document_id"])
    order = [F.col("year").asc_nulls_last(), "patch_id", F.col("title").asc_nulls_last(), "document_id"]
    return d.withColumn("pos", F.row_number().over(Window.partitionBy("game").orderBy(*order))).select("game", "pos", "document_id")


def sources_union(spark, sf):
    """Texts of two sources of documents under one set of columns, counted by source and game."""
    a = table(spark, sf, "patchnote_corpus").select("document_id", "game", F.lit("corpus").alias("origin"), F.col("clean_text").alias("text"))
    b = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "game", F.lit("documents").alias("origin"), "text")
    return a.unionByName(b).groupBy("origin", "game").agg(F.count("*").alias("n_rows"), F.count("text").alias("n_texts"))


def value_lists(spark, sf):
    return N.value_lists(PN.recs(spark, sf), PN.DIMENSIONS)


def group_means(spark, sf):
    """Mean unique share by model, in falling order: the order of a chart's bars."""
    from pyspark.sql.window import Window

    g = table(spark, sf, "generated_texts").dropDuplicates().groupBy("model_name").agg(F.round(F.avg("unique_token_ratio"), 6).alias("mean_ratio"), F.count("*").alias("n_texts"))
    return g.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("mean_ratio"), "model_name")))  # one row a model


def entity_labels(spark, sf):
    """How often each form of entity (a count of capitalised words) stands in the texts of each kind."""
    found = X.all_matches(F.coalesce("text", F.lit("")), r"[a-z,] (\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)")  # with the letter before
    d = table(spark, sf, "documents").select("kind", F.explode(found).alias("e")).select("kind", F.concat(F.lit("words_"), (F.size(F.split("e", " ")) - 1).cast("string")).alias("label"))
    return d.groupBy("kind", "label").agg(F.count("*").alias("n"))


def batch_params(spark):
    g = N.grid(spark, region=["", "No Such Region"], seed=["the", ""], temperature=[1.0], top_k=[1], random_seed=[7], tokens=[6], backoff_mode=["interpolate"], backoff_alpha=[0.4], sentence_mode=[False])
    from pyspark.sql.window import Window

    return g.withColumn("batch_no", F.row_number().over(Window.orderBy("region", "seed")))  # a grid is small


def lm_batch_run(spark, sf):
    """A batch over a small grid: the rows of an unknown region are skipped, the others generated greedily (top 1)."""
    b = N.run_batch(batch_params(spark), PN.recs(spark, sf), PN.ORDER)
    return b.select("batch_no", "region", "seed", "condition_summary", "num_source_quotes", "status", F.col("text").isNotNull().alias("has_text"))


def lm_model_roundtrip(spark, sf):
    """Records and n-grams by order of a model that was saved and loaded again."""
    folder = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    N.save_model(PN.recs(spark, sf), PN.counts(spark, sf), folder)
    recs, counts = N.load_model(spark, folder)
    a = recs.agg(F.count("*").alias("n"), F.sum(F.size("tokens")).cast("bigint").alias("total")).select(F.lit("records").alias("part"), "n", "total")
    return a.unionByName(counts.groupBy(F.concat(F.lit("order_"), F.col("ord").cast("string")).alias("part")).agg(F.count("*").alias("n"), F.sum("cnt").cast("bigint").alias("total")))


def manifest_unified(spark, sf):
    """Rows by origin and status of the unified manifest, and how many name a page's text."""
    from lexigrid.sources import sinks

    m = sinks.unified_manifest(table(spark, sf, "page_manifest"), table(spark, sf, "scrape_results"))
    return m.groupBy("manifest", "status").agg(F.count("*").alias("n_rows"), F.count("text_path").alias("n_texts"), F.count("canonical_url").alias("n_canonical"))


def artefact_paths(spark, sf):
    """Where the artefacts of each page go, by its kind and id."""
    from lexigrid.sources import sinks

    m = table(spark, sf, "page_manifest").select("output_id").distinct()
    kind = F.when(F.length("output_id") % 3 == 0, "patch_page").when(F.length("output_id") % 3 == 1, "newsentry").otherwise("microsite")
    return m.select("output_id", sinks.page_paths(kind, F.col("output_id")).alias("p")).select("output_id", "p.*")


def lines_squeezed(spark, sf):
    """The clean texts with each line squeezed and blank lines left out."""
    d = table(spark, sf, "patchnote_corpus").select("document_id", "clean_text").dropDuplicates()
    return d.select("document_id", X.squeeze_lines("clean_text").alias("text"))


def game_names(spark, sf):
    """Documents by the shown name of their game."""
    return table(spark, sf, "documents").groupBy(X.mapped(F.col("game"), GAME_NAMES).alias("game_label")).agg(F.count("*").alias("n"))


def page_manifest_records(spark, sf):
    """Status and length of each page read anew; pages of the scrape results are done already."""
    from lexigrid.operators import pages as PG

    done = table(spark, sf, "scrape_results").where("status = 'ok' AND raw_html_path IS NOT NULL").select(F.col("raw_html_path").alias("path")).distinct()

    def read(content):
        if "<html" not in content.lower():
            raise ValueError("no page")
        return content

    return PG.page_records(table(spark, sf, "page_files"), done, read).select("path", "n_text_chars", "status", "error")


def queries() -> dict:
    names = "manifest_unified artefact_paths lines_squeezed game_names page_manifest_records describe_targets_game describe_targets_type describe_units_game describe_units_type inspect_join inspect_report inspect_prompts validation_matrix corpus_sorted sources_union value_lists group_means entity_labels lm_batch_run lm_model_roundtrip"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    w = "coalesce(target_word_count, 0)"
    prose, stat = "target_type = 'prose_sentence'", "target_type = 'stat_or_list_line'"

    def targets(by: str) -> str:
        on = " AND ".join(f"d.{b} = lx.{b}" for b in by.split(", "))
        return f"""WITH {P.LOG}, t AS (SELECT *, {w} AS w, CASE WHEN {prose} THEN {w} END AS pw, CASE WHEN {stat} THEN {w} END AS sw FROM items),
            tk AS (SELECT {by}, lower(unnest(regexp_extract_all(coalesce(target_text, ''), {q(X.WORD)}))) AS x FROM items), lx AS (SELECT {by}, count(*) AS tokens, count(DISTINCT x) AS types, round(count(DISTINCT x) / count(*), 6) AS ttr FROM tk GROUP BY {by}),
            d AS (SELECT {by}, count(DISTINCT document_id) AS n_documents, count(*) AS n_targets, count(*) FILTER ({prose}) AS n_prose, count(*) FILTER ({stat}) AS n_stat, CAST(coalesce(sum(w), 0) AS BIGINT) AS n_words, CAST(coalesce(sum(pw), 0) AS BIGINT) AS n_prose_words, CAST(coalesce(sum(sw), 0) AS BIGINT) AS n_stat_words,
              round(avg(CAST({prose} AS DOUBLE)), 6) AS prose_share, round(avg(CAST({stat} AS DOUBLE)), 6) AS stat_share, {P.summ("w", "words")}, {P.summ("pw", "prose_words")}, {P.summ("sw", "stat_words")} FROM t GROUP BY {by})
            SELECT d.*, tokens, types, ttr FROM d LEFT JOIN lx ON {on}"""

    some = lambda c, other: f"coalesce(nullif(trim({c}), ''), '{other}')"
    names = PN.DIMENSIONS
    lists = " UNION ALL ".join(f"SELECT '{n}' AS dimension, {n} AS value FROM recs" for n in names)
    hit = lambda g: f"lower(game) = '{g}' AND (" + " OR ".join(f"contains(lower(coalesce({c}, '')), {q(t)})" for c in S.SEARCHED for t in P.TERMS) + ")"
    js = lambda c: f"to_json(coalesce({c}, ''))"
    return {
        "manifest_unified": """SELECT 'page' AS manifest, status, count(*) AS n_rows, count(text_path) AS n_texts, count(canonical_url) AS n_canonical FROM (SELECT DISTINCT * FROM page_manifest) p GROUP BY status
            UNION ALL SELECT 'scrape', status, count(*), count(text_path), 0 FROM (SELECT DISTINCT * FROM scrape_results) s GROUP BY status""",
        "artefact_paths": """WITH m AS (SELECT DISTINCT output_id, ['patches', 'news', 'microsites'][length(output_id) % 3 + 1] AS f FROM page_manifest)
            SELECT output_id, 'raw_html/' || f || '/' || output_id || '.html' AS raw_html_path, 'article_html/' || f || '/' || output_id || '.html' AS article_html_path, 'text/' || f || '/' || output_id || '.txt' AS text_path, 'structured/pages/' || f || '/' || output_id || '.json' AS structured_path FROM m""",
        "lines_squeezed": f"WITH d AS (SELECT DISTINCT document_id, clean_text FROM patchnote_corpus) SELECT document_id, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(clean_text, ''), '\\r\\n|\\n|\\r'), lambda x: {PC.squeeze('x')}), lambda x: x <> ''), chr(10)) AS text FROM d",
        "game_names": "SELECT CASE game WHEN 'emberfall' THEN 'Emberfall' WHEN 'duskline' THEN 'Duskline' ELSE game END AS game_label, count(*) AS n FROM documents GROUP BY 1",
        "page_manifest_records": """SELECT path, CASE WHEN contains(lower(content), '<html') THEN length(content) ELSE 0 END AS n_text_chars, CASE WHEN contains(lower(content), '<html') THEN 'ok' ELSE 'error' END AS status,
            CASE WHEN NOT contains(lower(content), '<html') THEN 'ValueError: no page' END AS error FROM page_files WHERE path NOT IN (SELECT raw_html_path FROM scrape_results WHERE status = 'ok' AND raw_html_path IS NOT NULL)""",
        "describe_targets_game": f"SELECT *, CASE game WHEN 'emberfall' THEN 'Emberfall' WHEN 'duskline' THEN 'Duskline' ELSE game END AS game_label FROM ({targets('game')}) x",
        "describe_targets_type": f"SELECT game, target_type, n_documents, n_targets, n_words, words_mean, words_median, words_std, tokens, types, ttr FROM ({targets('game, target_type')}) x",
        "describe_units_game": f"""WITH {PC.UNITS}, tk AS (SELECT game, lower(unnest(regexp_extract_all(text, {q(X.WORD)}))) AS x FROM units), lx AS (SELECT game, count(*) AS tokens, count(DISTINCT x) AS types, round(count(DISTINCT x) / count(*), 6) AS ttr FROM tk GROUP BY game),
            d AS (SELECT game, count(*) AS n_units, count(*) FILTER (included) AS n_targets, count(*) FILTER (NOT included) AS n_context, CAST(sum(word_count) AS BIGINT) AS n_words, CAST(coalesce(sum(word_count) FILTER (included), 0) AS BIGINT) AS n_target_words, CAST(coalesce(sum(word_count) FILTER (NOT included), 0) AS BIGINT) AS n_context_words,
              round(avg(CAST(included AS DOUBLE)), 6) AS target_share, round(avg(CAST(NOT included AS DOUBLE)), 6) AS context_share, {P.summ("word_count", "words")} FROM units GROUP BY game) SELECT d.*, tokens, types, ttr FROM d LEFT JOIN lx ON d.game = lx.game""",
        "describe_units_type": f"WITH {PC.UNITS} SELECT game, unit_type, included, count(*) AS n_units, CAST(sum(word_count) AS BIGINT) AS n_words, {P.summ('word_count', 'words')} FROM units GROUP BY game, unit_type, included",
        "inspect_join": f"WITH {P.LOG} SELECT i.item_id, game, l.primary_label, l.confidence FROM items i LEFT JOIN latest l USING (item_id)",
        "inspect_report": f"""WITH {P.LOG}, f AS (SELECT i.*, l.primary_label FROM items i LEFT JOIN latest l USING (item_id) WHERE {hit(P.GAMES[0]).replace("item_id", "i.item_id")})
            SELECT item_id, '## ' || item_id || chr(10) || chr(10) || '- game: ' || {some('game', '')} || chr(10) || '- patch: ' || {some('patch_id', '')} || chr(10) || '- label: ' || {some('primary_label', '(none)')}
              || chr(10) || chr(10) || '### Context before' || chr(10) || chr(10) || {some('context_before', '(empty)')} || chr(10) || chr(10) || '### Target' || chr(10) || chr(10) || {some('target_text', '(empty)')} || chr(10) || chr(10) || '### Context after' || chr(10) || chr(10) || {some('context_after', '(empty)')} || chr(10) AS markdown FROM f""",
        "inspect_prompts": f"""WITH {P.LOG} SELECT item_id, '{{"items":[{{"prompt_id":"item_001","context_before":' || {js('context_before')} || ',"target_text":' || {js('target_text')} || ',"context_after":' || {js('context_after')} || '}}]}}' AS prompt FROM items WHERE {hit(P.GAMES[1])}""",
        "validation_matrix": f"WITH {P.LOG}, {P.DIM}, p AS (SELECT lab.primary_label AS manual, m.primary_label AS k FROM lab JOIN m USING (item_id)) SELECT d.primary_label AS manual, CAST(row_number() OVER (ORDER BY label_order) - 1 AS INTEGER) AS label_order, "
        + ", ".join(f"(SELECT count(*) FROM p WHERE p.manual = d.primary_label AND p.k = {q(k)}) AS {k}" for k in A.NAMES)
        + " FROM dim d",
        "corpus_sorted": "WITH d AS (SELECT document_id, any_value(game) AS game, any_value(year) AS year, any_value(patch_id) AS patch_id, any_value(title) AS title FROM patchnote_corpus GROUP BY document_id) SELECT game, CAST(row_number() OVER (PARTITION BY game ORDER BY year ASC NULLS LAST, patch_id, title ASC NULLS LAST, document_id) AS INTEGER) AS pos, document_id FROM d",
        "sources_union": "SELECT origin, game, count(*) AS n_rows, count(text) AS n_texts FROM (SELECT game, 'corpus' AS origin, clean_text AS text FROM patchnote_corpus UNION ALL SELECT game, 'documents', text FROM documents) x GROUP BY origin, game",
        "value_lists": f"WITH {PN.RECORDS}, v AS ({lists}) SELECT dimension, count(DISTINCT value) AS n_values, array_to_string(list_sort(list(DISTINCT value)), '|') AS joined FROM v WHERE value <> '' GROUP BY dimension",
        "group_means": "WITH g AS (SELECT model_name, round(avg(unique_token_ratio), 6) AS mean_ratio, count(*) AS n_texts FROM (SELECT DISTINCT * FROM generated_texts) x GROUP BY model_name) SELECT *, CAST(row_number() OVER (ORDER BY mean_ratio DESC, model_name) AS INTEGER) AS pos FROM g",
        "entity_labels": r"WITH e AS (SELECT kind, unnest(regexp_extract_all(coalesce(text, ''), '[a-z,] (\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)', 1)) AS e FROM documents) SELECT kind, 'words_' || len(string_split(e, ' ')) AS label, count(*) AS n FROM e GROUP BY ALL",
        "lm_batch_run": f"""WITH {PN.RECORDS}, n AS (SELECT count(*) AS n FROM recs), g(batch_no, region, seed) AS (VALUES (1, '', ''), (2, '', 'the'), (3, 'No Such Region', ''), (4, 'No Such Region', 'the'))
            SELECT batch_no, region, seed, CASE WHEN region = '' THEN 'global' ELSE 'region=' || region END AS condition_summary, CASE WHEN region = '' THEN n ELSE 0 END AS num_source_quotes, CASE WHEN region = '' THEN 'ok' ELSE 'skipped: only 0 quotes' END AS status, region = '' AS has_text FROM g, n""",
        "lm_model_roundtrip": f"""WITH {PN.RECORDS} SELECT 'records' AS part, count(*) AS n, CAST(sum(len(tokens)) AS BIGINT) AS total FROM recs
            UNION ALL SELECT 'order_' || ord, count(*), CAST(sum(cnt) AS BIGINT) FROM ({PN.oracle_sql()["lm_ngrams_continuous"]}) y GROUP BY ord""",
    }
