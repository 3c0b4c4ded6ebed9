"""The queries of the training-text problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.llm import boilerplate_lines, encode, language, lookalike, markup, mixture, page_body, repetition, token_budget
from lexigrid.session import table


def p1_found(spark, sf):
    return boilerplate_lines.found(table(spark, sf, "patchnote_corpus"))


def p1_clean(spark, sf):
    return boilerplate_lines.cleaned(table(spark, sf, "patchnote_corpus"))


def p1_sequences(spark, sf):
    patterns, _ = boilerplate_lines.mine(table(spark, sf, "patchnote_corpus"))
    return patterns.withColumnRenamed("source", "game")


def p2_item_counts(spark, sf):
    return token_budget.item_counts(table(spark, sf, "annotation_items"), table(spark, sf, "sites"))


def p2_token_budget(spark, sf):
    return token_budget.budget(table(spark, sf, "annotation_items"), table(spark, sf, "sites"))


def p2_update(spark, sf):
    """The signed delta of a second update: the same items, now with the text around each target."""
    items, sites = table(spark, sf, "annotation_items"), table(spark, sf, "sites")
    ledger = token_budget.Ledger(spark)
    ledger.update(token_budget.items(items, sites))
    wider = items.withColumn("wider", F.concat_ws("\n", "context_before", "target_text", "context_after"))
    return ledger.update(token_budget.items(wider, sites, "wider"))


def url_host(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def markup_texts(spark, sf):
    """(text_id, host, text) of the clean texts and of the text files of the manifest; text_id is field, tab, key."""
    corpus = table(spark, sf, "patchnote_corpus")
    a = corpus.select(F.concat(F.lit("clean_text\t"), "document_id").alias("text_id"), url_host("url").alias("host"), F.col("clean_text").alias("text"))
    paths = table(spark, sf, "page_manifest").where("text_path IS NOT NULL").groupBy("text_path").agg(F.min(url_host("url")).alias("host"))
    files = table(spark, sf, "page_files").select(F.col("path").alias("text_path"), F.col("content").alias("text"))
    b = paths.join(files, "text_path").select(F.concat(F.lit("text_path\t"), "text_path").alias("text_id"), "host", "text")
    return a.unionByName(b).where(F.col("text").isNotNull()).dropDuplicates(["text_id", "text"])


def _split_id(df, *more):
    return df.select(F.substring_index("text_id", "\t", 1).alias("field"), F.expr("substring(text_id, instr(text_id, '\t') + 1)").alias("record_key"), *more)


def p3_found(spark, sf):
    return _split_id(markup.found(markup_texts(spark, sf)), "markup").distinct()


def p3_clean(spark, sf):
    return _split_id(markup.cleaned(markup_texts(spark, sf)), "clean_text")


def p3_template(spark, sf):
    return markup.template(markup.occurrences(markup_texts(spark, sf)))


def p3_slots(spark, sf):
    return _split_id(markup.slots(markup_texts(spark, sf)), "slot_no", "after", "before", "text")


def rendered_documents(spark, sf):
    """(document_id, host, text, content) of the rendered documents with their pages; each once."""
    docs = table(spark, sf, "patchnote_corpus").where("source_kind = 'rendered_html'")
    docs = docs.select("document_id", url_host("url").alias("host"), F.col("clean_text").alias("text"), F.col("relative_source_path").alias("path")).dropDuplicates()
    return docs.join(table(spark, sf, "page_files").select("path", "content"), "path", "left").drop("path")


def p5_found(spark, sf):
    return page_body.found(rendered_documents(spark, sf))


def p5_bodies(spark, sf):
    return page_body.bodies(rendered_documents(spark, sf))


def p5_pages(spark, sf):
    paths = table(spark, sf, "scrape_results").where("raw_html_path IS NOT NULL").groupBy(F.col("raw_html_path").alias("path")).agg(F.min(url_host("url")).alias("host"))
    return page_body.page_bodies(paths.join(table(spark, sf, "page_files").select("path", "content"), "path")).withColumnRenamed("path", "raw_html_path")


def p6_found(spark, sf):
    return repetition.found(table(spark, sf, "generated_texts"))


def p6_shares(spark, sf):
    return repetition.measure(table(spark, sf, "generated_texts"))


def p7_found(spark, sf):
    return lookalike.found(table(spark, sf, "voicelines"), table(spark, sf, "patchnote_corpus"), blanks=True)


def p8_ids(spark, sf):
    return encode.encode(table(spark, sf, "documents"))


def p9_mix(spark, sf):
    return mixture.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p9_shares(spark, sf):
    return mixture.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p10_found(spark, sf):
    return language.found(table(spark, sf, "documents"))


def p10_languages(spark, sf):
    return language.languages(table(spark, sf, "documents"))


def p10_passages(spark, sf):
    return language.passages(table(spark, sf, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


P1_LINES = r"""
lines AS (
  SELECT DISTINCT game, document_id, CAST(i AS INTEGER) AS line_no, lower(regexp_replace(parts[i + 1], '[^\p{L}]', '', 'g')) AS wording
  FROM (SELECT game, document_id, string_split(clean_text, chr(10)) AS parts FROM patchnote_corpus WHERE clean_text IS NOT NULL) t, range(len(parts)) r(i)),
need AS (SELECT game, greatest(4, ceil(count(DISTINCT document_id) * 8 / 100.0)) AS need FROM patchnote_corpus GROUP BY game),
hot AS (
  SELECT l.game, wording FROM lines l JOIN need n ON l.game = n.game WHERE wording <> ''
  GROUP BY l.game, wording, need HAVING count(DISTINCT document_id) >= need),
gone AS (SELECT DISTINCT l.game, document_id, line_no FROM lines l JOIN hot h ON l.game = h.game AND l.wording = h.wording)
"""

P6_WORDS = r"""
words AS (
  SELECT DISTINCT gen_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}''’]+') AS ws FROM generated_texts),
pos AS (SELECT gen_id, text, ws, len(ws) AS n, i FROM words, range(len(ws)) r(i)),
win AS (
  SELECT gen_id, text, i, row_number() OVER (PARTITION BY gen_id, text, list_slice(ws, i + 1, i + 5) ORDER BY i) AS k
  FROM pos WHERE i + 5 <= n),
marks AS (
  SELECT p.gen_id, p.text, p.i, p.n, max(CASE WHEN w.k > 1 THEN 1 ELSE 0 END) AS r
  FROM pos p LEFT JOIN win w ON p.gen_id = w.gen_id AND p.text = w.text AND w.i BETWEEN p.i - 4 AND p.i
  GROUP BY p.gen_id, p.text, p.i, p.n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {P1_LINES} SELECT DISTINCT document_id, line_no FROM gone",
        "p1_clean": f"""WITH {P1_LINES},
            d AS (SELECT DISTINCT document_id, game, clean_text FROM patchnote_corpus),
            l AS (SELECT document_id, game, clean_text, i, parts[i + 1] AS line FROM (SELECT *, string_split(clean_text, chr(10)) AS parts FROM d WHERE clean_text IS NOT NULL) t, range(len(parts)) r(i)),
            k AS (SELECT l.document_id, l.game, l.clean_text, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.line_no IS NULL), '') AS kept, count(g.line_no) AS n FROM l LEFT JOIN gone g ON g.document_id = l.document_id AND g.game = l.game AND g.line_no = l.i GROUP BY ALL)
            SELECT d.document_id, d.game, k.kept AS clean_text, CAST(coalesce(n, 0) AS INTEGER) AS n_removed FROM d LEFT JOIN k ON d.document_id = k.document_id AND d.game = k.game AND d.clean_text = k.clean_text""",
        "p6_found": f"WITH {P6_WORDS} SELECT gen_id FROM marks GROUP BY gen_id, text HAVING sum(r) * 10 >= 3 * count(*)",
    }
