"""Queries of the corpus, unit and item operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import text as X
from lexigrid.operators import corpus as C
from lexigrid.plans.profile import q
from lexigrid.session import table, wide


def documents(spark, sf):
    """Each document once (some rows are delivered twice)."""
    return wide(spark, sf, "patchnote_corpus", "document_id").dropDuplicates(["document_id", "text_sha256"])


def corpus_build(spark, sf):
    return C.build(documents(spark, sf))


def corpus_summary(spark, sf):
    return C.summary(corpus_build(spark, sf))


def units_segment(spark, sf):
    return C.units(documents(spark, sf))


def units_summary(spark, sf):
    u = units_segment(spark, sf)
    return u.groupBy("game", "unit_type", "included").agg(F.count("*").alias("n_units"), F.sum("word_count").cast("bigint").alias("n_words"), F.median("word_count").cast("double").alias("median_words"))


def items_context(spark, sf):
    return C.items(documents(spark, sf))


def items_summary(spark, sf):
    i = items_context(spark, sf)
    return i.groupBy("game", "target_type").agg(F.count("*").alias("n_items"), F.sum("target_word_count").cast("bigint").alias("n_words"), F.median("target_word_count").cast("double").alias("median_words"))


def items_audit(spark, sf):
    """Two audits: units left out that look like a change, and targets of at most two words."""
    u = units_segment(spark, sf)
    missed = u.where(~F.col("included") & F.col("text").rlike(C.CHANGE)).groupBy("game").agg(F.count("*").alias("n")).select("game", F.lit("left out, change-like").alias("audit"), "n")
    short = u.where(F.col("included") & (F.col("word_count") <= 2)).groupBy("game").agg(F.count("*").alias("n")).select("game", F.lit("target of two words").alias("audit"), "n")
    return missed.unionByName(short)


def patch_and_year(spark, sf):
    t = documents(spark, sf)
    return t.select("document_id", X.version_of(F.col("title"), F.col("url")).alias("version"), X.year_of(F.col("clean_text"), F.col("title")).alias("year_found"))


def versions_sorted(spark, sf):
    """Each version once per game, newest first, up to and with the stop version 14.1."""
    from pyspark.sql.window import Window

    v = table(spark, sf, "patchnote_corpus").select("game", "patch_id").distinct()
    w = Window.partitionBy("game").orderBy(F.desc(X.version_key(F.col("patch_id"))), F.desc("patch_id"))
    v = v.withColumn("pos", F.row_number().over(w))
    stop = F.min(F.when(F.col("patch_id") == "14.1", F.col("pos"))).over(Window.partitionBy("game"))
    return v.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("pos") <= F.col("stop"))).select("game", "pos", "patch_id")


def queries() -> dict:
    names = ("corpus_build", "corpus_summary", "units_segment", "units_summary", "items_context", "items_summary", "items_audit", "patch_and_year", "versions_sorted")
    return {n: globals()[n] for n in names}


def _in(values) -> str:
    return ", ".join(q(v) for v in values)


def unescaped(e: str) -> str:
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&rarr;", "→"), ("&mdash;", "—"), ("&copy;", "©"), ("&#8594;", "→"), ("&amp;", "&")):
        e = f"replace({e}, {q(name)}, {q(ch)})"
    return e


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(X.WS)}, ' ', 'g'))"


def words(e: str) -> str:
    return f"len(regexp_extract_all({e}, {q(X.WORD)}))"


def clean_line(e: str) -> str:
    t = f"regexp_replace({e}, {q(X.MD_IMAGE)}, '', 'g')"
    t = f"regexp_replace({t}, {q(X.MD_LINK)}, '\\1', 'g')"
    t = f"regexp_replace({t}, {q(X.URL)}, '', 'g')"
    t = unescaped(f"regexp_replace({t}, {q(X.TAG)}, ' ', 'g')")
    t = f"regexp_replace(regexp_replace({t}, {q(X.BULLET)}, ''), {q(X.ANY_ARROW)}, ' → ', 'g')"
    return squeeze(t)


DOCS = "docs AS (SELECT document_id, any_value(game) AS game, any_value(source_kind) AS source_kind, any_value(patch_id) AS patch_id, any_value(year) AS year, any_value(title) AS title, any_value(url) AS url, any_value(clean_text) AS clean_text FROM patchnote_corpus GROUP BY document_id, text_sha256)"
#: The values of the two lists and of the closing lines, in the SQL's own words.
CLOSING = "'dota and the dota logo are trademarks and/or registered trademarks of valve corporation.', '2025 valve corporation, all rights reserved.', 'dota and the dota logo are trademarks and/or registered trademarks of valve corporation. 2025 valve corporation, all rights reserved.'"
FURNITURE = (
    "'back to top', 'share', 'copy link', 'copied', 'show more', 'read more', 'load more', 'home', 'news', 'heroes', 'items', 'store', 'esports', 'login', 'logout', '(logout)', 'patches', 'gameplay updates', 'previous updates', "
    f"'select language', 'play for free', 'builds', 'steam guides', 'view hero detail page', 'english', {CLOSING}"
)
BUILD = f"""
WITH {DOCS},
l0 AS (SELECT document_id, i, parts[i + 1] AS line FROM (SELECT document_id, regexp_split_to_array(coalesce(clean_text, ''), '\\r\\n|\\n|\\r') AS parts FROM docs) d, range(len(parts)) r(i)),
l1 AS (SELECT document_id, i, {clean_line("line")} AS line FROM l0 WHERE NOT regexp_matches(line, {q(X.MD_IMAGE)})),
l2 AS (SELECT *, lower(regexp_replace(line, '^[# \\-*•\\t]+|[# \\-*•\\t]+$', '', 'g')) AS bare FROM l1 WHERE line <> ''),
l3 AS (SELECT *, lag(line) OVER (PARTITION BY document_id ORDER BY i) AS before FROM l2 WHERE bare <> '' AND bare NOT IN ({FURNITURE})),
t AS (SELECT document_id, string_agg(line, chr(10) ORDER BY i) AS clean_text, count(*) AS line_count FROM l3 WHERE before IS NULL OR before <> line GROUP BY document_id),
c AS (SELECT d.document_id, game, source_kind, patch_id, year, title, url, t.clean_text, line_count, CAST({words("t.clean_text")} AS BIGINT) AS word_count, sha256(t.clean_text) AS text_sha256 FROM docs d JOIN t USING (document_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY document_id, game, patch_id, title) AS n FROM c WHERE word_count >= 20)
SELECT * EXCLUDE (n) FROM r WHERE n = 1
"""
STRONG = lambda e: f"(regexp_matches({e}, {q(X.ARROW)}) OR regexp_matches({e}, {q(C.CHANGE)}) OR ((regexp_matches({e}, {q(C.NUMBER)}) OR regexp_matches({e}, {q(C.PERCENT)})) AND regexp_matches({e}, {q(C.STAT)})))"
TOLD = f"(regexp_matches(t, {q(C.STAT)}) OR regexp_matches(t, {q(C.CHANGE)}))"
UNITS = f"""
{DOCS},
u0 AS (SELECT *, list_filter(string_split(coalesce(clean_text, ''), chr(10)), lambda x: {squeeze("x")} <> '') AS ls FROM docs),
u1 AS (SELECT document_id, game, source_kind, patch_id, year, title, url, i + 1 AS line_index, {squeeze("ls[i + 1]")} AS s FROM u0, range(len(ls)) r(i)),
u2 AS (SELECT *, regexp_matches(s, {q(X.HEADING)}) AS heading,
  CASE WHEN regexp_matches(s, {q(X.HEADING)}) THEN regexp_replace({squeeze(f"regexp_extract(s, {q(X.HEADING)}, 1)")}, '^:+|:+$', '', 'g') ELSE trim(regexp_replace(s, {q(C.LINE_MARKS)}, '')) END AS t FROM u1),
u3 AS (SELECT *, regexp_replace(t, '^[ :]+|[ :]+$', '', 'g') AS bare, {words("t")} AS wc FROM u2 WHERE t <> ''),
u4 AS (SELECT *,
  CASE WHEN bare = '' OR lower(bare) IN ({CLOSING}) THEN true WHEN {STRONG("bare")} THEN false WHEN heading THEN true WHEN lower(bare) IN ({_in(C.CONTEXT_HEADINGS)}) THEN true ELSE {words("bare")} <= 6 AND NOT regexp_matches(bare, '[.!?]$') END AS ctx,
  CASE WHEN wc = 0 OR lower(t) IN ({CLOSING}) THEN false WHEN regexp_matches(t, {q(X.ARROW)}) THEN true WHEN regexp_matches(t, {q(C.PERCENT)}) AND wc <= 40 THEN true
       WHEN regexp_matches(t, {q(C.NUMBER)}) AND wc <= 40 AND (contains(t, ':') OR {TOLD}) THEN true
       WHEN wc <= 30 AND regexp_matches(t, {q(C.CHANGE)}) AND NOT regexp_matches(t, '[.!?]$') THEN true ELSE contains(t, ':') AND wc <= 30 AND {TOLD} END AS stat FROM u3),
u5 AS (SELECT *, CASE WHEN ctx OR stat THEN [t] ELSE list_filter(list_transform(string_split(regexp_replace({squeeze("t")}, {q(X.SENTENCE_CUT)}, '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') END AS parts FROM u4),
u6 AS (SELECT * EXCLUDE (t), j, parts[j + 1] AS text, CASE WHEN ctx THEN 'context_only_short_unit' WHEN stat THEN 'stat_or_list_line' ELSE 'prose_sentence' END AS unit_type FROM u5, range(len(parts)) r(j)),
units AS (SELECT document_id, game, source_kind, patch_id, year, title, url, row_number() OVER (PARTITION BY document_id ORDER BY line_index, j) AS unit_order, line_index, unit_type, NOT ctx AS candidate,
  NOT ctx AND {words("text")} >= 1 AS included, text, CAST({words("text")} AS BIGINT) AS word_count FROM u6)
"""
ITEMS = f"""
{UNITS},
w AS (SELECT *, string_agg(text, ' || ') OVER (PARTITION BY document_id ORDER BY unit_order ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS cb,
        string_agg(text, ' || ') OVER (PARTITION BY document_id ORDER BY unit_order ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ca FROM units),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY unit_order) AS item_order FROM w WHERE included),
items AS (SELECT document_id || '__item_' || lpad(CAST(item_order AS VARCHAR), 5, '0') AS item_id, document_id, game, source_kind, patch_id, year, title, url, item_order, unit_order, line_index, unit_type AS target_type,
  coalesce(cb, '') AS context_before, text AS target_text, coalesce(ca, '') AS context_after, word_count AS target_word_count, CAST(length(text) AS BIGINT) AS target_char_count, sha256(text) AS target_sha256 FROM n)
"""


def version_of(cols) -> str:
    one = lambda c, p: f"CASE WHEN regexp_extract(coalesce({c}, ''), {q(p)}, 1) <> '' THEN CAST(CAST(regexp_extract({c}, {q(p)}, 1) AS INT) AS VARCHAR) || '.' || CAST(CAST(regexp_extract({c}, {q(p)}, 2) AS INT) AS VARCHAR) || lower(regexp_extract({c}, {q(p)}, 3)) END"
    return "coalesce(" + ", ".join(one(c, p) for c in cols for p in X.VERSION_FORMS) + ")"


def oracle_sql() -> dict[str, str]:
    year = lambda c: f"nullif(regexp_extract(coalesce({c}, ''), {q(X.YEAR)}, 1), '')"
    key = "CAST(regexp_extract(patch_id, '^(\\d+)', 1) AS INT) DESC, CAST(regexp_extract(patch_id, '^\\d+\\.(\\d+)', 1) AS INT) DESC, regexp_extract(patch_id, '([a-z]*)$', 1) DESC, patch_id DESC"
    return {
        "corpus_build": BUILD,
        "corpus_summary": f"SELECT game, count(*) AS n_documents, CAST(sum(word_count) AS BIGINT) AS n_words, CAST(median(word_count) AS DOUBLE) AS median_words FROM ({BUILD}) b GROUP BY game",
        "units_segment": f"WITH {UNITS} SELECT * EXCLUDE (source_kind, year, title, url) FROM units",
        "units_summary": f"WITH {UNITS} SELECT game, unit_type, included, count(*) AS n_units, CAST(sum(word_count) AS BIGINT) AS n_words, CAST(median(word_count) AS DOUBLE) AS median_words FROM units GROUP BY ALL",
        "items_context": f"WITH {ITEMS} SELECT * FROM items",
        "items_summary": f"WITH {ITEMS} SELECT game, target_type, count(*) AS n_items, CAST(sum(target_word_count) AS BIGINT) AS n_words, CAST(median(target_word_count) AS DOUBLE) AS median_words FROM items GROUP BY ALL",
        "items_audit": f"WITH {UNITS} SELECT game, 'left out, change-like' AS audit, count(*) AS n FROM units WHERE NOT included AND regexp_matches(text, {q(C.CHANGE)}) GROUP BY game UNION ALL SELECT game, 'target of two words', count(*) FROM units WHERE included AND word_count <= 2 GROUP BY game",
        "patch_and_year": f"WITH {DOCS} SELECT document_id, {version_of(('title', 'url'))} AS version, CAST(coalesce({year('clean_text')}, {year('title')}) AS INT) AS year_found FROM docs",
        "versions_sorted": f"""
            WITH v AS (SELECT DISTINCT game, patch_id FROM patchnote_corpus), p AS (SELECT game, patch_id, row_number() OVER (PARTITION BY game ORDER BY {key}) AS pos FROM v),
            s AS (SELECT *, min(CASE WHEN patch_id = '14.1' THEN pos END) OVER (PARTITION BY game) AS stop FROM p)
            SELECT game, CAST(pos AS INTEGER) AS pos, patch_id FROM s WHERE stop IS NULL OR pos <= stop""",
    }
