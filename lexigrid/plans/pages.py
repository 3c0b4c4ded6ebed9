"""Queries of pages, ids, topics and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions import text as X, urls as U
from lexigrid.operators import hydrate as H, pages as P, structure, topics as K
from lexigrid.plans.corpus import squeeze, unescaped
from lexigrid.plans.profile import STOP, q
from lexigrid.session import cut, table, wide


def html(spark, sf):
    return wide(spark, sf, "page_files", "path").where("path LIKE '%.html'")


def html_leaf_blocks(spark, sf):
    return P.leaf_blocks(html(spark, sf))


def html_links(spark, sf):
    return P.links(html(spark, sf))


def html_metadata(spark, sf):
    return P.metadata(html(spark, sf))


def html_blocks(spark, sf):
    return P.blocks(html(spark, sf))


def heading_paths(spark, sf):
    return P.heading_paths(P.blocks(html(spark, sf))).select("path", "pos", "heading_path")


def block_text(spark, sf):
    return P.marked_text(P.blocks(html(spark, sf)))


def block_diagnostics(spark, sf):
    return P.diagnostics(P.blocks(html(spark, sf)))


def html_structure(spark, sf):
    return structure.page_blocks(structure.structured_pages(html(spark, sf)))


def html_pages(spark, sf):
    p = structure.structured_pages(html(spark, sf))
    return p.select("path", "title", "date_text", "root_tag", F.size("blocks").alias("n_blocks"), F.size("links").alias("n_links"), "status", "error")


def url_classify(spark, sf):
    u = table(spark, sf, "page_manifest").select("url").distinct()
    c = F.col("url")
    return u.select("url", U.host(c).alias("host"), U.path(c).alias("path"), U.last_part(c).alias("slug"), U.canonical(c).alias("canonical"), U.output_id(c).alias("output_id"), U.kind(c).alias("kind"))


def page_context_score(spark, sf):
    d = wide(spark, sf, "patchnote_corpus", "document_id").dropDuplicates(["document_id", "text_sha256"])
    kind = F.when(F.col("source_kind") == "official_text", "patch_page").when(F.col("source_kind") == "legacy_text", "microsite").otherwise("newsentry")
    return d.select("document_id", P.context_score(F.col("title"), F.col("clean_text"), kind).alias("s")).select("document_id", "s.*")


def entry_classify(spark, sf):
    a = table(spark, sf, "articles").select("url", "title", "category").distinct()
    return a.select("url", "title", P.classify_entry(F.col("url"), F.concat_ws(" ", "title", "category")).alias("s")).select("url", "title", "s.*")


def manifest_lookup(spark, sf):
    return P.manifest_lookup(table(spark, sf, "page_files").select("path"), table(spark, sf, "page_manifest"))


def scrape_audit(spark, sf):
    """Scrapes accepted or skipped, with the reason."""
    s = table(spark, sf, "scrape_results").dropDuplicates()
    reason = F.when(F.col("status") == "ok", "accepted").when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).otherwise(F.concat(F.lit("status: "), "status"))
    return s.groupBy("source_kind", reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("n_text_chars").cast("bigint").alias("n_text_chars"))


def article_authors(spark, sf):
    """Each article once per URL, its authors in order without repeats."""
    a = table(spark, sf, "articles")
    first = a.groupBy("url").agg(F.min_by(F.struct("patch_id", "title", "authors"), F.struct("patch_id", "title", "discovered_from")).alias("x"))
    return first.select("url", "x.patch_id", "x.title", F.array_join(F.array_distinct("x.authors"), "; ").alias("authors"))


# ids


def annotations(spark, sf):
    d = table(spark, sf, "documents")
    m = X.md5_unit(F.lit("form"), F.col("doc_id").cast("string"))
    return d.select(F.concat(F.when(m % 3 == 0, "t3_").when(m % 3 == 1, "t1_").otherwise(""), F.col("doc_id").cast("string")).alias("id"), "source", F.when(m % 2 == 0, "yes").otherwise("0.0").alias("answer"))


def source_rows(spark, sf):
    """A source where every seventh text is missing and every fifth comes twice, later under another form."""
    d = table(spark, sf, "documents").withColumn("m", X.md5_unit(F.lit("source"), F.col("doc_id").cast("string"))).where("m % 7 <> 0")
    one = d.select(F.concat(F.when(F.col("m") % 2 == 0, "t1_").otherwise("t3_"), F.col("doc_id").cast("string")).alias("source_id"), F.col("doc_id").alias("source_pos"), "text", "source")
    two = d.where("m % 5 = 0").select(F.col("doc_id").cast("string").alias("source_id"), (F.col("doc_id") + 10**12).alias("source_pos"), F.lit("late copy").alias("text"), "source")
    return one.unionByName(two)


def hydrate_variants(spark, sf):
    r = H.rehydrate(annotations(spark, sf), source_rows(spark, sf))
    return r.select("id", "answer", "source", "source_pos", "source_id", "text", "source_source")


def hydrate_category(spark, sf):
    d = table(spark, sf, "documents")
    dim = d.select(F.upper("source").alias("name"), F.element_at(F.split("source", "-"), -1).alias("category")).where("name IS NOT NULL").distinct()
    dim = dim.unionByName(dim.select("name", F.lit("zz second").alias("category")))
    return H.with_category(d.select("doc_id", "source"), "source", dim, "name", "category", "category")


def hydrate_prepare(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(X.md5_unit(F.lit("form"), F.col("doc_id").cast("string")) % 2 == 0, "yes").otherwise("0.0").alias("answer"))
    return H.prepare(d, "text", "answer").select("doc_id", "clean_text", "story_label", "label_name")


# topics


def bow_vocabulary(spark, sf):
    return K.vocabulary(wide(spark, sf, "documents"), "doc_id", "text")


def label_distribution(spark, sf):
    return table(spark, sf, "documents").groupBy("kind").agg(F.count("*").alias("n"))


def topic_label_means(spark, sf):
    return K.label_means(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


def topic_crosstab(spark, sf):
    return K.crosstab(K.dominant(table(spark, sf, "embeddings"), "embedding"), "dominant_topic", "label", list(range(10)))


def topic_contrast(spark, sf):
    return K.contrast(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 0, 1)


def topic_representatives(spark, sf):
    return K.representatives(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


def _scored(spark, sf):
    n = F.regexp_count("text", F.lit("[0-9]"))
    return table(spark, sf, "documents").where("text IS NOT NULL").select(F.round(n / F.greatest(F.length("text"), F.lit(1)), 6).alias("score"), (F.col("kind") == "patch_notes").cast("int").alias("y"))


def roc_points(spark, sf):
    return K.roc(_scored(spark, sf))


def topic_words(spark, sf):
    return K.topic_words(K.lda(table(spark, sf, "documents").select("text"), "text", k=6))


def topic_forest(spark, sf):
    """Accuracy of topics and forest on held-out texts: kind of text from its words."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    d = cut(table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text", "kind", (X.md5_unit(F.lit("split"), F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")))
    model = K.forest(d.where("NOT held_out"), "text", "kind", trees=10)
    p = model.transform(d.where("held_out"))
    one = lambda m: MulticlassClassificationEvaluator(labelCol="label_index", metricName=m).evaluate(p)
    return spark.createDataFrame([(m, float(one(m))) for m in ("accuracy", "f1")], "measure string, value double")


def topic_nmf(spark, sf):
    """Non-negative topic factors of the vocabulary's words: the ten heaviest of each factor."""
    docs = table(spark, sf, "documents")
    vocab = K.vocabulary(docs, "doc_id", "text", max_features=500).withColumn("term", F.row_number().over(Window.orderBy("word")))  # at most max_features words
    w = docs.select(F.col("doc_id").cast("int").alias("doc"), F.explode(K.bag_tokens(F.col("text"))).alias("word")).join(vocab.select("word", "term"), "word").groupBy("doc", "term").agg(F.sqrt(F.count("*").cast("double")).alias("weight"))
    model = K.nmf(cut(w), k=6, max_iter=5)
    f = K.long_scores(model.itemFactors, "id", "features").join(vocab.select("term", "word"), F.col("id") == F.col("term"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "word"))).where("rank <= 10").select("topic", "rank", "word", F.round("score", 6).alias("weight"))


def queries() -> dict:
    names = (
        "html_leaf_blocks html_structure html_pages html_links html_metadata html_blocks heading_paths block_text block_diagnostics url_classify page_context_score entry_classify manifest_lookup scrape_audit article_authors hydrate_variants "
        "hydrate_category hydrate_prepare bow_vocabulary label_distribution topic_label_means topic_crosstab topic_contrast topic_representatives roc_points topic_words topic_forest topic_nmf"
    )
    return {n: globals()[n] for n in names.split()}


HTML = "(SELECT * FROM page_files WHERE path LIKE '%.html')"
NOISE = "'home', 'news', 'heroes', 'items', 'store', 'esports', 'login', 'logout', '(logout)', 'patches', 'gameplay updates', 'previous updates', 'play for free', 'view hero detail page', 'builds', 'steam guides'"
bare = lambda e: f"regexp_replace(regexp_replace({e}, '(?i)<br(\\s[^>]*)?/?>', ' ', 'g'), '<[^>]*>', '', 'g')"
BLOCKS = f"""
c AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(content, {q(P.DROPPED)}, ' ', 'g'), {q(P.BREAK)}, ' ', 'g'), {q(P.INLINE)}, '', 'g') AS content FROM {HTML} h),
e AS (SELECT path, regexp_extract_all(content, {q(P.BLOCK)}) AS bs FROM c),
r AS (SELECT path, CAST(i AS INTEGER) AS pos, bs[i + 1] AS b FROM e, range(len(bs)) t(i)),
x AS (SELECT path, pos, lower(regexp_extract(b, {q(P.BLOCK)}, 1)) AS tag, regexp_replace({squeeze(unescaped(f"regexp_extract(b, {q(P.BLOCK)}, 2)"))}, {q(X.ANY_ARROW)}, ' → ', 'g') AS text FROM r),
blocks AS (SELECT path, pos, tag, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag = 'li' THEN 'list_item' WHEN tag = 'td' THEN 'table_cell' ELSE 'text' END AS block_type,
  CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN CAST(substr(tag, 2, 1) AS INTEGER) END AS heading_level, text FROM x WHERE text <> '')
"""
MEANING = f"lower({squeeze('text')}) NOT IN ({NOISE}) AND NOT regexp_matches({squeeze('text')}, '(?i)^https?://') AND NOT regexp_matches({squeeze('text')}, '(?i)\\.(?:png|jpe?g|webp|gif|svg|mp4|webm|mov)(?:[?#].*)?$|cdn\\.steamstatic\\.com|dota_react/|/assets/|\\.vtex') AND NOT (length({squeeze('text')}) < 80 AND regexp_matches({squeeze('text')}, '^[A-ZÆØÅa-zæøå .''-]+ \\([A-ZÆØÅa-zæøå .''-]+\\)$')) AND NOT regexp_matches({squeeze('text')}, '^[^\\p{{L}}\\p{{N}}]+$') AND length({squeeze('text')}) >= 2"
PATH = lambda u: f"CASE WHEN regexp_replace(regexp_extract({u}, {q(U.URL_PARTS)}, 3), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract({u}, {q(U.URL_PARTS)}, 3), '/+$', '') END"
UNIT = lambda *p: f"CAST('0x' || substr(md5({' || chr(124) || '.join(p)}), 1, 8) AS BIGINT)"


#: The signals in the SQL's own words: edges of words as classes, since the engines differ on them.
SIGNAL_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(t, '(?is)(^|[^\\p{{L}}\\p{{N}}_]){p}([^\\p{{L}}\\p{{N}}_]|$)') THEN '{r}' END"
    for p, r in (
        ("patch\\s+\\d+\\.\\d+[a-z]?", "mentions a specific patch version"),
        ("introducing[^\\p{L}\\p{N}_](.*[^\\p{L}\\p{N}_])?patch", "introduces a patch"),
        ("gameplay\\s+(update|patch|changes?)", "mentions gameplay update/patch/changes"),
        ("patch\\s+\\d+\\.\\d+[a-z]?", "mentions Patch <version>"),
        ("included\\s+in\\s+this\\s+update", "contains included-in-this-update section"),
        ("the\\s+.+\\s+update\\s+is\\s+here", "announces an update release"),
        ("balance\\s+(changes?|update|patch)", "mentions balance changes"),
        ("hero\\s+(changes?|balance)", "mentions hero changes"),
        ("item\\s+(changes?|balance)", "mentions item changes"),
    )
) + "], lambda x: x IS NOT NULL)"


def heading_sql() -> str:
    pos = lambda k: f"coalesce(h{k}.pos, -1)"
    parts = []
    for k in range(1, 7):
        cond = f"h{k} IS NOT NULL" + "".join(f" AND {pos(k)} > {pos(j)}" for j in range(1, k))
        parts.append(f"CASE WHEN {cond} THEN h{k}.text END")
    last = ", ".join(f"last_value(CASE WHEN heading_level = {k} THEN {{'pos': pos, 'text': text}} END IGNORE NULLS) OVER w AS h{k}" for k in range(1, 7))
    return f"WITH {BLOCKS}, l AS (SELECT path, pos, {last} FROM blocks WINDOW w AS (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING)) SELECT path, pos, concat_ws(' > ', {', '.join(parts)}) AS heading_path FROM l"


def oracle_sql() -> dict[str, str]:
    t = squeeze("concat_ws(chr(10), title, clean_text)")
    hay = squeeze(f"concat_ws(' ', regexp_extract({PATH('url')}, '([^/]*)$', 1), title, category)")
    seg = "list_filter(string_split(lower(p), '/'), lambda x: x <> '')"
    safe = lambda e: f"regexp_replace(substr(CASE WHEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({e})), '^https?://', ''), '[^a-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[_.\\-]+|[_.\\-]+$', '', 'g') = '' THEN 'untitled' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({e})), '^https?://', ''), '[^a-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[_.\\-]+|[_.\\-]+$', '', 'g') END, 1, 120), '^[_.\\-]+|[_.\\-]+$', '', 'g')"
    long = "l AS (SELECT vec_id, label, CAST(i AS INTEGER) AS topic, CAST(embedding[i + 1] AS DOUBLE) AS score FROM embeddings, range(64) r(i))"
    rank = lambda by: f"row_number() OVER (PARTITION BY {by} ORDER BY score DESC, vec_id)"
    return {
        "html_links": f"""WITH e AS (SELECT path, regexp_extract_all(content, {q(P.LINK)}) AS ls FROM {HTML} h), r AS (SELECT path, CAST(i AS INTEGER) AS pos, regexp_replace(regexp_extract(ls[i + 1], {q(P.LINK)}, 1), '#.*$', '') AS url, {squeeze(unescaped(bare(f"regexp_extract(ls[i + 1], {q(P.LINK)}, 2)")))} AS text FROM e, range(len(ls)) t(i))
            SELECT path, pos, url, text FROM (SELECT *, row_number() OVER (PARTITION BY path, url ORDER BY pos) AS n FROM r) x WHERE n = 1""",
        "html_metadata": f"""SELECT path, {squeeze(unescaped(f"regexp_extract(content, {q(P.TITLE)}, 1)"))} AS title, CAST(len(regexp_extract_all(content, '(?i)<script')) AS BIGINT) AS n_scripts, CAST(len(regexp_extract_all(content, '(?i)<a\\s')) AS BIGINT) AS n_links,
            CAST(length({squeeze(unescaped(f"regexp_replace(regexp_replace(content, {q(P.DROPPED)}, ' ', 'g'), {q(X.TAG)}, ' ', 'g')"))}) AS BIGINT) AS visible_chars FROM {HTML} h""",
        "html_blocks": f"WITH {BLOCKS} SELECT * FROM blocks",
        "heading_paths": heading_sql(),
        "block_text": f"""WITH {BLOCKS}, f AS (SELECT *, row_number() OVER (PARTITION BY path, regexp_replace(lower({squeeze('text')}), '^[#>\\-\\s]+', '') ORDER BY pos) AS n FROM blocks WHERE {MEANING})
            SELECT path, string_agg(CASE WHEN block_type = 'heading' THEN repeat('#', heading_level) || ' ' || text WHEN block_type = 'list_item' THEN '- ' || text ELSE text END, chr(10) || chr(10) ORDER BY pos) || chr(10) AS text, count(*) AS n_blocks FROM f WHERE n = 1 GROUP BY path""",
        "block_diagnostics": f"WITH {BLOCKS} SELECT path, count(*) AS n_blocks, count(*) FILTER ({MEANING}) AS n_meaningful, array_to_string(list_sort(list(DISTINCT block_type)), ',') AS block_types FROM blocks GROUP BY path",
        "url_classify": f"""WITH u AS (SELECT DISTINCT url, {PATH('url')} AS p FROM page_manifest)
            SELECT url, lower(regexp_extract(url, {q(U.URL_PARTS)}, 2)) AS host, p AS path, regexp_extract(p, '([^/]*)$', 1) AS slug, CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '/$') THEN regexp_replace(url, '[?#].*$', '') ELSE regexp_replace(url, '[?#].*$', '') || '/' END AS canonical,
              {safe("replace(CASE WHEN regexp_replace(p, '^/+', '') = '' THEN 'home' ELSE regexp_replace(p, '^/+', '') END, '/', '_')")} AS output_id,
              CASE WHEN starts_with(p, '/newsentry/') THEN 'newsentry' WHEN starts_with(p, '/patches/') OR p = '/patches' THEN 'patch_page'
                WHEN len({seg}) = 1 AND length({seg}[1]) >= 3 AND NOT contains({seg}[1], '.') AND {seg}[1] NOT IN ('home', 'news', 'updates', 'heroes', 'items', 'esports', 'workshop', 'store', 'pastupdates', 'patches', 'play', 'main', 'leaderboards')
                  AND NOT regexp_matches('/' || {seg}[1], '^/(heroes|hero/|items|esports|workshop|store|news|patches|pastupdates|home|community|privacy|login|play|main|leaderboards)') THEN 'microsite' END AS kind FROM u""",
        "page_context_score": f"""WITH d AS (SELECT document_id, any_value(title) AS title, any_value(clean_text) AS clean_text, any_value(source_kind) AS sk FROM patchnote_corpus GROUP BY document_id, text_sha256),
            a AS (SELECT document_id, CASE sk WHEN 'official_text' THEN 'patch_page' WHEN 'legacy_text' THEN 'microsite' ELSE 'newsentry' END AS kind, {t} AS t FROM d),
            b AS (SELECT document_id, t, kind, len(list_distinct(regexp_extract_all(t, {q(P.VERSION)}, 1))) AS nv, {SIGNAL_LIST} AS rs FROM a),
            s AS (SELECT *, CASE WHEN nv > 0 THEN 30 ELSE 0 END + 20 * len(rs) + CASE WHEN kind = 'microsite' THEN 20 ELSE 0 END - CASE WHEN nv = 0 AND regexp_matches(lower(t), '(^|[^\\p{{L}}\\p{{N}}_])cosmetic|treasure|workshop|esports|tournament|tickets?([^\\p{{L}}\\p{{N}}_]|$)') THEN 25 ELSE 0 END AS score FROM b),
            r AS (SELECT *, score >= 30 OR kind = 'microsite' AND regexp_matches(lower(t), 'gameplay|included in this update|patch') AS adjacent FROM s)
            SELECT document_id, CAST(CASE WHEN kind = 'patch_page' THEN 100 ELSE score END AS INTEGER) AS score, CAST(nv AS BIGINT) AS n_versions,
              CASE WHEN kind = 'patch_page' THEN 'official /patches/<version> page' ELSE array_to_string(list_sort(CASE WHEN kind = 'microsite' THEN list_append(rs, 'official themed update microsite') ELSE rs END), '; ') END AS reasons,
              CASE WHEN kind = 'microsite' THEN 'major_update_microsite' WHEN kind = 'newsentry' AND adjacent AND (list_contains(rs, 'mentions a specific patch version') OR list_contains(rs, 'introduces a patch')) THEN 'patch_announcement' ELSE kind END AS subkind,
              CASE WHEN kind = 'patch_page' THEN 'primary_patchnote' WHEN adjacent THEN 'patch_adjacent_context' ELSE 'general_official_communication' END AS role FROM r""",
        "entry_classify": f"""WITH a AS (SELECT DISTINCT url, title, category FROM articles), b AS (SELECT url, title, lower({hay}) AS hay, contains(lower({PATH('url')}) || '/', '/news/') AS ok FROM a),
            c AS (SELECT *, regexp_matches(hay, 'teamfight tactics|tft|esports|worlds|cosmetic|skin|merch|shop') AS leave,
              regexp_matches(hay, 'gameplay|season|summoner|rift|patch|ranked|mmr|balance|pbe|champion|item|objective|jungle|lane|role|map|bount|atakhan|void|wasd|tl;dw|dev update') AS take FROM b)
            SELECT url, title, ok AND NOT leave AND take AS include, CASE WHEN NOT ok THEN 'not_written_article' WHEN leave THEN 'excluded_by_keyword' WHEN take THEN 'included_by_keyword' ELSE 'no_keyword' END AS reason FROM c""",
        "manifest_lookup": """WITH k AS (SELECT unnest([raw_html_path, text_path, output_id]) AS key, output_id, url, title, status FROM page_manifest), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY output_id DESC, url DESC, status DESC, coalesce(title, '') DESC) AS n FROM k WHERE trim(coalesce(key, '')) <> '') x WHERE n = 1)
            SELECT p.path, CASE WHEN a.key IS NOT NULL THEN a.output_id ELSE b.output_id END AS output_id, CASE WHEN a.key IS NOT NULL THEN a.title ELSE b.title END AS title, CASE WHEN a.key IS NOT NULL THEN a.status ELSE b.status END AS status
            FROM page_files p LEFT JOIN l a ON p.path = a.key LEFT JOIN l b ON regexp_replace(regexp_extract(p.path, '([^/]*)$', 1), '\\.[A-Za-z0-9]+$', '') = b.key""",
        "scrape_audit": "WITH s AS (SELECT DISTINCT * FROM scrape_results) SELECT source_kind, CASE WHEN status = 'ok' THEN 'accepted' WHEN error IS NOT NULL THEN 'error: ' || error ELSE 'status: ' || status END AS reason, count(*) AS n, CAST(sum(n_text_chars) AS BIGINT) AS n_text_chars FROM s GROUP BY ALL",
        "article_authors": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY patch_id, title, discovered_from) AS n FROM articles)
            SELECT url, patch_id, title, array_to_string(list_filter(authors, lambda x, i: list_position(authors, x) = i), '; ') AS authors FROM f WHERE n = 1""",
        "hydrate_variants": f"""WITH d AS (SELECT *, {UNIT("'form'", "CAST(doc_id AS VARCHAR)")} AS f, {UNIT("'source'", "CAST(doc_id AS VARCHAR)")} AS m FROM documents),
            a AS (SELECT CASE f % 3 WHEN 0 THEN 't3_' WHEN 1 THEN 't1_' ELSE '' END || doc_id AS id, doc_id, source, CASE WHEN f % 2 = 0 THEN 'yes' ELSE '0.0' END AS answer FROM d),
            s AS (SELECT CASE WHEN m % 2 = 0 THEN 't1_' ELSE 't3_' END || doc_id AS source_id, doc_id, text, source FROM d WHERE m % 7 <> 0)
            SELECT id, answer, a.source, s.doc_id AS source_pos, source_id, text, s.source AS source_source FROM a LEFT JOIN s USING (doc_id)""",
        "hydrate_category": "SELECT doc_id, source, string_split(source, '-')[-1] AS category FROM documents",
        "hydrate_prepare": f"""WITH d AS (SELECT doc_id, {squeeze(f"regexp_replace(regexp_replace({unescaped(chr(39).join(['coalesce(text, ', '', ')']))}, 'https?://[^\\s\\p{{Z}}]+|www\\.[^\\s\\p{{Z}}]+', ' ', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])[ru]/[\\p{{L}}\\p{{N}}_]+', '\\1 ', 'g')")} AS clean_text, {UNIT("'form'", "CAST(doc_id AS VARCHAR)")} % 2 = 0 AS y FROM documents)
            SELECT doc_id, clean_text, CAST(y AS INTEGER) AS story_label, CASE WHEN y THEN 'story' ELSE 'no_story' END AS label_name FROM d WHERE length(clean_text) >= 50""",
        "bow_vocabulary": f"""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), {q(K.WORDS)}), lambda w: w NOT IN ({STOP})) AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word FROM d),
            g AS (SELECT word, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM w GROUP BY word) SELECT word, n_docs, n FROM g WHERE n_docs >= 5 AND n_docs <= (SELECT count(*) FROM documents) * 0.95 ORDER BY n DESC, word LIMIT 1000""",
        "label_distribution": "SELECT kind, count(*) AS n FROM documents GROUP BY kind",
        "topic_label_means": f"WITH {long} SELECT label, topic, round(avg(score), 6) AS mean_score FROM l GROUP BY label, topic",
        "topic_crosstab": "WITH d AS (SELECT label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS dominant_topic FROM embeddings) SELECT dominant_topic, " + ", ".join(f"count(*) FILTER (label = {v}) AS label_{v}" for v in range(10)) + " FROM d GROUP BY dominant_topic",
        "topic_contrast": f"WITH {long}, m AS (SELECT topic, avg(score) FILTER (label = 0) AS a, avg(score) FILTER (label = 1) AS b FROM l WHERE label IN (0, 1) GROUP BY topic) SELECT topic, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(b - a, 6) AS difference, round(abs(b - a), 6) AS abs_difference FROM m",
        "topic_representatives": f"WITH {long}, o AS (SELECT *, {rank('topic')} AS rank FROM l), w AS (SELECT *, {rank('topic, label')} AS rank FROM l) SELECT topic, 'overall' AS subset, CAST(rank AS INTEGER) AS rank, label, vec_id, round(score, 6) AS score FROM o WHERE rank <= 3 UNION ALL SELECT topic, 'within_label', CAST(rank AS INTEGER), label, vec_id, round(score, 6) FROM w WHERE rank <= 3",
        "roc_points": """WITH s AS (SELECT round(len(regexp_extract_all(text, '[0-9]')) * 1.0 / greatest(length(text), 1), 6) AS score, CAST(kind = 'patch_notes' AS INTEGER) AS y FROM documents WHERE text IS NOT NULL), c AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY score)
            SELECT score AS threshold, round(sum(p) OVER w / sum(p) OVER (), 9) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 9) AS fpr FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""",
    }
