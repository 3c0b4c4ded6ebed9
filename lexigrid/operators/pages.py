"""Pages as blocks: leaf text, links, metadata, heading paths, text with marks and page roles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from lexigrid.functions import text as X, urls as U
from lexigrid.operators.corpus import RENDERED_NOISE
from lexigrid.session import spread

#: Elements whose text counts as visible.
TEXT_TAGS = ("div", "span", "a", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Tree(HTMLParser):
    """A light element tree: (tag, parent, text parts, children); tags that don't close end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = [["#root", -1, [], []]]
        self.at = 0

    def handle_starttag(self, tag, attrs):
        node = len(self.nodes)
        self.nodes.append([tag, self.at, [], [], dict(attrs)])
        self.nodes[self.at][3].append(node)
        self.nodes[self.at][2].append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        at = self.at
        while at > 0 and self.nodes[at][0] != tag:
            at = self.nodes[at][1]
        if at > 0:
            self.at = self.nodes[at][1]

    def handle_data(self, data):
        self.nodes[self.at][2].append(data)

    def texts(self) -> list[str]:
        """The squeezed text of every element, children first."""
        out = [""] * len(self.nodes)
        for i in range(len(self.nodes) - 1, -1, -1):
            if self.nodes[i][0] in ("script", "style"):
                continue
            out[i] = " ".join(" ".join(out[x] if isinstance(x, int) else x for x in self.nodes[i][2]).split())
        return out


def leaf_texts(content: str | None, shortest: int = 2, longest: int = 240, noise=RENDERED_NOISE) -> list[str]:
    """The texts of elements without a child that has text of its own, in page order, equal neighbours once."""
    if not content:
        return []
    tree = Tree()
    tree.feed(content)
    tree.close()
    texts = tree.texts()
    drop = set(noise)
    # elements whose own or inner attributes or text lead to another language
    other = [any("?l=" in str(v or "") for v in node[4].values()) if len(node) > 4 else False for node in tree.nodes]
    for i in range(len(tree.nodes) - 1, 0, -1):
        other[tree.nodes[i][1]] |= other[i]
    out: list[str] = []
    for i, node in enumerate(tree.nodes):
        t = texts[i]
        if node[0] not in TEXT_TAGS or not shortest <= len(t) <= longest or t.lower() in drop:
            continue
        if any(tree.nodes[k][0] in TEXT_TAGS and texts[k] and texts[k].lower() not in drop for k in node[3]):
            continue
        if other[i] or "?l=" in t or "Select Language" in t or out and out[-1] == t:
            continue
        out.append(t)
    return out


def leaf_blocks(pages: DataFrame) -> DataFrame:
    """(path, pos, text) of the leaf texts of each (path, content)."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, i, t) for p, c in zip(pdf["path"], pdf["content"]) for i, t in enumerate(leaf_texts(c))], columns=schema.names)

    return spread(pages.select("path", "content")).mapInPandas(run, schema)


LINK = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?([^"'\s>]*)["']?[^>]*>(.*?)</a>"""
#: Inline elements go first, so a block's text reaches to the next tag of a block.
INLINE = r"(?i)</?(?:a|abbr|b|bdi|bdo|cite|code|em|font|i|ins|kbd|mark|q|s|samp|span|strong|sub|sup|tt|u|var)(?:\s[^>]*)?/?>"
BREAK = r"(?i)<br(?:\s[^>]*)?/?>"
BLOCK = r"(?i)<(h[1-6]|p|li|td|div|small)(?:\s[^>]*)?>([^<]+)"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
DROPPED = r"(?is)<(?:script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>"


def _bare(c) -> Column:
    """Text without its inline tags; a line break is a space."""
    return F.regexp_replace(F.regexp_replace(c, BREAK, " "), r"<[^>]*>", "")


def links(pages: DataFrame) -> DataFrame:
    """(path, pos, url, text): the links of each page, the first of equal targets kept."""
    every = F.regexp_extract_all("content", F.lit(LINK), F.lit(0))
    rows = pages.select("path", F.posexplode(every).alias("pos", "a")).select("path", "pos", U.canonical(F.regexp_extract("a", LINK, 1), keep_query=True).alias("url"), X.squeeze(X.unescaped(_bare(F.regexp_extract("a", LINK, 2)))).alias("text"))
    return rows.groupBy("path", "url").agg(F.min_by(F.struct("pos", "text"), "pos").alias("x")).select("path", "x.pos", "url", "x.text")


def metadata(pages: DataFrame) -> DataFrame:
    """(path, title, n_scripts, n_links, visible_chars): what the page says of itself."""
    visible = X.squeeze(X.unescaped(F.regexp_replace(F.regexp_replace("content", DROPPED, " "), X.TAG, " ")))
    return pages.select(
        "path", X.squeeze(X.unescaped(F.regexp_extract("content", TITLE, 1))).alias("title"), F.regexp_count("content", F.lit(r"(?i)<script")).cast("bigint").alias("n_scripts"),
        F.regexp_count("content", F.lit(r"(?i)<a\s")).cast("bigint").alias("n_links"), F.length(visible).cast("bigint").alias("visible_chars"),
    )


def blocks(pages: DataFrame) -> DataFrame:
    """(path, pos, tag, block_type, heading_level, text): blocks with text of their own, inline elements included."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", DROPPED, " "), BREAK, " "), INLINE, "")
    every = F.regexp_extract_all(flat, F.lit(BLOCK), F.lit(0))
    rows = pages.select("path", F.posexplode(every).alias("pos", "b")).select("path", "pos", F.lower(F.regexp_extract("b", BLOCK, 1)).alias("tag"), F.regexp_replace(X.squeeze(X.unescaped(F.regexp_extract("b", BLOCK, 2))), X.ANY_ARROW, " → ").alias("text"))
    kind = F.when(F.col("tag").rlike("^h[1-6]$"), "heading").when(F.col("tag") == "li", "list_item").when(F.col("tag") == "td", "table_cell").otherwise("text")
    return rows.where("text <> ''").select("path", "pos", "tag", kind.alias("block_type"), F.when(kind == "heading", F.substring("tag", 2, 1).cast("int")).alias("heading_level"), "text")


def heading_paths(b: DataFrame, levels: int = 6) -> DataFrame:
    """b with heading_path: the open headings above (and with) each block, joined by ' > '.

    A heading of a level is open if it stands later than every heading of a higher level. One page is one
    window, whatever its number of blocks.
    """
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("heading_level") == k, F.struct("pos", "text")), ignorenulls=True).over(w) for k in range(1, levels + 1)]
    d = b.withColumns({f"__h{k}": c for k, c in enumerate(last, 1)})
    pos = lambda k: F.coalesce(F.col(f"__h{k}")["pos"], F.lit(-1))
    parts = []
    for k in range(1, levels + 1):
        alive = F.col(f"__h{k}").isNotNull()
        for j in range(1, k):
            alive = alive & (pos(k) > pos(j))
        parts.append(F.when(alive, F.col(f"__h{k}")["text"]))
    return d.withColumn("heading_path", F.concat_ws(" > ", *parts)).drop(*[f"__h{k}" for k in range(1, levels + 1)])


def text_key(c) -> Column:
    return F.regexp_replace(F.lower(X.squeeze(c)), r"^[#>\-\s]+", "")


#: Texts of a site's menus; marks of addresses of assets.
MENU_TEXTS = (
    "home", "news", "heroes", "items", "store", "esports", "login", "logout", "(logout)", "patches", "gameplay updates", "previous updates", "play for free", "view hero detail page", "builds", "steam guides",
)
ASSET_ENDS = r"(?i)\.(?:png|jpe?g|webp|gif|svg|mp4|webm|mov)(?:[?#].*)?$"
ASSET_MARKS = ("cdn.steamstatic.com", "dota_react/", "/assets/", ".vtex")
LANGUAGE_ENTRY = r"^[A-ZÆØÅa-zæøå .'-]+ \([A-ZÆØÅa-zæøå .'-]+\)$"


def meaningful(c) -> Column:
    """Not a menu's text or language entry, a URL, an asset's address, signs alone or a single character."""
    t = X.squeeze(c)
    asset = t.rlike(ASSET_ENDS)
    for mark in ASSET_MARKS:
        asset = asset | F.contains(F.lower(t), F.lit(mark))
    language = t.rlike(LANGUAGE_ENTRY) & (F.length(t) < 80)
    return ~F.lower(t).isin(*MENU_TEXTS) & ~t.rlike(r"(?i)^https?://") & ~asset & ~t.rlike(r"^[^\p{L}\p{N}]+$") & ~language & (F.length(t) >= 2)


def marked_text(b: DataFrame) -> DataFrame:
    """(path, text, n_blocks): each page's meaningful blocks as text with heading and list marks, equal texts once."""
    d = b.where(meaningful(F.col("text"))).withColumn("k", text_key(F.col("text")))
    first = d.groupBy("path", "k").agg(F.min_by(F.struct("pos", "block_type", "heading_level", "text"), "pos").alias("x")).select("path", "x.*")
    mark = F.when(F.col("block_type") == "heading", F.concat(F.repeat(F.lit("#"), F.col("heading_level")), F.lit(" "), "text")).when(F.col("block_type") == "list_item", F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    g = first.select("path", "pos", mark.alias("line")).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("ls"))
    return g.select("path", F.concat(F.array_join("ls", "\n\n"), F.lit("\n")).alias("text"), F.size("ls").cast("bigint").alias("n_blocks"))


def diagnostics(b: DataFrame) -> DataFrame:
    return b.groupBy("path").agg(F.count("*").alias("n_blocks"), F.count_if(meaningful(F.col("text"))).alias("n_meaningful"), F.array_join(F.array_sort(F.collect_set("block_type")), ",").alias("block_types"))


#: Signals of a page that goes with a patch, and their names.
SIGNALS = [
    (r"(?is)(?:^|[^\p{L}\p{N}_])introducing[^\p{L}\p{N}_].*[^\p{L}\p{N}_]patch(?:[^\p{L}\p{N}_]|$)", "introduces a patch"),
    (r"(?i)(?:^|[^\p{L}\p{N}_])gameplay\s+(?:update|patch|changes?)(?:[^\p{L}\p{N}_]|$)", "mentions gameplay update/patch/changes"),
    (r"(?i)(?:^|[^\p{L}\p{N}_])patch\s+\d+\.\d+[a-z]?(?:[^\p{L}\p{N}_]|$)", "mentions Patch <version>"),
    (r"(?i)(?:^|[^\p{L}\p{N}_])included\s+in\s+this\s+update(?:[^\p{L}\p{N}_]|$)", "contains included-in-this-update section"),
    (r"(?i)(?:^|[^\p{L}\p{N}_])the\s+.+\s+update\s+is\s+here(?:[^\p{L}\p{N}_]|$)", "announces an update release"),
    (r"(?i)(?:^|[^\p{L}\p{N}_])balance\s+(?:changes?|update|patch)(?:[^\p{L}\p{N}_]|$)", "mentions balance changes"),
    (r"(?i)(?:^|[^\p{L}\p{N}_])hero\s+(?:changes?|balance)(?:[^\p{L}\p{N}_]|$)", "mentions hero changes"),
    (r"(?i)(?:^|[^\p{L}\p{N}_])item\s+(?:changes?|balance)(?:[^\p{L}\p{N}_]|$)", "mentions item changes"),
]
VERSION = r"(?:^|[^0-9.])([0-9]{1,2}\.[0-9]{1,2}[a-z]?)(?:[^0-9A-Za-z]|$)"
SHOP = r"(?i)(?:^|[^\p{L}\p{N}_])cosmetic|treasure|workshop|esports|tournament|tickets?(?:[^\p{L}\p{N}_]|$)"
#: What makes a themed page one of a patch, and the reasons that its kind and a named version give.
THEMED = ("gameplay", "included in this update", "patch")
THEMED_REASON, VERSION_REASON, PATCH_PAGE_REASON = "official themed update microsite", "mentions a specific patch version", "official /patches/<version> page"


def context_score(title, body, kind=None) -> Column:
    """A struct (score, n_versions, reasons, subkind, role): how surely a page of a kind (newsentry, patch_page, microsite or
    another) goes with a patch. A named version counts as two reasons; what a themed page is by kind counts once."""
    kind = F.lit(None).cast("string") if kind is None else kind
    t = X.squeeze(F.concat_ws("\n", title, body))
    versions = F.array_distinct(F.regexp_extract_all(t, F.lit(VERSION), F.lit(1)))
    named = t.rlike(dict((r, p) for p, r in SIGNALS)["mentions Patch <version>"])
    signals = F.array_compact(F.array(F.when(named, F.lit(VERSION_REASON)), *[F.when(t.rlike(p), F.lit(r)) for p, r in SIGNALS]))
    themed = F.coalesce(kind == "microsite", F.lit(False))
    score = F.when(F.size(versions) > 0, 30).otherwise(0) + 20 * F.size(signals) + F.when(themed, 20).otherwise(0) - F.when(t.rlike(SHOP) & (F.size(versions) == 0), 25).otherwise(0)
    low = F.lower(t)
    about = F.contains(low, F.lit(THEMED[0])) | F.contains(low, F.lit(THEMED[1])) | F.contains(low, F.lit(THEMED[2]))
    adjacent = (score >= 30) | (themed & about)
    announces = F.coalesce(kind == "newsentry", F.lit(False)) & adjacent & (named | t.rlike(SIGNALS[0][0]))
    reasons = F.array_join(F.array_sort(F.concat(F.when(themed, F.array(F.lit(THEMED_REASON))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)")), signals)), "; ")
    patch_page = F.coalesce(kind == "patch_page", F.lit(False))
    return F.struct(
        F.when(patch_page, 100).otherwise(score).cast("int").alias("score"), F.size(versions).cast("bigint").alias("n_versions"), F.when(patch_page, PATCH_PAGE_REASON).otherwise(reasons).alias("reasons"),
        F.when(patch_page, "patch_page").when(themed, "major_update_microsite").when(announces, "patch_announcement").otherwise(kind).alias("subkind"),
        F.when(patch_page, "primary_patchnote").when(adjacent, "patch_adjacent_context").otherwise("general_official_communication").alias("role"),
    )


#: Keywords that leave a developer post out or take it in.
EXCLUDE = ("teamfight tactics", "tft", "esports", "worlds", "cosmetic", "skin", "merch", "shop")
INCLUDE = (
    "gameplay", "season", "summoner", "rift", "patch", "ranked", "mmr", "balance", "pbe", "champion", "item", "objective", "jungle", "lane", "role", "map", "bount", "atakhan", "void", "wasd", "tl;dw", "dev update",
)


def classify_entry(url, listing, seeds=(), mode: str = "gameplay-context", part: str = "/news/") -> Column:
    """A struct (include, reason) of a listed post, by its URL and the text of its listing."""
    hay = F.lower(X.squeeze(F.concat_ws(" ", U.last_part(url), listing)))
    any_of = lambda ks: F.expr("false") if not ks else hay.rlike("|".join(re.escape(k) for k in ks))
    rule = lambda include, reason: F.struct(F.lit(include).alias("include"), F.lit(reason).alias("reason"))
    out = F.when(~F.contains(F.concat(F.lower(U.path(url)), F.lit("/")), F.lit(part)), rule(False, "not_written_article"))
    if seeds:
        out = out.when(U.canonical(url).isin(*seeds), rule(True, "explicit_seed_url"))
    if mode == "all-written":
        return out.otherwise(rule(True, "all_written_articles"))
    return out.when(any_of(EXCLUDE), rule(False, "excluded_by_keyword")).when(any_of(INCLUDE), rule(True, "included_by_keyword")).otherwise(rule(False, "no_keyword"))


def manifest_lookup(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, output_id, title, status): each page with the last manifest row that names it by path or stem."""
    order = F.struct("output_id", "url", "status", F.coalesce("title", F.lit("")))
    keyed = manifest.select(F.explode(F.array_compact(F.array("raw_html_path", "text_path", "output_id"))).alias("key"), "output_id", "title", "status", order.alias("o"))
    last = keyed.where(F.trim("key") != "").groupBy("key").agg(F.max_by(F.struct("output_id", "title", "status"), "o").alias("m"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z0-9]+$", "")
    a, b = last.select(F.col("key").alias("k1"), F.col("m").alias("m1")), last.select(F.col("key").alias("k2"), F.col("m").alias("m2"))
    j = pages.select("path", stem.alias("stem")).join(a, F.col("path") == F.col("k1"), "left").join(b, F.col("stem") == F.col("k2"), "left")
    return j.select("path", F.coalesce("m1", "m2").alias("m")).select("path", "m.*")


def marked_media_text(b: DataFrame) -> DataFrame:
    """(path, text) of blocks (path, pos, tag, block_type, text, alt, src) in the other form: quotes, media and rules marked,
    a blank line between blocks."""
    tag, kind = F.col("tag"), F.col("block_type")
    line = (
        F.when(tag.rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "), "text"))
        .when((tag == "li") | (kind == "list_item"), F.concat(F.lit("- "), "text"))
        .when((tag == "blockquote") | (kind == "blockquote"), F.concat(F.lit("> "), "text"))
        .when((tag == "img") | (kind == "media"), F.concat(F.lit("!["), F.coalesce(F.nullif("alt", F.lit("")), F.nullif("text", F.lit("")), F.lit("image")), F.lit("]("), F.coalesce("src", F.lit("")), F.lit(")")))
        .when((tag == "hr") | (kind == "separator"), "---")
        .otherwise(F.col("text"))
    )
    g = b.select("path", "pos", line.alias("line")).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("ls"))
    return g.select("path", F.concat(F.array_join("ls", "\n\n"), F.lit("\n")).alias("text"))


def page_records(pages: DataFrame, done: DataFrame | None, read) -> DataFrame:
    """One record per page (path, content) with status and error: pages that `done` has are left out, a page that read()
    fails on becomes a row with its error. read: content -> text."""
    schema = "path string, text string, n_text_chars bigint, status string, error string"
    if done is not None:
        pages = pages.join(done.select("path"), "path", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"]):
                try:
                    t = read(c)
                    rows.append((p, t, len(t or ""), "ok", None))
                except Exception as e:  # noqa: BLE001  a bad page must not end the run
                    rows.append((p, None, 0, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "n_text_chars", "status", "error"])

    return spread(pages.select("path", "content")).mapInPandas(run, schema)
