"""Problem 5: the main body of web pages.

Method: host suffix array. The pages of a site are read as token streams of block marks (`<li>`, `<p>`, ...)
and words (letters only, lower-cased; figures as #). Of the site's suffix array the suffixes that begin or end at a
block's edge are kept (a sparse suffix array); each is keyed by its hash at fixed depths, equal keys are one
interval of the array, and one partially aggregated count gives the distinct pages of every interval, so no
task holds a host and no suffix is compared with another.

* Long repeats: a run of whole blocks with at least `min_tokens` tokens that stands in at least `min_pages` pages and in
  `run_share` of the site's pages is boilerplate, and so is every block that it covers but the note's headline. As both the shortest such runs
  that begin and those that end at each block are keyed, every longer repeated run of whole blocks is covered.
* Template openings: a paragraph's first words that stand in `opening_share` of the pages (of the site or of all pages),
  once in each, where words that are as frequent by chance would stand twice in at least `evidence` pages (Poisson), open a
  unit of the page's template, whatever follows (a share prompt, a byline, a pointer to an older note).
* Slots: blocks whose opening or whole text is repeated, or that stand beside such a block, may be slots of the
  template. Repetition can't tell a link's title in a side box from the same title as a heading of the note, so an
  exact check follows for these alone: outside the element that holds the headline, or in a container or span
  beside the note's own elements, they are furniture.

Everything else is a unique run and kept.

A document's lines are aligned with its page's blocks by their letters and figures; a line without a block
(as its markup differs) is a paragraph of the note if a neighbouring line stands in the note, and furniture by structure if not.

Defined results: the lines of a document without a page are paragraphs without marks, judged by repetition alone; null
and empty texts have no lines; blank lines are no cases; a row delivered twice counts once; a null host is a site of its
own; a site whose pages repeat nothing keeps all its lines; pages of any length are read whole, one page per call.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from lexigrid.session import bounded, cut, spread

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style title template noscript svg head".split())
INLINE = frozenset("a abbr b bdi bdo cite code del em font i ins kbd mark q s samp strong sub sup tt u var label time span-in".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOTE = HEADINGS | frozenset("p li td th dt dd pre blockquote figcaption caption".split())
FURNITURE = frozenset("nav aside footer header form button menu".split())
#: Elements whose start ends an open paragraph.
ENDS_P = HEADINGS | frozenset("address article aside blockquote div dl fieldset footer form header hr main nav ol p pre section table ul li td tr th".split())
SCOPES = frozenset("table td th div main article section aside nav footer header ul ol body form".split())

#: How a block stands to the note by the page's structure: its own element, furniture, or a paragraph that may be either.
OWN, OUTSIDE, PARAGRAPH = 0, 1, 2
PARAGRAPHS = frozenset("p pre blockquote dd div section article main".split())


class Block:
    __slots__ = ("text", "tag", "path", "links", "region", "main", "loose")

    def __init__(self, text, tag, path, links):
        self.text, self.tag, self.path, self.links, self.region, self.main, self.loose = text, tag, path, links, False, False, False


class Reader(HTMLParser):
    """Leaf blocks of a page in order, with the open elements of each (tag, number)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = [("#root", 0)]
        self.count = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            path = tuple(x for x in self.stack if x[0] not in INLINE)
            self.blocks.append(Block(text, path[-1][0], path, self.linked / max(1, len(text))))
        self.parts, self.linked = [], 0

    def _inline(self, tag):
        return tag in INLINE or tag == "span" and any(x.strip() for x in self.parts)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
            return
        # a span opening inside a block's text or inside a heading, paragraph, entry or cell is part of its line
        inline = self._inline(tag) or tag == "span" and self.stack[-1][0] in NOTE
        if not inline:
            self.flush()
            if tag in ENDS_P:
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i][0] == "p":
                        del self.stack[i:]
                        break
                    if self.stack[i][0] in SCOPES:
                        break
            same = {"li": ("ul", "ol"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table", "tbody", "thead"), "dt": ("dl",), "dd": ("dl",)}.get(tag)
            if same:
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i][0] in same:
                        break
                    if self.stack[i][0] == tag or tag in ("td", "th") and self.stack[i][0] in ("td", "th"):
                        del self.stack[i:]
                        break
        self.count += 1
        self.stack.append(("span-in" if tag == "span" and inline else tag, self.count))

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name == tag or tag == "span" and name == "span-in":
                if tag not in INLINE and name != "span-in":
                    self.flush()
                del self.stack[i:]
                return
            if tag in INLINE | {"span", "p", "li"} and name in SCOPES:
                return

    def handle_data(self, data):
        if any(x[0] in HIDDEN for x in self.stack):
            return
        self.parts.append(data)
        if self.stack[-1][0] == "a":
            self.linked += len(data)


def key(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.lower())


def plain(text: str) -> str:
    """Letters of words and # for figures, lower-cased, invisible characters out."""
    t = re.sub(r"[­​-‏⁠﻿]", "", text.lower())
    return " ".join("#" if w[0].isdigit() else w for w in re.findall(r"[^\W_]+", t))


def read_page(content: str) -> list[Block]:
    """The blocks of a page; region: inside the note's element; main: one of the note's own elements; loose: its bare text."""
    r = Reader()
    r.feed(content)
    r.close()
    r.flush()
    blocks = r.blocks
    head = next((b for b in blocks if b.tag == "h1"), None)
    if head is not None:
        at = max(i for i, x in enumerate(head.path) if x[0] == "h1") - 1
        home = head.path[at]
        while home[0] in ("header", "hgroup") and at > 0:  # a header around the headline isn't the note
            at -= 1
            home = head.path[at]
    else:  # the element whose own paragraphs hold the most unlinked text
        weight: dict = {}
        for b in blocks:
            if b.tag in NOTE:
                for x in b.path[:-1][-3:]:
                    weight[x] = weight.get(x, 0) + len(b.text) * (1 - b.links) / (1 + len(b.path) - b.path.index(x))
        home = max(weight, key=weight.get) if weight else ("#root", 0)
    inside = [b for b in blocks if home in b.path]
    bare = not any(b.tag in ("p", "li", "td") for b in inside)  # a note written in containers alone
    for b in inside:
        below = b.path[b.path.index(home) + 1 :]
        b.region = not any(x[0] in FURNITURE for x in below)
        note = b.tag in NOTE or bare and b.tag in ("div", "section", "article", "main")
        boxed = any(x[0] in ("div", "section") for x in below[:-1]) and not bare and b.links > 0.8
        b.main = b.region and note and not boxed
        b.loose = not below  # stands in the note's element, but in no element of its own
    return blocks


def align(lines: list[str], blocks: list[Block]) -> list[int]:
    """The block of each line, or -1; in order."""
    a, b = [key(x) or "\0" for x in lines], [key(x.text) or "\1" for x in blocks]
    out = [-1] * len(a)
    for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        for k in range(m.size):
            out[m.a + k] = m.b + k
    return out


def judge(lines: list[str], content: str | None) -> tuple[list[int], list[Block]]:
    """(how each line stands to the note, the block of each line) by the page's structure."""
    blocks = read_page(content) if content else []
    if not blocks:
        return [PARAGRAPH] * len(lines), [Block(x, "p", (), 0.0) for x in lines]
    at = align(lines, blocks)
    n = len(lines)
    region = [None if j < 0 else blocks[j].region for j in at]
    near = [False] * n
    for order in (range(n), range(n - 1, -1, -1)):
        last = False
        for i in order:
            near[i] |= last
            last = region[i] if region[i] is not None else last
    out, of = [], []
    for i, j in enumerate(at):
        if j < 0:
            out.append(PARAGRAPH if near[i] else OUTSIDE)
            of.append(Block(lines[i], "p", (), 0.0))
        else:
            b = blocks[j]
            out.append(OUTSIDE if not b.main else PARAGRAPH if b.loose or b.tag in PARAGRAPHS else OWN)
            of.append(b)
    return out, of


KEYS = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("twice", T.BooleanType())]))
PAGES = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("site", T.StringType()),
        T.StructField("keys", KEYS),
        T.StructField("lines", T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("runs", T.ArrayType(T.IntegerType())), T.StructField("opening_site", T.ArrayType(T.IntegerType())), T.StructField("opening_all", T.ArrayType(T.IntegerType())), T.StructField("slots", T.ArrayType(T.IntegerType()))]))),
    ]
)


def runs(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """The shortest runs [a, b) of whole blocks with at least `least` tokens that begin, and those that end, at each block."""
    ends = [0]
    for n in sizes:
        ends.append(ends[-1] + n)
    out = set()
    b = 0
    for a in range(len(sizes)):
        while b < len(sizes) and ends[b] - ends[a] < least:
            b += 1
        if ends[b] - ends[a] >= least:
            out.add((a, b))
    a = len(sizes)
    for b in range(len(sizes), 0, -1):
        a = min(a, b)
        while a > 0 and ends[b] - ends[a] < least:
            a -= 1
        if ends[b] - ends[a] >= least:
            out.add((a, b))
    return sorted(out)


def page_suffixes(site: str, stands: list[int], blocks: list[Block], min_tokens: int):
    """The keys of a page with whether they stand in it twice, and for each block the places in that list of its runs,
    of its opening (paragraphs only; in its site and in all pages), and of what may make it a slot (blocks outside the note only)."""
    number: dict[int, int] = {}
    times: Counter = Counter()

    def place(*parts: str) -> int:
        key = xxhash.xxh64_intdigest("\0".join(parts)) - 2**63
        at = number.setdefault(key, len(number))
        times[at] += 1
        return at

    words = [plain(b.text).split() for b in blocks]
    units = [f"<{b.tag}> {' '.join(w)} </{b.tag}>" for b, w in zip(blocks, words)]
    run: list[list[int]] = [[] for _ in blocks]
    for a, b in runs([len(w) + 2 for w in words], min_tokens):
        at = place("run", site, *units[a:b])
        for k in range(a, b):
            if blocks[k].tag != "h1" or stands[k] != OWN:  # a note's headline is no furniture, however short and common
                run[k].append(at)
    opening, slots = [], []
    beside = lambda k: [place("open", blocks[k].tag, *words[k][:1]), place("whole", units[k])]
    for k, stand in enumerate(stands):
        opening.append(([place("site", site, *words[k][:1])], [place("all", *words[k][:1])]) if stand == PARAGRAPH and words[k] else ([], []))
        slots.append(sorted({x for j in (k - 1, k, k + 1) if 0 <= j < len(blocks) for x in beside(j)}) if stand == OUTSIDE else [])
    return [(key, times[at] > 1) for key, at in number.items()], run, opening, slots


def judged_pages(docs: DataFrame, min_tokens: int = 16) -> DataFrame:
    """(document_id, site, keys, lines) of each (document_id, site, text, content): the page's suffix keys, and the
    places of the keys that judge each non-blank line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, s, text, content in zip(pdf["document_id"], pdf["site"], pdf["text"], pdf["content"]):
                all_lines = text.split("\n")
                stands, blocks = judge(all_lines, content)
                full = [i for i, x in enumerate(all_lines) if x.strip()]
                keys, covered, opening, slots = page_suffixes(s, [stands[i] for i in full], [blocks[i] for i in full], min_tokens)
                rows.append((d, s, keys, [(i, covered[k], *opening[k], slots[k]) for k, i in enumerate(full)]))
            yield pd.DataFrame(rows, columns=PAGES.names)

    return spread(docs.select("document_id", "site", "text", "content")).mapInPandas(run, PAGES)


def family(host):
    """The last two labels of a host name: the language editions of a site share their templates."""
    return F.regexp_extract(F.coalesce(host, F.lit("")), r"([^.]+\.[^.]+)$", 1)


def once(n, twice, n_pages, share: float, evidence: float):
    """Whether an opening in n of n_pages pages, in `twice` of them more than once, stands once a page by design."""
    rate = -F.log1p(-F.least(n / n_pages, F.lit(1 - 1e-9)))
    by_chance = n_pages * (1 - F.exp(-rate) * (1 + rate))
    return (n >= share * n_pages) & (twice <= 0.02 * n) & (by_chance >= evidence)


def judged(docs: DataFrame, min_tokens: int = 16, min_pages: int = 2, run_share: float = 0.05, opening_share: float = 0.1, evidence: float = 5.0) -> DataFrame:
    """(document_id, line_no, reason) of each line outside the main content; reason: long_repeat, template_opening or slot."""
    rows = docs.where(F.col("text").isNotNull()).select("document_id", family(F.col("host")).alias("site"), "text", "content")
    pages = cut(judged_pages(rows, min_tokens))
    sites = bounded(pages.groupBy("site").agg(F.count("*").alias("site_pages")))
    every = pages.agg(F.count("*").alias("all_pages"))
    counts = pages.select(F.explode("keys").alias("k")).groupBy(F.col("k.key").alias("key")).agg(F.count("*").alias("n"), F.sum(F.col("k.twice").cast("bigint")).alias("twice")).where(F.col("n") >= min_pages)
    lines = pages.select("document_id", "site", "keys", F.explode("lines").alias("line"))
    use = lambda k, c: F.transform(f"line.{c}", lambda i: F.struct(F.lit(k).alias("use"), F.get("keys", i)["key"].alias("key")))
    uses = F.concat(*[use(k, c) for k, c in enumerate(("runs", "opening_site", "opening_all", "slots"))])
    each = lines.select("document_id", "site", F.col("line.line_no").alias("line_no"), F.explode(uses).alias("u")).select("document_id", "site", "line_no", "u.use", "u.key")
    hit = each.join(counts, "key").join(sites, "site").crossJoin(F.broadcast(every))  # `every` is one row
    test = lambda total: once(F.col("n"), F.col("twice"), F.col(total), opening_share, evidence)
    holds = F.when(F.col("use") == 0, F.col("n") >= run_share * F.col("site_pages")).when(F.col("use") == 1, test("site_pages")).when(F.col("use") == 2, test("all_pages")).otherwise(F.lit(True))
    return hit.where(holds).groupBy("document_id", "line_no").agg(F.min("use").alias("use")).select("document_id", "line_no", F.get(F.array(*map(F.lit, ("long_repeat", "template_opening", "template_opening", "slot"))), F.col("use")).alias("reason"))


def found(docs: DataFrame, **kw) -> DataFrame:
    """(document_id, line_no): the lines outside the main content."""
    return judged(docs, **kw).select("document_id", "line_no")


def bodies(docs: DataFrame, **kw) -> DataFrame:
    """(document_id, body): each document's text without the found lines; null stays null."""
    gone = found(docs, **kw).groupBy("document_id").agg(F.collect_set("line_no").alias("gone"))
    keep = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("gone"), i))
    joined = docs.select("document_id", "text").dropDuplicates().join(gone, "document_id", "left")
    return joined.select("document_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n")).alias("body"))


def page_text(content: str | None) -> str | None:
    """All blocks of a page as lines: headings as `# `, list entries and table rows as `- `."""
    if content is None:
        return None
    mark = lambda b: "# " if b.tag in HEADINGS - {"h1"} else "- " if b.tag in ("li", "td", "th") else ""
    return "\n".join(mark(b) + b.text for b in read_page(content))


def page_bodies(pages: DataFrame) -> DataFrame:
    """(path, body) of each distinct (path, host, content): the main body of the page, read from its blocks."""

    @F.pandas_udf(T.StringType())
    def run(col: pd.Series) -> pd.Series:
        return col.map(page_text)

    blocks = spread(pages.select("path", "host", "content").dropDuplicates(["path"])).select(F.col("path").alias("document_id"), "host", run("content").alias("text"), "content")
    return bodies(cut(blocks)).withColumnRenamed("document_id", "path")
