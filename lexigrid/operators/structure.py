"""Pages as typed blocks through an element tree: content root, blocks with heading paths, metadata, links, assets.

One page is one call; a page that can't be read gives a row with status 'error' and the reason, so a batch never
fails as a whole. Pages parsed before are left out by an anti-join on their path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lexigrid.operators.corpus import NOISE_LINES
from lexigrid.session import spread

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript svg iframe form template".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = frozenset((*HEADINGS, "p", "li", "blockquote", "table", "pre", "hr", "img"))
CONTAINERS = frozenset("div section dd dt span".split())
#: Elements inside a word or phrase, which part no words.
JOINED = frozenset("a abbr b cite code em font i ins mark q s strong sub sup u".split())
#: Elements that an opening tag closes, up to the elements that hold them.
CLOSES = {"p": ({"p"}, {"td", "th", "li", "div", "body"}), "li": ({"li", "p"}, {"ul", "ol"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"})}
#: Parts of class names that tell a change row.
CHANGE_CLASSES = ("attribute", "change", "stat", "spell", "ability", "item", "effect", "new", "removed", "updated", "buff", "nerf")
CHANGE_START = re.compile(r"(?:new|removed|updated|bugfix|buff|nerf|adjusted)\b", re.I)
VISIBLE_ID = "__SCRAPER_VISIBLE_TEXT_BLOCKS__"
ARROWS = re.compile(r"\s*(?:⇒|→|⟶|⟹|=>|->)\s*")
DATE = re.compile(r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}\b")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "cache")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children, self.cache = tag, attrs, parent, [], None

    def walk(self):
        """The elements below in page order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        if self.cache is None:
            out, stack = [], list(reversed(self.children))
            while stack:
                c = stack.pop()
                if isinstance(c, str):
                    out.append(c)
                elif c.tag in JOINED:
                    stack += reversed(c.children)
                elif c.tag not in HIDDEN:
                    stack += [" ", *reversed(c.children), " "]
            self.cache = " ".join("".join(out).split())
        return self.cache

    def up(self):
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        shut = CLOSES.get(tag) or (CLOSES["p"] if tag in BLOCKS or tag in ("div", "ul", "ol", "section") else None)
        if shut:
            n, last = self.at, None
            while n.parent is not None and n.tag not in shut[1]:
                if n.tag in shut[0]:
                    last = n
                n = n.parent
            if last is not None:
                self.at = last.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(content: str) -> Node:
    b = Builder()
    b.feed(content)
    b.close()
    return b.root


def strip(root: Node) -> None:
    """Takes out hidden elements and small menus (under 300 letters, two links or more)."""
    for n in list(root.walk()):
        menu = n.tag in ("nav", "footer", "header") and len(n.text()) < 300 and sum(x.tag == "a" for x in n.walk()) >= 2
        if n.tag in HIDDEN or menu:
            n.parent.children = [c for c in n.parent.children if c is not n]
            for p in n.up():
                p.cache = None


def content_root(root: Node) -> Node:
    """The most article-like element: text length and a hundred for each block; the body if none is marked as one."""
    marked = [n for n in root.walk() if n.tag in ("main", "article") or n.attrs.get("role") == "main" or n.attrs.get("id") in ("main", "content") or re.search(r"\b(?:article|patch-?notes)\b", n.attrs.get("class", ""), re.I)]
    body = next((n for n in root.walk() if n.tag == "body"), root)
    return max(marked or [body], key=lambda n: len(n.text()) + 100 * sum(x.tag in BLOCKS for x in n.walk()))


def table_rows(table: Node) -> list[list[str]]:
    rows = []
    for tr in table.walk():
        if tr.tag == "tr":
            row = [x.text() for x in tr.children if isinstance(x, Node) and x.tag in ("td", "th")]
            if any(row):
                rows.append(row)
    return rows


def meaningful(text: str) -> bool:
    t = " ".join(text.split())
    return len(t) >= 2 and t.lower() not in NOISE_LINES and not re.match(r"https?://", t, re.I) and bool(re.search(r"[^\W_]", t)) and not re.search(r"\.(?:png|jpe?g|gif|webp|svg|mp4|webm|css|js)(?:[?#]|$)", t, re.I)


def text_key(text: str) -> str:
    return re.sub(r"^[#>\-\s]+", "", " ".join(text.split()).lower())


def change_row(n: Node, text: str) -> bool:
    """A row of figures outside paragraphs and lists, by its class or its look."""
    names = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower()
    letters = sum(c.isalpha() for c in text)
    shouted = letters and sum(c.isupper() for c in text) / letters > 0.55 and len(text) <= 220 and any(c.isdigit() for c in text)
    return any(h in names for h in CHANGE_CLASSES) or bool(ARROWS.search(text)) or bool(CHANGE_START.match(text)) or bool(shouted)


def blocks(root: Node, base: str = "") -> list[dict]:
    """The blocks of a content root in page order, each with the headings above it."""
    out: list[dict] = []
    stack: list[tuple[int, str]] = []
    for n in root.walk():
        inside = any(x.tag in BLOCKS for x in n.up() if x is not root and x.tag != "#root")
        media = ""
        if n.tag == "img":
            if inside:
                continue
            text, kind = " ".join(n.attrs.get("alt", "").split()), "media"
            src = n.attrs.get("src") or n.attrs.get("data-src") or ""
            media = urljoin(base, src) if src else ""
            if not media:
                continue
        elif n.tag in HEADINGS:
            text, kind = n.text(), "heading"
            if text:
                level = int(n.tag[1])
                stack = [h for h in stack if h[0] < level] + [(level, text)]
        elif n.tag == "table":
            if inside:
                continue
            text, kind = "\n".join(" | ".join(r) for r in table_rows(n)), "table"
        elif n.tag in BLOCKS:
            if inside:
                continue
            text, kind = n.text(), {"li": "list_item", "blockquote": "blockquote", "hr": "separator", "pre": "code"}.get(n.tag, "paragraph")
        elif n.tag in CONTAINERS:
            below = [x.tag for x in n.walk()]
            if inside or any(t in BLOCKS for t in below) or n.tag != "span" and any(t in CONTAINERS - {"span"} for t in below) or n.tag == "span" and any(x.tag in CONTAINERS for x in n.up() if x is not root):
                continue
            text = n.text()
            changed = change_row(n, text)
            if n.tag == "span" and not changed or not changed and not 2 <= len(text) <= 260:
                continue
            kind = "change_row" if changed else "text_container"
        else:
            continue
        if not text and kind not in ("media", "separator"):
            continue
        out.append({"pos": len(out), "tag": n.tag, "block_type": kind, "heading_level": int(n.tag[1]) if kind == "heading" else None, "heading_path": " > ".join(t for _, t in stack), "text": ARROWS.sub(" → ", text), "element_id": n.attrs.get("id"), "element_class": n.attrs.get("class"), "media": media or None, "source": "html"})
    return out


def visible_blocks(root: Node) -> list[dict]:
    """The texts that a renderer left in the page as JSON; none if there are none or they can't be read."""
    script = next((n for n in root.walk() if n.tag == "script" and n.attrs.get("id") == VISIBLE_ID), None)
    if script is None:
        return []
    try:
        items = json.loads("".join(c for c in script.children if isinstance(c, str)))
    except ValueError:
        return []
    out = []
    for x in items if isinstance(items, list) else []:
        text = ARROWS.sub(" → ", str(x.get("text") or "")).strip() if isinstance(x, dict) else ""
        if meaningful(text):
            level = x.get("heading_level")
            out.append({"pos": len(out), "tag": str(x.get("tag") or "div").lower(), "block_type": str(x.get("block_type") or "visible_text"), "heading_level": int(level) if isinstance(level, (int, float)) else None, "heading_path": "", "text": text, "element_id": None, "element_class": None, "media": None, "source": "visible"})
    return out


def merged(html: list[dict], visible: list[dict]) -> list[dict]:
    """The page's blocks, then the visible ones whose text is new; heading paths go on through both."""
    seen = {text_key(b["text"]) for b in html if b["text"]}
    out = list(html)
    for b in visible:
        k = text_key(b["text"])
        if k and k not in seen:
            seen.add(k)
            out.append(b)
    stack: list[tuple[int, str]] = []
    for i, b in enumerate(out):
        if b["block_type"] == "heading" and b["text"]:
            level = b["heading_level"] or 2
            stack = [h for h in stack if h[0] < level] + [(level, b["text"])]
        b["pos"], b["heading_path"] = i, " > ".join(t for _, t in stack)
    return out


def metadata(root: Node, base: str = "") -> dict:
    """Title, description, canonical URL and date text: page tags first, then the page's own title and text."""
    meta = {(n.attrs.get("property") or n.attrs.get("name") or "").lower(): " ".join(n.attrs.get("content", "").split()) for n in root.walk() if n.tag == "meta"}
    pick = lambda *ks: next((meta[k] for k in ks if meta.get(k)), None)
    title = next((" ".join("".join(c for c in n.children if isinstance(c, str)).split()) for n in root.walk() if n.tag == "title"), None)
    link = next((n.attrs.get("href") for n in root.walk() if n.tag == "link" and "canonical" in n.attrs.get("rel", "")), None)
    date = pick("article:published_time", "date", "pubdate", "publishdate", "og:updated_time")
    if not date and (m := DATE.search(root.text())):
        date = m.group()
    return {"title": pick("og:title", "twitter:title") or title, "description": pick("og:description", "description", "twitter:description"), "canonical_url": pick("og:url") or (urljoin(base, link) if link else None), "date_text": date}


def unique(pairs):
    seen: set = set()
    return [p for p in pairs if p[0] and not (p[0] in seen or seen.add(p[0]))]


def parse(content: str | None, base: str = "") -> dict:
    """A page as one record; an unreadable page has status 'error'."""
    try:
        if not content or not content.strip():
            raise ValueError("empty page")
        root = tree(content)
        visible, meta = visible_blocks(root), metadata(root, base)
        strip(root)
        home = content_root(root)
        found = merged(blocks(home, base), visible)
        links = unique([(urljoin(base, n.attrs["href"]).split("#")[0], n.text()) for n in home.walk() if n.tag == "a" and n.attrs.get("href")])
        assets = unique([(urljoin(base, n.attrs.get("src") or n.attrs.get("data-src") or n.attrs.get("poster") or ""), n.attrs.get("alt")) for n in home.walk() if n.tag in ("img", "source", "video")])
        return {**meta, "root_tag": home.tag, "blocks": found, "links": [{"url": u, "text": t} for u, t in links], "assets": [{"url": u, "text": t} for u, t in assets], "status": "ok", "error": None}
    except Exception as e:  # noqa: BLE001
        return {"title": None, "description": None, "canonical_url": None, "date_text": None, "root_tag": None, "blocks": [], "links": [], "assets": [], "status": "error", "error": str(e)}


_S = T.StringType()
BLOCK = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("tag", _S), T.StructField("block_type", _S), T.StructField("heading_level", T.IntegerType()), *[T.StructField(c, _S) for c in ("heading_path", "text", "element_id", "element_class", "media", "source")]])
PAIR = T.StructType([T.StructField("url", _S), T.StructField("text", _S)])
PAGE = T.StructType([*[T.StructField(c, _S) for c in ("path", "title", "description", "canonical_url", "date_text", "root_tag")], T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("links", T.ArrayType(PAIR)), T.StructField("assets", T.ArrayType(PAIR)), T.StructField("status", _S), T.StructField("error", _S)])


def structured_pages(pages: DataFrame, done: DataFrame | None = None, base: str = "") -> DataFrame:
    """One record per page of (path, content) that isn't in done (path)."""
    rows = pages.select("path", "content")
    if done is not None:
        rows = rows.join(done.select("path").distinct(), "path", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{"path": p, **parse(c, base)} for p, c in zip(pdf["path"], pdf["content"])], columns=PAGE.names)

    return spread(rows).mapInPandas(run, PAGE)


def page_blocks(structured: DataFrame) -> DataFrame:
    """(path, and a block's fields): one row per block."""
    return structured.select("path", F.explode("blocks").alias("b")).select("path", "b.*")


#: Marks of small furniture in an element's role, label, test id, class or id.
FURNITURE_MARKS = ("cookie", "newsletter", "share", "social", "breadcrumb")


def strip_marked(root: Node) -> None:
    """Takes out hidden elements and elements under 300 letters whose attributes name furniture."""
    for n in list(root.walk()):
        marks = " ".join(str(n.attrs.get(a, "")) for a in ("role", "aria-label", "data-testid", "class", "id")).lower()
        small = n.parent is not None and any(m in marks for m in FURNITURE_MARKS) and len(n.text()) < 300
        if n.parent is not None and (n.tag in HIDDEN or small):
            n.parent.children = [c for c in n.parent.children if c is not n]
            for p in n.up():
                p.cache = None


def element_path(n: Node) -> str:
    """The place of an element: its ancestors below html, each with its id and its number among its siblings of one tag."""
    parts = []
    while n is not None and n.parent is not None and n.tag != "html":
        same = [x for x in n.parent.children if isinstance(x, Node) and x.tag == n.tag]
        own = n.attrs.get("id")
        parts.append(f"{n.tag}{'#' + own if own else ''}:nth-of-type({next(i for i, x in enumerate(same, 1) if x is n)})")
        n = n.parent
    return " > ".join(reversed(parts))


def kept_attributes(n: Node) -> dict:
    return {a: n.attrs[a] for a in ("id", "class", "href", "src", "alt", "title", "datetime") if a in n.attrs}
