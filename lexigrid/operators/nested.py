"""Text and version values inside JSON of unknown shape."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

VERSION = re.compile(r"(?<![\d.])(\d{1,2})\.(\d{1,2})([a-z]?)(?![A-Za-z0-9])", re.I)
VERSION_KEYS = ("version", "patch", "patch_number", "patch_name")
LABEL_KEYS = ("title", "name", "label", "heading", "displayName", "id")
TEXT_KEYS = ("text", "note", "description", "content", "body", "info", "value")

LEAF = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("key", T.StringType()), T.StructField("text", T.StringType())])


def load(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def walk(obj, path=(), key=""):
    """Every value below obj without a value of its own, with the labels of its objects and its key; no recursion limit."""
    stack = [(obj, path, key)]
    while stack:
        o, p, k = stack.pop()
        if isinstance(o, dict):
            label = next((str(o[x]) for x in LABEL_KEYS if isinstance(o.get(x), (str, int)) and str(o[x]).strip()), None)
            here = (*p, label) if label else p
            stack += [(v, here, str(n)) for n, v in reversed(list(o.items()))]
        elif isinstance(o, list):
            stack += [(v, p, k) for v in reversed(o)]
        else:
            yield o, p, k


def text_leaves(text: str | None) -> list[tuple[int, str, str, str]]:
    """(pos, label path, key, text) of the text values, one of each path, key and text."""
    out, seen = [], set()
    for v, p, k in walk(load(text)):
        if not isinstance(v, str):
            continue
        t = " ".join(re.sub(r"<[^>]+>", " ", v).split())
        if len(t) < 2 or k not in TEXT_KEYS or (p, k, t) in seen:
            continue
        seen.add((p, k, t))
        out.append((len(out), " > ".join(p), k, t))
    return out


def versions(text: str | None) -> list[str]:
    """Versions in any text value or version-like key, newest first."""
    found = set()
    for v, _, k in walk(load(text)):
        if isinstance(v, (str, float, int)) and not isinstance(v, bool) and (isinstance(v, str) or k.lower() in VERSION_KEYS):
            found |= {(int(a), int(b), c.lower()) for a, b, c in VERSION.findall(str(v))}
    return [f"{a}.{b}{c}" for a, b, c in sorted(found, reverse=True)]


def html_strings(text: str | None) -> list[str]:
    """Text values that hold markup, the longest first."""
    return sorted({v for v, _, _ in walk(load(text)) if isinstance(v, str) and re.search(r"<[a-z][^>]*>", v, re.I)}, key=lambda v: (-len(v), v))


def text_leaves_of(c: Column) -> Column:
    @F.pandas_udf(T.ArrayType(LEAF))
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda t: [dict(zip(LEAF.names, x)) for x in text_leaves(t)])

    return run(c)


def versions_of(c: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(col: pd.Series) -> pd.Series:
        return col.map(versions)

    return run(c)


def html_strings_of(c: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(col: pd.Series) -> pd.Series:
        return col.map(html_strings)

    return run(c)


def response_text(c: Column) -> Column:
    """The answer's text in any of three response envelopes; JVM-side."""
    return F.coalesce(F.get_json_object(c, "$.output_text"), F.get_json_object(c, "$.output[0].content[0].text"), F.get_json_object(c, "$.output[1].content[0].text"), F.get_json_object(c, "$.choices[0].message.content"))


def objects(obj):
    """Every object inside obj, itself first, in order; no recursion limit."""
    stack = [obj]
    while stack:
        o = stack.pop()
        if isinstance(o, dict):
            yield o
            stack += reversed(list(o.values()))
        elif isinstance(o, list):
            stack += reversed(o)


NEXT_DATA = re.compile(r"""(?is)<script[^>]*\bid\s*=\s*["']?__NEXT_DATA__["']?[^>]*>(.*?)</script>""")
PAGE_FIELDS = ("title", "published_at", "description", "category", "locale")


def next_data(content: str | None):
    """The JSON that a page carries for its own scripts, or None."""
    m = NEXT_DATA.search(content or "")
    return load(m[1]) if m else None


def page_fields(content: str | None) -> dict:
    """Title (one that names a patch), date, description, category and locale from the page's own JSON: of each the first."""
    out = dict.fromkeys(PAGE_FIELDS)
    flat = lambda v: " ".join(re.sub(r"<[^>]+>", " ", v).split())

    def offer(field, value):
        if out[field] is None and isinstance(value, str) and value.strip():
            out[field] = flat(value)

    for o in objects(next_data(content)):
        if "patch" in str(o.get("title")).lower():
            offer("title", o.get("title"))
        for k in ("publishedAt", "publishDate", "date", "createdAt"):
            if isinstance(o.get(k), str) and re.search(r"\d{4}-\d{2}-\d{2}", o[k]):
                offer("published_at", o[k])
        d, c, a = o.get("description"), o.get("category"), o.get("analytics")
        offer("description", d.get("body") if isinstance(d, dict) else d)
        offer("category", c.get("title") if isinstance(c, dict) else None)
        offer("locale", a.get("contentLocale") if isinstance(a, dict) else None)
    return out


def listed_urls(content: str | None) -> list[tuple[str, str]]:
    """(url, text) of the addresses in the page's own JSON (url, href, action.payload.url) with title and description of
    their object, the first of each address."""
    out: dict[str, str] = {}
    for o in objects(next_data(content)):
        act = o.get("action")
        inner = act.get("payload") if isinstance(act, dict) else None
        text = " ".join(x for x in (o.get("title"), o.get("description")) if isinstance(x, str))
        for v in (o.get("url"), o.get("href"), inner.get("url") if isinstance(inner, dict) else None):
            if isinstance(v, str) and v:
                out.setdefault(v, " ".join(text.split()))
    return list(out.items())


def page_fields_of(c: Column) -> Column:
    """page_fields as a struct column; only pages that carry such JSON reach Python's parser."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in PAGE_FIELDS])

    @F.pandas_udf(schema)
    def run(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_fields(t) for t in col], columns=list(PAGE_FIELDS))

    return run(c)


def listed_urls_of(c: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])))
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda t: [{"url": u, "text": x} for u, x in listed_urls(t)])

    return run(c)
