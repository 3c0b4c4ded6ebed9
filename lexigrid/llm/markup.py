"""Problem 3: markup residue in text.

Method: equivalence-class template deduction over the marks of same-host texts. A lexer reads each text into loose marks:
everything that opens or closes markup by its form (`<name>`, `**` before or after a word, `[`, `](`, `{{`, `$`, ...),
whether or not it has a partner, and signs that are markup by themselves (character references, commands, rules).
As in plain text the same signs stand for themselves, the occurrences of one sign are told apart by role, in context: those that
open and close around one slot, and those without a partner.

Marks of a host whose occurrence vectors (how often in which text) agree form a class. A class is valid for a mark
if it also holds the mark's other end and both nest in every text, or if the mark needs no other end. Only marks of valid
classes are residue: an unknown element counts because `<x>` and `</x>` share their vector and nest, `<3`, `$4.99` and
`[sic]` don't because nothing closes them. Valid classes are nested into the template of a host by the spans of their
marks in each text; what stands between the marks of the template are the slots. A text has residue of a kind if
a mark of that kind in a valid class occurs in it; `clean` takes the markers out and keeps headings, lists, code and formulas.

Vectors are compared by two order-free 64-bit sums, so a mark that stands in a third of all texts is never gathered in
one task.

What is no residue: heading marks `#` and bullet marks at the start of a line, arrows, and signs and figures
in plain use (`<3`, `a > b`, `2 * 3`, `$4.99 or $6.99`, `net_graph_1`, `C:\\Games`, `R&D`).

Defined results: null, empty and blank texts have no marks; a null host is a host of its own; a row
delivered twice counts once; a lone tag with a name of HTML is residue, one with another name isn't.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from lexigrid.session import bounded, cut, spread

#: Element names of HTML.
TAGS = (
    "a abbr address article aside audio b big blockquote body br button caption center cite code col dd del details dfn div dl dt em embed fieldset figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript object ol option p param picture pre q s samp script section "
    "select small source span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
)

_TAG = rf"</?(?:{'|'.join(sorted(TAGS.split(), key=len, reverse=True))})(?=[\s/>])[^<>]*>"

#: (kind, name, pattern). The first pattern that matches at a place wins.
GRAMMAR: list[tuple[str, str, str]] = [
    ("html", "comment", r"<!--[\s\S]*?-->|<!--|<!doctype[^<>]*>"),
    ("wiki", "ref", r"</?(?:ref|nowiki|gallery)(?=[\s/>])[^<>]*>"),
    ("html", "tag", _TAG),
    ("html", "charref", r"&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,31});|&(?:nbsp|amp|lt|gt|quot)(?![a-z0-9;=])"),
    ("markdown", "image", r"!\[[^\[\]\n]*\]\([^()\s]*(?:\s[^()\n]*)?\)"),
    ("markdown", "link", r"(?<!\[)\[[^\[\]\n]+\]\((?:https?:|/|#|\.|mailto:|www\.)?[^()\s]*(?:\s\"[^\"\n]*\")?\)"),
    ("markdown", "definition", r"(?m:^\s{0,3}\[[^\[\]\n]+\]:\s+\S+)"),
    ("markdown", "reference", r"(?<!\[)\[[^\[\]\n]+\]\[[^\[\]\n]*\]"),
    ("markdown", "task", r"(?m:(?<=^)(?:\s*[-*+•]\s+)+\[[ xX]\](?=\s))"),
    ("wiki", "link", r"\[\[[^\[\]\n]+\]\]"),
    ("wiki", "external", r"\[(?:https?:)?//[^\s\[\]]+(?:\s[^\[\]\n]*)?\]"),
    ("wiki", "template", r"\{\{[^{}\n]*(?:\{\{[^{}\n]*\}\}[^{}\n]*)*\}\}"),
    ("wiki", "table", r"(?m:^\s*(?:\{\|.*|\|\}|\|-+)\s*$)"),
    ("wiki", "heading", r"(?m:^\s*(={2,6})[^=\n]+\1\s*$)"),
    ("wiki", "bold", r"'''''[^'\n]+'''''|'''(?:[^'\n]|'(?!''))+'''|(?<!')''(?:[^'\n]|'(?!'))+''(?!')"),
    ("wiki", "switch", r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__"),
    ("latex", "environment", r"\\(?:begin|end)\{[^{}\n]*\}"),
    ("latex", "display", r"\$\$[^$]+\$\$|\\\["),
    ("latex", "formula", r"\\\(|(?<![\\$\w])\$(?!\s)(?=[^$\n]*[\\^_={}])[^$\n]++(?<![\s\\])\$(?!\w)"),
    ("latex", "command", r"(?<![\w:\\/.])\\[a-zA-Z]+\*?(?:\[[^\[\]\n]*\])?\{[^{}\n]*\}|(?<![\w:\\/.])\\(?:item|hline|newline|noindent|par|ldots|dots|times|cdot|rightarrow|leftarrow|Rightarrow|to|leq|geq|neq|approx|pm|infty|alpha|beta|gamma|delta|sum|prod|sqrt|frac|quad|qquad|medskip|bigskip|smallskip|LaTeX|TeX)(?![a-zA-Z])|(?<=[0-9a-zA-Z])\\%|\\\\(?=\s*$)"),
    ("markdown", "fence", r"(?m:^\s*(?:```|~~~).*$)"),
    ("markdown", "code", r"(?<!`)`[^`\n]+`(?!`)"),
    ("markdown", "strong", r"\*\*(?=[^\s*])[^*\n]*(?:\*(?!\*)[^*\n]*)*(?<=\S)\*\*|(?<![\w])__(?=[^\s_])[^\n]*?(?<=[^\s_])__(?!\w)"),
    ("markdown", "strike", r"~~(?=\S)[^~\n]+(?<=\S)~~"),
    ("markdown", "emphasis", r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])|(?<![\w\\])_(?=[^\s_])[^_\n]*(?<=[^\s_])_(?!\w)"),
    ("markdown", "rule", r"(?m:^\s*\|?(?:\s*:?-{3,}:?\s*\|)+(?:\s*:?-{3,}:?\s*)?$)"),
]
FLAGS = {("html", "comment"), ("html", "tag"), ("html", "charref"), ("wiki", "ref")}
COMPILED = [(k, n, re.compile(p, re.I if (k, n) in FLAGS else 0)) for k, n, p in GRAMMAR]
#: A text without any of these signs has no marker.
SIGNS = re.compile(r"[<&\[{$`\\]|\*|__|_\S|~~|''|==|\|\s*:?-|^\s*\|[-}]", re.M)


#: Openings that a pattern of GRAMMAR leaves to `spans`: the closing mark, and whether both stand in one line.
CLOSED_BY = {r"\[": (r"\]", False), r"\(": (r"\)", True)}


def spans(pat: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Places of a pattern's matches, not overlapping; an opening of CLOSED_BY reaches to its first closing mark, at any
    distance. The search for closing marks and ends of lines never goes back."""
    at = close = line_end = 0
    while m := pat.search(text, at):
        a, b = m.span()
        if m.group() in CLOSED_BY:
            mark, one_line = CLOSED_BY[m.group()]
            if 0 <= close < b + 1:
                close = text.find(mark, b + 1)
            if one_line and 0 <= line_end <= b:
                line_end = text.find("\n", b)
            if close < 0 or one_line and 0 <= line_end < close:
                at = a + 1
                continue
            b = close + len(mark)
        yield a, b
        at = max(b, a + 1)


#: Names whose match is a slot with an opening and a closing mark.
ENDS = {
    ("markdown", "image"), ("markdown", "link"), ("markdown", "reference"), ("markdown", "code"), ("markdown", "strong"), ("markdown", "strike"), ("markdown", "emphasis"),
    ("wiki", "link"), ("wiki", "external"), ("wiki", "template"), ("wiki", "heading"), ("wiki", "bold"), ("latex", "display"), ("latex", "formula"),
}

#: Openings and closings by form alone, by (kind, name).
LOOSE = {
    ("markdown", "strong"): (r"\*\*(?=[^\s*])", r"(?<=[^\s*])\*\*"), ("markdown", "emphasis"): (r"(?<![\w*\\_])[*_](?=[^\s*_])", r"(?<=[^\s*_])[*_](?![\w*_])"),
    ("markdown", "strike"): (r"~~(?=\S)", r"(?<=\S)~~"), ("markdown", "code"): (r"`(?=\S)", r"(?<=\S)`"), ("markdown", "link"): (r"\[(?=\S)", r"(?<=\S)\](?!\])"),
    ("wiki", "link"): (r"\[\[", r"\]\]"), ("wiki", "template"): (r"\{\{", r"\}\}"), ("wiki", "bold"): (r"''+(?=\w)", r"(?<=\w)''+"), ("latex", "formula"): (r"\$(?=\S)", r"(?<=\S)\$"),
}
LOOSE_RE = {k: tuple(re.compile(x) for x in v) for k, v in LOOSE.items()}
ELEMENT = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)(?:\s[^<>]*)?/?>")


def _nested(found: list[tuple[int, int, bool, str]]) -> set[int]:
    """The places in `found` (start, end, closing, name) of the elements that open and close, nested."""
    stack: list[int] = []
    opened: Counter = Counter()
    out: set[int] = set()
    for i, (_, _, closing, name) in enumerate(found):
        if not closing:
            stack.append(i)
            opened[name] += 1
        elif opened[name]:
            while True:
                at = stack.pop()
                opened[found[at][3]] -= 1
                if found[at][3] == name:
                    break
            out |= {i, at}
    return out


def marks(text: str | None) -> list[tuple[int, int, str, str, str, str, bool]]:
    """(start, end, kind, label, mark, end of the slot, nests) of the loose marks of a text, in order.

    The end is 'open', 'close' or 'one' (needs no other); nests: it opens or closes a slot, or needs no other."""
    if not text or not SIGNS.search(text):
        return []
    taken = bytearray(len(text))
    out = []
    for kind, name, pat in COMPILED:
        for a, b in spans(pat, text):
            if a == b or taken[a] or taken[b - 1]:
                continue
            if name in ("strong", "emphasis", "strike", "heading", "bold") or not any(taken[a:b]):
                edges = {"strong": 2, "strike": 2, "emphasis": 1}.get(name)
                if edges:  # what stands inside may hold other markers
                    for i in (*range(a, a + edges), *range(b - edges, b)):
                        taken[i] = 1
                else:
                    taken[a:b] = b"\1" * (b - a)
                label = _token(kind, name, text[a:b])
                if (kind, name) in ENDS:
                    w = edges or 1
                    out += [(a, a + w, kind, label, label + "(", "open", True), (b - w, b, kind, label, label + ")", "close", True)]
                else:
                    out.append((a, b, kind, label, label, "one", True))
    # character references that spell out a tag are inside no other token, as they come first in the grammar
    elements = [(m.start(), m.end(), bool(m[1]), m[2].lower()) for m in ELEMENT.finditer(text) if not taken[m.start()]] if "<" in text else []
    pairs = _nested(elements)
    for i, (a, b, closing, name) in enumerate(elements):
        out.append((a, b, "html", f"<{name}>" if i in pairs else f"<{name}>~", f"<{'/' if closing else ''}{name}>" + ("" if i in pairs else "~"), "close" if closing else "open", i in pairs))
        taken[a:b] = b"\1" * (b - a)
    for (kind, name), both in LOOSE_RE.items():
        for end, pat in zip(("open", "close"), both):
            for m in pat.finditer(text):
                if not taken[m.start()] and not taken[m.end() - 1]:
                    label = f"{kind}:{name}~"
                    out.append((m.start(), m.end(), kind, label, label + "()"[end == "close"], end, False))
    return sorted(out)


def tokens(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, mark) of the marks that are residue if the text is a host of its own."""
    found = marks(text)
    ends: dict[str, set[str]] = {}
    times: Counter = Counter(m[4] for m in found)
    for m in found:
        ends.setdefault(m[3], set()).add(m[5])
    valid = {m[3] for m in found if m[6] and (m[5] == "one" or ends[m[3]] >= {"open", "close"})}
    for label in [x for x in valid if ends[x] >= {"open", "close"}]:
        n = {times[m[4]] for m in found if m[3] == label}
        if len(n) > 1:
            valid.discard(label)
    return [(a, b, kind, mark) for a, b, kind, label, mark, _, nests in found if nests and label in valid]


def _token(kind: str, name: str, raw: str) -> str:
    """The marker's identity over texts: a tag's name, a command's name, otherwise the pattern's name."""
    if name in ("tag", "ref"):
        return re.match(r"</?[A-Za-z0-9]+", raw).group().lower() + ">"
    if name == "charref":
        return raw.lower()
    if name in ("command", "environment"):
        return re.match(r"\\\\?[A-Za-z%]*(?:\{[^{}]*\})?", raw).group() if name == "environment" else re.match(r"\\+[A-Za-z%]*", raw).group()
    return f"{kind}:{name}"


OCC = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("text_id", "host", "kind", "label", "token", "end")]
    + [T.StructField(x, T.IntegerType()) for x in ("n", "first", "last")]
    + [T.StructField("nests", T.BooleanType())]
)
SIGNED = r"[<&\[{$`\\*~=|_']"


def occurrences(texts: DataFrame) -> DataFrame:
    """(text_id, host, kind, label, token, end, n, first, last, nests) of each loose mark of (text_id, host, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, h, t in zip(pdf["text_id"], pdf["host"], pdf["text"]):
                seen: dict[tuple, list] = {}
                for a, _, kind, label, mark, end, nests in marks(t):
                    x = seen.setdefault((kind, label, mark, end), [0, a, a, True])
                    x[0], x[2], x[3] = x[0] + 1, a, x[3] and nests
                rows += [(i, h, *k, *x) for k, x in seen.items()]
            yield pd.DataFrame(rows, columns=OCC.names)

    marked = texts.where(F.col("text").rlike(SIGNED))
    return spread(marked.select("text_id", "host", "text")).mapInPandas(run, OCC)


def classes(occ: DataFrame) -> DataFrame:
    """(host, token, kind, label, end, class_id, n_texts, n, valid): marks of a host with one occurrence vector share a class.

    The vector of a mark is the multiset of (text, how often): two order-free sums of 64-bit hashes. valid: the class
    holds both ends of the mark's slot and they nest in every text, or the mark needs no other end.
    """
    h = lambda salt: F.sum(F.xxhash64(F.lit(salt), "text_id", "n").cast("decimal(38,0)"))
    vec = occ.groupBy("host", "token", "kind", "label", "end").agg(h(1).alias("v1"), h(2).alias("v2"), F.count("*").alias("n_texts"), F.sum("n").alias("n"), F.min("nests").alias("nests"))
    vec = vec.withColumn("class_id", F.md5(F.concat_ws("|", F.coalesce("host", F.lit("\0")), F.col("v1").cast("string"), F.col("v2").cast("string"))))
    slot = Window.partitionBy("host", "class_id", "kind", "label")  # the marks of one label: at most its two ends
    both = (F.count("*").over(slot) == 2) & F.min("nests").over(slot)
    return vec.select("host", "token", "kind", "label", "end", "class_id", "n_texts", "n", F.when(F.col("end") == "one", F.col("nests")).otherwise(both).alias("valid"))


def _with_classes(occ: DataFrame, kinds: DataFrame) -> DataFrame:
    """Occurrences with class_id and valid of their marks."""
    c = kinds.select(F.col("host").alias("h"), F.col("token").alias("t"), F.col("kind").alias("k"), "class_id", "valid")
    return occ.join(bounded(c), F.col("host").eqNullSafe(F.col("h")) & (F.col("token") == F.col("t")) & (F.col("kind") == F.col("k"))).drop("h", "t", "k")


def template(texts_occ: DataFrame) -> DataFrame:
    """(host, class_id, tokens, kinds, n_texts, n, parent): the valid classes of each host with their marks in order of
    first place, nested: parent is the valid class with the narrowest span that holds the class in every text in which both
    occur and that occurs wherever it does; null at the top."""
    occ = cut(texts_occ)
    marked = _with_classes(occ, classes(occ)).where("valid")
    span = marked.groupBy("host", "class_id", "text_id").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.array_sort(F.collect_list(F.struct("first", "token", "kind", "n"))).alias("o"))
    span = cut(span)
    cls = span.groupBy("host", "class_id").agg(
        F.min(F.transform("o", lambda x: x["token"])).alias("tokens"), F.array_sort(F.array_distinct(F.min(F.transform("o", lambda x: x["kind"])))).alias("kinds"), F.count("*").alias("n_texts"), F.sum(F.aggregate("o", F.lit(0), lambda s, x: s + x["n"])).alias("n")
    )
    inner = span.select("text_id", "host", "class_id", "a", "b")
    outer = span.select(F.col("text_id").alias("t"), F.col("class_id").alias("parent"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    # within one text: as many rows as it has pairs of marks of different kinds, whatever its length
    held = inner.join(outer, (F.col("text_id") == F.col("t")) & (F.col("pa") < F.col("a")) & (F.col("pb") > F.col("b")))
    width = held.groupBy("host", "class_id", "parent").agg(F.count("*").alias("m"), F.avg(F.col("pb") - F.col("pa")).alias("w"))
    always = width.join(cls.select(F.col("class_id").alias("c"), "n_texts"), (F.col("class_id") == F.col("c")) & (F.col("m") == F.col("n_texts")))
    best = always.groupBy("class_id").agg(F.min(F.struct("w", "parent"))["parent"].alias("parent"))
    return cls.join(best, "class_id", "left").select("host", "class_id", "tokens", "kinds", "n_texts", "n", "parent")


def found(texts: DataFrame) -> DataFrame:
    """(text_id, markup): each text with each kind of its marks in valid classes."""
    occ = cut(occurrences(texts))
    return _with_classes(occ, classes(occ)).where("valid").select("text_id", F.col("kind").alias("markup")).distinct()


SLOT = T.StructType([T.StructField("text_id", T.StringType()), T.StructField("slot_no", T.IntegerType()), T.StructField("after", T.StringType()), T.StructField("before", T.StringType()), T.StructField("text", T.StringType())])


def slots(texts: DataFrame) -> DataFrame:
    """(text_id, slot_no, after, before, text): what stands between the marks of the host's valid classes in each text, with
    the marks on either side (null at the text's ends); slots of white space alone are left out."""
    occ = cut(occurrences(texts))
    valid = _with_classes(occ, classes(occ)).where("valid").groupBy("text_id").agg(F.collect_set("token").alias("valid"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t, tokens_ in zip(pdf["text_id"], pdf["text"], pdf["valid"]):
                keep = set(tokens_)
                ends = [(0, 0, None), *[(a, b, mark) for a, b, _, _, mark, _, _ in marks(t) if mark in keep], (len(t), len(t), None)]
                n = 0
                for (_, a, left), (b, _, right) in zip(ends, ends[1:]):
                    if t[a:b].strip():
                        rows.append((i, n, left, right, t[a:b].strip()))
                        n += 1
            yield pd.DataFrame(rows, columns=SLOT.names)

    marked = texts.where(F.col("text").rlike(SIGNED)).select("text_id", "text").join(valid, "text_id")
    return marked.mapInPandas(run, SLOT)


def _unwrap(pattern: str, t: str) -> str:
    """t with what stands inside instead of each match, at any depth."""
    n = 1
    while n:
        t, n = re.subn(pattern, r"\1", t)
    return t


_HEADING = re.compile(r"<h([1-6])(?=[\s>])[^<>]*>", re.I)


def clean(text: str | None) -> str | None:
    """The text without markup; headings as `# `, list entries as `- `, code and formulas kept."""
    if text is None or not SIGNS.search(text):
        return text
    t = text.replace("\r\n", "\n")
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x02{len(kept) - 1}\x03"

    t = re.sub(r"[\x02\x03]", "", t)
    # code and formulas first, so that nothing inside is taken for a marker
    t = re.sub(r"(?ms)^\s*```[^\n]*\n(.*?)\n\s*```\s*$", lambda m: keep("\n".join("    " + x for x in m[1].split("\n"))), t)
    t = re.sub(r"(?is)<pre(?=[\s>])[^<>]*>\s*(?:<code[^<>]*>)?(.*?)(?:</code>)?\s*</pre>", lambda m: keep("    " + html.unescape(m[1]).replace("\n", "\n    ")), t)
    t = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", lambda m: keep(m[1]), t)
    for kind, name, pat in COMPILED:
        if kind == "latex" and name in ("display", "formula"):
            at, parts = 0, []
            for a, b in spans(pat, t):
                parts += [t[at:a], keep(t[a:b])]
                at = b
            t = "".join([*parts, t[at:]])
    t = html.unescape(t) if "&" in t else t
    t = re.sub(r"<!--[\s\S]*?-->", "", t)
    t = re.sub(r"(?is)<(script|style)(?=[\s>]).*?</\1\s*>", "", t)
    t = _HEADING.sub(lambda m: "\n" + "#" * int(m[1]) + " ", t)
    t = re.sub(r"(?i)<li(?=[\s>])[^<>]*>(?:\s*[-*•]\s)?", "\n- ", t)
    t = re.sub(r"(?i)</t[dh]>\s*<t[dh](?=[\s>])[^<>]*>", " | ", t)
    t = re.sub(r"(?i)</?(?:p|div|ul|ol|table|tr|h[1-6]|br|section|article|blockquote|li)(?=[\s/>])[^<>]*>", "\n", t)
    t = re.sub(rf"(?i){_TAG}|</?(?:ref|nowiki|gallery)(?=[\s/>])[^<>]*>|<!doctype[^<>]*>", "", t)
    # wiki
    t = re.sub(r"\[\[(?:Category|File|Image|Datei|Kategorie):[^\[\]\n]*\]\]", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", t)
    t = re.sub(r"\[(?:https?:)?//[^\s\[\]]+(?:\s([^\[\]\n]*))?\]", lambda m: m[1] or "", t)
    t = _unwrap(r"\{\{(?:[^{}|\n]*\|)*([^{}|\n]*)\}\}", t)
    t = re.sub(r"(?m)^\s*(={2,6})\s*([^=\n]+?)\s*\1\s*$", lambda m: "#" * len(m[1]) + " " + m[2], t)
    t = re.sub(r"'{2,5}((?:[^'\n]|'(?!'))+)'{2,5}", r"\1", t)
    t = re.sub(r"(?m)^\s*(?:\{\|.*|\|\}|\|-+)\s*\n?", "", t)
    # LaTeX
    t = re.sub(r"\\(sub)*section\*?\{([^{}\n]*)\}", lambda m: ("##" if m[1] else "#") + " " + m[2], t)
    t = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}[ \t]*\n?", "", t)
    t = re.sub(r"\\item(?![a-zA-Z])(?:\s*[-*•]\s)?\s*", "- ", t)
    t = _unwrap(r"(?<![\w:\\/.])\\[a-zA-Z]+\*?(?:\[[^\[\]\n]*\])?\{([^{}\n]*)\}", t)
    t = re.sub(r"(?<=[0-9a-zA-Z])\\%", "%", t)
    # Markdown
    t = re.sub(r"!\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1", t)
    t = re.sub(r"(?<!\[)\[([^\[\]\n]+)\](?:\([^()\n]*\)|\[[^\[\]\n]*\])", r"\1", t)
    t = re.sub(r"(?m)^(\s*)(?:[-*+•]\s+)+\[[ xX]\]\s+(?:[-*+•]\s+)?", r"\1- ", t)
    t = re.sub(r"\*\*(?=\S)(.+?)(?<=\S)\*\*|(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)", lambda m: m[1] or m[2], t)
    t = re.sub(r"~~(?=\S)([^~\n]+)(?<=\S)~~", r"\1", t)
    t = re.sub(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*)(?<=[^\s*])\*(?![\w*])", r"\1", t)
    t = re.sub(r"(?m)^\s*\|?(?:\s*:?-{3,}:?\s*\|)+(?:\s*:?-{3,}:?\s*)?\n?", "", t)
    t = re.sub(r"(?m)^\s*(?:```|~~~).*\n?", "", t)
    t = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", t)).strip("\n")
    return re.sub(r"\x02(\d+)\x03", lambda m: kept[int(m[1])], t)


def cleaned(texts: DataFrame) -> DataFrame:
    """(text_id, clean_text) of each distinct (text_id, text)."""

    @F.pandas_udf(T.StringType())
    def run(col: pd.Series) -> pd.Series:
        return col.map(clean)

    return spread(texts.select("text_id", "text").dropDuplicates()).select("text_id", run("text").alias("clean_text"))
