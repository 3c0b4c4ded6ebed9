"""Column functions on text. Patterns are written so that Java, RE2 and Python read them alike."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

WS = r"[\t-\r\x{85}\p{Z}]+"
ENDS = r"^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$"
WORD = r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)?"
LM_TOKEN = r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*|[.!?,;:]"
PROFILE_TOKEN = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*|[^\s\p{Z}\p{L}\p{N}]"
SENTENCE_CUT = r"([.!?])[\t-\r\x{85}\p{Z}]+([A-Z0-9\"'“])"
SYMBOLS_ONLY = r"^[\p{S}\p{P}]+$"
CONTROL = r"[\p{Cf}\p{Cc}]"
ARROW = r"(→|⇒|=>|->)"
ANY_ARROW = r"[\t-\r\x{85}\p{Z}]*(?:⇒|→|⟶|⟹|=>|->)[\t-\r\x{85}\p{Z}]*"
URL = r"(?i)https?://[^\s\p{Z}]+"
MD_IMAGE = r"!\[[^\]]*\]\([^)]*\)"
MD_LINK = r"\[([^\]]+)\]\(https?://[^)]+\)"
TAG = r"<[^>]+>"
BULLET = r"^[\t-\r\x{85}\p{Z}]*[-*•][\t-\r\x{85}\p{Z}]+"
HEADING = r"^#{1,6} (.+)$"
YEAR = r"(?:^|[^\p{L}\p{N}_])((?:20|19)[0-9]{2})(?:[^\p{L}\p{N}_]|$)"
#: Three written forms of a version: "patch 1.2b", "patch-1-2b", a bare "1.2b".
VERSION_FORMS = (
    r"(?i)(?:^|[^\p{L}\p{N}_])patch[\t-\r\x{85}\p{Z}]+([0-9]{1,2})[.\-]([0-9]{1,2})([a-z]?)(?:[^\p{L}\p{N}_]|$)",
    r"(?i)(?:^|[^\p{L}\p{N}_])patch-([0-9]{1,2})-([0-9]{1,2})([a-z]?)(?:[^\p{L}\p{N}_]|$)",
    r"(?i)(?:^|[^0-9])([0-9]{1,2})\.([0-9]{1,2})([a-z]?)(?:[^a-zA-Z0-9]|$)",
)
NO_VALUE = ("", "nan", "none", "null")


def all_matches(c, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def squeeze(c) -> Column:
    """Runs of white space as one space, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, WS, " "))


def words(c) -> Column:
    return all_matches(F.coalesce(c, F.lit("")), WORD)


def word_count(c) -> Column:
    return F.size(words(c)).cast("bigint")


def lm_tokens(c) -> Column:
    return all_matches(F.lower(c), LM_TOKEN)


def profile_tokens(c) -> Column:
    return all_matches(F.coalesce(c, F.lit("")), PROFILE_TOKEN)


def symbols_only(c) -> Column:
    return c.rlike(SYMBOLS_ONLY)


def has_control(c) -> Column:
    return c.rlike(CONTROL)


def sentences(c) -> Column:
    """Sentences of squeezed text; the empty text has none."""
    t = squeeze(F.coalesce(c, F.lit("")))
    return F.filter(F.transform(F.split(F.regexp_replace(t, SENTENCE_CUT, "$1\u0001$2"), "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def strip(c) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, ENDS, "")


def meta(c) -> Column:
    """A metadata value: null, blank and words for no value become ''."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t).isin(*NO_VALUE), "").otherwise(t)


def clean_meta(c) -> Column:
    """meta() without a table prefix `|-|`."""
    return strip(F.regexp_replace(meta(c), r"^\|-\|\s*", ""))


def first_value(*cols) -> Column:
    """The first value that is not ''; '' if none."""
    return F.coalesce(*[F.nullif(meta(c), F.lit("")) for c in cols], F.lit(""))


@F.pandas_udf(T.StringType())
def unescape(col: pd.Series) -> pd.Series:
    """Character references as characters; only texts with an ampersand reach this function."""
    return col.map(lambda t: _html.unescape(t) if isinstance(t, str) else t)


def unescaped(c) -> Column:
    """JVM-side for the usual references; the UDF is left to callers with other ones (`unescape`)."""
    out = c
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&rarr;", "→"), ("&mdash;", "—"), ("&copy;", "©"), ("&#8594;", "→"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(ch))
    return out


def clean_line(c) -> Column:
    """One line without images, link targets, URLs, tags and bullets; arrows as ` → `."""
    t = F.regexp_replace(c, MD_IMAGE, "")
    t = F.regexp_replace(t, MD_LINK, "$1")
    t = F.regexp_replace(t, URL, "")
    t = unescaped(F.regexp_replace(t, TAG, " "))
    t = F.regexp_replace(F.regexp_replace(t, BULLET, ""), ANY_ARROW, " → ")
    return squeeze(t)


def clean_each(lines) -> Column:
    """clean_line() for an array of lines; each step only runs on the lines that hold its sign."""

    def step(a, test, f):
        return F.transform(a, lambda x: F.when(test(x), f(x)).otherwise(x))

    has = lambda *signs: lambda x: _any([F.contains(x, F.lit(s)) for s in signs])
    a = step(lines, has("]("), lambda x: F.regexp_replace(F.regexp_replace(x, MD_IMAGE, ""), MD_LINK, "$1"))
    a = step(a, has("://"), lambda x: F.regexp_replace(x, URL, ""))
    a = step(a, has("<"), lambda x: F.regexp_replace(x, TAG, " "))
    a = step(a, has("&"), unescaped)
    a = step(a, has("-", "*", "•"), lambda x: F.regexp_replace(x, BULLET, ""))
    a = step(a, has("⇒", "→", "⟶", "⟹", "=>", "->"), lambda x: F.regexp_replace(x, ANY_ARROW, " → "))
    return F.transform(a, squeeze)


def _any(conditions) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def year_of(*cols) -> Column:
    """The first 19xx or 20xx in the first value that holds one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), YEAR, 1), F.lit("")) for c in cols]).cast("int")


def version_of(*cols) -> Column:
    """The version of the first value that holds one, numbers without leading zeros, suffix in lower case."""

    def one(c, p):
        c = F.coalesce(c, F.lit(""))
        major, minor, suffix = (F.regexp_extract(c, p, i) for i in (1, 2, 3))
        return F.when(major != "", F.concat(F.try_to_number(major, F.lit("99")).cast("int").cast("string"), F.lit("."), F.try_to_number(minor, F.lit("99")).cast("int").cast("string"), F.lower(suffix)))

    return F.coalesce(*[one(c, p) for c in cols for p in VERSION_FORMS])


def version_key(c) -> Column:
    """A struct that orders versions: major, minor, suffix."""
    return F.struct(F.regexp_extract(c, r"^(\d+)", 1).try_cast("int").alias("major"), F.regexp_extract(c, r"^\d+\.(\d+)", 1).try_cast("int").alias("minor"), F.regexp_extract(c, r"([a-z]*)$", 1).alias("suffix"))


def slug(c) -> Column:
    t = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), r"-+", "-")
    return F.lower(F.regexp_replace(t, r"^-+|-+$", ""))


def safe_id(c, fallback: str = "run") -> Column:
    t = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(fallback))


def percent(c) -> Column:
    """A share as text; a share that rounds to nothing as <0.1%."""
    return F.when(c.isNull() | F.isnan(c), "").when(c == 0, "0%").when(c < 0.001, "<0.1%").otherwise(F.format_string("%.1f%%", c * 100))


def title_case(c) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def post_clean(c) -> Column:
    """Text of a forum post: references as characters, no URLs, no r/ and u/ names, squeezed."""
    t = F.regexp_replace(unescaped(F.coalesce(c, F.lit(""))), r"https?://[^\s\p{Z}]+|www\.[^\s\p{Z}]+", " ")
    return squeeze(F.regexp_replace(t, r"(^|[^\p{L}\p{N}_])[ru]/[\p{L}\p{N}_]+", "$1 "))


def md5_unit(*cols) -> Column:
    """A number in [0, 2^32) from the MD5 of the columns: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def squeeze_lines(c) -> Column:
    """Each line squeezed, blank lines left out."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r"), squeeze), lambda x: x != ""), "\n")


def utc_now() -> Column:
    """The time of the query in UTC, to the second, with its zone."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def mapped(c, names: dict) -> Column:
    """The name of a value, or the value itself where it has none."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    return c if table is None else F.coalesce(table[c], c)
