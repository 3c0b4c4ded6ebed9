"""Column functions on URLs and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/@?#]*@)?([^/:?#]+)(?::[0-9]+)?([^?#]*)"


def host(c) -> Column:
    return F.lower(F.regexp_extract(c, URL_PARTS, 2))


def path(c) -> Column:
    """The path without slashes at its end; '/' for none."""
    p = F.regexp_replace(F.regexp_extract(c, URL_PARTS, 3), r"/+$", "")
    return F.when(p == "", "/").otherwise(p)


def last_part(c) -> Column:
    return F.element_at(F.split(path(c), "/"), -1)


def canonical(c, keep_query: bool = False) -> Column:
    """Without fragment and, unless kept, query; with a slash at the end where the query is dropped."""
    if keep_query:
        return F.regexp_replace(c, r"#.*$", "")
    bare = F.regexp_replace(c, r"[?#].*$", "")
    return F.when(bare.rlike(r"/$"), bare).otherwise(F.concat(bare, F.lit("/")))


def compare_form(c) -> Column:
    return F.concat(F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)), F.lit("://"), host(c), path(c))


def safe_name(c, most: int = 120) -> Column:
    t = F.regexp_replace(F.lower(F.trim(c)), r"^https?://", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9._-]+", "_"), r"_+", "_")
    t = F.regexp_replace(t, r"^[_.\-]+|[_.\-]+$", "")
    t = F.when(t == "", "untitled").otherwise(t)
    return F.regexp_replace(F.substring(t, 1, most), r"^[_.\-]+|[_.\-]+$", "")


def output_id(c) -> Column:
    p = F.regexp_replace(path(c), r"^/+", "")
    return safe_name(F.replace(F.when(p == "", "home").otherwise(p), F.lit("/"), F.lit("_")))


#: Single path parts that are site pages and no themed pages, and openings of paths of site pages.
SITE_PAGES = ("home", "news", "updates", "heroes", "items", "esports", "workshop", "store", "pastupdates", "patches", "play", "main", "leaderboards")
SITE_PATHS = (
    "/heroes", "/hero/", "/items", "/esports", "/workshop", "/store", "/news", "/patches", "/pastupdates", "/home", "/community", "/privacy", "/login", "/play", "/main", "/leaderboards",
)


def microsite(c) -> Column:
    """A page of its own at the root of its host: one part without a dot, of three characters or more, that is no site page."""
    parts = F.filter(F.split(F.lower(path(c)), "/"), lambda x: x != "")
    one = F.concat(F.lit("/"), F.get(parts, 0))
    site = F.get(parts, 0).isin(*SITE_PAGES)
    for p in SITE_PATHS:
        site = site | F.startswith(one, F.lit(p))
    return (F.size(parts) == 1) & ~site & ~F.contains(one, F.lit(".")) & (F.length(one) >= 4)


def kind(c, base_host: Column | None = None) -> Column:
    """newsentry, patch_page, microsite or null; null for other hosts than base_host."""
    p = path(c)
    out = F.when(F.startswith(p, F.lit("/newsentry/")), "newsentry").when(F.startswith(p, F.lit("/patches/")) | (p == "/patches"), "patch_page").when(microsite(c), "microsite")
    return out if base_host is None else F.when(host(c) == F.lower(base_host), out)
