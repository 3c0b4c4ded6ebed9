"""From raw texts to a clean corpus, page-order units and target items with context.

Lines, units and context windows stay inside one row of their document (array functions), so no step but the
keep-first of equal texts shuffles anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lexigrid.functions import text as X

#: Lines of any text that are page furniture, compared in lower case without marks.
NOISE_LINES = ("back to top", "share", "copy link", "copied", "show more", "read more", "load more")
#: Closing lines of a site, which only give context.
TRAILING_NOISE = (
    "dota and the dota logo are trademarks and/or registered trademarks of valve corporation.",
    "2025 valve corporation, all rights reserved.",
    "dota and the dota logo are trademarks and/or registered trademarks of valve corporation. 2025 valve corporation, all rights reserved.",
)
#: Furniture of rendered pages.
RENDERED_NOISE = (
    "home", "news", "heroes", "items", "store", "esports", "login", "logout", "(logout)", "patches", "gameplay updates", "previous updates", "select language", "play for free", "builds",
    "steam guides", "view hero detail page", "english",
    *TRAILING_NOISE,
)
#: Headings that only give context.
CONTEXT_HEADINGS = (
    "abilities", "talents", "items", "champions", "heroes", "systems", "system", "general",
    "general updates", "neutral items", "hero updates", "item updates", "bugfixes",
    "bugfixes/qol changes", "bugfixes & qol changes", "qol changes", "base stats",
    "summoner spells", "runes", "skins", "chromas", "patch highlights", "removed items",
    "champion adjustments", "balance adjustments", "system changes", "arena", "augments",
)
#: Words that tell a change or a fix.
CHANGE_WORDS = (
    "fixed|fixes|bugfix|bugfixes|corrected|increased|decreased|reduced|adjusted|changed|renamed|added|re-added|readded|removed|re-enabled|reenabled|enabled|disabled|"
    "replaced|rescaled|reworked|uncapped|capped|now|no longer"
)
#: Terms of statistics rows.
STAT_TERMS = (
    "cooldown|damage|health|armor|armour|mana|speed|range|duration|cost|rating|rank|pool|regen|regeneration|strength|agility|intelligence|radius|bounty|gold|attack|cast|hp|spell|active|passive|"
    "slow|stun|shield|healing|heal|ap|ad|mr|resist|resistance"
)


def _word(alternatives: str) -> str:
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{alternatives})(?:[^\p{{L}}\p{{N}}_]|$)"


CHANGE = _word(CHANGE_WORDS)
STAT = _word(STAT_TERMS)
NUMBER = r"(?:^|[^A-Za-z])[-+]?[0-9]"
PERCENT = r"[0-9][\t-\r\x{85}\p{Z}]*%"
LINE_MARKS = r"^[>*•-][\t-\r\x{85}\p{Z}]+"

NOT_BLANK = r"[^\t-\r\x{85}\p{Z}]"

UNIT_TYPES = ("context_only_short_unit", "stat_or_list_line", "prose_sentence")


def clean_lines(text: Column, noise=(*NOISE_LINES, *RENDERED_NOISE)) -> Column:
    """The cleaned lines of a text: image lines and furniture dropped, of equal neighbours only the first kept."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: ~(F.contains(x, F.lit("![")) & x.rlike(X.MD_IMAGE)))
    lines = X.clean_each(raw)
    bare = lambda x: F.lower(F.regexp_replace(x, r"^[# \-*•\t]+|[# \-*•\t]+$", ""))
    longest = max(map(len, noise), default=0) + 8  # longer lines are no furniture, and marks alone are seen without a copy
    return F.filter(lines, lambda x: x.rlike(r"[^# \-*•\t]") & ((F.length(x) > longest) | ~bare(x).isin(*noise)))


def without_repeats(lines: Column) -> Column:
    return F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))


def build(texts: DataFrame, min_words: int = 20, order: str = "document_id") -> DataFrame:
    """Cleaned documents with counts and hash; of equal texts the first in order, short ones left out.

    texts: document_id, game, source_kind, patch_id, year, title, url, clean_text (raw or cleaned before).
    """
    keep = ["document_id", "game", "source_kind", "patch_id", "year", "title", "url"]
    t = texts.select(*keep, clean_lines(F.col("clean_text")).alias("lines")).withColumn("lines", without_repeats(F.col("lines")))
    t = t.withColumn("clean_text", F.array_join("lines", "\n")).withColumn("line_count", F.size("lines").cast("bigint")).drop("lines")
    t = t.withColumn("word_count", X.word_count(F.col("clean_text"))).withColumn("text_sha256", F.sha2("clean_text", 256))
    first = Window.partitionBy("text_sha256").orderBy(order, "game", "patch_id", "title")
    # short texts go last: before the window the planner would clean each text a second time to filter it
    return t.withColumn("__n", F.row_number().over(first)).where((F.col("__n") == 1) & (F.col("word_count") >= min_words)).drop("__n")


def summary(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("game").agg(F.count("*").alias("n_documents"), F.sum("word_count").cast("bigint").alias("n_words"), F.median("word_count").cast("double").alias("median_words"))


NO_UNITS = "CAST(array() AS ARRAY<STRUCT<line_index: BIGINT, unit_type: STRING, candidate: BOOLEAN, included: BOOLEAN, text: STRING, word_count: BIGINT>>)"


def line_facts(lines: Column) -> Column:
    """What the rules need to know of each line, each fact evaluated once: the steps hand over structs, as the
    planner shares no common parts inside a lambda."""
    a = F.transform(lines, lambda x, i: F.struct((i + 1).cast("bigint").alias("i"), X.squeeze(x).alias("s")))
    a = F.transform(a, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"), x["s"].rlike(X.HEADING).alias("heading")))
    text = lambda x: F.when(x["heading"], F.regexp_replace(X.squeeze(F.regexp_extract(x["s"], X.HEADING, 1)), r"^:+|:+$", "")).otherwise(F.trim(F.regexp_replace(x["s"], LINE_MARKS, "")))
    a = F.filter(F.transform(a, lambda x: F.struct(x["i"].alias("i"), x["heading"].alias("heading"), text(x).alias("t"))), lambda x: x["t"] != "")

    def facts(x):
        t = x["t"]
        return F.struct(
            x["i"].alias("i"), x["heading"].alias("heading"), t.alias("t"), F.regexp_replace(t, r"^[ :]+|[ :]+$", "").alias("bare"), X.word_count(t).alias("wc"), t.rlike(X.ARROW).alias("arrow"),
            t.rlike(CHANGE).alias("change"), t.rlike(STAT).alias("stat"), t.rlike(NUMBER).alias("number"), t.rlike(PERCENT).alias("percent"), F.contains(t, F.lit(":")).alias("colon"), t.rlike(r"[.!?]$").alias("ended"),
            F.lower(F.regexp_replace(t, r"^[ :]+|[ :]+$", "")).isin(*TRAILING_NOISE).alias("closing"), F.lower(t).isin(*TRAILING_NOISE).alias("closing_as_is"),
        )

    return F.transform(a, facts)


def context_only(x: Column) -> Column:
    """Kept as context: a closing line of the site, or no change signal, and a heading, a known heading or at most six words without an end mark."""
    signal = x["arrow"] | x["change"] | ((x["number"] | x["percent"]) & x["stat"])
    return (
        F.when((x["bare"] == "") | x["closing"], True)
        .when(signal, False)
        .when(x["heading"], True)
        .when(F.lower(x["bare"]).isin(*CONTEXT_HEADINGS), True)
        .otherwise((x["wc"] <= 6) & ~x["bare"].rlike(r"[.!?]$"))
    )


def stat_line(x: Column) -> Column:
    """A row of figures or a list entry: five rules in order."""
    wc, told = x["wc"], x["stat"] | x["change"]
    return (
        F.when((wc == 0) | x["closing_as_is"], False)
        .when(x["arrow"], True)
        .when(x["percent"] & (wc <= 40), True)
        .when(x["number"] & (wc <= 40) & (x["colon"] | told), True)
        .when((wc <= 30) & x["change"] & ~x["ended"], True)
        .otherwise(x["colon"] & (wc <= 30) & told)
    )


def line_units(x: Column, min_words: int) -> Column:
    """The units of one line's facts, as an array of structs."""

    def unit(text, wc, kind, target):
        return F.struct(x["i"].alias("line_index"), F.lit(kind).alias("unit_type"), F.lit(target).alias("candidate"), (F.lit(target) & (wc >= min_words)).alias("included"), text.alias("text"), wc.alias("word_count"))

    return (
        F.when(context_only(x), F.array(unit(x["t"], x["wc"], UNIT_TYPES[0], False)))
        .when(stat_line(x), F.array(unit(x["t"], x["wc"], UNIT_TYPES[1], True)))
        .otherwise(F.transform(X.sentences(x["t"]), lambda s: unit(s, X.word_count(s), UNIT_TYPES[2], True)))
    )


def document_units(corpus: DataFrame, min_words: int = 1) -> DataFrame:
    """The documents with the array of their units in page order."""
    lines = F.filter(F.split(F.coalesce("clean_text", F.lit("")), "\n"), lambda x: x.rlike(NOT_BLANK))
    found = F.flatten(F.transform(line_facts(lines), lambda x: line_units(x, min_words)))
    return corpus.withColumn("units", F.coalesce(found, F.expr(NO_UNITS)))


def units(corpus: DataFrame, min_words: int = 1) -> DataFrame:
    """One row per unit."""
    docs = document_units(corpus, min_words).select("document_id", "game", "patch_id", F.posexplode("units").alias("pos", "u"))
    return docs.select("document_id", "game", "patch_id", (F.col("pos") + 1).cast("bigint").alias("unit_order"), "u.*")


def items(corpus: DataFrame, min_words: int = 1, window: int = 5) -> DataFrame:
    """One row per target with up to `window` units of context on either side."""
    docs = document_units(corpus, min_words)
    target = F.filter(F.sequence(F.lit(0), F.greatest(F.size("units") - 1, F.lit(0))), lambda i: F.coalesce(F.get("units", i)["included"], F.lit(False)))

    def item(i, k):
        start = F.greatest(i - window, F.lit(0))
        text = lambda a: F.array_join(F.transform(a, lambda u: u["text"]), " || ")
        return F.struct((k + 1).cast("bigint").alias("item_order"), (i + 1).cast("bigint").alias("unit_order"), text(F.slice("units", start + 1, i - start)).alias("context_before"), F.get("units", i).alias("u"), text(F.slice("units", i + 2, F.lit(window))).alias("context_after"))

    rows = docs.select("document_id", "game", "source_kind", "patch_id", "year", "title", "url", F.explode(F.transform(target, item)).alias("t"))
    return rows.select(
        F.format_string("%s__item_%05d", "document_id", "t.item_order").alias("item_id"), "document_id", "game", "source_kind", "patch_id", "year", "title", "url", "t.item_order", "t.unit_order",
        F.col("t.u.line_index").alias("line_index"), F.col("t.u.unit_type").alias("target_type"), "t.context_before", F.col("t.u.text").alias("target_text"), "t.context_after",
        F.col("t.u.word_count").alias("target_word_count"), F.length("t.u.text").cast("bigint").alias("target_char_count"), F.sha2(F.col("t.u.text"), 256).alias("target_sha256"),
    )
