import pytest
from pyspark.sql import functions as F

from lexigrid.functions import text as X, urls as U


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).collect()[0].o


@pytest.mark.parametrize(
    "text,want",
    [("- **Attack Speed:** 35% => 33%", "**Attack Speed:** 35% → 33%"), ("See [notes](https://x.y/z) &amp; more https://a.b", "See notes & more"), ("<b>Mana</b>  cost:3->4", "Mana cost:3 → 4"), ("  ", "")],
)
def test_clean_line(spark, text, want):
    assert one(spark, text, X.clean_line) == want


def test_words(spark):
    assert one(spark, "can't re-added 35% state-of-the-art", X.words) == ["can't", "re-added", "35", "state-of", "the-art"]
    assert one(spark, None, X.word_count) == 0


def test_lm_tokens(spark):
    assert one(spark, "I'm ready! State-of-the-art... (ok)", X.lm_tokens) == ["i'm", "ready", "!", "state-of-the-art", ".", ".", ".", "ok"]


@pytest.mark.parametrize("text,want", [("v1.2 is out. now live! \"Quoted\" ok.", ["v1.2 is out. now live!", '"Quoted" ok.']), ("Up 3. 4 down", ["Up 3.", "4 down"]), ("", []), (None, [])])
def test_sentences(spark, text, want):
    assert one(spark, text, X.sentences) == want


@pytest.mark.parametrize("text,want", [("patch-14-10b-notes", "14.10b"), ("Patch 26.09 Notes", "26.9"), ("7.00", "7.0"), ("7.07b", "7.7b"), ("v7.34bc", None), (None, None)])
def test_version(spark, text, want):
    assert one(spark, text, lambda c: X.version_of(c)) == want


def test_small_functions(spark):
    assert one(spark, "Run: A & B / v1.0!", X.slug) == "run-a-b-v1.0"
    assert one(spark, " a b/c ", X.safe_id) == "a_b_c" and one(spark, None, X.safe_id) == "run"
    assert one(spark, " NaN ", X.meta) == "" and one(spark, "|-| Name", X.clean_meta) == "Name"
    assert one(spark, "in 1999 and 2024", lambda c: X.year_of(F.lit("x"), c)) == 1999
    assert one(spark, "see r/abc and https://x.y u/me &lt;3", X.post_clean) == "see and <3"
    assert [one(spark, v, lambda c: X.percent(c.cast("double"))) for v in ("0", "0.0004", "0.1234", None)] == ["0%", "<0.1%", "12.3%", ""]
    assert one(spark, "a_b", X.title_case) == "A B"
    assert one(spark, "x &copy; &eacute;", X.unescape) == "x © é"


def test_urls(spark):
    u = "HTTPS://Www.Site.Example/en/News/patch-1-2/?a=1#x"
    assert one(spark, u, U.host) == "www.site.example" and one(spark, u, U.path) == "/en/News/patch-1-2"
    assert one(spark, "https://a.b/c?x#y", U.canonical) == "https://a.b/c/" and one(spark, "https://a.b/c?x#y", lambda c: U.canonical(c, True)) == "https://a.b/c?x"
    assert one(spark, "https://a.b", U.output_id) == "home" and one(spark, "https://a.b/x/y.z", U.output_id) == "x_y.z"
    assert [one(spark, f"https://a.b{p}", U.kind) for p in ("/newsentry/1", "/patches/1.2", "/largo", "/news", "/a/b", "")] == ["newsentry", "patch_page", "microsite", None, None, None]
    assert one(spark, None, U.host) is None
