from lexigrid.llm import page_body as P

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var p='<p>no</p>';</script></head><body>
<{nav}><ul><li><a href="/1">Home</a><li><a href="/2">News</a></ul></{nav}>
<aside><h3>Most read</h3><ul><li><a href="/3">Notes on {a}</a></li></ul><p>Teaser {a}. Read on</p></aside>
<{body}><h1>Patch <b>1.{i}</b></h1><span>By Ann Bee, Game team</span><p>Share this update: Post | Mail ({i})</p>
<h2>Notes on {a}</h2><p>{a} <span class=v>text</span> here.<p>{a}s is second<table><tr><td>Row {a}: 1 &rarr; 2<tr><td>{a} row two</table>
<ul><li><a href="#x">Entry {a}</a></ul><div class=q>Advertisement</div><p>Older: Notes on {a}</p></{body}>
<footer><small>&copy; 2020 Game</small></footer></body></html>"""
LINES = "Home\nNews\nMost read\nNotes on {a}\nTeaser {a}. Read on\nPatch 1.{i}\nBy Ann Bee, Game team\nShare this update: Post | Mail ({i})\nNotes on {a}\n{a} **text** here.\n{a}s is second\nRow {a}: 1 → 2\n```\n{a} code\n```\n{a} row two\nEntry {a}\nAdvertisement\nOlder: Notes on {a}\n© 2020 Game"
MAIN = {5, 8, 9, 10, 11, 12, 13, 14, 15, 16}


NAMES = ["Ada", "Bob", "Cid", "Dee", "Eve", "Fay", "Gus", "Hal"]


def rows():
    out = []
    for i, a in enumerate(NAMES):
        nav, body = (("nav", "main"), ("div", "div"), ("div", "article"))[i % 3]
        out.append((f"d{i}", "h.site.example", LINES.format(i=i, a=a), PAGE.format(i=i, a=a, nav=nav, body=body)))
    return out


def test_judge():
    for _, _, text, page in rows():
        stands, _ = P.judge(text.split("\n"), page)
        # a share prompt and a pointer are paragraphs that repetition judges
        assert {i for i, m in enumerate(stands) if m != P.OUTSIDE} == MAIN | {7, 18}
        assert stands[7] == stands[18] == P.PARAGRAPH and stands[5] == stands[8] == P.OWN


def test_runs():
    assert P.runs([3, 3, 3], 6) == [(0, 2), (1, 3)]
    assert P.runs([1, 9, 1], 6) == [(0, 2), (1, 2), (1, 3)]
    assert P.runs([1, 1], 6) == [] and P.runs([], 6) == []
    # every long repeated run is covered by the keyed ones inside it
    import random

    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(1, 12))]
        kept = P.runs(sizes, 10)
        for a in range(len(sizes)):
            for b in range(a + 1, len(sizes) + 1):
                if sum(sizes[a:b]) >= 10:
                    assert {k for x, y in kept if a <= x and y <= b for k in range(x, y)} == set(range(a, b))


def test_once_a_page(spark):
    rows = [(300, 0, 1000.0), (300, 40, 1000.0), (30, 0, 1000.0), (3, 0, 10.0), (10, 0, 10.0), (190, 3, 1000.0)]
    got = spark.createDataFrame(rows, "n bigint, twice bigint, pages double")
    assert [r.x for r in got.select(P.once(P.F.col("n"), P.F.col("twice"), P.F.col("pages"), 0.1, 5.0).alias("x")).collect()] == [True, False, False, False, True, True]


def test_table_layout():
    page = "<TABLE><TR><TD><ul><li><a href=/a>Home</a></ul></TD></TR></TABLE><TABLE><TR><TD><H1>T</H1><P>x y<table><tr><TD>r</TD></tr></table><P>z</TD></TR></TABLE><TABLE><TR><TD><P>All rights</P></TD></TR></TABLE>"
    stands, _ = P.judge(["Home", "T", "x y", "r", "z", "All rights"], page)
    assert [x != P.OUTSIDE for x in stands] == [False, True, True, True, True, False]


def test_found(spark):
    df = spark.createDataFrame([*rows(), rows()[0], ("n", "h.site.example", None, None), ("e", None, "", None), ("p", "own.example", "Head\nBy Ann Bee, Game team\n\nx", None)], "document_id string, host string, text string, content string").dropDuplicates()
    got: dict = {}
    for r in P.found(df).collect():
        got.setdefault(r.document_id, set()).add(r.line_no)
    want = set(range(20)) - MAIN
    assert "p" not in got  # a page of a site of its own repeats nothing
    assert {k: sorted(v ^ want) for k, v in got.items()} == {f"d{i}": [] for i in range(len(NAMES))}
    reasons = {(r.line_no, r.reason) for r in P.judged(df).collect()}
    assert (18, "template_opening") in reasons and {n for n, r in reasons if r != "slot"} <= want
    body = {r.document_id: r.body for r in P.bodies(df).collect()}
    assert body["n"] is None and body["e"] == "" and body["d0"].split("\n")[0] == "Patch 1.0" and len(body["d0"].split("\n")) == len(MAIN)
    assert P.found(df.limit(0)).collect() == []


def test_page_bodies(spark):
    df = spark.createDataFrame([(d, h, page) for d, h, _, page in rows()] + [("x", None, None)], "path string, host string, content string")
    got = {r.path: r.body for r in P.page_bodies(df).collect()}
    assert got["d0"] == "Patch 1.0\n# Notes on Ada\nAda text here.\nAdas is second\n- Row Ada: 1 → 2\n- Ada row two\n- Entry Ada"
    assert got["x"] is None and len(got) == len(NAMES) + 1
    assert P.page_text(None) is None and P.page_text("") == "" and P.page_text("<p>" * 2000 + "x").endswith("x")


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "document_id string, host string, text string, content string, site string, n int, key bigint")
    assert P.found(df).collect() == [] and P.bodies(df).collect() == []
    more = spark.createDataFrame([(*r, "s", 1, 2, "k") for r in rows()], "document_id string, host string, text string, content string, site string, n int, use int, keys string")
    assert P.found(more).count() == len(NAMES) * (20 - len(MAIN))


def test_malformed():
    for junk in ("<", "<div", "</p></p>", "<table><td>a<table>", "<h1></h1>", "<!--", "&#x;", "<a href='"):
        P.read_page(junk)


def test_align_long_pages():
    lines = ["menu", *(f"line {i}" for i in range(2500))]
    blocks = [P.Block(x, "p", (), 0.0) for x in [*lines[1:], "menu"]]
    assert P.align(lines, blocks) == [-1, *range(2500)]
