import pytest

from lexigrid.llm import markup as M

RESIDUE = [
    ("a <b>x</b>", {"html"}), ("x<BR />", {"html"}), ("&lt;strong&gt;", {"html"}), ("it&#x27;s", {"html"}), ("x<!-- block 3 -->", {"html"}), ("</div>", {"html"}), ("<LI>one", {"html"}),
    ("**a b**", {"markdown"}), ("__a__ b", {"markdown"}), ("`x`", {"markdown"}), ("~~x~~", {"markdown"}), ("[a](https://b.c/d)", {"markdown"}), ("[a][3]", {"markdown"}), ("![a](/b.png)", {"markdown"}), ("- [x] a", {"markdown"}), ("|---|---|", {"markdown"}), ("```\nx\n```", {"markdown"}),
    ("[[a|b]]", {"wiki"}), ("{{ai|b}}", {"wiki"}), ("'''b'''", {"wiki"}), ("''b''", {"wiki"}), ("== a ==", {"wiki"}), ("[https://a.b/c d]", {"wiki"}), ("{| class=\"wikitable\"\n|-\n|}", {"wiki"}),
    ("\\section{A}", {"latex"}), ("\\textbf{a}", {"latex"}), ("$D = 8 + \\frac{3}{10} \\times L$", {"latex"}), ("\\(x_{1} \\leq 2\\)", {"latex"}), ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"latex"}), ("5\\% \\rightarrow 6\\%", {"latex"}),
    ("**a** <i>b</i> [[c]]", {"markdown", "html", "wiki"}), ("<x-note>a</x-note>", {"html"}),
]
PLAIN = ["# Head", "- item", "* item", "• item", "a <3", "x >_< y", "a > 12 and b > 9", "2 * level + 8", "* not in every region", "$4.99 instead of $6.99", "net_graph_15", "C:\\Games\\Fazar\\logs", "R&D & more", "100% => 150% -> 3 → 4", "HP < 40% of", "x ~ the quiet one ~", "a | b | c", "d'accord l''", "", " ", None, "a *", "f(x)[0]", "[sic] (x)", "<Name> wins", "</x> <x>", "a ** b **c", "`a", "{{a", "]] [["]


@pytest.mark.parametrize("text,kinds", RESIDUE)
def test_residue(text, kinds):
    assert {t[2] for t in M.tokens(text)} == kinds


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert M.tokens(text) == []
    assert M.clean(text) == text


@pytest.mark.parametrize(
    "text,want",
    [
        ("<h2>A</h2><p>x &amp; y</p><ul><li>b</li></ul>", "\n## A\n\nx & y\n\n- b\n".strip("\n")),
        ("== A ==\n[[x|y]] '''z'''", "## A\ny z"),
        ("\\section{A}\n\\begin{itemize}\n\\item b\n\\end{itemize}\n$D = \\frac{1}{2}$", "# A\n- b\n$D = \\frac{1}{2}$"),
        ("```\nx **y**\n```\n**z**", "    x **y**\nz"),
        ("<pre><code>set a_b 5</code></pre>", "    set a_b 5"),
        ("- [x] a `b_c` ~~d~~ [e](http://f)", "- a b_c d e"),
    ],
)
def test_clean(text, want):
    assert M.clean(text) == want


def test_found_and_template(spark):
    rows = [("1", "h", "<b>x</b>"), ("2", "h", "y"), ("3", "h", "<b>a</b> <b>c</b> **d**"), ("3", "h", "<b>a</b> <b>c</b> **d**"), ("4", None, "[[z]]"), ("5", "h", None), ("6", "h", "<b>" * 30000)]
    df = spark.createDataFrame(rows, "text_id string, host string, text string").dropDuplicates()
    assert sorted(map(tuple, M.found(df).collect())) == [("1", "html"), ("3", "html"), ("3", "markdown"), ("4", "wiki"), ("6", "html")]
    assert M.found(df.limit(0)).collect() == []
    rows = M.template(M.occurrences(df.where("text_id in ('1', '3')"))).collect()
    got = {tuple(r.tokens): r for r in rows}
    assert set(got) == {("<b>", "</b>"), ("markdown:strong(", "markdown:strong)")} and all(r.parent is None for r in rows)


def test_classes_decide(spark):
    """Marks without a partner are lexed and refused by their classes, on a host where others are paired."""
    rows = [("1", "h", "**a** $4.99 [sic]"), ("2", "h", "a **b and [c"), ("3", "h", "<x>a</x>"), ("4", "h", "a <x> b"), ("5", "h", "</x> <x>")]
    df = spark.createDataFrame(rows, "text_id string, host string, text string")
    occ = M.occurrences(df)
    assert {r.text_id for r in occ.select("text_id").distinct().collect()} == {"1", "2", "3", "4", "5"}
    assert sorted(map(tuple, M.found(df).collect())) == [("1", "markdown"), ("3", "html")]
    refused = {r.token for r in M.classes(occ).where("NOT valid").collect()}
    assert {"latex:formula~(", "markdown:strong~(", "<x>~", "</x>~"} <= refused


def test_nested_template(spark):
    rows = [(str(i), "h", f"<x><y>{i}</y> **b{i}**</x>") for i in range(3)]
    df = spark.createDataFrame(rows, "text_id string, host string, text string")
    # all marks stand once in each text: one class, from which the slots follow
    (one,) = M.template(M.occurrences(df)).collect()
    assert one.tokens == ["<x>", "<y>", "</y>", "markdown:strong(", "markdown:strong)", "</x>"] and one.n_texts == 3
    more = df.unionByName(spark.createDataFrame([("9", "h", "<x>z</x>")], df.schema))
    got = {tuple(r.tokens): r for r in M.template(M.occurrences(more)).collect()}
    inner, outer = got[("<y>", "</y>", "markdown:strong(", "markdown:strong)")], got[("<x>", "</x>")]
    assert inner.parent == outer.class_id and outer.parent is None


def test_slots(spark):
    df = spark.createDataFrame([("1", "h", "a <b>x</b>\n**y** z"), ("2", "h", "plain [sic]"), ("3", "h", None)], "text_id string, host string, text string")
    got = [(r.slot_no, r.after, r.before, r.text) for r in M.slots(df).orderBy("slot_no").collect()]
    assert got == [(0, None, "<b>", "a"), (1, "<b>", "</b>", "x"), (2, "markdown:strong(", "markdown:strong)", "y"), (3, "markdown:strong)", None, "z")]


def test_long_and_deep():
    for text in ("\\(" + "x+" * 400 + "x\\)", "\\[" + "x\n" * 2000 + "\\]", "$x=" + "1+" * 400 + "1$"):
        name = "latex:display" if text[1] == "[" else "latex:formula"
        assert M.tokens(f"a {text} b") == [(2, 3, "latex", name + "("), (1 + len(text), 2 + len(text), "latex", name + ")")]
        assert M.clean(f"a {text} **b**") == f"a {text} b"
    assert M.clean("{{a|" * 6 + "x" + "}}" * 6) == "x" and M.clean("\\emph{" * 6 + "x" + "}" * 6) == "x"
    for pat in (p for k, n, p in M.COMPILED if (k, n) in (("latex", "display"), ("latex", "formula"))):
        for text in ("\\(" * 50000, "\\[" * 50000, "\\( x\n" * 20000, "\\(x\\)" * 20000):
            list(M.spans(pat, text))


def test_spans_as_by_pattern():
    import random
    import re

    rng = random.Random(5)
    bounded = [re.compile(r"\$\$[^$]+\$\$|\\\[[\s\S]+?\\\]"), re.compile(r"\\\([^\n]+?\\\)|(?<![\\$\w])\$(?!\s)(?=[^$\n]*[\\^_={}])[^$\n]+(?<![\s\\])\$(?!\w)")]
    scanned = [p for k, n, p in M.COMPILED if (k, n) in (("latex", "display"), ("latex", "formula"))]
    for _ in range(3000):
        text = "".join(rng.choice(["\\(", "\\)", "\\[", "\\]", "$", "$$", "\n", " ", "x", "_", "\\"]) for _ in range(rng.randint(0, 14)))
        for one, other in zip(bounded, scanned):
            assert [m.span() for m in one.finditer(text)] == list(M.spans(other, text)), text
