import json

import pytest

from lexigrid import pipeline
from lexigrid.operators import pages, structure as S

PAGE = """<html><head><title> My page </title><meta property="og:description" content="about"><link rel="canonical" href="/c"></head><body>
<nav><a href="/a">A</a><a href="/b">B</a></nav><article><h1>Top</h1><p>Intro of March 3, 2020<p>Next <b>one</b><h2>Sub</h2><ul><li>x<p>y</p><li>z</ul>
<div class="stat-row"><span>DAMAGE</span> <span>1 =&gt; 2</span></div><div><div>inner text</div></div><table><tr><th>a<th>b<tr><td>1<td>2</table><img src="i.png" alt="pic"><h1>Other</h1><blockquote>q</blockquote><a href="/l#x">link</a><a href="/l">again</a></article>
<script>var x = "<p>no</p>"</script></body></html>"""


def test_blocks():
    p = S.parse(PAGE, "https://s.example/")
    assert p["status"] == "ok" and p["title"] == "My page" and p["description"] == "about" and p["canonical_url"] == "https://s.example/c" and p["date_text"] == "March 3, 2020" and p["root_tag"] == "article"
    got = [(b["block_type"], b["text"], b["heading_path"]) for b in p["blocks"]]
    assert got == [
        ("heading", "Top", "Top"), ("paragraph", "Intro of March 3, 2020", "Top"), ("paragraph", "Next one", "Top"), ("heading", "Sub", "Top > Sub"), ("list_item", "x y", "Top > Sub"), ("list_item", "z", "Top > Sub"),
        ("change_row", "DAMAGE 1 → 2", "Top > Sub"), ("text_container", "inner text", "Top > Sub"), ("table", "a | b\n1 | 2", "Top > Sub"), ("media", "pic", "Top > Sub"), ("heading", "Other", "Other"), ("blockquote", "q", "Other"),
    ]
    assert [x["url"] for x in p["links"]] == ["https://s.example/l"] and p["assets"] == [{"url": "https://s.example/i.png", "text": "pic"}]


def test_visible_blocks_are_merged():
    extra = json.dumps([{"text": "- Intro", "tag": "DIV"}, {"text": "new => text", "heading_level": 2, "block_type": "heading"}, {"text": "https://x.y"}, 3])
    p = S.parse(f'<body><p>Intro</p><script id="{S.VISIBLE_ID}">{extra}</script></body>')
    assert [(b["text"], b["source"], b["heading_path"]) for b in p["blocks"]] == [("Intro", "html", ""), ("new → text", "visible", "new → text")]
    assert S.visible_blocks(S.tree(f'<script id="{S.VISIBLE_ID}">no json</script>')) == []


@pytest.mark.parametrize("content,status", [(None, "error"), ("", "error"), ("  ", "error"), ("plain", "ok"), ("<p>" * 5000 + "x", "ok"), ("</div><li><td>", "ok")])
def test_odd_pages(content, status):
    assert S.parse(content)["status"] == status


def test_table(spark):
    df = spark.createDataFrame([("a", PAGE), ("b", None), ("c", PAGE)], "path string, content string")
    got = S.structured_pages(df, spark.createDataFrame([("c",)], "path string"))
    assert {(r.path, r.status) for r in got.collect()} == {("a", "ok"), ("b", "error")}
    assert S.page_blocks(got).count() == 12
    assert S.structured_pages(df.limit(0)).collect() == []


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/patchnote_corpus.parquet").dropDuplicates(["document_id"])
    t = pipeline.run(docs, str(tmp_path / "run"))
    assert t["items"].count() == t["annotations"].count() > 0 and t["label_shares"].count() == 7 * t["corpus_summary"].count()
    with pytest.raises(FileExistsError):
        pipeline.run(docs, str(tmp_path / "run"))


def test_small_furniture_paths_and_attributes():
    root = S.tree("<html><body><div class='share-box'>Share</div><div id=a><p>x</p><p class=k href=/u>y</p></div><div class=cookie>" + "long " * 100 + "</div></body></html>")
    S.strip_marked(root)
    assert root.text().startswith("x y long") and "Share" not in root.text()
    p = [n for n in root.walk() if n.tag == "p"][1]
    assert S.element_path(p) == "body:nth-of-type(1) > div#a:nth-of-type(1) > p:nth-of-type(2)" and S.kept_attributes(p) == {"class": "k", "href": "/u"}


def test_media_text(spark):
    rows = [("p", 0, "h2", "heading", "T", None, None), ("p", 1, "img", "media", "", "A", "/a.png"), ("p", 2, "hr", "separator", "", None, None), ("p", 3, "blockquote", "blockquote", "q", None, None), ("p", 4, "li", "list_item", "e", None, None)]
    df = spark.createDataFrame(rows, "path string, pos int, tag string, block_type string, text string, alt string, src string")
    assert pages.marked_media_text(df).collect()[0].text == "## T\n\n![A](/a.png)\n\n---\n\n> q\n\n- e\n"
