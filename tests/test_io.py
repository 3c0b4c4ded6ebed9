import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import annotate, nested
from lexigrid.sources import files, sinks
from lexigrid.streaming import resume


def test_csv_and_labels(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿genre, title,label\nMEM,"one, two",REAL\nHIST,"three\nfour",FAKE\n', encoding="utf-8")
    df = files.csv(spark, str(p), genre=["MEM"])
    assert df.columns == ["genre", "title", "label"] and df.count() == 1
    assert {r.text for r in files.labelled(spark, str(p)).collect()} == {"one, two", "three\nfour"}
    with pytest.raises(ValueError):
        files.labelled(spark, str(p), label="nope")


def test_json_lines(spark, tmp_path):
    lines = '{"id": "a", "body": "x"}\nnot json\n{"id": "b"}\n'
    (tmp_path / "x.jsonl").write_text(lines)
    assert [tuple(r) for r in files.json_lines(spark, str(tmp_path / "x.jsonl"), "id string, body string").orderBy("id").collect()] == [("a", "x"), ("b", None)]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("b.jsonl", lines)
        z.writestr("a.json", '{"id": "c"}\n')
        z.writestr("c.txt", '{"id": "no"}\n')
    got = files.json_lines_zip(spark, str(tmp_path / "x.zip"), "id string, body string").orderBy("source_pos").collect()
    assert [(r.source_pos, r.id) for r in got] == [(0, "c"), (1, "a"), (3, "b")]


def test_documents_and_lists(spark, tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    for name, text in (("patch_7.30b.html", "<p>x</p>"), ("patch_7.11.html", "x"), ("index.html", "x"), ("about.html", "x"), ("patch_7.31.html", " ")):
        (d / name).write_text(text)
    ok, skipped = files.documents(spark, str(d), ".html", excluded=("7.11",))
    assert [r.patch_id for r in ok.collect()] == ["7.30b"]
    assert sorted(r.reason for r in skipped.collect()) == ["empty", "excluded version", "index page", "no version in name"]
    (tmp_path / "urls.txt").write_text("# list\n\nhttps://a.b/patch-9-2-notes\nhttps://a.b/patch-10-1-notes/?x\nhttps://a.b/patch-10-1-notes\nhttps://a.b/other\n")
    assert [r.version for r in files.url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["10.1", "9.2"]
    assert [r.slug for r in files.version_candidates(spark, 1, 1, 1, ("", "b")).collect()] == ["patch-1-1-notes", "patch-1-1", "patch-1-1b-notes", "patch-1-1b"]
    (d / "m.json").write_text(json.dumps({"metadata": {"title": "T"}, "record": {"title": "R", "published_at": "2020"}, "url": "u"}))
    (d / "bad.json").write_text("{")
    assert [tuple(r) for r in files.page_sidecars(spark, str(d)).collect()] == [("m", "T", "2020", "u")]


def test_configs(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"labels": {"b": {"order": 2}, "a": {"order": 1, "description": "d", "positive_examples": ["1", "2", "3"]}}}))
    book = files.codebook(str(p))
    assert list(book["labels"]) == ["a", "b"] and files.codebook(str(tmp_path / "no.json"))["labels"] == {}
    assert "positive: 1 | 2" in files.system_prompt(book)
    p.write_text(json.dumps({"top_k": 8, "seeds": ["x"], "limit": 3}))
    assert files.batch_config(str(p)) == {"top_k": [8], "seeds": ["x"], "limit": 3}
    p.write_text("[1]")
    with pytest.raises(ValueError):
        files.batch_config(str(p))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], 0.5)], "i int, l array<string>, x double")
    for fmt in sinks.FORMATS:
        sinks.write(df, str(tmp_path / fmt), fmt)
        with pytest.raises(Exception):
            sinks.write(df, str(tmp_path / fmt), fmt)
        sinks.write(df, str(tmp_path / fmt), fmt, overwrite=True)
    sinks.write_all({"a": df, "b": df}, str(tmp_path / "run"))
    with pytest.raises(FileExistsError):
        sinks.write_all({"a": df}, str(tmp_path / "run"))
    sinks.append(df, str(tmp_path / "log"))
    sinks.append(df, str(tmp_path / "log"))
    seqs = [r.append_seq for r in spark.read.parquet(str(tmp_path / "log")).collect()]
    assert len(set(seqs)) == 2
    assert sinks.markdown(df.drop("l"), "T").splitlines() == ["## T", "", "| i | x |", "|---|---|", "| 1 | 0.5000 |"]
    assert sinks.merge_schemas([df.select("i"), df.select("x")]).columns == ["i", "x"]
    assert sinks.run_id("s", 3, 42, "A b/c") == "s_topics3_seed42_a-b-c"
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert sinks.file_hashes(spark, str(tmp_path / "f.bin")).collect()[0].sha256.startswith("ba7816bf")


def test_nested(spark):
    doc = json.dumps({"title": "Root", "items": [{"name": "A", "note": "first <b>x</b>", "n": 3}, {"name": "A", "note": "first <b>x</b>"}, {"note": "7.31 and 7.30b"}], "version": 7.29})
    rows = spark.createDataFrame([(doc,), ("bad",), (None,)], "j string").select(nested.text_leaves_of(F.col("j")).alias("t"), nested.versions_of(F.col("j")).alias("v"), nested.html_strings_of(F.col("j")).alias("h")).collect()
    assert [(x.path, x.key, x.text) for x in rows[0].t] == [("Root > A", "note", "first x"), ("Root", "note", "7.31 and 7.30b")]
    assert rows[0].v == ["7.31", "7.30b", "7.29"] and rows[0].h == ["first <b>x</b>"] and rows[1].t == [] and rows[2].v == []
    env = [('{"output_text":"a"}',), ('{"output":[{"content":[{"text":"b"}]}]}',), ('{"choices":[{"message":{"content":"c"}}]}',), ("x",)]
    assert [r.o for r in spark.createDataFrame(env, "j string").select(nested.response_text(F.col("j")).alias("o")).collect()] == ["a", "b", "c", None]


def test_stream_takes_each_item_once(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    df = spark.createDataFrame([("a", "fixed it"), ("b", "x"), ("a", "fixed it")], "item_id string, target_text string")
    df.write.parquet(src)
    resume.stream(spark, src, df.schema, log, str(tmp_path / "c1")).awaitTermination()
    spark.createDataFrame([("c", "y"), ("b", "x")], df.schema).write.mode("append").parquet(src)
    resume.stream(spark, src, df.schema, log, str(tmp_path / "c1")).awaitTermination()
    resume.stream(spark, src, df.schema, log, str(tmp_path / "c2")).awaitTermination()
    rows = spark.read.parquet(log).collect()
    assert sorted(r.item_id for r in rows) == ["a", "b", "c"]
    assert {r.item_id: r.primary_label for r in annotate.latest_ok(spark.read.parquet(log)).collect()}["a"] == "corrective_maintenance"


def test_sources_are_resolved_and_reused(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for n in ("b/y.zip", "b/x.zip"):
        (tmp_path / n).write_text("")
    assert files.resolve(None, (tmp_path / "no",), str(tmp_path), "*.zip").endswith("x.zip") and files.resolve(str(tmp_path / "b/y.zip"), (), "", "*").endswith("y.zip")
    for args in ((str(tmp_path / "no"), (), "", "*"), (None, (), str(tmp_path / "none"), "*.zip")):
        with pytest.raises(FileNotFoundError):
            files.resolve(*args)
    built = []
    build = lambda: built.append(1) or spark.range(3)
    assert files.reuse(spark, str(tmp_path / "t"), build).count() == files.reuse(spark, str(tmp_path / "t"), build).count() == 3 and len(built) == 1
    files.reuse(spark, str(tmp_path / "t"), build, force=True)
    assert len(built) == 2


def test_bad_bytes_lists_and_fallback(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'{"x": "\xff"}')
    (tmp_path / "b.json").write_bytes(b"no")
    got = sorted(r.content or "" for r in files.json_values(spark, str(tmp_path / "*.json")).collect())
    assert got == ["", '{"x": "\ufffd"}']
    assert spark.range(1).select(files.comma_list(F.lit(" a, ,b,")).alias("x")).collect()[0].x == ["a", "b"]
    for d, n, t in (("h", "one.html", "<p>"), ("t", "one.txt", "x"), ("t", "two.txt", "y")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / n).write_text(t)
    assert sorted((r.stem, r.kind) for r in files.html_or_text(spark, str(tmp_path / "h"), str(tmp_path / "t")).collect()) == [("one", "html"), ("two", "text")]


def test_manifests_metadata_and_paths(spark, tmp_path):
    df = spark.createDataFrame([("a", "ok"), ("b", "ok")], "output_id string, status string")
    path = str(tmp_path / "m")
    assert sinks.checkpointed_manifest(df.limit(1), path).count() == 1 and sinks.checkpointed_manifest(df, path).count() == 2
    (tmp_path / "in.txt").write_text("abc")
    m = sinks.run_metadata(spark, [str(tmp_path / "in.txt")], seed=7).collect()[0]
    assert m.inputs[0].sha256.startswith("ba7816bf") and m.settings == '{"seed": 7}' and m.created_at.endswith("Z")
    assert sinks.run_metadata(spark, []).collect()[0].inputs == []
    p = df.select(sinks.page_paths(F.lit("newsentry"), F.col("output_id")).alias("p")).collect()[0].p
    assert p.text_path == "text/news/a.txt"
    with pytest.raises(Exception, match="unknown source kind"):
        df.select(sinks.page_folder(F.lit("x"))).collect()
    corpus = spark.createDataFrame([("d", "t", 1)], "document_id string, clean_text string, target_word_count int")
    t = sinks.corpus_tables(corpus, corpus.limit(0), corpus)
    assert "clean_text" not in t["corpus_audit"].columns and t["manual_review"].count() == 1
    assert sinks.markdown(spark.range(1500)).count("\n") == 1502


def test_log_numbers_rise_over_partitions(spark, tmp_path):
    src, log = str(tmp_path / "src"), str(tmp_path / "log")
    for k in range(2):
        spark.range(300).selectExpr(f"concat('{k}_', id) AS item_id", "'x' AS target_text").repartition(200).write.mode("append").parquet(src)
        resume.stream(spark, src, "item_id string, target_text string", log, str(tmp_path / "c")).awaitTermination()
    r = spark.read.parquet(log).selectExpr("item_id LIKE '0%' AS first", "append_seq")
    a, b = r.where("first").agg(F.max("append_seq")).collect()[0][0], r.where("NOT first").agg(F.min("append_seq")).collect()[0][0]
    assert a < b and r.count() == 600


def test_page_json(spark):
    page = """<html><script id="__NEXT_DATA__" type="x">{"a": [{"title": "News"}, {"title": "Patch 1.2", "url": "/u", "description": {"body": "<p>One  two</p>"}, "publishedAt": "2024-01-02T00:00:00Z"},
      {"category": {"title": "Game"}, "analytics": {"contentLocale": "en-us"}, "action": {"payload": {"url": "/v"}}, "href": "/u"}]}</script></html>"""
    f = nested.page_fields(page)
    assert f == {"title": "Patch 1.2", "published_at": "2024-01-02T00:00:00Z", "description": "One two", "category": "Game", "locale": "en-us"}
    assert nested.listed_urls(page) == [("/u", "Patch 1.2"), ("/v", "")]
    df = spark.createDataFrame([(page,), ("<p>",), (None,)], "c string")
    got = df.select(nested.page_fields_of(F.col("c")).alias("f"), nested.listed_urls_of(F.col("c")).alias("u")).collect()
    assert got[0].f.title == "Patch 1.2" and got[1].f.title is None and got[2].u == [] and len(got[0].u) == 2
