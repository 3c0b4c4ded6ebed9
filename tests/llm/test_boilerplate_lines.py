from lexigrid.llm import boilerplate_lines as B


def test_found_and_clean(spark):
    rows = [(f"d{i}", "g", f"own {chr(97 + i)}\nShare this! {i}\nA*B*C\n\n12", 1) for i in range(5)]
    rows += [("d5", "g", None, 1), ("d6", "g", "", 1), ("d0", "g", rows[0][2], 1), ("e0", None, "alone", 1), ("d7", "g", "share\tTHIS\nother", 1)]
    df = spark.createDataFrame(rows, "document_id string, game string, clean_text string, line_no int")
    got = {(r.document_id, r.line_no) for r in B.found(df).collect()}
    assert got == {(f"d{i}", k) for i in range(5) for k in (1, 2)} | {("d7", 0)}
    clean = {r.document_id: r for r in B.cleaned(df).collect()}
    assert clean["d0"].clean_text == "own a\n\n12" and clean["d0"].n_removed == 2
    assert clean["d5"].clean_text is None and clean["d6"].clean_text == "" and clean["e0"].n_removed == 0
    assert len(clean) == 9
    assert B.found(df.limit(0)).collect() == []


def test_sequences(spark):
    df = spark.createDataFrame([(f"d{i}", "g", "x\na\nb\nc" if i < 4 else "a\nz\nb") for i in range(6)], "document_id string, game string, clean_text string")
    pats, occ = B.mine(df)
    by = {(r.length, r.n_docs) for r in pats.collect()}
    assert by == {(1, 4), (1, 6), (2, 4), (3, 4), (4, 4)}
    assert occ.where("length = 4").count() == 4


def test_share_is_exact(spark):
    # 8 % of 75 documents are 6
    df = spark.createDataFrame([(f"d{i}", "g", "same" if i < 6 else f"w{'a' * i}") for i in range(75)] + [(f"h{i}", "h", "same" if i < 5 else f"w{'a' * i}") for i in range(75)], "document_id string, game string, clean_text string")
    assert {r.document_id for r in B.found(df).collect()} == {f"d{i}" for i in range(6)}


def test_sequences_of_any_length(spark):
    df = spark.createDataFrame([(f"d{i}", "g", "a\nb\nc\nd\ne\nf\ng\nh") for i in range(4)], "document_id string, game string, clean_text string")
    pats, occ = B.mine(df)
    assert sorted(r.length for r in pats.collect()) == sorted(k for k in range(1, 9) for _ in range(9 - k))
    assert [r.line_nos for r in occ.where("length = 8").collect()] == [list(range(8))] * 4


def test_found_and_clean_grow_every_level(spark, monkeypatch):
    df = spark.createDataFrame([(f"d{i}", "g", f"own {chr(97 + i)}\na\nb\n\nc\nd\ne\nf\ng") for i in range(4)], "document_id string, game string, clean_text string")
    mined, span = [], B.prefix_span
    monkeypatch.setattr(B, "prefix_span", lambda *a: mined.append(span(*a)) or mined[-1])
    assert {(r.document_id, r.line_no) for r in B.found(df).collect()} == {(f"d{i}", k) for i in range(4) for k in (1, 2, 4, 5, 6, 7, 8)}
    assert {r.clean_text for r in B.cleaned(df).collect()} == {f"own {chr(97 + i)}\n" for i in range(4)}
    for patterns, _ in mined:
        assert sorted(r.length for r in patterns.collect()) == sorted(k for k in range(1, 8) for _ in range(8 - k))
    assert len(mined) == 2
