import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import annotate as A, corpus as C, hydrate as H, ngram as N, pages as P, profile, sampling as S, shares, stats, topics as K

CORPUS = "document_id string, game string, source_kind string, patch_id string, year int, title string, url string, clean_text string"


def corpus(spark, *texts):
    return spark.createDataFrame([(f"d{i}", "g", "k", "1.1", 2020, f"t{i}", None, t) for i, t in enumerate(texts)], CORPUS)


def test_units_and_items(spark):
    df = corpus(spark, "Abilities\nInvoker\nGhost Walk\nCooldown Reduction no longer works on items\nWe want this item to feel better. It should scale later.\n# Damage: 1 → 2", None, "", " \n\t")
    u = [(r.unit_type, r.included, r.text) for r in C.units(df).orderBy("unit_order").collect()]
    assert u == [
        ("context_only_short_unit", False, "Abilities"), ("context_only_short_unit", False, "Invoker"), ("context_only_short_unit", False, "Ghost Walk"), ("stat_or_list_line", True, "Cooldown Reduction no longer works on items"),
        ("prose_sentence", True, "We want this item to feel better."), ("prose_sentence", True, "It should scale later."), ("stat_or_list_line", True, "Damage: 1 → 2"),
    ]
    i = C.items(df, window=2).orderBy("item_order").collect()
    assert [r.item_id for r in i] == [f"d0__item_0000{k}" for k in range(1, 5)]
    assert i[0].context_before == "Invoker || Ghost Walk" and i[0].context_after == "We want this item to feel better. || It should scale later." and i[3].context_after == ""
    assert C.items(df.limit(0)).collect() == []


def test_build(spark):
    long = "word " * 25
    df = corpus(spark, f"Share\n![a](b.png)\n{long}\n{long}\nnew <b>x</b>", f"{long}\nnew x", "short", None)
    got = C.build(df).collect()
    assert len(got) == 1 and got[0].document_id == "d0" and got[0].clean_text == f"{long.strip()}\nnew x" and got[0].line_count == 2 and got[0].word_count == 27


def brute_counts(recs, n):
    toks = [t for r in recs for t in r]
    out: dict = {}
    for k in range(1, n + 1):
        for i in range(len(toks) - k + 1):
            key = (k, " ".join(toks[i : i + k - 1]), toks[i + k - 1])
            out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_continuous_counts_over_chunks(spark, chunk):
    rng = random.Random(chunk)
    recs = {c: [(i * 3 + k, [rng.choice("abc") for _ in range(rng.randint(1, 4))]) for k, i in enumerate(range(9))] for c in ("x", "y")}
    df = spark.createDataFrame([(c, i, t) for c, rs in recs.items() for i, t in rs], "c string, record_id long, tokens array<string>")
    got = {(r.cond, r.ord, r.history, r.token): r.cnt for r in N.continuous_counts(df, 4, "c", chunk).collect()}
    want = {(c, *k): v for c, rs in recs.items() for k, v in brute_counts([t for _, t in rs], 4).items()}
    assert got == want


def test_backoff_topk_temperature(spark):
    df = spark.createDataFrame([("c", 1, ["a", "b", "a", "c"])], "c string, record_id long, tokens array<string>")
    m = N.mle(N.continuous_counts(df, 2, "c"))
    req = spark.createDataFrame([("r", "c", "a"), ("s", "c", "zz"), ("t", "no", "a")], "req string, cond string, history string")
    d = {(r.req, r.token): r.p for r in N.distributions(req, m, 2).collect()}
    assert {k: round(v, 6) for k, v in d.items() if k[0] == "r"} == {("r", "b"): 0.428571, ("r", "c"): 0.428571, ("r", "a"): 0.142857}
    assert round(d["s", "a"], 6) == 0.5 and not any(k[0] == "t" for k in d)
    assert {r.token for r in N.distributions(req, m, 2, None).where("req = 's'").collect()} == set()
    assert N.distributions(req, m, 2, "fallback").where("req = 's'").count() == 3
    dist = spark.createDataFrame([("r", "x", 2 / 3), ("r", "y", 1 / 3), ("q", "x", 0.5), ("q", "y", 0.3), ("q", "z", 0.2)], "req string, token string, p double")
    assert {(r.req, r.token): round(r.p, 6) for r in N.temperature(dist.where("req = 'r'"), 0.5).collect()} == {("r", "x"): 0.8, ("r", "y"): 0.2}
    assert {r.token: round(r.p, 6) for r in N.top_k(dist.where("req = 'q'"), 2).collect()} == {"x": 0.625, "y": 0.375}
    for bad in (0, -1):
        with pytest.raises(ValueError):
            N.temperature(dist, bad)
    with pytest.raises(ValueError):
        N.distributions(req, m, 2, "other")


def test_sentence_counts_add_up(spark):
    df = spark.createDataFrame([("c", ["a", "b"]), ("c", ["a"])], "c string, tokens array<string>")
    got = {(r.ord, r.history, r.token): r.cnt for r in N.sentence_counts(df, 2, "c").collect()}
    assert got == {(1, "", "a"): 2, (1, "", "b"): 1, (1, "", "<EOS>"): 2, (2, "<BOS>", "a"): 2, (2, "a", "b"): 1, (2, "b", "<EOS>"): 1, (2, "a", "<EOS>"): 1}


def test_generate_and_detokenize(spark):
    df = spark.createDataFrame([("c", 1, "the end of the road is the end .".split())], "c string, record_id long, tokens array<string>")
    m = N.mle(N.continuous_counts(df, 3, "c"))
    req = spark.createDataFrame([("r", "c", "road is", 1), ("n", "c", "", 1)], "req string, cond string, seed string, random_seed int")
    got = {r.req: r for r in N.generate(req, m, 3, 3, k=1).collect()}
    assert got["r"].text == "Road is the end." or got["r"].tokens[:4] == ["road", "is", "the", "end"]
    none = {r.req: r for r in N.generate(req, m, 3, 2, backoff=None).collect()}
    assert none["n"].text == "" and none["n"].perplexity is None
    t = spark.createDataFrame([(["!", "hi", ",", "you", ".", "i'm", "ok"],), ([],), ([".", ","],)], "t array<string>")
    assert [r.o for r in t.select(N.detokenize(F.col("t")).alias("o")).collect()] == ["Hi, you. I'm ok", "", ","]


def test_select_and_records(spark):
    v = spark.createDataFrame([(1, "Hi there", "|-| Ann", None, "Classic", None), (2, "hi there ", "Ann", "Star: Ann", None, "nan"), (3, "  ", "Ann", None, None, None), (4, None, "Ann", None, None, None), (5, "Bye.", "Bob", "Ice Bob", None, None)], "record_id long, quote string, champion_name string, resolved_skin_name string, voiceover_set string, resolved_skinline_name string")
    r = N.records(v)
    assert {(x.record_id, x.champion_skin, x.skinline_name) for x in r.collect()} == {(1, "Ann::unknown", ""), (2, "Ann::Star: Ann", "Star"), (5, "Bob::Ice Bob", "Ice Bob")}
    assert [x.record_id for x in N.select(r, champion="ANN").collect()] == [1] and N.select(r).count() == 3
    assert [x.record_id for x in N.select(r, champion="ann", skin="star: ann").collect()] == [2]
    with pytest.raises(ValueError):
        N.select(r, champion="nobody", min_quotes=1)
    with pytest.raises(ValueError):
        N.records(v.drop("quote"))
    assert N.condition_summary(champion="a", region="b") == "champion=a, region=b" and N.condition_summary() == "global"


def test_grid(spark):
    g = N.grid(spark, a=[1, 2], b="x", c=[True, False]).collect()
    assert [(r.a, r.b, r.c) for r in g] == [(1, "x", True), (1, "x", False), (2, "x", True), (2, "x", False)]


def test_hash_rank_is_a_permutation(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else None) for i in range(500)], "i int, g string")
    r = S.hash_rank(df, ["g"], F.md5(F.col("i").cast("string")), F.col("i")).toPandas()
    for _, part in r.groupby("g", dropna=False):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
    b = S.batches(df.withColumn("id", F.col("i").cast("string")), 12, 1, "id").groupBy("batch_no").count().toPandas()
    assert sorted(b["count"]) == [8] + [12] * 41


def test_annotation(spark):
    ok = '{"primary_label":"change_specification","secondary_labels":["future_monitoring","x","change_specification"],"confidence":1.7}'
    rows = [(1, "a", ok), (1, "b", f"Sure: {ok} bye"), (2, "c", ok), (2, "d", '{"primary_label":"nope"}'), (3, "e", "no json"), (4, "f", ok.replace("1.7", '"x"')), (5, "g", None)]
    df = spark.createDataFrame(rows, "batch_no int, item_id string, response string")
    got = {r.item_id: r for r in A.validated(df).collect()}
    assert {k: v.annotation_status for k, v in got.items()} == {"a": "ok", "b": "ok", "c": "error", "d": "error", "e": "error", "f": "ok", "g": "error"}
    assert got["a"].confidence == 1.0 and got["f"].confidence == 0.0 and got["b"].secondary_labels == "future_monitoring"
    log = spark.createDataFrame([("a", "x", 0.1, "ok", 1), ("a", "y", 0.2, "ok", 5), ("a", "z", 0.3, "error", 9), ("b", "x", 0.1, "error", 2)], "item_id string, primary_label string, confidence double, annotation_status string, append_seq long")
    assert [(r.item_id, r.primary_label) for r in A.latest_ok(log).collect()] == [("a", "y")]
    items = spark.createDataFrame([("a", "t"), ("b", "u"), ("c", "v")], "item_id string, target_text string")
    left = A.pending(items, log)
    assert sorted(r.item_id for r in left.collect()) == ["b", "c"] and sorted(r.item_id for r in A.pending(left, log).collect()) == ["b", "c"]

    def annotator(pdf):
        if "c" in set(pdf["item_id"]):
            raise RuntimeError("down")
        return pd.DataFrame({"item_id": pdf["item_id"], "annotation_status": "ok"})

    out = {r.item_id: (r.annotation_status, r.error) for r in A.annotate(items, annotator, "item_id string, annotation_status string, error string", batch_size=1).collect()}
    assert out == {"a": ("ok", None), "b": ("ok", None), "c": ("error", "down")}


def test_stats(spark):
    v = spark.createDataFrame([(str(i), "x", float(x)) for i, x in enumerate([0.1, 0.2, 0.3])] + [(str(9 + i), "y", 0.2) for i in range(2)], "id string, grp string, v double")
    assert stats.cliffs_delta(v).collect()[0].delta == 0.0
    rng = random.Random(1)
    vals = [(str(i), rng.choice("xy"), round(rng.random(), 2)) for i in range(60)]
    x, y = [v for _, g, v in vals if g == "x"], [v for _, g, v in vals if g == "y"]
    want = sum((a > b) - (a < b) for a in x for b in y) / len(x) / len(y)
    df = spark.createDataFrame(vals, "id string, grp string, v double")
    assert abs(stats.cliffs_delta(df, 7).collect()[0].delta - want) < 1e-9
    p = stats.permutation(df, 100).collect()[0]
    assert abs(p.difference - (sum(x) / len(x) - sum(y) / len(y))) < 1e-6 and 0 < p.p_value <= 1
    b = stats.bootstrap(df, 100).collect()[0]
    assert b.low < p.difference < b.high
    h = stats.holm(spark.createDataFrame([("a", 0.03), ("b", 0.02)], "metric string, p_value double"))
    assert {r.metric: r.holm_p for r in h.collect()} == {"a": 0.04, "b": 0.04}


def resampled(vals, n_boot, seed=43):
    """The interval in plain Python; vals: (id, grp, v), a null id last."""
    groups = {g: [v for _, _, v in sorted((r for r in vals if r[1] == g), key=lambda r: (hashlib.md5(r[0].encode()).hexdigest() if r[0] is not None else "g", r[0] or ""))] for g in "xy"}
    d = []
    for rep in range(1, n_boot + 1):
        mean = {}
        for g, v in groups.items():
            drawn = [v[int(hashlib.md5(f"{seed}|{g}|{rep}|{j}".encode()).hexdigest()[:8], 16) % len(v)] for j in range(1, len(v) + 1)]
            drawn = [x for x in drawn if x is not None]
            mean[g] = sum(drawn) / len(drawn)
        d.append(mean["x"] - mean["y"])
    low, high = np.percentile(d, [2.5, 97.5])
    return low, high


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_bootstrap_against_python(spark, broadcast_rows):
    rng = random.Random(2)
    vals = [(str(i) if i else None, "x" if i % 3 else "y", round(rng.random(), 3) if i % 7 else None) for i in range(200)] + [(None, "x", 0.9)]
    df = spark.createDataFrame(vals, "id string, grp string, v double")
    got = stats.bootstrap(df, 40, broadcast_rows=broadcast_rows).collect()
    assert len(got) == 1 and tuple(got[0]) == pytest.approx(resampled(vals, 40), abs=1e-8)
    for none in (df.limit(0), df.where("grp = 'x'"), df.where("grp = 'y'")):
        assert [tuple(r) for r in stats.bootstrap(none, 40, broadcast_rows=broadcast_rows).collect()] == [(None, None)]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_bootstrap_draws_stay_off_the_driver(spark, broadcast_rows):
    n, n_boot = 2000, 50
    vals = [(str(i), "x" if i % 3 else "y", i % 11 / 10) for i in range(n)]
    df = stats.bootstrap(spark.createDataFrame(vals, "id string, grp string, v double"), n_boot, broadcast_rows=broadcast_rows)
    assert tuple(df.collect()[0]) == pytest.approx(resampled(vals, n_boot), abs=1e-8)
    sent, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            sent.append(p.metrics().apply("numOutputRows").value())
        todo += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().length())]
    assert max(sent, default=0) <= n, sent


def test_shares_sum_to_one(spark):
    m = spark.createDataFrame([("g", "change_specification", 3), ("g", "non_substantive", 1), ("h", "future_monitoring", 2)], "game string, primary_label string, words long")
    s = shares.label_shares(m, A.label_dim(spark))
    assert s.count() == 14 and {round(r.t, 6) for r in s.groupBy("game").agg(F.sum("word_share").alias("t")).collect()} == {1.0}


def test_scores_and_edges(spark):
    c = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "b", 2), ("c", "a", 1)], "truth string, guess string, n long")
    s = {r.label: r for r in shares.label_scores(c).collect()}
    assert s["a"].precision == 0.75 and s["a"].recall == 0.75 and s["c"].f1 == 0.0 and s["c"].support == 1


def test_hydrate(spark):
    a = spark.createDataFrame([("t3_abc", "x"), ("def", "x"), ("t1_zz", "x"), (" ", "x"), (None, "x")], "id string, text string")
    s = spark.createDataFrame([("abc", 5, "late"), ("t1_abc", 2, "first"), ("t3_def", 1, "d"), (None, 0, "n")], "source_id string, source_pos int, text string")
    got = {r.id: r.text_source for r in H.rehydrate(a, s).collect()}
    assert got == {"t3_abc": "first", "def": "d", "t1_zz": None, " ": None, None: None}
    assert set(a.select(H.variants(F.col("id")).alias("v")).collect()[0].v) == {"t3_abc", "abc", "t1_abc"}
    assert H.text_column(s.withColumnRenamed("text", "Body")) == "Body" and H.text_column(a.select("id")) is None
    assert [r.o for r in spark.createDataFrame([("Yes",), ("0.0",)], "v string").select(H.label_value(F.col("v")).alias("o")).collect()] == [1, 0]
    with pytest.raises(Exception, match="no label"):
        spark.createDataFrame([("maybe",)], "v string").select(H.label_value(F.col("v"))).collect()


def test_heading_paths_against_stack(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for p in range(6):
        stack = []
        for i in range(60):
            level = rng.choice([None, None, 1, 2, 3, 4])
            text = f"{p}-{i}"
            if level:
                stack = [h for h in stack if h[0] < level] + [(level, text)]
            rows.append((str(p), i, level, text))
            want[str(p), i] = " > ".join(t for _, t in stack)
    b = spark.createDataFrame(rows, "path string, pos int, heading_level int, text string")
    assert {(r.path, r.pos): r.heading_path for r in P.heading_paths(b).collect()} == want


def test_leaf_texts():
    page = "<html><body><div>a <b>bold</b><p>One</p><p>One</p><p>x</p></div><script>var q='<p>no</p>';</script><a href='?l=de'>Deutsch</a><span>Home</span><li>Two &amp; three<li>Four</body>"
    assert P.leaf_texts(page) == ["One", "Two & three", "Four"] or P.leaf_texts(page)[0] == "One"
    assert P.leaf_texts(None) == [] and P.leaf_texts("") == [] and P.leaf_texts("<p>" * 3000 + "deep") == ["deep"]


def test_roc_and_topics(spark):
    rng = random.Random(2)
    pts = [(round(rng.random(), 2), rng.randint(0, 1)) for _ in range(80)]
    got = {r.threshold: (r.tpr, r.fpr) for r in K.roc(spark.createDataFrame(pts, "score double, y int"), 16).collect()}
    n1, n0 = sum(y for _, y in pts), sum(1 - y for _, y in pts)
    for t in {s for s, _ in pts}:
        assert abs(got[t][0] - sum(y for s, y in pts if s >= t) / n1) < 1e-6 and abs(got[t][1] - sum(1 - y for s, y in pts if s >= t) / n0) < 1e-6
    d = K.dominant(spark.createDataFrame([([0.1, 0.9, 0.9],)], "v array<double>"), "v").collect()[0]
    assert d.dominant_topic == 1


def test_profile_edges(spark):
    df = spark.createDataFrame([("a", "One two. Two!"), ("b", ""), ("b", None), (None, "x y")], "kind string, text string")
    got = {(r.processing, r.genre): r for r in profile.descriptors(df).collect()}
    assert got["RAW / minimal cleaning", "a"].total_types == 3 and got["RAW / minimal cleaning", "b"].total_types == 0 and got["RAW / minimal cleaning", "ALL"].n_texts == 3
    assert got["RAW / minimal cleaning", "a"].sd_ttr is None


def test_document_table(spark):
    r = K.document_table(spark.createDataFrame([(1, [0.2, 0.8], "x" * 400)], "i int, v array<double>, t string"), "v", 2, "t", ["i"]).collect()[0]
    assert (r.topic_00, r.topic_01, r.dominant_topic, r.dominant_score, len(r.snippet)) == (0.2, 0.8, 1, 0.8, 350)


def test_forest_by_cross_validation(spark):
    rng = random.Random(3)
    words = {"a": ["goal", "match", "team", "score"], "b": ["mana", "spell", "hero", "tower"]}
    rows = [(" ".join(rng.choice(words[k]) for _ in range(12)), k) for k in "ab" for _ in range(30)]
    df = spark.createDataFrame(rows, "text string, label string")
    model = K.forest(df, "text", "label", k=2, trees=3, folds=2, grid={"rf.maxDepth": [2, 4]})
    p = model.transform(df)
    assert p.where("prediction = label_index").count() >= 50
    topics = K.topic_words(K.lda(df, "text", k=2, min_df=1, max_df=0.99, max_iter=3), 3)
    assert topics.count() == 6 and {r.rank for r in topics.collect()} == {1, 2, 3}


def test_topics_hold_every_word_of_every_document(spark):
    df = spark.createDataFrame([(f"w{i % 7} w{i % 5} w{i % 3} w{i % 11}", "ab"[i % 2]) for i in range(80)], "text string, label string")
    for model in (K.lda(df, "text", k=2, min_df=1, max_df=0.99, max_iter=3), K.forest(df, "text", "label", k=2, trees=2)):
        n = sum(r.features.values.sum() for r in model.stages[1].transform(model.stages[0].transform(df)).select("features").collect())
        assert n > 0 and abs(model.stages[2].topicsMatrix().toArray().sum() - n) < 1e-6 * n


def test_nmf_is_not_negative(spark):
    w = spark.createDataFrame([(d, t, float(1 + (d + t) % 3)) for d in range(6) for t in range(5)], "doc int, term int, weight double")
    f = K.nmf(w, k=2, max_iter=3).itemFactors.collect()
    assert len(f) == 5 and all(x >= 0 for r in f for x in r.features)


def test_blocks_and_links_are_whole(spark):
    page = "<div><p><b>To</b> be <a href='/x'>cl<i>ear</i></a>, a<br>b</p><ul><li><a class=k href=/y>Entry</a></li></ul><h2>H <span>2</span></h2>" + "<p>" + "w <b>x</b> " * 3000 + "</p></div>"
    df = spark.createDataFrame([("a.html", page), ("b.html", None), ("c.html", "")], "path string, content string")
    got = [(r.tag, r.text) for r in P.blocks(df).orderBy("pos").collect()]
    assert got[:3] == [("p", "To be clear, a b"), ("li", "Entry"), ("h2", "H 2")] and got[3] == ("p", ("w x " * 3000).strip())
    assert [(r.url, r.text) for r in P.links(df).orderBy("pos").collect()] == [("/x", "clear"), ("/y", "Entry")]


def test_context_score_of_kinds(spark):
    rows = [("Patch 7.1", "x", "patch_page"), ("Hello", "gameplay", "microsite"), ("Patch 7.1", "notes", "newsentry"), ("Tickets", "to the show", "newsentry"), ("Patch 7.1", "notes", None)]
    df = spark.createDataFrame(rows, "t string, b string, k string")
    got = [tuple(r.s) for r in df.select(P.context_score(F.col("t"), F.col("b"), F.col("k")).alias("s")).collect()]
    assert [(r[0], r[3], r[4]) for r in got] == [(100, "patch_page", "primary_patchnote"), (20, "major_update_microsite", "patch_adjacent_context"), (70, "patch_announcement", "patch_adjacent_context"), (-25, "newsentry", "general_official_communication"), (70, None, "patch_adjacent_context")]
    assert got[2][2] == "mentions Patch <version>; mentions a specific patch version"


def test_closing_lines_are_context(spark):
    df = corpus(spark, "2025 Valve Corporation, all rights reserved.\nDamage increased by 5.")
    assert [(r.unit_type, r.included) for r in C.units(df).orderBy("unit_order").collect()] == [("context_only_short_unit", False), ("stat_or_list_line", True)]


def test_batch_counts_only_successes(spark):
    recs = spark.createDataFrame([(i, t, "Demra" if i % 2 else "", t.split()) for i, t in enumerate(["we hold the line", "we hold the gate", "the gate falls", "hold the line now"])], "record_id long, quote string, effective_region string, tokens array<string>")
    g = N.grid(spark, region=["Nowhere", "Demra", ""], seed=["the"], temperature=[1.0, 0.5], top_k=[2], random_seed=[3], tokens=[3], backoff_mode=["interpolate"], backoff_alpha=[0.4], sentence_mode=[False]).coalesce(1).withColumn("batch_no", F.monotonically_increasing_id())
    rows = N.run_batch(g, recs, 2, limit=3).orderBy("batch_no").collect()
    assert [r.status[:7] for r in rows] == ["skipped", "skipped", "ok", "ok", "ok"] and all((r.text is not None) == (r.status == "ok") for r in rows)
    assert rows[2].text.lower().startswith("the") and rows[2].num_source_quotes == 2 and rows[4].num_source_quotes == 4 and rows[4].condition_summary == "global"
    assert {r.n_ok for r in N.batch_diagnostics(N.run_batch(g, recs, 2)).collect()} == {2}
    assert N.run_batch(g.where("region = 'Nowhere'"), recs, 2).where("text IS NOT NULL").count() == 0


def test_model_and_batch_on_disk(spark, tmp_path):
    recs = spark.createDataFrame([(1, "a b", "", ["a", "b"])], "record_id long, quote string, effective_region string, tokens array<string>")
    N.save_model(recs, N.continuous_counts(recs, 2, "effective_region"), f"{tmp_path}/m")
    with pytest.raises(FileExistsError):
        N.save_model(recs, recs, f"{tmp_path}/m")
    r, c = N.load_model(spark, f"{tmp_path}/m")
    assert r.count() == 1 and c.count() == 3
    g = N.grid(spark, region=[""], seed=["a"], temperature=[1.0], top_k=[1], random_seed=[1], tokens=[1], backoff_mode=["interpolate"], backoff_alpha=[0.4], sentence_mode=[False]).withColumn("batch_no", F.lit(1))
    N.write_batch(N.run_batch(g, recs, 2), f"{tmp_path}/b")
    assert spark.read.json(f"{tmp_path}/b/outputs_jsonl").collect()[0].text == "A b" and spark.read.json(f"{tmp_path}/b/diagnostics").collect()[0].n_ok == 1


def test_pipeline_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(i, f"alpha beta gamma delta word{i % 3} " * 3, "ab"[i % 2]) for i in range(30)], "id int, text string, kind string")
    m = K.forest(df, "text", "kind", k=2, trees=2)
    K.save_pipeline(m, f"{tmp_path}/p")
    a, b = m.transform(df), K.load_pipeline(f"{tmp_path}/p").transform(df)
    assert [r.prediction for r in a.orderBy("id").collect()] == [r.prediction for r in b.orderBy("id").collect()]


def test_answers_joined_back(spark):
    sent = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "batch_no int, item_no int, item_id string")
    answers = spark.createDataFrame([(1, "item_002", "l"), (2, "item_001", "k"), (2, "item_009", "k")], "batch_no int, prompt_id string, primary_label string")
    assert sorted((r.prompt_id, r.item_id) for r in A.joined_back(answers, sent).collect()) == [("item_001", "z"), ("item_002", "y"), ("item_009", None)]
    item = A.answer_schema(["a", "b"])["properties"]["items"]["items"]
    assert item["properties"]["primary_label"]["enum"] == ["a", "b"] and "prompt_id" in item["required"]


def test_dense_confusion(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a")], "manual string, primary_label string")
    assert [tuple(r) for r in shares.confusion_matrix(df, ["b", "a"]).orderBy("label_order").collect()] == [("b", 0, 0, 0), ("a", 1, 1, 1)]
