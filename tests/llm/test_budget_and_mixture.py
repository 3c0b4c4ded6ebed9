import base64

import pytest

from lexigrid.llm import mixture as X, token_budget as B

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def n_tokens():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(enc.encode_ordinary(t)) if t else 0


ITEMS = "item_id string, game string, url string, target_text string, hash string"


def test_budget_against_brute_force(spark, sf, n_tokens):
    items, sites = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("annotation_items", "sites"))
    lang = {r.site_host: r.site_lang for r in sites.collect()}
    want: dict = {}
    for r in {(r.item_id, r.game, r.url, r.target_text) for r in items.collect()}:
        host = r[2].split("/")[2] if r[2] else None
        for level, key in (("cell", (r[1], lang.get(host, "(unknown)"), host if host in lang else "(unknown)")), ("game", (r[1], None, None)), ("all", (None, None, None))):
            c = want.setdefault((level, *key), [0, 0, 0])
            c[0] += 1
            c[1] += not (r[3] or "").strip()
            c[2] += n_tokens(r[3])
    got = {(r.level, r.game, r.site_lang, r.site_host): [r.n_items, r.n_empty, r.n_tokens] for r in B.budget(items, sites).collect()}
    assert {k: v for k, v in got.items() if k[0] in ("cell", "game", "all")} == want


def test_item_counts(spark, sf, n_tokens):
    items, sites = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("annotation_items", "sites"))
    want = sorted({(r.item_id, r.game, n_tokens(r.target_text), not (r.target_text or "").strip()) for r in items.collect()})
    assert sorted((r.item_id, r.game, r.n_tokens, r.empty) for r in B.item_counts(items, sites).collect()) == want


def test_updates_with_removed_and_changed_documents(spark, tmp_path, n_tokens):
    sites = spark.createDataFrame([("a.b", "g", "en")], "site_host string, game string, site_lang string")
    one = [("1", "g", "http://a.b/x", "one two", "h"), ("2", "g", "http://a.b/y", "gone soon", "h"), ("3", "g", None, None, "h"), ("4", None, "http://z.z", "other words here", "h"), ("1", "g", "http://a.b/x", "one two", "h")]
    two = [("1", "g", "http://a.b/x", "one two three", "h"), ("3", "g", None, " ", "h"), ("4", None, "http://z.z", "other words here", "h"), ("5", "g", "http://A.b/x", "one two", "h")]
    ledger = B.Ledger(spark, str(tmp_path))
    for k, rows in enumerate((one, two, two, []), 1):
        ledger.update(B.items(spark.createDataFrame(rows, ITEMS), sites))
        fresh = B.Ledger(spark, str(tmp_path / f"f{k}"))
        fresh.update(B.items(spark.createDataFrame(rows, ITEMS), sites))
        assert sorted(map(tuple, ledger.cube().collect())) == sorted(map(tuple, fresh.cube().collect()))
        assert ledger.version() == k
    counted = [spark.read.parquet(f"{ledger.folder}/counts/v={v}").count() for v in range(1, 5)]
    assert counted == [3, 2, 0, 0]  # "one two" moved to another document without being encoded again
    assert B.totals(ledger.cube()).collect() == []


def test_mixture(spark, n_tokens):
    docs = [(i, "big", "word " * (1 + i % 7)) for i in range(400)] + [(1000 + i, "small", "tiny text " * 3) for i in range(10)] + [(2000, "small", None), (2001, "other", "x"), (2002, None, "x"), (0, "big", "word ")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, report = X.mix(df, targets)
    rows, rep = chosen.collect(), {r.source: r for r in report.collect()}
    assert {r.source for r in rows} == {"big", "small"} and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.copies <= {"big": 1, "small": 3}[r.source] and r.n_tokens == n_tokens(dict((d[0], d[2]) for d in docs)[r.doc_id]) for r in rows)
    assert rep["small"].most_copies == 3 and rep["small"].n_tokens == rep["small"].budget == 3 * rep["small"].available
    assert abs(rep["big"].reached_share - 5 / 9) < 0.01 and rep["none"].n_tokens == 0 and rep["none"].reached_share == 0
    longest = max(r.n_tokens for r in rows)
    assert all(abs(r.n_tokens - r.budget) <= longest / 2 for r in rep.values())
    again = X.mix(df, targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    chosen, report = X.mix(df, targets, total=10**6)
    assert {r.source: r.most_copies for r in report.collect()} == {"big": 1, "small": 3, "none": 0}
    empty, report = X.mix(df.limit(0), targets)
    assert empty.collect() == [] and {r.n_tokens for r in report.collect()} == {0}
