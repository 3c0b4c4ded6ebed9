import numpy as np

from lexigrid.llm import repetition as R


def brute(text):
    ws = [w for w, _ in R.words(text or "")]
    rep = set()
    for i in range(len(ws) - 4):
        if any(ws[j : j + 5] == ws[i : i + 5] for j in range(i)):
            rep |= set(range(i, i + 5))
    return len(ws), len(rep)


def test_words():
    assert [w for w, _ in R.words("Don't stop_now, 3x’s ÄÖ!")] == ["don't", "stop", "now", "3x’s", "äö"]


def test_repeated_against_brute(spark, sf):
    for r in spark.read.parquet(f"{sf}/generated_texts.parquet").select("text").collect():
        assert R.count(r.text) == brute(r.text)


def test_content_share_against_exact_share(spark, sf):
    """The decoded labels alone estimate the share; with the margin they lose no case."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/generated_texts.parquet").select("text").distinct().collect() if r.text]
    w = R.train(texts)
    assert w["three"] > 0 and w["stay"] > 0
    err, lost, cases = [], 0, 0
    for t in texts:
        n, pieces, marked, content = R.label(t, weights=w)
        _, k = brute(t)
        if n:
            err.append(abs(1 - content - k / n))
            if k * 10 >= 3 * n:
                cases += 1
                lost += content > 0.7 + R.MARGIN
    assert cases > 5 and lost == 0 and np.mean(err) < 0.03


def test_labels_decide(spark):
    """A field that calls everything content keeps every text: the rows come through the labels."""
    df = spark.createDataFrame([(1, "a b c d e. a b c d e.")], "gen_id long, text string")
    assert R.found(df).count() == 1
    assert R.found(df, weights=R.WEIGHTS | {"bias": -99.0}).count() == 0


def test_pieces():
    text = "one two three. four five\nsix " + "w " * 25
    ws = R.words(text)
    inner = R.repeated([w for w, _ in ws], 3)
    assert R.pieces(text, ws, inner * False).tolist() == [0, 3, 5, 15, 25] and R.pieces(text, ws, inner).tolist() == [0, 3, 5, 7, 17, 27]
    assert R.train([]) == R.WEIGHTS and R.train(["a b c"]) == R.WEIGHTS


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(5)
    for _ in range(30):
        e, stay = rng.normal(size=rng.integers(1, 7)), rng.normal()
        n = len(e)
        ys = np.array([[b >> i & 1 for i in range(n)] for b in range(2**n)])
        p = np.exp(ys @ e + stay * (ys[:, 1:] == ys[:, :-1]).sum(axis=1))
        p /= p.sum()
        one, equal = R.marginals(e, stay)
        assert np.allclose(one, p @ ys) and np.allclose(equal, p @ (ys[:, 1:] == ys[:, :-1]))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(100):
        e = rng.normal(size=rng.integers(1, 8))
        best = max(range(2 ** len(e)), key=lambda b: sum(e[i] * (b >> i & 1) for i in range(len(e))) + 0.7 * sum((b >> i & 1) == (b >> i + 1 & 1) for i in range(len(e) - 1)))
        assert [best >> i & 1 for i in range(len(e))] == R.viterbi(e, 0.7).tolist()


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "a b c d e a b c d e"), (4, "a b c d e a b c d e"), (5, "w " * 20000), (6, "a b c d")]
    df = spark.createDataFrame(rows, "gen_id long, text string")
    assert sorted(r.gen_id for r in R.found(df).collect()) == [4, 5]
    got = {r.gen_id: r for r in R.measure(df).collect()}
    assert got[1].repeated_share == 0 and got[2].n_pieces == 0 and got[3].retained and got[4].repeated_share == 0.5
    assert R.found(df.limit(0)).collect() == []
