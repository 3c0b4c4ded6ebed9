import random

import pytest

from lexigrid.llm import language as L

EN = "We want the hero to win fewer lanes in the evening. The shop of the town stays closed for ten minutes during the update. Players told us that this felt unfair to them."
DE = "Wir möchten, dass der Held am Abend seltener gewinnt. Der Laden der Stadt bleibt für zehn Minuten während der Wartung geschlossen. Viele Spieler fanden, dass es nicht fair war."
FR = "Nous voulons que le héros gagne moins souvent le soir. La boutique de la ville restera fermée pendant dix minutes lors de la maintenance. Beaucoup de joueurs trouvaient que ce n'était pas juste."


@pytest.mark.parametrize("label,want", [("EN", "en"), ("en-US", "en"), ("pt_BR", "pt"), ("deu", "de"), ("German", "de"), ("English", "en"), (" ", None), (None, None), ("unknown", None), ("xx", None), ("?", None), ("und", None), ("日本語", "ja"), ("sv", "sv"), ("klingon", None)])
def test_labels(label, want):
    assert L.normal_label(label) == want


def test_segments():
    assert len(L.segments(EN)) == 3
    assert L.segments("Changes to Mekon / Iron Maul\nMekon Iron Coil Armor: 1 → 2\nGood job!\n(Cuore di Vetro)\n???\n🔥🔥🔥") == []
    assert L.segments("今後のアップデートでもDanimisの様子を見ていきます。二つの小さな素材から作れます。")[1].startswith("二つ")
    assert L.segments("He came to the town. =🔥-!!_!!!x=!=🔥xx-🔥x!__🔥x-=🔥x_🔥🔥=--x!_🔥_x==x!") == ["He came to the town."]
    assert L.segments(None) == [] and L.segments("") == [] and L.segments("  \n ") == []


def rows():
    out = []
    i = 0
    for _ in range(12):
        for k, t in (("en", EN), ("de", DE), ("fr", FR)):
            out.append((i, t, k, "s"))
            i += 1
    return out


def test_found(spark):
    extra = [(100, EN, None, "s"), (101, DE, "en", "s"), (102, EN + "\n" + DE, "en", "s"), (103, EN + " Bonjour!", "eng", "s"), (104, None, "en", "s"), (105, "", None, "s"), (106, "???", "unknown", "s"), (107, EN * 300, "English", "s"), (108, EN + " / " + FR + "\n" + DE, "fr", "s"), (101, DE, "en", "s"), (109, EN.upper(), "DE", "s"), (110, EN + " La boutique de la ville restera fermée.", "en", "s")]
    df = spark.createDataFrame(rows() + extra, "doc_id long, text string, lang string, label string")
    got = sorted(map(tuple, L.found(df).collect()))
    assert got == [(100, "en"), (101, "de"), (102, "de"), (102, "en"), (108, "de"), (108, "en"), (108, "fr"), (109, "en")]
    lang = {(r.doc_id, r.lang): r for r in L.languages(df).collect()}
    assert lang[102, "de"].n_sentences == 3 and 0.4 < lang[102, "de"].share < 0.6 and lang[102, "de"].confidence > 0.9
    p = [(r.passage_no, r.lang) for r in L.passages(df).where("doc_id = 108").orderBy("passage_no").collect()]
    assert p == [(0, "en"), (1, "fr"), (2, "de")]
    assert L.found(df.limit(0)).collect() == []


def test_refit_takes_wrong_labels_out():
    texts, labels = [r[1] for r in rows()], [r[2] for r in rows()]
    labels[1], labels[5] = "en", "fr"
    m = L.Model.fit(texts, labels)
    assert {x[1] for x in L.infer(m, DE)} == {"de"}


def test_held_out_accuracy(spark):
    """Labels of held-out documents of one language: wrong ones are a few percent by construction."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL").collect()
    rng = random.Random(7)
    rng.shuffle(docs)
    train, test = docs[:500], docs[500:]
    pairs = [(r.text, L.normal_label(r.lang)) for r in train]
    m = L.Model.fit([t for t, k in pairs if k and t.strip()], [k for t, k in pairs if k and t.strip()])
    hit = n = 0
    for r in test:
        s = L.infer(m, r.text)
        if s and L.normal_label(r.lang):
            n += 1
            hit += L.normal_label(r.lang) in L.text_languages(s)
    assert hit / n > 0.88


def test_best_share_against_grid():
    import numpy as np

    rng = np.random.default_rng(4)
    grid = np.linspace(0, 0.999, 2000)
    for _ in range(50):
        ratio = np.exp(rng.normal(0, 2, size=rng.integers(1, 60)))
        best = max(float(np.log1p(x * (ratio - 1)).sum()) for x in grid)
        _, gain = L.best_share(ratio)
        assert abs(gain - max(best, 0)) < 1e-2 * max(1, best)


def test_fit_reads_whole_texts():
    """A word after thousands of others is known to the model; n-grams are not capped."""
    m = L.Model.fit([EN * 60 + " zyxwv", DE], ["en", "de"])
    assert "zyxw" in m.grams and m.word("zyxwv")[m.langs.index("en")] > m.word("qqqqq")[m.langs.index("en")]
