"""Problem 10: missing or wrong language labels.

Method: multilingual mixture inference. Each language has character n-gram probabilities, fitted on a bounded,
hash-ordered sample of labelled documents (`sample_per_label`) whose wrong labels are taken out by refitting.
For each document, expectation-maximisation estimates the proportions of the languages from the n-gram
likelihoods of its words; the set of languages is grown while the penalised likelihood rises. Each sentence is
then given the language of the set under which it is likeliest, with its posterior as confidence, and
neighbouring sentences of one language form a passage.

A sentence ends in a sentence mark and has at least four words (Japanese: eight letters); headings, change
rows, names, loose labels and phrases of up to three words are none. The languages of a text are those with at
least two sentences, or, where no language has two, the language of the longest sentence.

All documents are read, each whole and in one row of a Python stage; no shuffle is needed. The broadcast model
has the n-grams of the sample, whole texts of it, and does not grow with the number of documents.

Defined results: null, empty and blank texts and texts without a sentence have no language and are no cases; a
label that is null, blank or names no language is missing; a label that can't be read as a language is missing
too; with no usable labelled row at all there is no model and no document has a language.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from lexigrid.session import spread

#: Two-letter codes with their other codes and names.
LANGUAGES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano castilian", "pt": "por portuguese português portugues",
    "it": "ita italian italiano", "pl": "pol polish polski", "nl": "nld dut dutch nederlands flemish", "ru": "rus russian русский", "ja": "jpn japanese 日本語",
    "sv": "swe swedish svenska", "da": "dan danish dansk", "no": "nor norwegian norsk nb nob nn nno", "fi": "fin finnish suomi", "cs": "ces cze czech čeština", "sk": "slk slo slovak",
    "hu": "hun hungarian magyar", "ro": "ron rum romanian română", "bg": "bul bulgarian български", "el": "ell gre greek ελληνικά", "tr": "tur turkish türkçe", "uk": "ukr ukrainian українська",
    "zh": "zho chi chinese 中文", "ko": "kor korean 한국어", "ar": "ara arabic العربية", "he": "heb hebrew", "hi": "hin hindi", "th": "tha thai", "vi": "vie vietnamese", "id": "ind indonesian", "ca": "cat catalan", "la": "lat latin",
}
_CODES = {x: k for k, v in LANGUAGES.items() for x in (k, *v.split())}
NO_LANGUAGE = frozenset("xx und unknown zxx mul mis n/a na none null ? - qaa xxx other".split())

ORDERS = (2, 3, 4)
#: Overlapping n-grams count a letter several times; each counts this much.
WEIGHT = 0.35
#: The rise of the log-likelihood that a further language must bring.
PENALTY = 6.0

WORDS = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟー々]|[^\W\d_぀-ヿ㐀-鿿ｦ-ﾟ]+(?:['’][^\W\d_]+)*")
CJK = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]")
#: Words of two letters and more.
PROPER = re.compile(r"[^\W\d_]{2,}")
#: A sentence mark with closing quotes, before a space, a line's end or (full-width marks) anything.
SPLIT = re.compile(r"(?<=[。！？])[」』”’）)]*|(?<=[.!?…])[\"'”’»)\]]*(?=\s|$)|\n|\s/\s|\s\|\s|\t+")
ENDED = re.compile(r"[.!?…。！？][\"'”’»」』)\]）*\W]*$")


def normal_label(label: str | None) -> str | None:
    """The two-letter code a label names, or None."""
    if not isinstance(label, str):
        return None
    x = label.strip().lower()
    if not x or x in NO_LANGUAGE:
        return None
    if x in _CODES:
        return _CODES[x]
    head = re.split(r"[-_ ,;/(]", x)[0]
    if head in NO_LANGUAGE:
        return None
    return _CODES.get(head)


def _drawn(t: str) -> bool:
    """Drawings of signs and emoji are no words and end no sentence."""
    return sum(c.isalnum() for c in t) < 0.6 * len(t)


def sentences(text: str | None) -> list[tuple[str, list[str]]]:
    """(sentence, its words in lower case) of a text, in order."""
    out = []
    if not text:
        return out
    # most words hold only letters, perhaps with a sign at the end
    if any([_drawn(w) for w in text.split() if len(w) >= 8 and not w[:-1].isalnum()]):
        text = re.sub(r"\S{8,}", lambda m: " " if _drawn(m.group()) else m.group(), text)
    at = 0
    cuts = [m.span() for m in SPLIT.finditer(text)]
    for a, b in [*cuts, (len(text), len(text))]:
        piece = text[at:b].strip()
        at = b
        if not piece or not ENDED.search(piece):
            continue
        n_cjk = 0 if piece.isascii() else len(CJK.findall(piece))
        words = WORDS.findall(piece.lower())
        if n_cjk < 8:
            need, names = 4 + n_cjk, 2
            for w in words:
                n = len(w)
                need -= n == 1 or w.count(w[0]) < n
                names -= n > 1 and w.isalpha()
                if need <= 0 and names <= 0:
                    break
            else:
                if need > 0 or len(PROPER.findall(piece)) < 2:
                    continue
        if words:
            out.append((piece, words))
    return out


def segments(text: str | None) -> list[str]:
    """The sentences of a text, in order."""
    return [s for s, _ in sentences(text)]


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1)] if len(word) > 1 or not CJK.match(word) else [word]


class Model:
    """Log-probabilities of n-grams by language: a matrix with a row for each n-gram, and a last one for unseen n-grams."""

    def __init__(self, langs: list[str], grams_: list[str], matrix: np.ndarray):
        self.langs, self.grams, self.matrix = langs, grams_, matrix
        self.at = {g: i for i, g in enumerate(grams_)}
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1024, len(langs)))

    def word(self, w: str) -> np.ndarray:
        """The log-likelihoods of a word by language."""
        at = self._number(w)
        return self.rows[at]

    def _number(self, w: str) -> int:
        at = self.number.get(w)
        if at is None:
            at = self.number[w] = len(self.number)
            if at == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            get, unseen = self.at.get, len(self.grams)
            self.rows[at] = self.matrix[[get(g, unseen) for g in grams(w)]].sum(axis=0) * WEIGHT
        return at

    def units(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The (words, languages) log-likelihoods of all lists of words, and the place of the first word of each."""
        if len(self.number) > 300_000:  # bounds the words kept by a worker; they are computed again
            self.number, self.rows = {}, np.zeros((1024, len(self.langs)))
        ids: list[int] = []
        starts = []
        known = self.number
        for t in texts:
            starts.append(len(ids))
            for w in t:
                at = known.get(w)
                ids.append(self._number(w) if at is None else at)
        return self.rows[ids], np.array(starts)

    @staticmethod
    def fit(texts: list[str], labels: list[str], rounds: int = 3) -> Model | None:
        """n-gram probabilities by language; documents whose text speaks against their label move to the likelier one.

        A word that a text repeats counts 1 + log2 of its occurrences there, so that one text can't fill a language."""
        if not texts:
            return None
        counts = [Counter(WORDS.findall(t.lower())) for t in texts]
        y = list(labels)
        model = None
        lam = 0.3
        for _ in range(rounds):
            langs = sorted(set(y))
            words: dict[str, Counter] = {k: Counter() for k in langs}
            for c, k in zip(counts, y):
                to = words[k]
                for w, n in c.items():
                    to[w] += 1 + math.log2(n)
            by: dict[str, Counter] = {k: Counter() for k in langs}
            for k, ws in words.items():
                to = by[k]
                for w, n in ws.items():
                    for g in grams(w):
                        to[g] += n
            vocab = sorted(set().union(*by.values()))
            seen = np.array([[by[k].get(g, 0.0) for k in langs] for g in [*vocab, ""]])
            model = Model(langs, vocab, np.log((seen + lam) / (seen.sum(axis=0) + lam * (len(vocab) + 1))))
            new = [langs[int(np.argmax(model.score(c)))] if c else k for c, k in zip(counts, y)]
            if new == y:
                break
            y = new
        return model

    def score(self, counts: Counter) -> np.ndarray:
        """The log-likelihoods of a bag of words by language."""
        at = [self._number(w) for w in counts]
        return np.array(list(counts.values()), dtype=float) @ self.rows[at]


def em(like: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of a mixture of the columns of a log-likelihood matrix."""
    n, k = like.shape
    if k == 1:
        return np.ones(1), float(like.sum())
    top = like.max(axis=1)
    p = np.exp(like - top[:, None])
    pi = np.full(k, 1.0 / k)
    for _ in range(rounds):
        new = pi * (p.T @ (1.0 / np.maximum(p @ pi, 1e-300))) / n
        done = np.abs(new - pi).max() < 1e-3
        pi = new
        if done:
            break
    return pi, float(np.log(np.maximum(p @ pi, 1e-300)).sum() + top.sum())


def best_share(ratio: np.ndarray, rounds: int = 6) -> tuple[float, float]:
    """(share, gain): the share of a new language at which it raises the log-likelihood of a mixture most,
    sum log(1 + share * (ratio - 1)) for the words' ratios of probabilities, by Newton steps kept inside the bracket
    (it is concave), and by how much."""
    d = ratio - 1
    if d.sum() <= 0:
        return 0.0, 0.0
    low, high, x = 0.0, 0.999, 0.1
    for _ in range(rounds):
        g = d / (1 + x * d)
        slope = float(g.sum())
        low, high = (x, high) if slope > 0 else (low, x)
        step = x + slope / max(float(g @ g), 1e-300)
        x, before = step if low < step < high else (low + high) / 2, x
        if abs(x - before) < 1e-4:
            break
    return x, float(np.log1p(x * d).sum())


def language_set(like: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """The columns whose mixture has the best penalised likelihood, grown one by one, and their proportions.

    EM over all languages gives those with a share of the text; of them the one that raises the likelihood of the mixture so
    far most is added while it gains more than the penalty, and EM estimates the proportions of the grown set."""
    chosen = [int(np.argmax(like.sum(axis=0)))]
    full, _ = em(like)
    pi = np.ones(1)
    rest = [int(i) for i in np.flatnonzero(full > 0.01) if i != chosen[0]]
    base = like[:, chosen[0]]
    while rest:
        tried = [(*best_share(np.exp(np.clip(like[:, i] - base, -50, 50))), i) for i in rest]
        share, gain, i = max(tried, key=lambda x: x[1])
        if gain <= penalty:
            break
        chosen.append(i)
        rest.remove(i)
        pi = np.array([1 - share, share]) if len(chosen) == 2 else em(like[:, chosen])[0]
        if rest:
            part = like[:, chosen]
            top = part.max(axis=1)
            base = top + np.log(np.maximum(np.exp(part - top[:, None]) @ pi, 1e-300))
    return chosen, pi


def infer(model: Model, text: str | None, penalty: float = PENALTY) -> list[tuple[str, str, float]]:
    """(sentence, language, confidence) of each sentence of a text."""
    found_ = sentences(text)
    if not found_:
        return []
    sents = [s for s, _ in found_]
    like, starts = model.units([w for _, w in found_])
    chosen, pi = language_set(like, penalty)
    # a sentence the whole mixture leaves to a foreign language with a clear lead brings it into the set
    sums = np.add.reduceat(like, starts, axis=0)
    clear = ((sums - sums[:, chosen].max(axis=1)[:, None]) > penalty).sum(axis=0) >= 2
    for k in np.flatnonzero(clear):
        if k not in chosen and ((sums[:, k] - sums[:, chosen].max(axis=1)) > penalty).sum() >= 2:
            chosen, pi = [*chosen, int(k)], np.append(pi, 0.01)
    pi = np.maximum(pi, 1e-3)
    score = sums[:, chosen] + np.log(pi / pi.sum())
    best = np.argmax(score, axis=1)
    each = np.arange(len(sents))
    lead = np.clip(sums - sums[each, np.array(chosen)[best]][:, None], -60, 60)
    post = np.exp(score - score[each, best][:, None])
    conf = np.minimum(1.0 / np.exp(lead).sum(axis=1), 1.0 / post.sum(axis=1))
    return [(s, model.langs[chosen[k]], float(c)) for s, k, c in zip(sents, best, conf)]


def text_languages(sents: list[tuple[str, str, float]]) -> dict[str, tuple[int, float, float]]:
    """language -> (sentences, share of the sentences' letters, confidence) for the languages of a text."""
    if not sents:
        return {}
    n = Counter(k for _, k, _ in sents)
    several = [k for k, c in n.items() if c >= 2]
    if not several:
        several = [max(sents, key=lambda x: len(x[0]))[1]]
    size = {k: sum(len(s) for s, x, _ in sents if x == k) for k in n}
    total = sum(size.values())
    return {k: (n[k], size[k] / total, sum(len(s) * c for s, x, c in sents if x == k) / size[k]) for k in sorted(several)}


SPOKEN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("share", T.DoubleType()), T.StructField("confidence", T.DoubleType())]))),
        T.StructField("passages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())]))),
    ]
)


def training_sample(docs: DataFrame, sample_per_label: int = 300) -> tuple[list[str], list[str]]:
    """A bounded sample for fitting: per readable label the documents first in hash order, each whole."""
    sites = [F.when(F.lower(F.trim("lang")).isin([k, *v.split()]) | F.lower(F.trim("lang")).rlike(rf"^{k}[-_]"), k) for k, v in LANGUAGES.items()]
    labelled = docs.where("text IS NOT NULL AND length(text) >= 20").select(F.coalesce(*sites).alias("label"), "text").where("label IS NOT NULL")
    first = Window.partitionBy("label").orderBy(F.xxhash64("text"))
    rows = labelled.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_per_label).select("label", "text").collect()
    rows = sorted((r.text, r.label) for r in rows)
    pairs = [(" ".join(segments(t)), k) for t, k in rows]
    pairs = [(t, k) for t, k in pairs if t]
    return [t for t, _ in pairs], [k for _, k in pairs]


def fit(docs: DataFrame, sample_per_label: int = 300) -> Model | None:
    return Model.fit(*training_sample(docs, sample_per_label))


def spoken(docs: DataFrame, model: Model | None = None, sample_per_label: int = 300, with_passages: bool = True) -> DataFrame:
    """(doc_id, label, languages, passages) of each distinct (doc_id, text, lang); passages are null if not asked for."""
    docs = docs.select("doc_id", "text", "lang").dropDuplicates()
    model = model or fit(docs, sample_per_label)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.grams, model.matrix) if model else None)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *SPOKEN.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value) if shared.value else None
        for pdf in batches:
            rows = []
            for d, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
                sents = infer(m, text) if m else []
                langs = [{"lang": k, "n_sentences": n, "share": s, "confidence": c} for k, (n, s, c) in text_languages(sents).items()]
                passages: list[dict] | None = [] if with_passages else None
                for s, k, c in sents if with_passages else ():
                    if passages and passages[-1]["lang"] == k:
                        p = passages[-1]
                        p["confidence"] = (p["confidence"] * p["n_sentences"] + c) / (p["n_sentences"] + 1)
                        p["n_sentences"] += 1
                        p["text"] += " " + s
                    else:
                        passages.append({"lang": k, "n_sentences": 1, "text": s, "confidence": c})
                rows.append((d, normal_label(lang), langs, passages))
            yield pd.DataFrame(rows, columns=schema.names)

    return spread(docs).mapInPandas(run, schema)


def found(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, lang): the languages of each text with a missing or wrong label or with several languages."""
    s = spoken(docs, with_passages=False, **kw).where(F.size("languages") > 0)
    case = F.col("label").isNull() | (F.size("languages") > 1) | ~F.exists("languages", lambda x: x["lang"] == F.col("label"))
    return s.where(case).select("doc_id", F.explode("languages.lang").alias("lang")).distinct()


def passages(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, passage_no, lang, n_sentences, confidence, text) of every passage."""
    return spoken(docs, **kw).select("doc_id", F.posexplode("passages").alias("passage_no", "p")).select("doc_id", "passage_no", "p.lang", "p.n_sentences", F.round("p.confidence", 6).alias("confidence"), "p.text")


def languages(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, label, lang, n_sentences, share, confidence): every language of every text."""
    return spoken(docs, with_passages=False, **kw).select("doc_id", "label", F.explode("languages").alias("p")).select("doc_id", "label", "p.lang", "p.n_sentences", F.round("p.share", 6).alias("share"), F.round("p.confidence", 6).alias("confidence"))
