"""Problem 6: repetition inside a single document.

Method: line sequence labelling. Each text is cut into its lines, those into sentences and those into pieces of at
most two windows of words, also where three-word sequences begun earlier start or end; a linear-chain conditional random field labels the pieces content (0) or repetition (1)
by Viterbi decoding. It sees no five-word windows: its features are the shares of a piece's words inside
two-word and three-word sequences begun earlier in the text, whether all of them are, whether the piece's wording
is a copy of an earlier piece, and whether it is short; what its neighbours are, the transitions carry.

The content share of the decoded labels (words in content pieces of all words) decides retention: a text whose content
share is above 1 - `min_share` is kept. The labels only estimate the exact share, so `found` settles every text
whose content share is within `margin` above that line by an exact count of repeated words, as well as those below;
texts with a higher content share are kept without a count. README has the recall of this step against the exact
count of all texts.

The weights are fitted by maximum likelihood (forward-backward) on a bounded sample of texts, the first
`sample` in hash order, whose pieces are labelled by the exact count (more than half of the words repeated).

Defined results: a null, empty or wordless text has share 0, content share 1 and no pieces; texts shorter than a
window have no repetition; a row delivered twice counts once; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lexigrid.session import spread

WINDOW = 5
MIN_SHARE = (3, 10)
#: How far the content share may lie above the line of retention for an exact count to settle the text.
MARGIN = 0.15
#: Where no sample can be had. Emission score of label 1 = the features times these; label 0 scores 0; staying on a label scores `stay`.
WEIGHTS = {"bias": -5.0, "two": 2.0, "three": 6.0, "full": 2.0, "copy": 2.0, "short": 0.0, "stay": 0.7}

WORD = re.compile(r"(?:[^\W_]|['’])+")
SEGMENT = re.compile(r"[^\n.!?。！？]*(?:[.!?。！？]+|\n|$)")


def words(text: str) -> list[tuple[str, int]]:
    """Runs of letters, digits and apostrophes, lower-cased, with their start."""
    return [(m.group().lower(), m.start()) for m in WORD.finditer(text)]


def repeated(ws: list[str], window: int = WINDOW) -> np.ndarray:
    """Marks each word in a window that already began earlier in the text."""
    n = len(ws)
    marks = np.zeros(n + 1, dtype=np.int64)
    seen: set[tuple[str, ...]] = set()
    for i in range(n - window + 1):
        key = tuple(ws[i : i + window])
        if key in seen:
            marks[i] += 1
            marks[min(n, i + window)] -= 1
        else:
            seen.add(key)
    return np.cumsum(marks[:n]) > 0


def viterbi(emission: np.ndarray, stay: float) -> np.ndarray:
    """Best label sequence of a two-label chain: emission scores of label 1 (label 0 scores 0), `stay` for equal neighbours."""
    n = len(emission)
    if n == 0:
        return np.zeros(0, dtype=np.int8)
    back = np.zeros((n, 2), dtype=np.int8)
    a0, a1 = 0.0, float(emission[0])
    for i in range(1, n):
        s0, s1 = (a0 + stay, a1), (a0, a1 + stay)
        back[i, 0] = 1 if s0[1] > s0[0] else 0
        back[i, 1] = 1 if s1[1] >= s1[0] else 0
        a0, a1 = max(s0), max(s1) + float(emission[i])
    labels = np.zeros(n, dtype=np.int8)
    labels[-1] = 1 if a1 > a0 else 0
    for i in range(n - 1, 0, -1):
        labels[i - 1] = back[i, labels[i]]
    return labels


FEATURES = ("bias", "two", "three", "full", "copy", "short")


def pieces(text: str, ws: list[tuple[str, int]], inner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The place of the first word of each piece: a sentence of a line, cut after every two windows of words and where
    `inner` (words in three-word sequences begun earlier) changes."""
    ends = np.array([m.end() for m in SEGMENT.finditer(text) if m.end() > m.start()], dtype=np.int64)
    seg = np.searchsorted(ends, np.array([p for _, p in ws]), side="right")
    start = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (inner[1:] != inner[:-1])]))
    inside = np.arange(len(ws)) - np.repeat(start, np.diff(np.append(start, len(ws))))
    return np.flatnonzero(inside % (2 * window) == 0)


def features(text: str | None, window: int = WINDOW):
    """(words, words of each piece, features of each piece) of one text."""
    ws = words(text or "")
    if not ws:
        return [], np.zeros(0, dtype=np.int64), np.zeros((0, len(FEATURES)))
    plain = [w for w, _ in ws]
    two, three = repeated(plain, 2), repeated(plain, 3)
    first = pieces(text, ws, three, window)
    size = np.diff(np.append(first, len(ws)))
    share = [np.add.reduceat(x.astype(np.int64), first) / size for x in (two, three)]
    seen: set[tuple[str, ...]] = set()
    copy = np.zeros(len(first))
    for k, (at, n) in enumerate(zip(first, size)):
        key = tuple(plain[at : at + n])
        copy[k] = key in seen
        seen.add(key)
    return plain, size, np.stack([np.ones(len(first)), *share, (share[1] == 1) & (size >= window), copy, size < 3], axis=1)


def label(text: str | None, window: int = WINDOW, weights: dict = WEIGHTS):
    """(words, pieces, pieces labelled 1, content share) of one text."""
    plain, size, f = features(text, window)
    if not plain:
        return 0, 0, 0, 1.0
    labels = viterbi(f @ np.array([weights[x] for x in FEATURES]), weights["stay"])
    return len(plain), len(size), int(labels.sum()), int(size[labels == 0].sum()) / len(plain)


def count(text: str | None, window: int = WINDOW) -> tuple[int, int]:
    """(words, repeated words) of one text, exactly."""
    plain = [w for w, _ in words(text or "")]
    return len(plain), int(repeated(plain, window).sum())


def marginals(emission: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of each segment and P(equal labels) of each pair of neighbours, by forward-backward."""
    n = len(emission)
    unary = np.stack([np.zeros(n), emission], axis=1)
    pair = np.array([[stay, 0.0], [0.0, stay]])
    fwd, bwd = unary.copy(), np.zeros((n, 2))
    for i in range(1, n):
        fwd[i] += np.logaddexp.reduce(fwd[i - 1][:, None] + pair, axis=0)
    for i in range(n - 2, -1, -1):
        bwd[i] = np.logaddexp.reduce(pair + unary[i + 1] + bwd[i + 1], axis=1)
    z = np.logaddexp.reduce(fwd[-1])
    one = np.exp(fwd[:, 1] + bwd[:, 1] - z)
    both = np.exp(fwd[:-1, :, None] + pair + (unary[1:] + bwd[1:])[:, None, :] - z)
    return one, both[:, 0, 0] + both[:, 1, 1]


def train(texts: list[str], window: int = WINDOW, epochs: int = 12, rate: float = 0.5, decay: float = 1e-4) -> dict:
    """Weights of the field by gradient ascent on texts whose pieces are labelled by the exact count."""
    data = []
    for t in texts:
        plain, size, f = features(t, window)
        if plain:
            first = np.cumsum(size) - size
            y = np.add.reduceat(repeated(plain, window).astype(np.int64), first) * 2 > size
            data.append((f, y.astype(float)))
    if not any(y.any() for _, y in data):
        return dict(WEIGHTS)
    w, stay = np.array([WEIGHTS[x] for x in FEATURES]), WEIGHTS["stay"]
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        for f, y in data:
            one, equal = marginals(f @ w, stay)
            w = w + step * ((y - one) @ f / len(y) - decay * w)
            if len(y) > 1:
                stay += step * (float(((y[1:] == y[:-1]) - equal).mean()) - decay * stay)
    return dict(zip(FEATURES, map(float, w))) | {"stay": float(stay)}


def fit(df: DataFrame, text: str = "text", window: int = WINDOW, sample: int = 300) -> dict:
    """train() on the first `sample` distinct texts in hash order (for fitting only)."""
    rows = df.select(F.col(text).alias("t")).where("t IS NOT NULL AND length(t) > 0").distinct().orderBy(F.xxhash64("t"), "t").limit(sample).collect()
    return train([r.t for r in rows], window)


LABELS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("n_marked", T.LongType()), T.StructField("content_share", T.DoubleType())])
COUNT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_repeated", T.LongType())])


def labelled(df: DataFrame, key="gen_id", text="text", window: int = WINDOW, weights: dict | None = None) -> DataFrame:
    """(key, __text, n_words, n_pieces, n_marked, content_share): one row per key and text."""
    weights = weights or fit(df, text, window)

    @F.pandas_udf(LABELS)
    def run(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([label(t, window, weights) for t in col], columns=LABELS.names)

    rows = spread(df.select(F.col(key).alias(key), F.col(text).alias("__text")).dropDuplicates())
    return rows.select(key, "__text", run("__text").alias("m")).select(key, "__text", "m.*")


def counted(window: int):
    @F.pandas_udf(COUNT)
    def run(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count(t, window) for t in col], columns=COUNT.names)

    return run


def measure(df: DataFrame, key="gen_id", text="text", window: int = WINDOW, min_share=MIN_SHARE, weights: dict | None = None) -> DataFrame:
    """(key, n_words, n_repeated, repeated_share, n_pieces, n_marked, content_share, retained): the exact share and the labels'
    share of each key and text; retained: the content share is above 1 - min_share."""
    got = labelled(df, key, text, window, weights).withColumn("c", counted(window)("__text"))
    share = F.when(F.col("n_words") > 0, F.col("c.n_repeated") / F.col("n_words")).otherwise(F.lit(0.0))
    line = 1 - min_share[0] / min_share[1]
    return got.select(key, "n_words", F.col("c.n_repeated").alias("n_repeated"), share.alias("repeated_share"), "n_pieces", "n_marked", "content_share", (F.col("content_share") > line).alias("retained"))


def found(df: DataFrame, key="gen_id", text="text", window: int = WINDOW, min_share=MIN_SHARE, margin: float = MARGIN, weights: dict | None = None) -> DataFrame:
    """(key): texts whose content share is at most 1 - min_share + margin and whose exact share reaches min_share
    = (numerator, denominator)."""
    num, den = min_share
    near = labelled(df, key, text, window, weights).where((F.col("n_words") > 0) & (F.col("content_share") <= 1 - num / den + margin))
    exact = near.withColumn("c", counted(window)("__text")).where((F.col("c.n_words") > 0) & (F.col("c.n_repeated") * den >= F.col("c.n_words") * num))
    return exact.select(key).distinct()
