"""Problem 8: encoding of the whole corpus with a byte-level BPE of public_tokenizers.

Method: merge replay. The texts are cut into words by the tokenizer's own pattern; the distinct words of
a task's texts form its dictionary. An inverted index leads from each token pair to the words and places
where it stands; the pairs are applied in the order of their rank, every place of a pair at once, and only
the pairs next to a merged place are taken out of and put into the index. As each word's merges only
depend on the word, replaying the dictionary of each task gives the same ids as one replay over the whole
corpus, and no token ever crosses the network.

Defined results: a null or empty text has the empty list; special tokens' strings are ordinary text;
every row delivered is answered once per doc_id and text.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from lexigrid.session import spread

TOKENIZER = "byte_bpe_50k"
KEEP_WORDS = 400_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Replay:
    """The merges of one tokenizer, applied to many words at once."""

    def __init__(self, path: str, pattern: str | None = None):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern)
        self.token = {i: b for b, i in self.ranks.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.cache: dict[str, list[int]] = {}

    def merged(self, a: int, b: int) -> int:
        """The id of the token that the pair makes, or -1. Its rank is its id."""
        got = self.pair.get((a, b))
        if got is None:
            got = self.pair[a, b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return got

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of each distinct word by replaying the merges in rank order over an inverted index."""
        ids: list[int] = []  # the words' bytes in a row, -1 between words
        starts, known = [], {}
        for w in words:
            raw = w.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            if whole is not None:  # a byte-pair vocabulary reaches each of its tokens by its merges
                known[w] = [whole]
                continue
            starts.append((w, len(ids)))
            ids.extend(self.ranks[raw[i : i + 1]] for i in range(len(raw)))
            ids.append(-1)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[tuple[int, int], set[int]] = defaultdict(set)
        queue: list[tuple[int, tuple[int, int]]] = []
        for i in range(n - 1):
            a, b = ids[i], ids[i + 1]
            if a >= 0 and b >= 0:
                index[a, b].add(i)
        for p in index:
            rank = self.merged(*p)
            if rank >= 0:
                queue.append((rank, p))
        heapq.heapify(queue)
        dead = bytearray(n)
        while queue:
            new, p = heapq.heappop(queue)
            places = index.pop(p, None)
            if not places:
                continue
            a, b = p
            fresh: set[tuple[int, int]] = set()
            for i in sorted(places):
                j = after[i]
                if dead[i] or ids[i] != a or j >= n or ids[j] != b:  # an earlier place of the same pair took it
                    continue
                h, k = before[i], after[j]
                if h >= 0 and ids[h] >= 0:
                    index[ids[h], a].discard(h)
                    index[ids[h], new].add(h)
                    fresh.add((ids[h], new))
                if k < n and ids[k] >= 0:
                    index[b, ids[k]].discard(j)
                    index[new, ids[k]].add(i)
                    fresh.add((new, ids[k]))
                ids[i] = new
                dead[j] = 1
                after[i] = k
                if k < n:
                    before[k] = i
            for q in fresh:
                rank = self.merged(*q)
                if rank >= 0:
                    heapq.heappush(queue, (rank, q))
        for w, at in starts:
            out = []
            while ids[at] >= 0:
                out.append(ids[at])
                at = after[at]
            known[w] = out
        return known

    def _cut(self, texts) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        cut = [self.split.findall(t) if isinstance(t, str) and t else [] for t in texts]
        new = list({w for ws in cut for w in ws if w not in self.cache})
        if len(self.cache) + len(new) > KEEP_WORDS:
            self.cache = {}
            new = list({w for ws in cut for w in ws})
        self.cache |= self.encode_words(new)
        return cut

    def encode_batch(self, texts) -> list[list[int]]:
        """The ids of each text; null and empty texts have the empty list."""
        return [[i for w in ws for i in self.cache[w]] for ws in self._cut(texts)]

    def count_batch(self, texts) -> list[int]:
        """The number of tokens of each text."""
        cut = self._cut(texts)
        size = {w: len(self.cache[w]) for w in {w for ws in cut for w in ws}}
        return [sum([size[w] for w in ws]) for ws in cut]


_LOADED: dict[str, Replay] = {}


def replay(path: str) -> Replay:
    """One replay per Python worker and tokenizer."""
    if path not in _LOADED:
        _LOADED[path] = Replay(path)
    return _LOADED[path]


def encode(df: DataFrame, key="doc_id", text="text", tokenizer=TOKENIZER, path: str | None = None) -> DataFrame:
    """(key, ids) of each text by the tokenizer, without special tokens."""
    path = path or tokenizer_path(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = replay(path)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "ids": bpe.encode_batch(pdf["__text"])})

    rows = df.select(F.col(key).alias(key), F.col(text).alias("__text"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(rows).mapInPandas(run, schema)


def count_udf(tokenizer=TOKENIZER, path: str | None = None):
    """A pandas UDF: text to number of tokens, 0 for null and empty texts."""
    path = path or tokenizer_path(tokenizer)

    @F.pandas_udf(T.LongType())
    def n_tokens(col: pd.Series) -> pd.Series:
        return pd.Series(replay(path).count_batch(col), index=col.index, dtype="int64")

    return n_tokens.asNondeterministic()  # so that a filter on the count does not run it twice
