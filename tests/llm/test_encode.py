import base64

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from lexigrid.llm import encode as E

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_library(exact):
    bpe = E.Replay(E.tokenizer_path("byte_bpe_50k"))
    texts = ["", None, " ", "a", "aaaaaaaaaaaa", "<|endoftext|>", "  two\n\n\tspaces  ", "naïve Ünïcode ß 日本語テキスト 👩‍👩‍👧", "x" * 5000, "don't WE'LL 12345 3.14", "ab" * 3000]
    got = bpe.encode_batch(texts)
    assert got == [exact.encode_ordinary(t) if t else [] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_replay_property(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))} if not hasattr(test_replay_property, "r") else test_replay_property.r
    test_replay_property.r = ranks
    if not hasattr(test_replay_property, "t"):
        test_replay_property.t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        test_replay_property.b = E.Replay(E.tokenizer_path("byte_bpe_50k"))
    text = text.encode("utf-8", "ignore").decode()
    assert test_replay_property.b.encode_batch([text])[0] == test_replay_property.t.encode_ordinary(text)


def test_table(spark, exact):
    df = spark.createDataFrame([(1, "one two", "x"), (2, None, "x"), (3, "", "x"), (4, "one two", None)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in E.encode(df).collect()}
    assert got == {1: exact.encode_ordinary("one two"), 2: [], 3: [], 4: exact.encode_ordinary("one two")}
    assert E.encode(df.limit(0)).collect() == []


def test_whole_corpus(spark, sf, exact):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: exact.encode_ordinary(r.text) if r.text else [] for r in df.collect()}
    assert {r.doc_id: list(r.ids) for r in E.encode(df).collect()} == want
    assert isinstance(E.encode(df).toPandas(), pd.DataFrame)
