import base64
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm.bpe import DEFAULT_VOCABULARY, count_tokens, encode_corpus, encoder

tiktoken = pytest.importorskip("tiktoken")
# The pattern of this vocabulary family, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def known():
    with open(DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    import numpy as np

    return np.frombuffer(encoder().packed(text), np.int32).tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'sdtrevml.,_()#09²½ é日"), st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=["Cn"])), max_size=80))
def test_as_the_public_encoder(known, text):
    assert ids(text) == known.encode_ordinary(text)


def test_very_long_pretoken_takes_time_in_proportion(known):
    text = "abcabd" * 3000
    assert ids(text) == known.encode_ordinary(text)
    began = time.process_time()
    assert len(ids("xy" * 300_000)) > 0
    assert time.process_time() - began < 60


def test_rows(spark, known):
    rows = [(1, "Hello  world\n", "x"), (2, None, "x"), (3, "", "x"), (4, "<|endoftext|>", "x"), (5, "é" * 70_000, "x"), (1, "Hello  world\n", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = sorted(map(tuple, encode_corpus(df, "doc_id", "text").collect()))
    assert out == sorted((k, known.encode_ordinary(t or "")) for k, t, _ in rows)
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(df, "doc_id", "text", []).collect()) == sorted((k, len(i)) for k, i in out)
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
