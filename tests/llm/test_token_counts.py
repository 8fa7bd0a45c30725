"""Token counts against the library on whole texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm.queries import tokenizer_file
from sheaf.llm.token_counts import _Lengths, count_tokens

NAME = "byte_bpe_50k.json"
TEXTS = [
    None, "", " ", "a", " a", "a ", "a  b", "it's  a\n test", "x \n y", "a <|endoftext|> b", "a<|endoftext|>b <|endoftext|>",
    "café 　  x 日本 \U0001f600 \t\t", "word " * 3000, "q" * 5000, "a \x1c b\x85 c",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(NAME))
    return lambda text: len(t.encode(text or "", add_special_tokens=False))


def test_counts(spark, library):
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, extra int")
    got = {r.doc_id: r for r in count_tokens(docs, tokenizer_file(NAME)).collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "n_bytes", "n_tokens", "over_limit", "extra"}
    for i, text, _, _ in rows:
        assert got[i].n_tokens == library(text), text
        assert got[i].n_bytes == len((text or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 1024)


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file(NAME)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\t'abcs1. 　é<|>日", max_size=40))
def test_segments_are_safe(text):
    lengths = _Lengths(tokenizer_file(NAME))
    assert lengths.count([text]) == [len(lengths.tokenizer.encode(text, add_special_tokens=False))]
