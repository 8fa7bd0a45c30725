"""Byte-level BPE against the public library, and round trips."""

import random
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm.byte_bpe import Codec, decode, encode, merge, read_ranks, stitch
from sheaf.llm.queries import tokenizer_file

RANKS = tokenizer_file("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SMALL = {"chunk": 40, "overlap": 8}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(RANKS, PATTERN)


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def by_chunks(codec, text, chunk, overlap):
    cuts = list(codec.chunks(text, chunk, overlap))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    return stitch(codec.encode_chunks([(text[a:b], a, b == len(text)) for a, b in cuts], overlap)), len(cuts)


TEXTS = [
    None, "", " ", "a", " a", "a ", "a  b", "it's  we'll I'd 'S a\n test", "x \n y", "a <|endoftext|> b", "café 　  x 日本 \U0001f600 \t\t", "q" * 5000,
    " " * 3000 + "x", "ab " * 3000, "don't " * 500, "?!" * 900 + " end", "日本語のテキスト、" * 300, "12 345a6 " * 200, "\x00\x1c\x85  x‍", "'" * 700 + "ll",
]


def test_every_character(codec, library):
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    odd = []
    for lo in range(0, len(chars), 4096):
        text = " ".join(f"{c}a1.{c} {c}{c}" for c in chars[lo : lo + 4096])
        if ids_of(codec.encode([text])[0]) != library.encode_ordinary(text):
            odd.extend(c for c in chars[lo : lo + 4096] if ids_of(codec.encode([t := f"{c}a1.{c} {c}{c}"])[0]) != library.encode_ordinary(t))
    assert odd == []


def test_tables(spark, library):
    rows = [(i, t, "x", 7, 1) for i, t in enumerate(TEXTS * 2)] + [(None, "null id " * 30, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, rest int, key int")
    out = decode(encode(docs, RANKS, PATTERN, **SMALL), RANKS)
    assert set(out.columns) == {"doc_id", "rest", "key", "ids", "n_tokens", "decoded"}
    got = out.collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text, _, rest, key in rows:
        r = by_id[i]
        assert ids_of(r.ids) == library.encode_ordinary(text or ""), text
        assert r.n_tokens == len(r.ids) // 4 and bytes(r.decoded) == (text or "").encode()
        assert (r.rest, r.key) == (rest, key)


def test_only_texts_and_empty_tables(spark):
    texts = spark.createDataFrame([("word " * 50,)], "text string")
    assert [r.n_tokens for r in encode(texts, RANKS, PATTERN, **SMALL).collect()] == [51]
    assert encode(spark.createDataFrame([], "doc_id long, text string"), RANKS, PATTERN).count() == 0


def test_ids_outside_the_vocabulary(spark):
    out = decode(spark.createDataFrame([(None,)], "ids binary"), RANKS).collect()
    assert out[0].decoded is None
    with pytest.raises(Exception, match="no token"):
        decode(spark.createDataFrame([(bytearray(b"\xff\xff\xff\xff"),)], "ids binary"), RANKS).collect()


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_chunks(codec, library, text):
    ids, n = by_chunks(codec, text, 40, 8)
    assert ids_of(ids) == library.encode_ordinary(text)
    assert n > 50 or not text.startswith(("ab ", "don't", "日本", "12 "))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\t'abcslre1. 　é<|>日\U0001f600", max_size=200), st.integers(3, 9))
def test_stitching(text, overlap):
    codec = test_stitching.codec = getattr(test_stitching, "codec", None) or Codec(RANKS, PATTERN)
    ids, _ = by_chunks(codec, text, 4 * overlap, overlap)
    assert [ids] == codec.encode([text])


def test_merging(codec, library):
    rng = random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choices("aetion", k=rng.randint(1, 60)))
        want = library.encode_ordinary(piece)
        assert merge(piece.encode(), codec.merges.ranks, codec.merges.longest) == want
        assert ids_of(codec.merges.packed([piece])[piece]) == want


def test_merging_together(codec, library):
    rng = random.Random(2)
    pieces = sorted({"".join(rng.choices("abcdefghinost日é", k=rng.randint(1, 14))) for _ in range(3000)})
    packed = codec.merges.packed(pieces)
    assert {p: ids_of(x) for p, x in packed.items()} == {p: library.encode_ordinary(p) for p in pieces}
