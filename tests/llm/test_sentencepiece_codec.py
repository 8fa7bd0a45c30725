"""Encoding against a search of all segmentations, and exact round trips."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm.queries import tokenizer_file
from sheaf.llm.sentencepiece_codec import MARK, Codec, decode, encode, with_counts

MODEL = tokenizer_file("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", " the  quick\n\tbrown ", "日本 \U0001f600\x00", "a▁b ▁▁", "naïve café", "x" * 20000, "word " * 5000, "▁"]


@pytest.fixture(scope="module")
def codec():
    return Codec(MODEL)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}


def best(text, pieces, unknown):
    """The highest total score, by a plain table over all pieces."""
    score = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        score[end] = score[end - 1] + unknown
        for start in range(max(0, end - 16), end):
            if text[start:end] in pieces:
                score[end] = max(score[end], score[start] + pieces[text[start:end]])
    return score[-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abethinorsd .,é日\U0001f600", max_size=25))
def test_best_score_and_round_trip(codec, pieces, text):
    ids = np.frombuffer(codec.encode([text])[0], np.int32).tolist()
    assert codec.decode(ids) == text
    if text:
        held = [codec.texts[i] for i in ids]
        total, i = 0.0, 0
        while i < len(ids):
            if ids[i] in codec.bytes.values():  # the bytes of one unknown character
                lead = held[i][0]
                i += 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
                total += codec.unknown
            else:
                total += pieces[held[i].decode().replace(" ", MARK)]
                i += 1
        assert total == pytest.approx(best(MARK + text.replace(" ", MARK), pieces, codec.unknown))


def test_tables(spark):
    rows = [(i, t, [1], "z") for i, t in enumerate(TEXTS + TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string")
    out = decode(with_counts(encode(docs, MODEL, verify=True)), MODEL)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, text, _, _ in rows:
        r = got[i]
        assert r.decoded == text and r.text == text
        assert (r.ids is None, r.round_trip, r.n_pieces) == ((True, None, None) if text is None else (False, True, len(r.ids)))
    assert encode(docs.limit(0), MODEL).count() == 0
