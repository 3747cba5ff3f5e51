import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opsloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary.load(PATH)
ENCODER = bpe.Encoder(VOCABULARY)
ODD = ["", " ", "\n\n x", "a  b", "x" * 700, "don't<|endoftext|> stop", "é́ 日本 😀 \x1c\x85\xa0", "12 345\t\t6 ", "\r\n  end ", "it's\nIt'S  "]


def same(text):
    packed = ENCODER.encode([text])[0]
    ids = REFERENCE.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert bpe.decode_ids(packed, VOCABULARY.tokens) == REFERENCE.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\t\r\x0b\x0c\x1c\x85\xa0\u3000\u2028ab1.'sé", max_size=400))
def test_white_space_of_all_kinds(text):
    same(text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="theanding \n.1é<|endoftext|>", max_size=200), max_size=30))
def test_texts_together(texts):
    """A slice's texts get the ids that each gets on its own."""
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(VOCABULARY).encode(texts)] == [REFERENCE.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_and_short_merges_agree():
    words = [b"thethingandtheotherthing"[i:] * k for i in range(24) for k in (1, 2, 20)]
    want = [bpe.merge_long([VOCABULARY.single[b] for b in w], VOCABULARY.pairs, VOCABULARY.merged) for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Merger(VOCABULARY).merge(words)] == want


def test_frame(documents):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "same", "same"])]
    df = bpe.decode(bpe.encode(documents(rows), VOCABULARY), VOCABULARY)
    got = {r["doc_id"]: (r["decoded"], r["score"]) for r in df.collect()}
    assert got == {i: (t or "", "x") for i, t in rows}
    assert bpe.encode(documents([]), VOCABULARY).count() == 0
    both = {r["doc_id"]: r["coded"] for r in bpe.encode_and_decode(documents(rows), VOCABULARY).collect()}
    assert {i: (r["token_ids"], r["decoded"]) for i, r in ((r["doc_id"], r) for r in df.collect())} == {i: tuple(c) for i, c in both.items()}


@pytest.mark.parametrize("text", ["a\tb\tc\n\n\nd", "a\tb\tc\n\n", "a　b c  \n d", "a\rb\rc\n\n\nd e", " a\tb", "a\tb\n", "plain text\nwith lines"])
def test_white_space_that_cancels_out(text):
    same(text)
