from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from vectorloom.nn.fixtures import WORDPIECE, write_bpe, write_model, write_unigram
from vectorloom.nn.model import Model
from vectorloom.tokenizers import ByteBPE, TokenizerError, Unigram, WordPiece, item_token_cap, open_tokenizer, truncate
from vectorloom.tokenizers.bpe import compose, split


@pytest.fixture(scope="module")
def bpe(tmp_path_factory):
    at = tmp_path_factory.mktemp("bpe")
    write_bpe(at)
    return open_tokenizer(at)


@pytest.mark.parametrize(("text", "ids"), [
    ("hello", [259]), ("hello world", [259, 263, 262]), ("held", [256, 262]), ("dr", [100, 114]), ("x123", [120, 49, 50, 51]),
    ("hello, world!", [259, 44, 263, 262, 33]), ("a\tb", [97, 9, 98]), ("a\nb", [97, 10, 98]), ("7 8", [55, 32, 56]),
    ("it's", [105, 116, 39, 115]), ("é", [195, 169]), ("a…b", [97, 226, 128, 166, 98]),
])
def test_bpe_ids(bpe, text, ids):
    assert bpe.encode(text) == ids


def test_composition_is_restricted():
    for a, b in (("é", "é"), ("à", "à"), ("ô", "ô"), ("ñ", "ñ"), ("ü", "ü"), ("å", "å"), ("ç", "ç")):
        assert compose(a) == b
    assert compose("x́") == "x́"
    assert compose("ĝ") == "ĝ"


def test_split_rules():
    assert split("a  b") == ["a", " ", " b"]
    assert split("a \n\n b") == ["a", " \n\n", " b"]
    assert split("x  ") == ["x", "  "]
    assert split(" ?!\n\nq") == [" ?!\n\n", "q"]
    assert split("we'LL go") == ["we", "'LL", " go"]
    assert split("-abc") == ["-abc"]


@given(st.text(max_size=40))
def test_bpe_round_trip(text):
    at = test_bpe_round_trip.bpe = getattr(test_bpe_round_trip, "bpe", None) or ByteBPE({s: i for i, s in enumerate(__import__("vectorloom.tokenizers.bpe", fromlist=["x"]).byte_signs())}, [])
    assert "".join(split(text)) == text
    assert at.decode(at.core(text)) == compose(text)


def test_bpe_keeps_broken_bytes(bpe):
    text = b"a\xff\xc3b".decode("utf-8", "surrogateescape")
    assert bpe.decode(bpe.encode(text)) == text


def test_empty_text_and_terminal(bpe, tmp_path):
    with pytest.raises(TokenizerError):
        bpe.encode("")
    write_bpe(tmp_path)
    assert open_tokenizer(tmp_path, append_terminal=True).encode("") == [264]
    assert bpe.encode("hello\0 world") == [259]
    assert bpe.encode("world", instruct="hello ") == bpe.encode("hello world")


def test_late_layout(bpe):
    ids, keep = bpe.encode_late("hello", True)
    assert len(ids) == 32 and ids[:3] == [259, 266, 265] and keep == list(range(32))
    long, keep = bpe.encode_late("x" * 50, True)
    assert len(long) == 51 and len(keep) == 51
    assert bpe.encode_late("hello, world", False) == ([259, 267, 44, 263, 262], [0, 1, 3, 4])


@pytest.mark.parametrize(("text", "ids"), [
    ("the capital of france is paris", [5, 6, 7, 8, 9, 10]), ("unaffable", [13, 14, 15]), ("tokenization", [21, 22]), ("The Capital.", [5, 6, 12]),
    ("hello, world!", [17, 11, 18, 19]), ("café", [16]), ("café", [16]), ("2023", [20]), ("xyzzy", [1]), ("中文", [23, 1]), ("a" * 101, [1]), ("", []), ("he​llo", [17]),
])
def test_wordpiece(text, ids):
    assert WordPiece(WORDPIECE).core(text) == ids


def test_wordpiece_cased_and_specials():
    w = WordPiece(WORDPIECE, lower=False)
    assert (w.core("The"), w.core("the"), w.encode("")) == ([1], [5], [2, 3])
    assert WordPiece(["[UNK]", "a", "a"]).core("a") == [2]
    with pytest.raises(ValueError):
        WordPiece(["a"])


@pytest.mark.parametrize(("text", "ids"), [("Hello world!", [8, 9, 7]), ("   ", []), ("南瓜", [6, 10, 11]), ("missing", [6, 3])])
def test_unigram(tmp_path, text, ids):
    write_unigram(tmp_path)
    t = Unigram.load(tmp_path)
    assert t.core(text) == ids
    assert (t.vocab_size, t.unk, t.bos, t.eos, t.pad, t.mask) == (14, 3, 0, 2, 1, 13)


def test_unigram_identity_ids(tmp_path):
    write_unigram(tmp_path, xlm_r=False)
    assert Unigram.load(tmp_path).core("Hello world!") == [7, 8, 6]


def test_caps():
    assert [item_token_cap(0, 0, b) for b in (0, 16384)] == [32768, 16384]
    assert item_token_cap(512, 0, 16384) == 512 and item_token_cap(32768, 0, 16384) == 16384
    assert truncate([101, 7, 8, 9, 10, 102], 4, True) == [101, 7, 8, 102]
    assert truncate([101, 7, 8, 102], 2, False) == [101, 7]


def test_ids_as_arrays_are_those_of_the_core(bpe, tmp_path):
    """Pieces come from a cache as bytes, with no object for each token; the model takes arrays as it takes lists."""
    write_model(tmp_path, vocab=268)
    ended = open_tokenizer(tmp_path, append_terminal=True)
    for text in ("hello world", "héllo  wórld 12", "\0x", "x\0y", "𝒳 中 \x85" * 50):
        for t in (bpe, ended):
            plain = [*t.prefix, *t.core("held " + text.split("\0")[0]), *t.suffix]
            got = t.encode_array(text, instruct="held ")
            assert got.dtype == np.int32 and got.tolist() == plain == t.encode(text, instruct="held ")
    assert truncate(got, 4, True).tolist() == truncate(plain, 4, True) and truncate(got, 4, False).tolist() == plain[:4]
    assert np.array_equal(Model(tmp_path).embed([got, got[:3]]), Model(tmp_path).embed([plain, plain[:3]]))
