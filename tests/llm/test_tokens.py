import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from simlode.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder(K.read_ranks(K.VOCABULARY))


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=K.read_ranks(K.VOCABULARY), special_tokens={})


def ids(encoder, texts):
    flat, counts = encoder(texts)
    out, at = [], 0
    for n in counts:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


ODD = ["", " ", "\n\n  x", "it's WE'LL they'Re", "a" * 20_000, " " * 3000 + "x", "<|endoftext|>", "ﬁ﻿z​", "日本語 مرحبا ١٢٣ ½ Ⅷ", "😀👩‍👩‍👧 𝐀𐐀", "\x1c\x1d \x85  ", "tab\t\r\nend "]


def test_odd_texts_match_the_library(encoder, library):
    assert ids(encoder, ODD) == [library.encode_ordinary(t) for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text_matches_and_decodes(encoder, library, texts):
    got = ids(encoder, texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [library.decode_bytes(x).decode() for x in got] == texts


def test_perfect_hash_is_minimal(encoder):
    keys = list(encoder.ranks)
    assert sorted(encoder.find(K._hashes(keys)).tolist()) == list(range(len(keys)))


def test_memory_is_bounded(encoder, library, monkeypatch):
    monkeypatch.setattr(K, "MEMO_ENTRIES", 3)
    texts = [f"word{i} other{i}" for i in range(20)]
    assert [x for t in texts for x in ids(encoder, [t])] == [library.encode_ordinary(t) for t in texts]
    assert len(encoder.codes) < 12


def test_corpus(spark, library):
    rows = [(1, "hello world", "a", 9), (2, None, "b", 9), (3, "", None, 9), (1, "hello world", "a", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, k0 int")
    got = sorted((r.doc_id, r.ids) for r in K.encode_corpus(df, ["doc_id"]).collect())
    hello = library.encode_ordinary("hello world")
    assert got == [(1, hello), (1, hello), (2, []), (3, [])]
    assert K.encode_corpus(df.limit(0), ["doc_id"]).collect() == []
    assert K.encode_corpus(df, ["doc_id", "k0"], ids="text").columns == ["doc_id", "k0", "text"]
