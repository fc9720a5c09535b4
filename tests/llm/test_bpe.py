import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer as Library

from corpusplan.llm import bpe
from corpusplan.llm.queries import vocabulary

TEXTS = [None, "", " ", "The cat's hats", "naïve Straße ΣΑΣ ΟΔΟΣ İstanbul", "a" * 3000, "x<|endoftext|>Y <|startoftext|>",
         "12345 ½ ²", "é é ẛ̣", "don't they'LL", "\x1c\x85   tab\there", "日本語 한국어 🎉🎉", "\0 \x07"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Library.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(bpe.load_definition(vocabulary()), cache_words=50)


def naive(symbols, merges):
    symbols = list(symbols)
    while True:
        ranked = [(merges[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges]
        if not ranked:
            return symbols
        i = min(ranked)[1]
        symbols[i:i + 2] = [merges[symbols[i], symbols[i + 1]][1]]


@given(st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=200, deadline=None)
def test_segment_tree_merges_leftmost_lowest(symbols):
    merges = {(0, 0): (3, 4), (0, 1): (1, 5), (4, 4): (0, 6), (1, 0): (1, 7), (5, 2): (2, 8), (4, 0): (2, 9), (6, 6): (5, 10)}
    assert bpe.merge_all(list(symbols), merges) == naive(symbols, merges)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_and_text_are_the_library_s(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
    assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_table(spark, library):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(None, "The cat", None, 1), (0, None, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")
    out = bpe.encode_decode(docs, vocabulary()).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), vocabulary(), keep=False).count() == 0
