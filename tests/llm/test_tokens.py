"""Encoding, decoding and counting against the tokenizers library."""

import random
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from riffle.llm.heap_merges import count_tokens, linked, merge
from riffle.llm.rank_array import decode, encode, merge_short
from riffle.llm.vocabulary import Vocabulary

FILE = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(FILE)


def strange(n):
    draw = random.Random(2)
    pool = [chr(c) for c in range(0x20, 0x3000)] + ["'s", "'LL", " ", " ", "<|endoftext|>", "<|startoftext|>", "\U0001f600", "가", "각", "\x1c", "\x85", "　"]
    fixed = ["a" * 3000, "ΑΣΣ ΣΑΣ İi ﬁ ǅ", "<|endoftext|>hi<|startoftext|><|endoftext|> x<|end", "a\x1cb\x1fc", "it's I'LL don't 'd''s", "é x̀à", "᫊ⷶ", ""]
    return fixed + ["".join(draw.choice(pool) for _ in range(draw.randint(1, 60))) for _ in range(n)]


def test_strange_texts(spark, library):
    texts = strange(1500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: e.ids for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}
    for r in decode(encode(docs, FILE), FILE).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert ids == want[r.doc_id] and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, FILE).collect()} == {i: len(x) for i, x in want.items()}


def test_odd_rows(odd, none, library):
    ids = lambda text: library.encode(text or "", add_special_tokens=False).ids
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    encoded = encode(odd, FILE)
    assert encoded.columns == [c for c in odd.columns if c != "ids"] + ["n_tokens", "ids"]
    assert Counter((r.doc_id, bytes(r.ids)) for r in encoded.collect()) == Counter((k, np.array(ids(t), "<u4").tobytes()) for k, t in rows)
    got = Counter(map(tuple, count_tokens(odd, FILE, limit=300).collect()))
    assert got == Counter((k, len((t or "").encode()), len(ids(t)), len(ids(t)) > 300) for k, t in rows)
    assert decode(encode(none, FILE), FILE).collect() == [] and count_tokens(none, FILE).collect() == []


def test_both_merges_agree(vocabulary):
    draw = random.Random(3)
    for _ in range(500):
        word = "".join(draw.choice("aeinrstho") for _ in range(draw.randint(1, 40)))
        symbols = merge_short(word, vocabulary.ranks)
        assert symbols == merge(word, vocabulary.ranks)
        assert len(symbols) == len(word) - linked(word, vocabulary.ranks)[1]


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        Vocabulary.load(path("byte_bpe_50k.json"))
