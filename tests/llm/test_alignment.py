"""Alignment against the tokenizers' own libraries and a plain count of all links."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from riffle.llm import token_alignment as ta
from riffle.llm.vocabulary import byte_names


@pytest.fixture(scope="module")
def tokenizers():
    return ta.Tokenizers.load(path("byte_bpe_50k.json"), PATTERN, path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def groups():
    """Groups of a text by the libraries, byte by byte."""
    first = Tokenizer.from_file(path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    value = {c: b for b, c in enumerate(byte_names())}

    def of(text):
        if not text:
            return [], [], []
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        bytes_a = [bytes(value[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return [], [], []
        ends = lambda x: [sum(map(len, x[:i + 1])) for i in range(len(x))]
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        out, last = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            out.append(([i for i, e in zip(a, ends_a) if last < e <= end], [i for i, e in zip(b, ends_b) if last < e <= end]))
            last = end
        return a, b, out

    return of


def plain(rows, groups):
    per = [(k, *groups(t)) for k, t in rows]
    counts = Counter()
    links = []
    for _, _, _, found in per:
        mine = [(x, y) for ga, gb in found for x in ga for y in gb]
        counts.update(set(mine))
        links.append(mine)
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (k, a, b, found), mine in zip(per, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)
        out.append((k, len(a), len(b), len(found), len(mine), sum(counts[p] == best[p[0]] for p in mine), sum(counts[p] for p in mine),
                    sha256(text.encode()).hexdigest() if a else ""))
    return out


def strange():
    draw = random.Random(4)
    pool = [chr(c) for c in range(0x20, 0x2600)] + ["<s>", "</s>", "<unk>", "<|endoftext|>", "▁", "  ", "\n\n", "\U0001f600", "가", "the ", "tion"]
    fixed = ["<s> a </s>", "<0x41>", "▁", " leading", "trailing ", "a  b   c", "\t\t", "x" * 2000, " " * 500, "日本語" * 30, "é" * 50, "\x00a", "<|endoftext|>"]
    return fixed + ["".join(draw.choice(pool) for _ in range(draw.randint(1, 30))) for _ in range(400)]


key = lambda r: tuple((x is not None, x) for x in r)


def test_strange_texts(spark, tokenizers, groups):
    rows = list(enumerate(strange()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ta.count_links(docs, tokenizers).collect())) == plain(rows, groups)
    for r in ta.align(docs, tokenizers).collect():
        a, b, found = groups(rows[r.doc_id][1])
        cuts = list(zip([0, *r.cut_a], r.cut_a, [0, *r.cut_b], r.cut_b))
        assert (r.a, r.b) == (a, b) and [(a[i:k], b[j:n]) for i, k, j, n in cuts] == found


def test_odd_rows(odd, none, tokenizers, groups):
    short = odd.where("text IS NULL OR length(text) < 20000")
    rows = [(r.doc_id, r.text) for r in short.collect()]
    assert sorted(map(tuple, ta.count_links(short, tokenizers).collect()), key=key) == sorted(plain(rows, groups), key=key)
    assert ta.count_links(none, tokenizers).collect() == [] and ta.align(none, tokenizers).collect() == []
    assert ta.count_links(odd, tokenizers).count() == odd.count()


def test_long_lists_in_pieces(tokenizers, monkeypatch):
    aligner = ta.Aligner(tokenizers)
    draw = random.Random(8)
    text = "".join(draw.choice(["word ", "日本", "\U0001f600" * 9, "xyzzy" * 3, "\n"]) for _ in range(3000))
    a, b = aligner.tokens(text)
    assert a and b
    whole = [x.tolist() for x in aligner.cuts(a, b)]
    monkeypatch.setattr(ta, "TOGETHER", 3)
    assert [x.tolist() for x in aligner.cuts(a, b)] == whole and [x[-1] for x in whole] == [len(a), len(b)]


def test_large_groups(monkeypatch):
    given = [np.array(x) for x in ([1, 2, 1, 3], [5, 5, 6], [0, 3, 4], [0, 2, 3])]
    want = ta.links_of(*given)
    monkeypatch.setattr(ta, "ONE_BY_ONE", 1)
    got = ta.links_of(*given)
    assert [x.tolist() for x in got] == [x.tolist() for x in want] == [[1 << 32 | 5, 2 << 32 | 5, 3 << 32 | 6], [4, 2, 1]]
