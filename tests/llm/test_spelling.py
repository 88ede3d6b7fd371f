"""Spelling variants against a brute-force comparison of all words."""

import random
import re
from collections import Counter
from zlib import crc32

from riffle.llm import spelling_variants as sv


def edits(word, letters):
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def plain(counts, ratio=5):
    letters = {c for w in counts for c in w}
    near = {w: edits(w, letters) & counts.keys() for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w] and counts[best] > counts[w]:
            form[w] = best
    out = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return out


def vocabulary(draw, n):
    """Words of a small alphabet with common beginnings and endings, and edited copies of them."""
    ends, words = ["ation", "ing", "ness", "ment", "é"], {}
    while len(words) < n:
        word = "".join(draw.choice("abcdé") for _ in range(draw.randint(3, 7))) + draw.choice(ends) + draw.choice(["", "s", "ed"])
        words[word] = draw.choice([5, 6, 25, 30, 200, 5000])
        for other in draw.sample(sorted(edits(word, "abx")), 3):
            words[other] = draw.choice([5, 25, 125, 5000])
    return {w: c for w, c in words.items() if len(w) >= 6}


def test_variants(spark):
    counts = vocabulary(random.Random(5), 2500)
    got = sv.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == plain(counts)


def test_every_near_word_shares_a_list(spark):
    draw = random.Random(6)
    counts = vocabulary(draw, 1500)
    held, extended = sv.gram_dictionary(spark.createDataFrame([(w,) for w in counts], "word string"))
    assert any(len(g) == 4 for g in held)
    for word in draw.sample(sorted(counts), 400):
        mine = {x[:2] for x in sv.lists_of(word, held, extended)}
        for other in edits(word, "abcdént"):
            if len(other) >= 6:
                theirs = {x[:2] for x in sv.lists_of(other, held, extended)}
                assert any(g == h and abs(p - q) <= 1 for g, p in mine for h, q in theirs)


def test_words_of_texts(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, "Überraschung überraschung ÉCOLE×s école abcdefG " * 3) for i in range(60)]
    want = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 7 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            want[run] += len(run) >= 6
    got = sv.count_words(spark.createDataFrame(rows, "doc_id long, text string"), misspelt=7)
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if n >= 5}


def test_odd_words(spark, none):
    rows = [("aaaaaaa", 5, 1), ("aaaaaaa", 5, 1), ("aaaaaab", 60, 1), (None, 9, 1), ("short", 9, 1), ("bbbbbbb", None, 1), ("q" * 5000, 7, 1), ("q" * 4999 + "r", 40, 1)]
    got = sv.group_variants(spark.createDataFrame(rows, "word string, n long, list int")).collect()
    assert {tuple(r) for r in got} == plain({"aaaaaaa": 10, "aaaaaab": 60, "bbbbbbb": 0, "q" * 5000: 7, "q" * 4999 + "r": 40})
    assert sv.group_variants(sv.count_words(none)).collect() == []
