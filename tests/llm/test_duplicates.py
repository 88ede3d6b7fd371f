"""Duplicate operators against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from riffle.llm import earlier_copies, near_duplicates, repeated_windows
from riffle.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_order(rows):
    """Rows in the order of (doc_id, null first; text)."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def brute_earlier(rows, width):
    seen, out = set(), []
    for key, text in in_order(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if data[i:i + width] in seen:
                gone[i:i + width] = b"\1" * width
            else:
                seen.add(data[i:i + width])
        spans = sum(1 for i in range(len(data)) if gone[i] and (not i or not gone[i - 1]))
        out.append((key, len(data), sum(gone), spans, bytes(x for x, y in zip(data, gone) if not y)))
    return out


@pytest.mark.parametrize("segments, longer", [(8000, ()), (3, ()), (2, (25, 33))])
def test_earlier_copies(odd, none, monkeypatch, segments, longer):
    monkeypatch.setattr(earlier_copies, "INDEX_SEGMENTS", segments)
    monkeypatch.setattr(earlier_copies, "GRAMS", (20, *longer))
    monkeypatch.setattr(earlier_copies, "PIECE", 5_000)  # the very long text comes in many pieces
    got = [(*tuple(r)[:4], bytes(r.kept)) for r in earlier_copies.remove_earlier(odd, 40).collect()]
    assert Counter(got) == Counter(brute_earlier(pairs(odd), 40))
    if segments == 3:
        assert earlier_copies.remove_earlier(none).collect() == []


def test_anchor_with_many_segments(spark, monkeypatch):
    """Texts that share a passage of 60 bytes in different surroundings, some twice: the anchor is split, whole windows at last."""
    monkeypatch.setattr(earlier_copies, "INDEX_SEGMENTS", 20)
    draw, shared = random.Random(3), "the very same words stand in each of these many texts, always"
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(50)) + shared + "".join(draw.choice("abcdefgh ") for _ in range(50)) for _ in range(150)]
    texts += [t[10:] + "x" for t in texts[::3]] + ["y" + t for t in texts[::5]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(*tuple(r)[:4], bytes(r.kept)) for r in earlier_copies.remove_earlier(rows).collect()]
    assert Counter(got) == Counter(brute_earlier(pairs(rows), 100))
    assert sum(r[2] for r in got) > 0


def test_earlier_copies_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [(*tuple(r)[:4], bytes(r.kept)) for r in earlier_copies.remove_earlier(docs).collect()]
    assert Counter(got) == Counter(brute_earlier(pairs(docs), 100))


def test_repeated_windows(odd, none):
    words = [(k, WORD.findall(t or "")) for k, t in pairs(odd)]
    count = Counter(tuple(w[i:i + 20]) for _, w in words for i in range(len(w) - 19))
    want = Counter()
    for key, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if count[tuple(w[i:i + 20])] > 1:
                gone[i:i + 20] = [True] * 20
        want[(key, len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y))] += 1
    assert Counter(map(tuple, repeated_windows.remove_repeated(odd, 20).collect())) == want
    assert repeated_windows.remove_repeated(none).collect() == []


def brute_components(rows, percent):
    rows = in_order(rows)
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holds = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)
    shared = Counter((a, b) for v in holds.values() for b in v for a in v if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return Counter((rows[i][0], len(sets[i]), rows[top(i)][0], top(i) == i) for i in range(len(rows)))


def test_near_duplicates(odd, none):
    assert Counter(map(tuple, near_duplicates.label_near_duplicates(odd).collect())) == brute_components(pairs(odd), 85)
    assert near_duplicates.label_near_duplicates(none).collect() == []


def test_near_duplicates_in_chains_and_blocks(spark, monkeypatch):
    """Texts that differ from the next by one word only reach each other through the others."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    rows = [(1000 * g + i, " ".join(f"w{g}x{j if j >= i else j + 500}" for j in range(120))) for g in range(2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, near_duplicates.label_near_duplicates(docs).collect())) == brute_components(rows, 85)


def test_keep_first_keeps_columns(odd):
    kept = near_duplicates.keep_first(odd, percent=85)
    assert kept.columns == odd.columns
    want = sum(n for row, n in brute_components(pairs(odd), 85).items() if row[3])
    assert kept.count() == want


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 30)] + [(3, 3)]
    got = {r.key: r.least for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(7, 30), 7)}
