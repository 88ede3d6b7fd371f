import random

import numpy as np

from riffle.llm.run_index import RunIndex


def test_first_of_long():
    draw = random.Random(1)
    for turn in range(120):
        segments = [bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 60))) for _ in range(draw.randint(1, 12))]
        if turn % 3 == 0:
            segments = [b"a" * draw.randint(1, 40) for _ in segments]
        index = RunIndex.build(np.frombuffer(b"".join(segments), np.uint8), np.array([len(s) for s in segments]))
        for width in (2, 6):
            got, seen, at = index.first_of_long(width), {}, 0
            for s in segments:
                for i in range(len(s)):
                    want = seen.setdefault(s[i:i + width], at + i) if i + width <= len(s) else at + i
                    assert got[at + i] == want
                at += len(s)


def test_repetitive_text_has_few_runs():
    data = np.frombuffer((b"abcdefghij" * 30) * 2, np.uint8)
    index = RunIndex.build(data, np.array([300, 300]))
    assert index.runs < 60 and len(index.place) < 60


def test_matching_statistics_stream_in_pieces(monkeypatch):
    from riffle.llm import run_index

    data, lengths = np.frombuffer(b"banana$bananas", np.uint8), np.array([7, 7])
    whole = [x.tolist() for x in RunIndex.build(data, lengths).matching_statistics().__next__()[1:]]
    monkeypatch.setattr(run_index, "STREAM", 3)
    parts = list(RunIndex.build(data, lengths).matching_statistics())
    assert [sum((p[i].tolist() for p in parts), []) for i in (1, 2)] == whole
