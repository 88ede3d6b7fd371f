import random

import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, key long, anchor string, count int, _words int, ids int, quality int, email string, leaks int"


def sentence(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like inner ones."""
    draw = random.Random(11)
    a, b, long = sentence(draw, 90), sentence(draw, 60), sentence(draw, 60_000)
    texts = [
        (5, a), (5, a), (5, b), (1, a), (None, None), (None, a), (2, ""), (3, "  \n\t "), (4, None), (6, long), (7, b + " " + b), (8, "one two"), (8, "one two"),
        (9, "a" * 3000), (10, "é" * 400 + " " + a[:300]), (11, "\U0001f600 " * 80), (12, "x " + a + " y"), (13, a.upper()), (14, long[1000:2000]),
        (15, "\n".join([b] * 3)), (16, "mail a.b@c.example.com, call +1 (403) 555-9312; card 4495114827612972 ip 1.2.3.4"),
    ]
    rows = [(i, t, None, None, None, i, None, None, None, None, None, None, None) for i, t in texts]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
