"""Fingerprints against a plain one-permutation MinHash, and their estimates against exact similarities."""

import re

import pytest
import xxhash
from pyspark.sql import functions as F

from riffle.llm import fingerprints as fp
from riffle.llm.fingerprints import BINS, BITS, VALUE_BITS


def h(data, seed=42):
    return xxhash.xxh64(data.to_bytes(8, "little") if isinstance(data, int) else data, seed=seed & (2**64 - 1)).intdigest()


def h_all(numbers):
    seed = 42
    for x in numbers:
        seed = h(x, seed)
    return seed


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain(text):
    """Bins as a dictionary; an empty bin asks the others one by one in its own order."""
    least = {}
    for s in shingles(text):
        x = h_all([h(w.encode()) for w in s]) >> 2
        k = x >> VALUE_BITS
        least[k] = min(x, least.get(k, x))
    if not least:
        return ""
    out = []
    for k in range(BINS):
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        of = k if k in least else min(least, key=lambda j: signed(h_all([k, j])) >> BITS)
        out.append(least[of] & (2**BITS - 1))
    return "".join(bytes(out[i:i + 8])[::-1].hex() for i in range(0, BINS, 8))


def test_against_plain_form(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (k, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        want.append((k, len(t), edited, plain(t), plain(edited)))
    got = [(r.doc_id, r.n_chars, r.edited_text, r.fingerprint, r.edited_fingerprint) for r in fp.compare_edited(odd).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_and_single(spark, none):
    assert fp.compare_edited(none).collect() == []
    one = spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")
    row = fp.compare_edited(one).first()
    assert row.near_next == 1.0 and row.edited_text == "a b c a b c"[:6] + "a b c"[:5]


def test_ids_far_apart(spark):
    rows = [((i * 2654435761) % (1 << 60), f"text number {i} of some that are far apart") for i in range(3000)]
    got = {r.doc_id: r.next_text for r in fp.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows)
    assert got == {k: order[(i + 1) % len(order)][1] for i, (k, _) in enumerate(order)}


def test_many_buckets(spark):
    rows = spark.range(0, 5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).where("doc_id < 600 or doc_id > 1700")
    got = {r.doc_id: int(r.next_text) for r in fp.with_next(rows).collect()}
    ids = sorted(got)
    assert got == {k: ids[(i + 1) % len(ids)] for i, k in enumerate(ids)}


@pytest.mark.parametrize("shared", [0, 30, 60, 95, 100])
def test_estimates(spark, shared):
    """Pairs of texts with a known similarity: the mean estimate is close to it."""
    rows = [(j, " ".join(f"a{j}w{i}" for i in range(200)), " ".join(f"a{j}{'w' if i < 2 * shared else 'v'}{i}" for i in range(200))) for j in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, a string, b string")
    found = docs.select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("x")).agg(F.avg("x")).first()[0]
    one, two = shingles(rows[0][1]), shingles(rows[0][2])
    assert abs(found - len(one & two) / len(one | two)) < 0.02
