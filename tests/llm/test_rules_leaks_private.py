"""Quality rules, benchmark leaks and personal data."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.llm import contamination, personal_data, quality_rules
from riffle.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), QUERIES[name], ORACLES[name], SF) == ""


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(spark):
    for name in ("op4_quality_rules", "op10_personal_data"):
        text = plan(QUERIES[name](spark, SF))
        assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


def test_rules_of_odd_rows(odd, none):
    found = quality_rules.judge(odd)
    assert found.count() == odd.count() and set(odd.columns) < set(found.columns)
    for r in found.collect():
        text = r.text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        again = {i + k for i in range(len(words) - 2) for k in range(3) if seen[tuple(words[i:i + 3])] > 1}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(again))
        assert r.n_symbols == sum(x in "#*$%&|<>" for x in text)
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(none).collect() == []


def test_cascade_asks_cheap_and_strict_rules_first(spark):
    rows = spark.range(2000).select((F.col("id") % 10).alias("a"))
    slow = F.aggregate(F.sequence(F.lit(1), F.lit(2000)), F.lit(0), lambda s, x: s + x) + F.col("a") > 2001000 + 4
    out = quality_rules.cascade(rows, {"slow": slow, "never": F.col("a") > 99, "cheap": F.col("a") > 4}, rows)
    assert {r[0] for r in out.where("rejected_by IS NOT NULL").select("rejected_by").distinct().collect()} == {"cheap"}
    assert out.where("rejected_by IS NULL").count() == 1000
    assert quality_rules.cascade(rows, {}, rows).where("rejected_by IS NULL").count() == 2000


def brute_tiles(item, text, least):
    free = [True] * len(item), [True] * len(text)
    total = 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and free[0][i + n] and free[1][j + n] and item[i + n] == text[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return total
        free[0][i:i + n] = free[1][j:j + n] = [False] * n
        total += n


def test_tiles_equal_greedy_marking():
    draw = random.Random(3)
    for turn in range(200):
        item = [draw.randint(0, 4) for _ in range(draw.randint(1, 20))]
        text = [draw.randint(0, 4) for _ in range(draw.randint(1, 40))]
        if turn % 2:
            text = text[:5] + item[len(item) // 2:] + text[5:9] + item[:len(item) // 2]
        hashes = [np.array(x, np.uint64) + np.uint64(99) for x in (item, text)]
        assert contamination.tiled(*hashes, 3) == brute_tiles(item, text, 3)


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_leaks(spark, odd, none, monkeypatch, block):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block)
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, a), (2, "Two words"), (3, ""), (4, None), (None, "nu xi omicron pi rho sigma"), (6, a)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, f"x y {a.upper()} z"), (2, "theta iota kappa lambda mu, and then: alpha beta gamma delta epsilon"), (3, "alpha beta gamma delta"), (4, "these TWO words"),
             (5, None), (6, ""), (7, "nu xi omicron pi rho sigma")]
    got = {r.doc_id: [tuple(x) for x in r.leaks] for r in contamination.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()}
    reordered = pytest.approx(10 / 12)
    assert got == {1: [(1, 1.0), (6, 1.0)], 2: [(1, reordered), (6, reordered)], 3: [], 4: [(2, 1.0)], 5: [], 6: [], 7: [(None, 1.0)]}
    found = contamination.find_leaks(odd, benchmark)
    assert found.count() == odd.count() and found.columns == [c for c in odd.columns if c != "leaks"] + ["leaks"]
    assert contamination.find_leaks(none, benchmark).collect() == []
    assert contamination.find_leaks(odd, benchmark.where("false")).where(F.size("leaks") > 0).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out[kind].append(f"{kind}:{m.start()}:{m.end()}")
    return out


NO_SECRETS = personal_data.SpanClassifier({}, 0.5, dict.fromkeys(personal_data.FEATURES, 0.0), -1.0)


def test_base_spans(spark, odd, none):
    draw = random.Random(5)
    texts = ["".join(draw.choice("0123456789.@+-() abZ_%\U0001f600é,=") for _ in range(draw.randint(0, 120))) for _ in range(1500)]
    texts += ["a@b.c%d@e.f.", "1.2.3.4.5.6.7.8", "0001.2.3.255 1.2.3.256", "5" * 4000, "a" * 30000 + "@x.y", "a.b@" * 3000, "1.2.3.4 " * 700, "1.2.3.4 " * 20_000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frame in (docs, odd.select("doc_id", "text")):
        for r in personal_data.find(frame, NO_SECRETS).select("text", *(personal_data.written(k).alias(k) for k in PATTERNS)).collect():
            assert {k: r[k] for k in PATTERNS} == brute_spans(r.text or "")
    assert personal_data.find(none, personal_data.fit(none)).collect() == []
    assert personal_data.find(odd, NO_SECRETS).count() == odd.count()


def test_labelers_and_classifier(spark):
    draw = random.Random(6)
    hexes = ["".join(draw.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [f'the token = "{x}" here' for x in hexes] + [f"see 4{draw.randrange(10**15):015d} now" for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classifier = personal_data.fit(docs)
    assert all(a > b for a, b in classifier.reliability.values()) and 0.25 < classifier.prior < 0.45
    found = {r.doc_id: [x.value for x in r.secret] for r in personal_data.find(docs, classifier).collect()}
    assert all(found[i] == [hexes[i]] for i in range(60)) and not any(found[i] for i in range(60, 180))


def test_short_credentials(spark):
    draw = random.Random(7)
    hexes = ["".join(draw.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    short = {"password = Summer2024 ok": ["Summer2024"], "pwd: hunter2.": ["hunter2"], 'the "password": "P@ssw0rd!2024", next': ["P@ssw0rd!2024"],
             "Secret='two words, x9' end": ["two words, x9"], "passwd=Tr0ub4dor&3": ["Tr0ub4dor&3"], "pwd: QWErty!": ["QWErty!"],
             "password=ab!cdefghijklmnop12345": ["ab!cdefghijklmnop12345"]}
    texts = list(short) + [f'the token = "{x}" here' for x in hexes] + [f"see 4{draw.randrange(10**15):015d} now" for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.text: [x.value for x in r.secret] for r in personal_data.find(docs, personal_data.fit(docs)).collect()}
    assert {t: found[t] for t in short} == short
    assert all(found[f'the token = "{x}" here'] == [x] for x in hexes) and not any(v for t, v in found.items() if t.startswith("see"))


def test_redaction(spark):
    rows = [(1, "mail a@b.de or c@d.fr, ip 1.2.3.4."), (2, None), (3, "none"), (4, "")]
    out = personal_data.redacted(personal_data.find(spark.createDataFrame(rows, "doc_id long, text string"), NO_SECRETS))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "mail [email] or [email], ip [ip].", 2: None, 3: "none", 4: ""}
