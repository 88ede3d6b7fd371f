"""Quality rules as a short-circuit cascade. DataFrame functions only."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.session import materialize, release

#: Rows on which cost and selectivity of the rules are estimated.
SAMPLE_ROWS = 2_000
SPACE, SYMBOL = r"[\x20\x09-\x0D]+", "[#*$%&|<>]+"


def unused(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds the counts that the rules are made of; columns of these names are replaced.

    ``n_words``: runs without space and tab to carriage return; ``word_chars``: their code points; ``n_symbols``:
    characters ``#*$%&|<>``; ``n_lines``: lines with a word; ``n_dup_lines``: those equal to an earlier one;
    ``n_repeat_words``: words in 3-word windows found twice or more in the text. A null text is empty: all are 0.

    Everything is worked out within the row, in time n log n of its words. Windows of one text are compared by
    64-bit hashes.
    """
    text = F.coalesce("text", F.lit(""))
    new = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, l, h = (unused(x, docs.columns) for x in ("_words", "_lines", "_hashes"))
    rows = docs.select(*kept, words.alias(w), lines.alias(l))
    hashes = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    rows = rows.select(*kept, F.size(w).cast("long").alias("n_words"), l, hashes.alias(h))

    def twice(ordered: Column) -> Column:
        """Places of the windows with an equal neighbour in the order of the hashes."""
        hit = F.filter(ordered, lambda x, k: F.get(ordered, k - 1)["h"].eqNullSafe(x["h"]) | F.get(ordered, k + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    repeat = F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(ordered, twice), covered))
    bare = F.length(F.regexp_replace(text, SPACE, ""))
    return rows.select(
        *kept, "n_words", bare.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))).cast("long").alias("n_symbols"),
        F.size(l).cast("long").alias("n_lines"), (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"))


def share(text: str, kind: str) -> Column:
    """Characters of a class, as a share of the word characters."""
    held = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{kind}]+", ""))
    return held / F.greatest("word_chars", F.lit(1))


def default_rules() -> dict[str, Column]:
    """Rules by name, each true for a text to reject; they read ``text`` and the counts of :func:`with_counts`."""
    return {
        "symbols": F.col("n_symbols") > 0.2 * F.col("n_words"),
        "same_lines": F.col("n_dup_lines") > 0.5 * F.col("n_lines"),
        "short_words": F.col("word_chars") < 2 * F.col("n_words"),
        "long_words": F.col("word_chars") > 20 * F.col("n_words"),
        "capitals": share("text", "A-Z") > 0.4,
        "exclamations": share("text", "!") > 0.1,
        "digits": share("text", "0-9") > 0.4,
    }


def first_rows(docs: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows, read from as few partitions as hold them; a limit inside a plan would read all partitions."""
    return docs.sparkSession.createDataFrame(docs.take(n), docs.schema)


def cascade(rows: DataFrame, rules: dict[str, Column], sample: DataFrame) -> DataFrame:
    """Adds ``rejected_by``: the first rule of the cascade that rejects the row, null if none does.

    Cost and selectivity of each rule are estimated on ``sample``, a small table with the columns of ``rows``: the
    time of a pass that works out this rule alone, less that of a pass without a rule, and the share it rejects. The
    rules are then asked in the order of rejection per cost, as one conditional expression, so that a row rejected
    early never pays for the rest. Which rows are rejected does not depend on the order. A rule that is null for a row
    does not reject it.
    """
    if not rules:
        return rows.withColumn("rejected_by", F.lit(None).cast("string"))
    sample = materialize(sample, "rules")
    hits = sample.agg(*(F.avg(F.coalesce(rule, F.lit(False)).cast("double")).alias(name) for name, rule in rules.items())).first()

    def seconds(*columns: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.count("*"), *(F.count_if(c) for c in columns)).collect()
        return time.perf_counter() - began

    seconds()
    empty = min(seconds(), seconds())
    cost = {name: max(seconds(rule) - empty, 1e-4) for name, rule in rules.items()}
    release(sample)
    verdict = None
    for name in sorted(rules, key=lambda x: -(hits[x] or 0) / cost[x]):
        verdict = F.when(rules[name], F.lit(name)) if verdict is None else verdict.when(rules[name], F.lit(name))
    return rows.withColumn("rejected_by", verdict)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row of ``docs``, which keeps its other columns.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows (a null or empty
    text fails). ``kept``: not failed, and rejected by no rule of the cascade. Repeated rows are judged alike; an
    empty table gives an empty result.
    """
    rows, sample = with_counts(docs), with_counts(first_rows(docs.select("text")))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return cascade(rows, default_rules(), sample).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
