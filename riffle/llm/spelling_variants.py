"""Spelling variants of words: near words by an index of variable-length grams, and the form each word stands for."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import parts
from riffle.session import materialize, release

#: Letters of a gram. A word of both together or more shares a gram with every word that one edit makes of it.
SHORTEST, LONGEST = 2, 4
#: A gram is extended if it has more than 1/EXTENDED of all gram places; a gram with less than 1/RARE of that is not held.
EXTENDED, RARE = 1_000, 64
#: Different words that a task counts together before it hands them on.
COUNTED = 300_000
LETTERS = "a-zÀ-ÿ"


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, misspelt: int | None = None) -> DataFrame:
    """(``word``, ``n``): maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, over whole texts.

    Only words of at least ``least_length`` letters found ``least_count`` times or more. ``misspelt`` spoils about one
    run in that many before it is counted, always the same in the same document: if it divides the crc32 of
    ``<doc_id>:<run>``, the letter at crc32 modulo length is deleted (a null ``doc_id`` is written ``null``).

    Null and empty texts have no words; rows repeated count again; other columns are ignored; an empty table gives an
    empty result. Each task counts for itself and sums meet in one shuffle. A very long text is one string in memory.
    """
    run = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in parts(found):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                # In bytes only A-Z have a lower case.
                opened = crc32(f"{'null' if doc is None else doc}:".encode())
                for word, n in Counter(run.findall(text.encode().lower().decode())).items():
                    if misspelt:
                        h = crc32(word.encode(), opened)
                        if h % misspelt == 0:
                            word = word[:h % len(word)] + word[h % len(word) + 1:]
                    if len(word) >= least_length:
                        total[word] += n
            if len(total) > COUNTED:
                yield counted()
                total.clear()
        yield counted()

    words = docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(batches, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def gram_dictionary(words: DataFrame) -> tuple[dict[str, int], set[str]]:
    """The grams that words are cut into, with their frequencies, and those of them that are extended.

    Grams are counted over the distinct words, from the shortest on. Only a frequent gram is extended by a letter, and
    grams that are rare by far are left out: a word then falls back on a shorter one. So a list of the index is never
    long for want of a longer gram, and each length has at most ``EXTENDED * RARE`` entries, however many words.
    """
    def grams(size: int) -> DataFrame:
        at = F.explode(F.sequence(F.lit(1), F.length("word") - size + 1))
        return words.where(F.length("word") >= size).select("word", at.alias("at")).select(F.substring("word", F.col("at"), F.lit(size)).alias("gram"))

    places = words.agg(F.sum(F.length("word") - SHORTEST + 1)).first()[0] or 0
    hot, held, extended = max(places // EXTENDED, 1), {}, set()
    for size in range(SHORTEST, LONGEST + 1):
        every = grams(size)
        if size > SHORTEST:
            longer = words.sparkSession.createDataFrame([(g,) for g in sorted(extended) if len(g) == size - 1], "head string")
            # At most EXTENDED heads.
            every = every.withColumn("head", F.left("gram", F.lit(size - 1))).join(F.broadcast(longer), "head").select("gram")
        found = every.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") * RARE > hot).collect()
        held.update((r.gram, r.n) for r in found)
        extended.update(r.gram for r in found if r.n > hot and size < LONGEST)
    return held, extended


def cut(word: str, held: dict[str, int], extended: set[str]) -> list[tuple[str, int, int]]:
    """(gram, start, last place looked at) for each start: the longest gram that can be reached letter by letter.

    The place behind the word counts as looked at where the word ended before the gram could be extended.
    """
    out, n = [], len(word)
    for start in range(n - SHORTEST + 1):
        gram, last = word[start:start + SHORTEST], start + SHORTEST - 1
        while gram in extended:
            last = start + len(gram)
            longer = word[start:last + 1]
            if last >= n or longer not in held:
                break
            gram = longer
        out.append((gram, start, last))
    return out


def affected(grams: list[tuple[str, int, int]], length: int) -> int:
    """The most grams that one edit can change: those that looked at its place, which may be the one behind the word."""
    change = [0] * (length + 2)
    for _, start, last in grams:
        change[start] += 1
        change[last + 1] -= 1
    return max(accumulate(change))


def lists_of(word: str, held: dict[str, int], extended: set[str]) -> list[tuple[str, int, int]]:
    """The grams whose lists have to be read for a word: its rarest ones, one more than an edit can affect.

    A near word keeps all grams but those affected, as seen from either word. Of the grams kept, the first one in an
    order that all words share is then among these of both words.
    """
    grams = cut(word, held, extended)
    grams.sort(key=lambda x: (held.get(x[0], 0), x[0], x[1]))
    return grams[:affected(grams, len(word)) + 1]


def near_pairs(words: DataFrame) -> DataFrame:
    """(``a``, ``n_a``, ``b``, ``n_b``), once for each two words of ``words`` (``word``, ``n``) one edit apart, in either order.

    The edit lies behind a shared gram or before it, so its list is cut further by the part of the word up to its end,
    or from its start, which both words have; and by the lengths of the two words. What meets in a list is verified.
    """
    dictionary = words.sparkSession.sparkContext.broadcast(gram_dictionary(words))
    shape = ["word", "n", "part", "at", "size", "role"]

    def listed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, extended = dictionary.value
        for batch in found:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                size = len(word)
                for gram, start, _ in lists_of(word, held, extended):
                    for part, at in ((word[:start + len(gram)], start), (word[start:], -1)):
                        # With words as long, longer by one (role 1), and shorter by one (role 2).
                        rows += (word, n, part, at, 2 * size, 0), (word, n, part, at, 2 * size + 1, 1), (word, n, part, at, 2 * size - 1, 2)
                if len(rows) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], shape)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], shape)

    lists = words.where(F.length("word") >= SHORTEST + LONGEST).mapInArrow(listed, "word string, n long, part string, at long, size long, role long")
    lists = lists.select("word", "n", "role", F.xxhash64("part", "at", "size").alias("list"))
    lists = materialize(lists.repartition("list"), "lists")
    one = lists.where("role < 2").select("list", F.col("word").alias("a"), F.col("n").alias("n_a"), "role")
    two = lists.where("role <> 1").select("list", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("role").alias("role_b"))
    met = one.join(two, "list").where("(role = 0 AND role_b = 0 AND a < b) OR (role = 1 AND role_b = 2)")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``): where the forms of ``forms`` (``word``, ``form``) lead in the end. Steps double."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        if not roots.join(above, "root", "left_semi").limit(1).count():
            return roots
        further = materialize(roots.join(above, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "roots")
        release(roots)
        roots = further


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """The near words of each of ``words`` (``word``, ``n``), and the form it is a variant of.

    Two words are near if they differ by one inserted, deleted or replaced code point. The ``form`` of a word is its near
    word of the largest ``n`` (of equal ones the first in the order of code points), if that ``n`` is at least ``ratio``
    times its own; ``root`` follows forms to the last, and is the word itself without one. Returns (``word``, ``form``,
    ``root``, ``n``, ``n_near``, ``form_n``). Forms always grow in ``n``, so they never lead back.

    Rows with the same word are added up, null words and words of fewer than 6 code points are left out, a null ``n`` is
    0, other columns are ignored, and an empty table gives an empty result. The length of a word has no limit.
    """
    given = words.where(F.length("word") >= SHORTEST + LONGEST)
    words = materialize(given.groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")), "words")
    pairs = materialize(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), "n_a", F.col("b").alias("near"), F.col("n_b").alias("n_near_word")).union(
        pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy("word", F.col("n_a").alias("n")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_near_word")).alias("less"), "near")).alias("best"))
    stands = (-F.col("best.less") >= ratio * F.col("n")) & (-F.col("best.less") > F.col("n"))
    best = materialize(best.select("word", "n_near", F.when(stands, F.col("best.near")).alias("form"), F.when(stands, -F.col("best.less")).alias("form_n")), "forms")
    roots = last_forms(best.where("form IS NOT NULL"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
