"""Fingerprints of documents by one-permutation MinHash, and how alike two are. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.llm.common import keyed
from riffle.llm.quality_rules import let
from riffle.session import BROADCAST_ROWS, materialize

#: Words of a shingle, bins, low-order bits kept of each bin, and bins in one packed number.
SHINGLE, BINS, BITS = 5, 128, 8
PACKED = 64 // BITS
#: A hash has 62 bits: its bin, then its value. A value of ones only stands for an empty bin.
VALUE_BITS = 62 - (BINS - 1).bit_length()
VALUE = (1 << VALUE_BITS) - 1
LOW = (1 << BITS) - 1
SPACE, BLANKS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
#: Consecutive keys that are looked through together for the next document: 2 to this power.
BUCKET_BITS = 9


def bin_of(hashed: Column) -> Column:
    return F.shiftright(hashed, VALUE_BITS)


def shingle_hashes(text: Column) -> Column:
    """A 62-bit hash of each run of five words; of all words together if there are fewer; none without a word.

    Words are runs without space and tab to carriage return, in lower case.
    """
    def runs(words: Column) -> Column:
        five = lambda x, i: F.xxhash64(x, *(F.get(words, i + j) for j in range(1, SHINGLE)))
        return F.when(F.size(words) < SHINGLE, F.array(F.xxhash64(words))).otherwise(
            F.transform(F.slice(words, F.lit(1), F.size(words) - (SHINGLE - 1)), five))

    def hashed(bare: Column) -> Column:
        words = F.transform(F.split(bare, SPACE), lambda x: F.xxhash64(x))
        return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(let(words, runs))

    found = let(F.btrim(F.lower(text), F.lit(BLANKS)), hashed)
    return F.transform(found, lambda x: F.shiftrightunsigned(x, 2))


def fingerprint(text: Column) -> Column:
    """``BINS`` numbers of ``BITS`` bits in packed longs; no number for a text without words. Null is no text.

    All shingles are hashed once. The top bits of a hash name its bin, and a bin keeps its smallest hash. An empty bin
    takes the one of the first non-empty bin in an order of the bins of its own, drawn by hashing the two bins: so two
    texts agree in it as often as in a full bin, and no bin lends more than others. Only low-order bits are kept.
    """
    empty = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint")), lambda k: F.shiftleft(k, VALUE_BITS).bitwiseOR(F.lit(VALUE)))

    # In the order of the hashes the first of each bin is its least; the marks of emptiness come last in their bins.
    def least(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1))))

    def filled(bins: Column) -> Column:
        is_full = lambda x: x.bitwiseAND(F.lit(VALUE)) != VALUE

        def borrowed(full: Column) -> Column:
            lent = lambda x: F.array_min(F.transform(full, lambda y: F.xxhash64(bin_of(x), bin_of(y)).bitwiseAND(F.lit(~LOW)).bitwiseOR(y.bitwiseAND(F.lit(LOW)))))
            return F.transform(bins, lambda x: F.when(is_full(x), x).otherwise(lent(x)).bitwiseAND(F.lit(LOW)))

        return let(F.filter(bins, is_full), borrowed)

    def packed(low: Column) -> Column:
        def word(j: Column) -> Column:
            out = F.get(low, j * PACKED)
            for i in range(1, PACKED):
                out = out.bitwiseOR(F.shiftleft(F.get(low, j * PACKED + i), BITS * i))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PACKED - 1)), word)

    def made(hashes: Column) -> Column:
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(
            let(let(let(F.sort_array(F.concat(hashes, empty)), least), filled), packed))

    return let(shingle_hashes(F.coalesce(text, F.lit(""))), made)


def written(packed: Column) -> Column:
    """A fingerprint in hexadecimal digits; empty for a text without words."""
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity (0 to 1) of the shingle sets behind two fingerprints.

    Different values agree in their low-order bits once in 2 ** BITS, which is taken back out of the share of bins
    that agree. The standard error is at most 0.045. Two texts without words are alike (1), one without is not (0).
    """
    def agreeing(x: Column) -> Column:
        """Bytes that are zero: the bits of the others are brought together in their lowest one, and counted."""
        for step, byte in ((4, 0x0F), (2, 0x03), (1, 0x01)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step)).bitwiseAND(F.lit(int.from_bytes(bytes([byte]) * 8, "little")))
        return PACKED - F.bit_count(x)

    same = F.aggregate(F.zip_with(a, b, lambda x, y: agreeing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 1 / 2**BITS
    found = F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(found)


def before_each(heads: DataFrame) -> DataFrame:
    """Adds ``before`` to a table with one row for each ``bucket``: the next smaller bucket, for the least the greatest.

    Buckets are ranged over the tasks; only the last one of each range is looked at together.
    """
    ranged = materialize(heads.repartitionByRange("bucket").withColumn("range", F.spark_partition_id()), "buckets")
    ends = ranged.groupBy("range").agg(F.max("bucket").alias("last"))
    ends = ends.select("range", F.coalesce(F.lag("last").over(Window.orderBy("range")), F.max("last").over(Window.partitionBy(F.lit(0)))).alias("end"))
    inside = F.lag("bucket").over(Window.partitionBy("range").orderBy("bucket"))
    rows = ranged.withColumn("inside", inside).join(F.broadcast(ends), "range")  # one row for each shuffle partition
    return rows.select(*heads.columns, F.coalesce("inside", "end").alias("before"))


def with_next(docs: DataFrame, *columns: tuple[str, Column]) -> DataFrame:
    """(``doc_id``, ``text``, ``next_text``, and each of ``columns`` (name, value) with its ``next_`` one) of every row.

    The next row is that of the next larger ``doc_id`` (null is least, rows with equal ones in the order of their
    texts), for the last row the first; a single row follows itself. Rows are cut into buckets of consecutive keys, and
    each bucket gets a copy of the row that follows its last one, so that no order of all rows is needed in one task.
    """
    rows = keyed(docs)
    bucket = F.shiftright("key", BUCKET_BITS)

    def opening(rows: DataFrame) -> DataFrame:
        return materialize(rows.groupBy(bucket.alias("bucket")).agg(F.min("key").alias("key"), F.count("*").alias("n")), "heads")

    heads = opening(rows)
    count, total = heads.agg(F.count("*"), F.sum("n")).first()
    if count > 1 + ((total or 0) >> (BUCKET_BITS - 4)):  # ids far apart: number the rows, so that buckets are full
        ranged = rows.withColumnRenamed("key", "_id").repartitionByRange("_id").sortWithinPartitions("_id")
        rows = materialize(ranged.drop("_id").withColumn("key", F.monotonically_increasing_id()), "numbered")
        heads = opening(rows)
        count = heads.count()
    follows = before_each(heads).select("key", F.col("before").alias("bucket"))
    copies = rows.join(F.broadcast(follows) if count <= BROADCAST_ROWS else follows, "key")
    every = rows.withColumn("bucket", bucket).withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    every = every.select("doc_id", "text", "key", "bucket", "copy", *(value.alias(name) for name, value in columns))
    order = Window.partitionBy("bucket").orderBy("copy", "key")
    names = ["text", *(name for name, _ in columns)]
    return every.withColumns({f"next_{x}": F.lead(x).over(order) for x in names}).where(~F.col("copy")).drop("key", "bucket", "copy")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of an edited form of it, and their likeness to each other and to the next text's.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    text. Returns (``doc_id``, ``n_chars``, ``edited_text``, ``fingerprint``, ``edited_fingerprint`` (hexadecimal),
    ``near_edited``, ``near_next``) for every row of ``docs``.

    A null text is empty; a text without words has an empty fingerprint, which is like another empty one only. A text
    of fewer than five words is one shingle. Equal texts have equal fingerprints, repeated rows too. A very long text is
    fingerprinted whole: its word hashes are an array in memory, about 60 bytes a word. The next text of the last row is
    the first's; see :func:`with_next` for null and repeated ids. Other columns are ignored; an empty table gives an
    empty result.
    """
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ("packed", fingerprint(F.col("text"))))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited_text", F.concat(F.left("text", F.length("text") - half), F.left("next_text", half)))
    rows = rows.withColumn("edited", fingerprint(F.col("edited_text")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "edited_text", written(F.col("packed")).alias("fingerprint"),
        written(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("packed"), F.col("edited")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"))
