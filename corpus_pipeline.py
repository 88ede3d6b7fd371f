"""A cleaning pipeline for training text: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes the rows that the one before it kept and returns the columns of ``documents``; the last returns the
token ids of each text and the text that they decode to.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.llm import contamination, near_duplicates, personal_data, quality_model, rank_array
from riffle.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
GOOD, WORDS = 0.7, "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier scores 0.7 or more."""
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.score(docs.select(*COLUMNS), model).where(F.col("quality_score") >= GOOD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near duplicates, similarity 0.8 or more."""
    return near_duplicates.keep_first(docs.select(*COLUMNS), size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    found = contamination.find_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind in brackets; ``n_chars`` follows the text."""
    docs = docs.select(*COLUMNS)
    out = personal_data.redacted(personal_data.find(docs, personal_data.fit(docs)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian unsigned 32-bit integers) and what they decode to."""
    out = rank_array.decode(rank_array.encode(docs.select(*COLUMNS), path(WORDS)), path(WORDS))
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("BPE encoding and decoding", tokenize),
]

#: Models and shingle joins with connected components have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
