"""The operators of this subpackage on the test tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import PATTERN, path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.llm import contamination, earlier_copies, fingerprints, heap_merges, language_filters, near_duplicates, personal_data, quality_model, quality_rules, rank_array, repeated_windows, spelling_variants, token_alignment

WORDS = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op7_substring_dedup", """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n FROM s),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM g WHERE n > 1),
    per AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
        sha256(coalesce(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF gone IS NULL OR NOT list_contains(gone, i)], ' '), '')) AS kept_sha256
    FROM d LEFT JOIN per USING (doc_id)""")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_windows.remove_repeated(documents(spark, sf_dir), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_suffix_array_dedup")
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = earlier_copies.remove_earlier(documents(spark, sf_dir), window=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_minhash_near_dedup", """
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 85 * (na.n + nb.n - m)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
    FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""")
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.label_near_duplicates(documents(spark, sf_dir), size=5, percent=85)


@query("op6_bpe_round_trip")
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = rank_array.encode(documents(spark, sf_dir).select("doc_id", "text"), path(WORDS)).drop("text")
    out = rank_array.decode(encoded, path(WORDS))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_merges.count_tokens(documents(spark, sf_dir), path(WORDS), limit=2048)


@query("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_leaks(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.col("leaks.item_id").alias("item_ids"),
                        F.coalesce(F.try_element_at("leaks", F.lit(1)).coverage, F.lit(0.0)).alias("coverage"))


def fold(parts: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(4) != 2)
    scored = quality_model.score(docs, quality_model.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    filters = language_filters.fit(docs.where(fold(3) != 1).select("text", "lang"))
    found = language_filters.predict(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op4_quality_rules", """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
    s AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM s),
    r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM g WHERE n > 1) GROUP BY doc_id),
    c AS (SELECT d.doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
          FROM d LEFT JOIN r USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(word_chars, 1) AS chars FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT (base_failed OR n_symbols > 0.2 * n_words OR n_dup_lines > 0.5 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
             OR length(regexp_replace(text, '[^A-Z]', '', 'g')) / chars > 0.4 OR length(regexp_replace(text, '[^!]', '', 'g')) / chars > 0.1
             OR length(regexp_replace(text, '[^0-9]', '', 'g')) / chars > 0.4) AS kept
    FROM b""")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = personal_data.find(docs, personal_data.fit(docs))
    kinds = list(personal_data.PATTERNS)
    base = F.concat(*map(personal_data.written, kinds))
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, personal_data.written("secret")), ",").alias("spans"), F.size("secret").cast("long").alias("n_secret"))


@query("op11_document_fingerprints")
def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_edited(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(spelling_variants.count_words(documents(spark, sf_dir), misspelt=199))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = token_alignment.Tokenizers.load(path("byte_bpe_50k.json"), PATTERN, path("piece_bpe_32k.model"))
    return token_alignment.count_links(documents(spark, sf_dir).select("doc_id", "text"), tokenizers)
