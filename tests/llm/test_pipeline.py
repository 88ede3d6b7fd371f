"""The pipeline stage by stage: each on what the one before it kept."""

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_duplicates import brute_components, pairs
from tests.llm.test_rules_leaks_private import brute_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "PII", "BPE encoding and decoding"]
    docs, steps = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        steps.append(docs)
        assert i == 4 or docs.columns == corpus_pipeline.COLUMNS
    good, first, clean, private, tokens = steps
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert np.mean([(k in kept) == bool(q) for k, q in labels.items()]) > 0.95
    want = {row[0] for row in brute_components(pairs(good), 80) if row[3]}
    assert {r.doc_id for r in first.collect()} == want
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in first.collect() if not any(x in r.text for x in items)}
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in private.collect():
        assert not any(brute_spans(r.text).values()) and r.n_chars == len(r.text)
        if not any(brute_spans(before[r.doc_id]).values()) and "token" not in before[r.doc_id] and "password" not in before[r.doc_id] and "AKIA" not in before[r.doc_id]:
            assert r.text == before[r.doc_id]
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in private.collect()}
    for r in tokens.collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert tokens.count() == private.count()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded"] and out.count() > 100
