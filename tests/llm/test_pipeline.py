"""The corpus pipeline over the smallest documents, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from normscope.llm import base, pii, queries


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(base.stored(stage(spark, out[-1], small), f"test-{name}"))
    return out


def test_stages(stages):
    docs, good, once, clean, mixed, tokens = stages
    assert all(set(s.columns) == set(docs.columns) for s in stages[1:-1])
    assert docs.count() > good.count() > once.count() == clean.count()
    assert once.select("doc_id").distinct().count() == once.count()
    assert not any(pii.pattern_spans(r["text"]) for r in clean.select("text").collect())
    assert clean.where(F.length("text") != F.col("n_chars")).count() == 0
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert tokens.count() == mixed.count() and tokens.where("n_tokens <> size(ids)").count() == 0


def test_run(spark, small, stages):
    assert corpus_pipeline.run(spark, small).count() == stages[-1].count()


def test_stages_take_empty_tables(spark, small, stages):
    for (_, stage), before in zip(corpus_pipeline.STAGES, stages, strict=False):
        assert stage(spark, before.limit(0), small).count() == 0


def test_queries_have_their_columns(spark, small):
    wanted = {
        "op1_": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op2_": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op4_": {"doc_id", "size", "source_size", "target", "taken"}, "op5_": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
        "op7_": {"page_id", "host", "path", "rule", "verdict"}, "op8_": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    }
    for name, query in queries.QUERIES.items():
        columns = wanted.get(name[:4])
        if columns:
            assert columns <= set(query(spark, small).columns)
