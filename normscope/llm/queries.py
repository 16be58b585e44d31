"""The dealt operators' queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .oracle import ORACLES  # noqa: F401

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sentence_pieces

    docs = base.documents(spark, sf_dir, "doc_id", "text")
    coded = sentence_pieces.encode(docs, "doc_id", "text", base.tokenizer_path(PIECES))
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.array_join(F.col("ends").cast("array<string>"), " "), 256).alias("ends_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    docs = base.documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged, _ = quality_rules.judge(docs, labels)
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = base.documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    profiles = language_id.learn(docs.where(~F.col("held_out")), "doc_id", "text", "lang")
    found = language_id.identify(docs, profiles, "doc_id", "text")
    return found.withColumnRenamed("id", "doc_id").withColumn("held_out", language_id.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    docs = base.documents(spark, sf_dir, "doc_id", "text", "source")
    return mixing.mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.detect(base.documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    fixed = F.filter("spans", lambda s: ~s["added"])
    of = lambda kind: F.filter(fixed, lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(joined(fixed), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), F.size(F.filter(fixed, lambda s: s["confirmed"])).cast("long").alias("n_confirmed"),
        joined(F.col("network")).alias("network_spans"), F.round("score", 3).alias("network_score"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.join(base.documents(spark, sf_dir, "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged, _ = url_filter.judge(pages)
    return judged.withColumnRenamed("id", "page_id")


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import matroska

    docs = base.documents(spark, sf_dir, "doc_id", "text")
    media = base.stored(matroska.to_media(docs, "doc_id", "text"), "media")
    return matroska.read_media(media).withColumnRenamed("id", "doc_id")


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import wavelet

    docs = base.documents(spark, sf_dir, "doc_id", "text")
    return wavelet.store_and_read(docs, "doc_id", "text", base.tokenizer_path(BYTES))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import TokenCountCache

    docs = base.documents(spark, sf_dir, "doc_id", "text")
    cache = TokenCountCache(spark, base.shared_path(spark, "token-counts"), base.tokenizer_path(BYTES))
    return cache.count(docs, "doc_id", "text").select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit")
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    found = line_dedup.dedup(base.documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periodic_runs

    docs = base.documents(spark, sf_dir, "doc_id", "text")
    docs = docs.withColumn("text", periodic_runs.planted(F.col("doc_id"), F.col("text")))
    found = periodic_runs.detect(docs, "doc_id", "text").withColumn("best", periodic_runs.longest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vector_codes

    found, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    digest = F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256")
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's counts and base verdict, which SQL can state."""
    from . import quality_rules

    counted = quality_rules.statistics(base.documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text").withColumn("base_failed", quality_rules.base_failed())
    return counted.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's sizes and targets, and the words that each source misses its target by, in sizes of its largest document."""
    mixed = op4_mixing(spark, sf_dir).join(base.documents(spark, sf_dir, "doc_id", "source"), "doc_id")
    near = F.abs(F.sum("taken") - F.first("target")) <= F.max("size")
    return mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), near.alias("is_near"), (F.max(F.col("taken") - 2 * F.col("size")) <= 0).alias("is_bounded"))


def media_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's sizes, which SQL can state."""
    return op8_matroska(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes")


QUERIES = {f.__name__: f for f in (
    op1_sentence_pieces, op2_quality_rules, op3_language_id, op4_mixing, op5_pii, op6_ngram_join, op7_url_filter, op8_matroska, op9_wavelet, op10_token_counts,
    op11_line_dedup, op12_periodic_runs, op13_vector_codes,
    quality_base, mixing_targets, media_sizes,
)}
