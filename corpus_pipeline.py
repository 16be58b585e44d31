"""The corpus pipeline: documents to token ids, in five stages that each apply one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of ``documents``.

Edge cases: null and empty texts fail the quality rules and go; texts of any length pass through whole; repeated ids
stay apart by their texts; of wholly equal rows the second stage keeps one; null ids, sources and other nulls stay
as they are; columns beside those of ``documents`` pass through the first four stages, whatever their names;
empty tables give empty ones; ties are settled as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normscope.llm import base, mixing, ngram_join, pii, quality_rules, sentence_pieces


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data redacted, and their new lengths."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.taken(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, the source byte after each, and a digest of the decoded text."""
    coded = sentence_pieces.encode(docs, "doc_id", "text", base.tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "ends", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixed", mixed),
    ("tokens", tokens),
]

#: No SQL states the learned list, the sampled paths, the network and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = base.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        base.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
