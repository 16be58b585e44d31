"""Token counts through a digest cache.

A content digest (of the null-to-empty text's bytes) and a tokenizer-version digest (of its file
and library version) are joined to stored counts; only distinct misses are encoded, and appended.

Edge cases: a null text counts as empty, which has no tokens; repeated texts are encoded once and
may be any share of the rows, as each task sends one of them at most; an empty table gives an empty
one; texts of any length are encoded whole, in batches cut by bytes; there are no ties to break; other columns
are neither read nor returned; a cache that isn't there yet is an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .bpe_units import UnitEncoder, byte_level, sentence_pieces

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def version_digest(path: str) -> str:
    """Of the tokenizer's bytes and the version of the library that runs it."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    return hashlib.sha256(base.read_bytes(path) + library.encode()).hexdigest()


_ENCODERS: dict[tuple[str, int], UnitEncoder] = {}


def unit_encoder(kind: str, data: bytes) -> UnitEncoder:
    """One for each Python worker and tokenizer."""
    key = (kind, hash(data))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = byte_level(data.decode()) if kind == "json" else sentence_pieces(data)
    return _ENCODERS[key]


class TokenCountCache:
    """Counts at ``path`` (a Parquet table that only grows) for one tokenizer file."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: str):
        self._spark, self.path = spark, path
        self.version = version_digest(tokenizer)
        self._kind = "json" if tokenizer.endswith(".json") else "model"
        self._data = spark.sparkContext.broadcast(base.read_bytes(tokenizer))  # a tokenizer file: some MB at most

    def stored(self) -> DataFrame | None:
        """This version's counts; None where nothing is stored yet."""
        if not base.exists(self._spark, self.path):
            return None
        return self._spark.read.schema(CACHE_SCHEMA).parquet(self.path).where(F.col("version") == self.version)

    def count(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, n_bytes, n_tokens) for every row; encodes and appends what the cache lacks."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        digest = F.unhex(F.sha2(text, 256))
        rows = df.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
        texts = df.select(digest.alias("digest"), text.alias("text"))
        known = self.stored()
        if known is not None:  # digests meet the cache alone; only the texts of misses move
            wanted = base.stored(rows.select("digest").distinct().join(known.select("digest"), "digest", "left_anti"), "token-misses")
            n = wanted.count()
            texts = texts.join(F.broadcast(wanted) if n <= 1_000_000 else wanted, "digest", "left_semi") if n else None
        if texts is not None:
            self._encoded(texts.groupBy("digest").agg(F.first("text").alias("text"))).write.mode("append").parquet(self.path)
        # runs at the same time may append a digest twice; written once more, so that both sides of
        # the join are plain exchanges, whose large partitions (one text's copies) Spark can split
        counts = base.stored(self.stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts-unique")
        return rows.join(counts, "digest").select("id", "n_bytes", "n_tokens")

    def _encoded(self, missing: DataFrame) -> DataFrame:
        kind, data, version = self._kind, self._data, self.version

        def run(batches):
            encoder = unit_encoder(kind, data.value)
            for whole in batches:
                for batch in base.cut(whole, 1 << 20):
                    _, at = encoder.encode_arrow(batch.column(1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([version] * batch.num_rows, pa.string()), batch.column(0), pa.array(np.diff(at), pa.int64())],
                        names=["version", "digest", "n_tokens"],
                    )

        return missing.mapInArrow(run, CACHE_SCHEMA)
