"""Shared plumbing of the training-data operators: shared storage, Arrow mapping, tokenizer files.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary local one,
    but only if driver and executors are one process: elsewhere tables in it would be incomplete."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="normscope-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/normscope-{purpose}-{uuid.uuid4().hex}"


#: What Spark sends to a Python worker at once. Its own 64 MB are held twice by the JVM while buffers double, and again by the worker.
SENT_BYTES = 4 << 20
_SENT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside send at most about ``SENT_BYTES`` to a Python worker at once, one row at least;
    a smaller limit of the session holds, and its own one comes back afterwards."""
    before = spark.conf.get(_SENT)
    limit = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before))
    if limit <= SENT_BYTES:
        yield
        return
    spark.conf.set(_SENT, str(SENT_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_SENT, before)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and executors may be lost."""
    spark = df.sparkSession
    path = shared_path(spark, purpose)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` wrote, once what was made of them is stored itself."""
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()} if table is not None else ():
            if "/normscope-" in folder:
                path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (name, *(f"{name}{i}" for i in range(len(taken) + 1))) if x.lower() not in taken) for name in names]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def words_pattern() -> str:
    """A word: a run without the six ASCII white-space characters."""
    return r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(words_pattern())), F.lit(0)).cast("long")


def map_arrow(
    df: DataFrame,
    rows: Callable[[pa.RecordBatch], dict[str, object]],
    schema: str,
    *,
    max_bytes: int = 16 << 20,
) -> DataFrame:
    """``mapInArrow`` of a function from a batch to columns. Batches are cut so that their
    buffers stay near ``max_bytes`` whatever the length of the texts."""
    names_types = df.sparkSession.createDataFrame([], schema).schema

    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(names_types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, max_bytes):
                made = rows(batch)
                yield pa.RecordBatch.from_arrays(
                    [_as_arrow(made[f.name], f.type) for f in out_schema], schema=out_schema
                )

    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``max_bytes`` each, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, min(n, n * max_bytes // max(1, batch.nbytes)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def _as_arrow(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
