"""Stored tables: tenant-filtered reads, versioned baselines, append-only logs, CSV."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..spec import EventSpec


_LOCAL: list[str] = []


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; below one local folder where that is unset, if driver and
    executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="normscope-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        root = f"file://{_LOCAL[0]}"
    return f"{root.rstrip('/')}/normscope-{purpose}-{uuid.uuid4().hex}"


def materialised(rows: DataFrame) -> DataFrame:
    """Rows written to shared storage and read back. Detector outputs are stored like this once, so that
    scores can be recomputed, later steps don't repeat the detectors, and filters on fused scores
    aren't pushed down as one huge expression."""
    path = shared_path(rows.sparkSession, "rows")
    rows.write.parquet(path)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    stored._stored_at = path
    return stored


def made_of(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows``, a plain view of a stored table, which ``discard`` then deletes by it."""
    rows._stored_at = getattr(stored, "_stored_at", None)
    return rows


def discard(spark: SparkSession, *stored: DataFrame | None) -> None:
    """Deletes tables of ``materialised`` once what was made of them is stored itself."""
    for rows in stored:
        at = getattr(rows, "_stored_at", None)
        if at is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Catalog:
    """Parquet tables below a root, partitioned by tenant; every read is of one tenant."""

    def __init__(self, spark: SparkSession, root: str, tenant: str):
        self.spark = self._spark = spark
        self._root, self.tenant = root.rstrip("/"), tenant

    def path(self, table: str) -> str:
        return f"{self._root}/{table}"

    def read(self, table: str) -> DataFrame:
        return self._spark.read.parquet(self.path(table)).where(F.col("tenant_id") == self.tenant)

    def exists(self, table: str) -> bool:
        """Whether the tenant has rows there."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/tenant_id={self.tenant}")
        return path.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(path)

    def scan(self, table: str, *, schema: str | None = None, order: Sequence[str] = (), limit: int | None = None) -> DataFrame:
        """The tenant's rows of a schema, in an order and up to a number only if asked for."""
        rows = self.read(table) if schema is None else self.read(table).where(F.col("schema_id") == schema)
        rows = rows.orderBy(*order) if order else rows
        return rows if limit is None else rows.limit(limit)

    def latest(self, table: str, key: str) -> DataFrame:
        """The last revision of every row of a table that is changed by appending."""
        rows = self.read(table)
        last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col("revision")).alias("_row"))
        return last.select(key, "_row.*")

    def append(self, table: str, rows: DataFrame) -> None:
        rows.withColumn("tenant_id", F.lit(self.tenant)).write.mode("append").partitionBy("tenant_id").parquet(self.path(table))

    def save_version(self, table: str, spec: EventSpec, rows: DataFrame) -> int:
        """What was learned for a schema (baselines, peer groups, models) as its next version; it alone is active."""
        last = self.scan(table, schema=spec.name).agg(F.max("version")).first()[0] if self.exists(table) else None
        version = (last or 0) + 1
        self.append(table, rows.withColumns({"schema_id": F.lit(spec.name), "version": F.lit(version), "created_at": F.current_timestamp()}))
        return version

    def versions(self, table: str, spec: EventSpec) -> DataFrame:
        """All versions with ``active``."""
        rows = self.scan(table, schema=spec.name)
        newest = F.broadcast(rows.agg(F.max("version").alias("_newest")))  # one row
        return rows.crossJoin(newest).withColumn("active", F.col("version") == F.col("_newest")).drop("_newest")

    def active(self, table: str, spec: EventSpec) -> DataFrame:
        return self.versions(table, spec).where("active").drop("active")

    def save_baselines(self, spec: EventSpec, baselines: DataFrame) -> int:
        return self.save_version("baselines", spec, baselines)

    def active_baselines(self, spec: EventSpec) -> DataFrame:
        return self.active("baselines", spec)

    def audit(self, action: str, object_type: str, object_id: str | None = None, actor: str | None = None, payload: str | None = None) -> None:
        values = {"action": action, "object_type": object_type, "object_id": object_id, "actor": actor, "payload": payload}
        self.append("audit", self._spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()], F.current_timestamp().alias("created_at")))


def tenant_of(tenants: DataFrame, key: str | None, demo: str = "demo") -> DataFrame:
    """The tenant of an API key, by its hash; the demo tenant without a key; no row for an unknown key."""
    if not key:
        return tenants.where(F.col("slug") == demo)
    return tenants.where(F.col("key_hash") == S.key_hash(F.lit(key)))


def active_policies(policies: DataFrame, schema: str) -> DataFrame:
    """Active policies of the schema or of all schemas."""
    return policies.where(F.col("active") & (F.col("schema_id").isNull() | (F.col("schema_id") == schema)))


def typed_events(rows: DataFrame, spec: EventSpec) -> DataFrame:
    """From (external_key, entity_id, at, payload): the columns that the spec names."""
    value = lambda c: F.element_at("payload", F.lit(c))
    columns = [F.col("external_key").alias(spec.event_id), F.col("entity_id").alias(spec.entity), F.col("at").alias(spec.time)]
    numeric = dict.fromkeys([*spec.numeric, *spec.rates])
    columns += [S.number(value(c)).alias(c) for c in numeric]
    columns += [value(c).alias(c) for c in dict.fromkeys([*spec.categorical, *spec.dimensions]) if c not in numeric]
    return rows.select(*columns)


def write_csv(rows: DataFrame, path: str, columns: Sequence[str], decimals: dict[str, int]) -> None:
    """A CSV with a header, chosen columns and fixed decimals."""
    shown: list[Column] = [F.format_string(f"%.{decimals[c]}f", F.col(c).cast("double")).alias(c) if c in decimals else F.col(c) for c in columns]
    rows.select(*shown).write.mode("overwrite").csv(path, header=True)


COUNTS = {"created": "cases_created", "suppressed": "suppressed", "duplicate": "duplicates", "capped": "capped"}
#: A run's row, of which the last revision holds: running, then completed or failed.
RUN = "scored long, cases_created long, suppressed long, duplicates long, capped long, detector_failures map<string,long>, version long, run_id string, status string, finished_at timestamp, error string, revision long"


def run_metrics(decided: DataFrame, run_id: str, version: int | None = None) -> DataFrame:
    """What a run came to; ``detector_failures`` counts the events that each detector raised on, ``version`` is that of the tables it scored with."""
    from ..operators.detectors import is_failure

    failed = decided.select(F.explode(F.filter("results", is_failure)).alias("r")).groupBy("r.detector").agg(F.count(F.lit(1)).alias("n"))
    failed = failed.agg(F.map_from_entries(F.collect_list(F.struct("detector", "n"))).alias("detector_failures"))  # a row for each detector
    counts = decided.agg(F.count(F.lit(1)).alias("scored"), *[F.count_if(F.col("decision.kind") == k).alias(n) for k, n in COUNTS.items()])
    rows = counts.crossJoin(failed).withColumns({"version": F.lit(version).cast("long"), "run_id": F.lit(run_id), "status": F.lit("completed"), "finished_at": F.current_timestamp(), "error": F.lit(None).cast("string")})
    return _revised(rows)


def _revised(rows: DataFrame) -> DataFrame:
    return rows.withColumn("revision", F.unix_micros(F.current_timestamp()))


def unfinished_run(spark: SparkSession, run_id: str, status: str = "running", error: Exception | None = None) -> DataFrame:
    """The row of a run that has begun, or has raised."""
    values = {"run_id": F.lit(run_id), "status": F.lit(status), "error": F.lit(None if error is None else f"{type(error).__name__}: {error}"[:1000]), "finished_at": F.current_timestamp() if error else F.lit(None)}
    values |= {n: F.lit(0) for n in ("scored", *COUNTS.values())}
    none = {n: F.lit(None) for n in ("detector_failures", "version", "revision")}
    kinds = dict(part.split(" ") for part in RUN.split(", "))
    return _revised(spark.range(1).select(*[(values | none)[c].cast(kind).alias(c) for c, kind in kinds.items()]))


def failed_run(spark: SparkSession, run_id: str, error: Exception) -> DataFrame:
    """The metrics row of a run that raised."""
    return unfinished_run(spark, run_id, "failed", error)


Channel = Callable[[DataFrame], None]


class Recorder:
    """A channel that keeps what it was given, for tests; payloads are a few cases."""

    def __init__(self, limit: int = 1000):
        self.payloads: list[dict] = []
        self._limit = limit

    def __call__(self, payloads: DataFrame) -> None:
        self.payloads += [r.asDict(recursive=True) for r in payloads.limit(self._limit).collect()]


def deliver(payloads: DataFrame, channel: Channel) -> DataFrame:
    """Hands payloads as a table to a channel; the rows with the outcome, which is one for all."""
    try:
        channel(payloads)
        status, error = "delivered", None
    except Exception as e:
        status, error = "failed", f"{type(e).__name__}: {e}"[:300]
    return payloads.withColumns({"status": F.lit(status), "error": F.lit(error).cast("string")})


def deliver_each(payloads: DataFrame, send: Callable[[str, dict], None], *, key: str = "exception_id", tries: int = 3, known: DataFrame | None = None) -> DataFrame:
    """Hands each payload to ``send(idempotency key, payload)`` in the tasks that hold it, and again while it raises, ``tries`` times at most. The
    rows with ``delivery_key``, ``status``, ``attempts`` and ``error`` of each, stored: one that fails doesn't hold back others. Payloads whose key ``known`` has as delivered
    are left out; the key is a digest of the payload, so a task that runs again sends what the receiver can tell to be the same."""
    kinds = T.StructType([*payloads.schema.fields, *T.StructType.fromDDL("delivery_key string, status string, attempts int, error string").fields])
    names = payloads.columns
    rows = payloads.withColumn("delivery_key", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.to_json(F.struct(*names))), 256))
    if known is not None:
        rows = rows.join(known.where("status = 'delivered'").select("delivery_key"), "delivery_key", "left_anti").select(*names, "delivery_key")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for row in part.to_pylist():
                digest, error = row.pop("delivery_key"), None
                for attempt in range(1, tries + 1):
                    try:
                        send(digest, row)
                        error = None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"[:300]
                found.append(("failed" if error else "delivered", attempt, error))
            status, attempts, errors = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(status, pa.string()), pa.array(attempts, pa.int32()), pa.array(errors, pa.string())], names=[*part.schema.names, "status", "attempts", "error"])

    return materialised(rows.mapInArrow(run, kinds))
