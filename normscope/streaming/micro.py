"""Structured Streaming: idempotent ingestion, walk-forward scoring by all detectors, and the fold into cases.

``fused`` gives every event the score that a batch run gives it. Events wait in their entity's state until the watermark has passed them and are
then walked in order of time, whatever order and micro-batches they came in. ``FoldSink`` folds what comes out into cases.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C
from ..functions import scalars as S
from ..operators import baselines, cases, detectors, ensemble, walks
from ..operators.detectors import Learned
from ..spec import EventSpec

WATERMARK = "72 hours"


def deduplicated(stream: DataFrame, spec: EventSpec, watermark: str = WATERMARK) -> DataFrame:
    """Each event id once within the watermark."""
    return stream.withWatermark(spec.time, watermark).dropDuplicatesWithinWatermark([spec.event_id])


def scored(stream: DataFrame, learned: Learned, spec: EventSpec) -> DataFrame:
    """Robust deviation and rarity of streamed events; the stored tables are static sides of the joins."""
    rows = baselines.resolve_scope(stream, learned.samples, spec.dimensions)
    if spec.numeric:
        rows = detectors.robust_deviation(rows, learned.numeric, spec)
    if spec.categorical:
        rows = detectors.categorical_rarity(rows, learned.categorical, spec)
    names = [c for c in ("d_robust_deviation", "d_categorical_rarity") if c in rows.columns]
    best = F.array_max(F.array(*[F.col(f"{n}.score") for n in names]))
    return rows.withColumn("score", F.round(100 * best, 2)).withColumn("severity", S.severity(F.col("score")))


def hourly_levels(stream: DataFrame, spec: EventSpec, feature: str, watermark: str = WATERMARK) -> DataFrame:
    """Count, mean and maximum of a feature for each hour and full scope, final once the watermark has passed."""
    window = F.window(F.col(spec.time), "1 hour")
    return stream.withWatermark(spec.time, watermark).groupBy(window, S.scope_key(spec.dimensions).alias("scope_key")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(feature).alias("mean"), F.max(feature).alias("largest")
    )


#: The state store that keyed state with timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Milliseconds without events after which an entity's history goes.
TIME_TO_LIVE = 400 * 86_400_000


class Walker(StatefulProcessor):
    """One entity: events that wait for the watermark, and its last HISTORY_LIMIT events. An event that comes when the watermark has passed its time is
    dropped, and so is one whose id waits already: what comes twice is either. An event that follows its entity's last one after ``ttl`` milliseconds or
    more starts anew, and the state goes when the watermark tells that no other can come."""

    def __init__(self, names: list[str], features: int, id_at: int, ttl: int):
        self.names, self.features, self.id_at, self.ttl = names, features, id_at, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row binary")
        self.history = handle.getValueState("history", "rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        known, fresh = {r[0][self.id_at] for r in held}, []
        for part in rows:
            for *row, where, values, at in part[[*self.names, "walk_where", "walk_values", "walk_at"]].itertuples(index=False, name=None):
                if at // 1000 > passed and row[self.id_at] not in known:
                    known.add(row[self.id_at])
                    fresh.append((tuple(row), tuple(where), tuple(None if v is None or v != v else float(v) for v in values), int(at)))
        if fresh:
            self.waiting.appendList([(pickle.dumps(r),) for r in fresh])
            self._wake(min(r[3] for r in fresh) // 1000)
        yield self._frame([], [], [])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(self._held(), key=lambda r: (r[3], r[0][self.id_at]))
        ready, later = [r for r in held if r[3] // 1000 <= passed], [r for r in held if r[3] // 1000 > passed]
        past, last = pickle.loads(self.history.get()[0]) if self.history.exists() else ([], None)
        self.timer.clear()
        if not held and last is not None and last // 1000 + self.ttl <= passed:
            self.history.clear()
            yield self._frame([], [], [])
            return
        walk, found = walks.Walk(self.features, history=past), {k: [] for k in walks.KINDS}
        for _, where, values, at in ready:
            if last is not None and at // 1000 - last // 1000 >= self.ttl:
                walk = walks.Walk(self.features)
            last = at
            for kind in walks.KINDS:
                found[kind].append(walk.judged(kind, where, values))
            walk.push(where, values)
        if ready:
            self.history.update((pickle.dumps((list(walk.events), last)),))
            self.waiting.clear()
            if later:
                self.waiting.put([(pickle.dumps(r),) for r in later])
        if later:
            self._wake(later[0][3] // 1000)
        elif last is not None:
            self._wake(last // 1000 + self.ttl)
        yield self._frame([r[0] for r in ready], found["rq"], found["cp"])

    def close(self) -> None:
        pass

    def _held(self) -> list[tuple]:
        return [pickle.loads(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []

    def _wake(self, at: int) -> None:
        """One timer, at the earliest place that is waited for."""
        if self.timer.exists():
            if self.timer.get()[0] <= at:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def _frame(self, rows: list[tuple], rolling: list[tuple], change: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.names).astype(object)
        for kind, found, fields in (("rq", rolling, ("n", "nz", "upper", "median")), ("cp", change, ("split", "strength", "before", "after"))):
            out[kind] = pd.Series([{"n": n, "parts": [dict(zip(fields, p, strict=True)) for p in parts], "error": error} for n, parts, error in found], dtype=object)
        return out


def walked(stream: DataFrame, spec: EventSpec, *, watermark: str = WATERMARK, ttl: int = TIME_TO_LIVE) -> DataFrame:
    """Every streamed event, once the watermark has passed it, with ``rq`` and ``cp`` of ``walks``: what its entity's last HISTORY_LIMIT
    events before it say, as in a batch. The session's state store must be STATE_STORE."""
    names = spec.columns
    kept = stream.select(*names).withWatermark(spec.time, watermark)
    rows = kept.withColumns({
        "walk_where": F.array(*walks.places(spec)).cast("array<string>"), "walk_values": F.array(*[F.col(f).cast("double") for f in spec.numeric]).cast("array<double>"),
        "walk_at": F.coalesce(F.unix_micros(F.col(spec.time).cast("timestamp")), F.lit(0)), "walk_entity": F.col(spec.entity).cast("string"),
    })
    schema = T.StructType([*kept.select(*names).schema.fields, *(T.StructType.fromDDL(f"{k} {kind}")[0] for k, kind in walks.KINDS.items())])
    walker = Walker(names, len(spec.numeric), names.index(spec.event_id), ttl)
    return rows.groupBy("walk_entity").transformWithStateInPandas(walker, schema, "Append", "eventTime")


def fused(stream: DataFrame, learned: Learned, spec: EventSpec, *, watermark: str = WATERMARK, ttl: int = TIME_TO_LIVE) -> DataFrame:
    """Streamed events with the fused score of all six detectors, as a batch run with these tables gives it."""
    run = detectors.Run(spec, None, learned, F.lit(True))
    rows = walked(stream, spec, watermark=watermark, ttl=ttl)
    for detector in (d for d in map(detectors.REGISTRY.get, C.DETECTORS) if d.on_log):
        rows = detectors.planned(detector, rows, run)
    rows = baselines.resolve_scope(rows, learned.samples, spec.dimensions)
    for detector in (d for d in map(detectors.REGISTRY.get, C.DETECTORS) if not d.on_log):
        rows = detectors.planned(detector, rows, run)
    return ensemble.fuse(rows, spec)


RESOLUTION = "entity string, case_id string, at timestamp"


class FoldSink:
    """For ``foreachBatch``: folds each micro-batch of scored events into cases. What is open is a table below ``folder``, one version for each batch, and
    so are the decisions, written under the batch's number: a batch that comes again writes the same, so nothing comes twice. A case closes from the time
    of its resolution on; ``resolutions`` are read as they are when a batch comes, and may come as a stream that appends to them.

    Batches must come in order of time within each entity, as ``fused`` gives them; then any cut of a log into batches gives the decisions of the batch fold."""

    def __init__(self, spark: SparkSession, folder: str, spec: EventSpec, config: cases.GateConfig | None = None, policies: object = (), resolutions: str | None = None):
        self.spark, self.folder, self.spec = spark, folder.rstrip("/"), spec
        self.config, self.policies, self.resolutions = config or cases.GateConfig(min_score=spec.min_score), policies, resolutions

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __call__(self, scored: DataFrame, batch: int) -> None:
        done = f"{self._path('decisions', batch)}/_SUCCESS"
        if self._exists(done):  # a replay
            return
        gated = cases.gate(scored, self.spec, self.config, self.policies)
        before = self.spark.read.parquet(self._path("open", batch - 1)) if self._exists(f"{self._path('open', batch - 1)}/_SUCCESS") else None
        closed = self.spark.read.schema(RESOLUTION).parquet(self.resolutions) if self.resolutions and self._exists(self.resolutions) else None
        folded = cases.fold(cases.candidates_of(gated, self.spec), self.config, before, resolutions=closed, keep_open=True)
        path = self._path("folded", batch)
        folded.write.mode("overwrite").parquet(path)
        folded = self.spark.read.parquet(path)
        still = folded.where("kind = 'open'").select("entity", F.col("event_id").alias("case_id"), F.timestamp_micros("at").alias("at"), "fingerprint", "until")
        still.write.mode("overwrite").parquet(self._path("open", batch))
        folded.where("kind <> 'open'").select("entity", "event_id", "kind", "ref").write.mode("overwrite").parquet(self._path("decisions", batch))
        for old in (path, self._path("open", batch - 2)):
            self._delete(old)

    def decisions(self) -> DataFrame:
        """(entity, event_id, kind, ref, batch) of all batches."""
        return self.spark.read.parquet(f"{self.folder}/decisions")
