"""Operations on a tenant's tables: each reads what is stored, works on Spark and appends what is new."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cases, feedback, queue
from ..operators.detectors import Learned
from ..sources import demo, ingest, tables
from ..sources.tables import Catalog
from ..spec import EventSpec, check_registration
from . import detection

POLICY = "id string, schema_id string, match map<string,string>, detectors array<string>, max_score double, reason string, active boolean"


def register(store: Catalog, spec: EventSpec) -> None:
    """A schema under a name that the tenant doesn't have."""
    check_registration(spec, [r["schema_id"] for r in schemas(store).collect()] if store.exists("schemas") else [])
    _put_schema(store, spec)


def _put_schema(store: Catalog, spec: EventSpec) -> None:
    import json

    store.append("schemas", _one(store, {"schema_id": spec.name, "definition": json.dumps(spec.as_dict())}))


def _one(store: Catalog, values: Mapping[str, object]) -> DataFrame:
    row = store.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.withColumns({"created_at": F.current_timestamp(), "revision": F.unix_micros(F.current_timestamp())})


def schemas(store: Catalog) -> DataFrame:
    return queue.by_name(store.latest("schemas", "schema_id"), "schema_id")


def schema(store: Catalog, name: str) -> EventSpec:
    import json

    found = store.latest("schemas", "schema_id").where(F.col("schema_id") == name).first()
    if found is None:
        raise LookupError(f"no schema {name!r}")
    return EventSpec.from_dict(json.loads(found["definition"]))


def add_events(store: Catalog, spec: EventSpec, batch: DataFrame) -> DataFrame:
    """Ingests a batch (idx, external_id, occurred_at, payload): what is new is appended. All rows with their
    outcome; ``ingest.summary`` and ``ingest.errors`` tell of it. The same batch again appends nothing."""
    if not 1 <= batch.limit(ingest.MAX_BATCH + 1).count() <= ingest.MAX_BATCH:
        raise ValueError(f"a batch has 1 to {ingest.MAX_BATCH} events")
    known = store.scan("events", schema=spec.name).select("external_key") if store.exists("events") else batch.sparkSession.createDataFrame([], "external_key string")
    out = tables.materialised(ingest.outcomes(batch, spec, known, bounded=True))
    store.append("events", out.where("outcome = 'accepted'").select(F.lit(spec.name).alias("schema_id"), "external_key", "entity_id", "at", "payload"))
    return out


def events(store: Catalog, spec: EventSpec, limit: int | None = None) -> DataFrame:
    """Typed events; in order of time only where a number of them is asked for."""
    return tables.typed_events(store.scan("events", schema=spec.name, order=("at", "external_key") if limit else (), limit=limit), spec)


def run_detection(store: Catalog, spec: EventSpec, run_id: str | None = None, *, version: int | None = None, **options: object) -> str:
    """A run over all stored events under the active policies: its cases are appended, but for those whose like
    is open, and its metrics. What it learns is stored as the next version; with ``version``, nothing is fitted and that version's tables
    score. The run's row says running until it has ended; a run that raises is stored as failed."""
    run_id, made_of, held_by = run_id or uuid.uuid4().hex, [version], []

    def keep(new: Learned) -> None:
        made_of.append(save_learned(store, spec, new))
        held_by.extend(getattr(new, part) for part in LEARNED.values())

    row = lambda rows: store.append("runs", rows.withColumn("schema_id", F.lit(spec.name)))
    row(tables.unfinished_run(store.spark, run_id))
    try:
        held = policies(store, spec.name) if store.exists("policies") else ()
        learned = None if version is None else load_learned(store, spec, version)
        decided = detection.detect(events(store, spec), spec, policies=held, learned=learned, keep=keep, models=store.path("model_files"), **options)
        found = tables.materialised(decided)
        add_cases(store, cases.to_cases(found, spec, store.tenant, run_id))
        row(tables.run_metrics(found, run_id, made_of[-1]))
        tables.discard(store.spark, found, decided, *held_by)  # what is stored with the tenant stays
    except Exception as error:
        row(tables.failed_run(store.spark, run_id, error))
        raise
    store.audit("detection_run", "run", run_id)
    return run_id


def run(store: Catalog, run_id: str) -> DataFrame:
    """A run's last row."""
    return store.latest("runs", "run_id").where(F.col("run_id") == run_id)


#: Where what was learned is stored, and the part of ``detection.Learned`` that it is.
LEARNED = {"scope_samples": "samples", "baselines": "numeric", "categorical_baselines": "categorical", "peer_groups": "peer_groups", "peer_findings": "peers", "models": "forests"}


def save_learned(store: Catalog, spec: EventSpec, learned: Learned) -> int:
    """Stores all that was learned as the next version. Its rows carry a token, and the version is there once the row that names the token is: of two
    writers of one version the first row holds."""
    token, known = uuid.uuid4().hex, _versions(store, spec)
    version = ((known.agg(F.max("version")).first()[0] if known is not None else None) or 0) + 1
    stamped = lambda rows: rows.withColumns({"schema_id": F.lit(spec.name), "version": F.lit(version), "token": F.lit(token), "created_at": F.current_timestamp()})
    parts = [name for name, part in LEARNED.items() if getattr(learned, part) is not None]
    for name in parts:
        store.append(name, stamped(getattr(learned, LEARNED[name])))
    store.append("learned", stamped(store.spark.range(1).select(F.array(*[F.lit(p) for p in parts]).alias("parts"))))
    return version


def _versions(store: Catalog, spec: EventSpec) -> DataFrame | None:
    return store.scan("learned", schema=spec.name) if store.exists("learned") else None


def load_learned(store: Catalog, spec: EventSpec, version: int | None = None) -> Learned:
    """The tables of a version, or of the last."""
    known = _versions(store, spec)
    rows = known.where(F.lit(version is None) | (F.col("version") == F.lit(version))).orderBy(F.desc("version"), "created_at", "token").limit(1).collect() if known is not None else []
    if not rows:
        raise LookupError(f"no version {version} of {spec.name!r}")
    parts = {}
    for name, part in LEARNED.items():
        if name in rows[0]["parts"] and store.exists(name):
            parts[part] = store.scan(name, schema=spec.name).where(F.col("token") == rows[0]["token"]).drop("schema_id", "version", "token", "created_at", "tenant_id")
    empty = store.spark.createDataFrame
    return Learned(**{"numeric": empty([], detection.EMPTY_NUMERIC), "categorical": empty([], detection.EMPTY_CATEGORICAL)} | parts)


def add_cases(store: Catalog, made: DataFrame) -> None:
    new = cases.not_stored(made, current_cases(store)) if store.exists("cases") else made
    store.append("cases", tables.materialised(new.drop("tenant_id").withColumn("revision", F.unix_micros(F.current_timestamp()))))


def current_cases(store: Catalog) -> DataFrame:
    return store.latest("cases", "id")


def change_case(store: Catalog, changed: DataFrame) -> None:
    """Appends the next revision of cases that ``queue.assign`` or ``queue.resolve`` has changed."""
    store.append("cases", tables.materialised(changed.drop("tenant_id").withColumn("revision", F.greatest(F.col("revision") + 1, F.unix_micros(F.current_timestamp())))))


def learn(store: Catalog, spec: EventSpec, training: DataFrame) -> dict[str, int]:
    """Learns baselines, peer groups and forests, and stores them as the next version."""
    version = save_learned(store, spec, detection.learn(training, spec, models=store.path("model_files")))
    return {name: version for name in ("baselines", "peer_groups", "models")}


def add_feedback(store: Catalog, given: DataFrame) -> None:
    """Labels (id, exception_id, label, note, author) of the tenant's cases; an unknown label or case raises."""
    rows = tables.materialised(queue.label_rows(given).withColumn("created_at", F.current_timestamp()))
    if rows.join(current_cases(store).select(F.col("id").alias("exception_id")), "exception_id", "left_anti").limit(1).count():
        raise LookupError("a label of an unknown case")
    store.append("feedback", rows)


def explain(store: Catalog, chosen: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], *, purpose: str = "explain") -> DataFrame:
    """Accounts of cases by a provider, or the template's where it fails; the log of its calls is appended."""
    told, calls = queue.explained(chosen, provider, purpose=purpose)
    store.append("provider_calls", calls.withColumn("created_at", F.current_timestamp()))
    return told


def add_policy(store: Catalog, policy: Mapping[str, object]) -> None:
    row = {"schema_id": None, "match": {}, "detectors": [], "reason": None, "active": True, **policy}
    _put_policies(store, store.spark.createDataFrame([tuple(row[c.split()[0]] for c in POLICY.split(", "))], POLICY))


def _put_policies(store: Catalog, rows: DataFrame) -> None:
    store.append("policies", rows.withColumns({"created_at": F.current_timestamp(), "revision": F.unix_micros(F.current_timestamp())}))


def deactivate_policy(store: Catalog, policy_id: str) -> None:
    found = tables.materialised(store.latest("policies", "id").where(F.col("id") == policy_id).drop("tenant_id"))
    if not found.limit(1).count():
        raise LookupError(f"no policy {policy_id!r}")
    store.append("policies", found.withColumns({"active": F.lit(False), "revision": F.col("revision") + 1}))


def policies(store: Catalog, schema_id: str) -> DataFrame:
    """Active policies of a schema, newest first, with their place as ``ordinal``."""
    rows = tables.active_policies(store.latest("policies", "id"), schema_id)
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), "id"))  # what people have written: one task orders it
    return queue.newest(rows.withColumn("ordinal", place))


def promote(store: Catalog, spec: EventSpec, labelled: DataFrame, *, weights: bool = False, threshold: bool = False, suppress: bool = False) -> EventSpec:
    """Applies the chosen parts of a proposal, made from the labels as they are now."""
    changed = feedback.promote(spec, labelled, apply_weights=weights, apply_threshold=threshold)
    if changed != spec:
        _put_schema(store, changed)
    if suppress:
        proposed = tables.materialised(feedback.policies(labelled))
        key = F.concat_ws("-", F.lit("proposal"), F.lit(spec.name), "baseline_scope", "detector")
        _put_policies(store, proposed.select(
            key.alias("id"), F.lit(spec.name).alias("schema_id"), "match", F.array("detector").alias("detectors"), "max_score", F.lit("repeated rejections").alias("reason"), F.lit(True).alias("active"),
        ))
    store.audit("promote", "schema", spec.name)
    return changed


def seed_demo(store: Catalog, count: int = 4000, *, force: bool = False) -> str | None:
    """The demo log and a first run; nothing where events are stored, unless forced."""
    spec = demo.SPEC
    if store.exists("events") and store.scan("events", schema=spec.name).limit(1).count() and not force:
        return None
    if not store.exists("schemas") or not schemas(store).where(F.col("schema_id") == spec.name).count():
        register(store, spec)
    rows = demo.log(store.spark, count)
    shown = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in spec.columns]))
    known = store.scan("events", schema=spec.name).select(F.col("external_key").alias(spec.event_id)) if store.exists("events") else None
    rows = rows if known is None else rows.join(known, spec.event_id, "left_anti")
    store.append("events", rows.select(F.lit(spec.name).alias("schema_id"), F.col(spec.event_id).alias("external_key"), F.col(spec.entity).alias("entity_id"), F.col(spec.time).alias("at"), shown.alias("payload")))
    return run_detection(store, spec)


def new_key() -> tuple[str, str]:
    """A random API key and the hash that is stored of it."""
    import hashlib
    import secrets

    key = secrets.token_urlsafe(32)
    return key, hashlib.sha256(key.encode()).hexdigest()


def is_key(key: str, stored: str) -> bool:
    """In constant time."""
    import hashlib
    import hmac

    return hmac.compare_digest(hashlib.sha256(key.encode()).hexdigest(), stored)


def payload_json(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``payload``: the columns as JSON, times in ISO 8601."""
    return rows.withColumn("payload", F.to_json(F.struct(*[F.col(c) for c in columns]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}))
