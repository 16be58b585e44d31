"""From scored events to cases: gates in order, then a fold over each entity's open cases."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..spec import EventSpec


@dataclass(frozen=True)
class GateConfig:
    min_score: float = C.MIN_SCORE
    min_confidence: float = C.MIN_CONFIDENCE
    dedup_hours: int = C.DEDUP_HOURS
    max_open: int = C.MAX_OPEN_PER_ENTITY


def first_policy(policies: Sequence[dict], event: dict[str, Column], score: Column, strongest: Column) -> Column:
    """The id of the first policy that covers the result, in their order; else null."""
    out = F.lit(None).cast("string")
    for policy in reversed(list(policies)):
        out = F.when(S.policy_covers(policy, event, score, strongest), F.lit(str(policy["id"]))).otherwise(out)
    return out


def with_policy(scored: DataFrame, spec: EventSpec, policies: DataFrame) -> DataFrame:
    """``scored`` with ``policy_id``: that of the first covering policy, from a table (id, match, detectors, max_score, active, ordinal) of any
    size. Policies that match on the same columns are one equi-join on those columns' values and the detector, so the plan grows with the combinations of
    columns in use alone. Of the policies of one key, those are kept that lie above all before them: the first that reaches a score is the answer."""
    event = set(spec.columns)
    known = policies.where("active").withColumn("match", F.coalesce("match", F.create_map().cast("map<string,string>")))
    strange = F.map_filter("match", lambda k, v: ~k.isin(*event) & (F.coalesce(v, F.lit("")) != ""))  # no event has that column
    known = known.where(F.cardinality(strange) == 0).withColumn("match", F.map_filter("match", lambda k, v: k.isin(*event)))
    known = known.withColumn("keys", F.array_sort(F.map_keys("match")))
    detector = F.explode(F.when(F.size(F.coalesce("detectors", F.array().cast("array<string>"))) > 0, F.array_distinct("detectors")).otherwise(F.array(F.lit("*"))))
    known = known.select("keys", "match", detector.alias("_detector"), F.struct("ordinal", F.col("max_score").cast("double").alias("max_score"), F.col("id").cast("string").alias("id")).alias("p"))
    rows, hits = scored, []
    for k, row in enumerate(known.select("keys").distinct().orderBy("keys").collect()):  # combinations of columns
        names = [f"_p{k}_{i}" for i in range(len(row["keys"]))]
        side = known.where(F.col("keys") == F.array(*map(F.lit, row["keys"])).cast("array<string>"))
        side = side.select(*[F.coalesce(F.element_at("match", F.lit(c)), F.lit("")).alias(n) for n, c in zip(names, row["keys"], strict=True)], F.col("_detector").alias(f"_p{k}_d"), "p")
        ordered = F.array_sort(F.collect_list("p"))
        rising = F.aggregate(ordered, F.array().cast("array<struct<ordinal:int,max_score:double,id:string>>"), lambda a, x: F.when(
            (F.size(a) == 0) | (F.element_at(a, -1)["max_score"] < x["max_score"]), F.concat(a, F.array(x.cast("struct<ordinal:int,max_score:double,id:string>")))).otherwise(a))
        side = side.groupBy(*names, f"_p{k}_d").agg(rising.alias("_all"))
        for what in ("any", "own"):
            here = side.where((F.col(f"_p{k}_d") == "*") == F.lit(what == "any")).withColumnRenamed("_all", f"_p{k}_{what}")
            tests = [F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(n) for n, c in zip(names, row["keys"], strict=True)]
            tests += [F.col("strongest") == F.col(f"_p{k}_d")] if what == "own" else []
            rows = rows.join(here, reduce(and_, tests or [F.lit(True)]), "left").drop(*names, f"_p{k}_d")  # no test: one row at most
            hits.append(F.get(F.filter(f"_p{k}_{what}", lambda p: p["max_score"] >= F.col("score")), F.lit(0)))
    if not hits:
        return rows.withColumn("policy_id", F.lit(None).cast("string"))
    return rows.withColumn("policy_id", F.array_min(F.array_compact(F.array(*hits)))["id"]).drop(*[c for c in rows.columns if c.startswith("_p") and c.rpartition("_")[2] in ("any", "own")])


def gate(scored: DataFrame, spec: EventSpec, config: GateConfig = GateConfig(), policies: Sequence[dict] | DataFrame = ()) -> DataFrame:
    """``gate``: low_score, low_confidence, suppressed, unexplained or candidate; ``policy_id`` of the
    suppressing policy; ``fingerprint`` of candidates. ``policies``: a few as dicts, in order, or a table of any size with ``ordinal``."""
    if isinstance(policies, DataFrame):
        rows = with_policy(scored, spec, policies)
    else:
        event = {c: F.col(c) for c in spec.columns}
        rows = scored.withColumn("policy_id", first_policy(policies, event, F.col("score"), F.col("strongest")))
    reached = (F.col("score") >= config.min_score) & (F.col("confidence") >= config.min_confidence)
    rows = rows.withColumn("policy_id", F.when(reached, F.col("policy_id")))
    rows = rows.withColumn("gate", F.when(F.col("score") < config.min_score, "low_score").when(F.col("confidence") < config.min_confidence, "low_confidence")
                           .when(F.col("policy_id").isNotNull(), "suppressed").when(F.size("reasons") == 0, "unexplained").otherwise("candidate"))
    return rows.withColumn("fingerprint", F.when(F.col("gate") == "candidate", S.fingerprint(F.col(spec.entity).cast("string"), F.col("strongest"), F.col("reasons"))))


FOLDED = "entity string, event_id string, kind string, ref string, at long, until long, fingerprint string"


def fold(
    candidates: DataFrame, config: GateConfig = GateConfig(), open_cases: DataFrame | None = None, *, resolutions: DataFrame | None = None, keep_open: bool = False,
) -> DataFrame:
    """From (entity, event_id, at timestamp, fingerprint, entity_level): (entity, event_id, kind, ref, ...) with
    kind created, duplicate (``ref`` is the open case) or capped. In order of time, then id: a
    fingerprint that is open repeats it (an event-level one only within the window from the accepted
    case); beyond ``max_open`` open cases nothing is created. ``open_cases`` (entity, case_id, at,
    fingerprint, and ``until`` where it is known when each closed) are open before. ``resolutions`` (entity, case_id, at) close cases from their
    time on. With ``keep_open`` the cases that are open at the end follow with kind open, ``at`` and ``until`` in microseconds: what the
    next part of the log needs. The state is a few entries for each entity, so a partition
    of ordered rows streams through in bounded memory, however many rows an entity has."""
    none = F.lit(None).cast("long")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = candidates.select("entity", F.lit(2).alias("stage"), micros("at").alias("at"), F.col("event_id").cast("string").alias("event_id"), "fingerprint", "entity_level", none.alias("until"))
    if open_cases is not None:
        until = F.col("until").cast("long") if "until" in open_cases.columns else none
        rows = rows.unionByName(open_cases.select("entity", F.lit(0).alias("stage"), micros("at").alias("at"), F.col("case_id").cast("string").alias("event_id"), "fingerprint", F.lit(False).alias("entity_level"), until.alias("until")))
    if resolutions is not None:
        rows = rows.unionByName(resolutions.select("entity", F.lit(1).alias("stage"), micros("at").alias("at"), F.col("case_id").cast("string").alias("event_id"), F.lit(None).cast("string").alias("fingerprint"), F.lit(False).alias("entity_level"), none.alias("until")))
    order_id = F.coalesce(F.col("event_id").try_cast("long"), F.lit(0))
    stored = (F.col("stage") > 0).cast("int")  # what was open comes first, then all in order of time; a case closes before what comes at that time
    ordered = rows.withColumns({"_n": order_id, "_s": stored}).repartition("entity").sortWithinPartitions("entity", "_s", "at", "stage", "_n", "event_id")
    window, most = config.dedup_hours * 3_600_000_000, config.max_open

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, open_ = None, []  # open_: [fingerprint, at, id, until]
        left = lambda: [(entity, o[2], "open", None, o[1], o[3], o[0]) for o in open_] if keep_open else []
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r.entity != entity:
                    out += left()
                    entity, open_ = r.entity, []
                if r.stage == 0:
                    open_.append([r.fingerprint, r.at, r.event_id, None if pd.isna(r.until) else int(r.until)])
                    continue
                if r.stage == 1:
                    for o in open_:
                        if o[2] == r.event_id and o[3] is None:
                            o[3] = r.at
                    continue
                open_ = [o for o in open_ if o[3] is None or o[3] > r.at]
                same = next((o for o in open_ if o[0] == r.fingerprint and (r.entity_level or o[1] >= r.at - window)), None)
                if same:
                    out.append((r.entity, r.event_id, "duplicate", same[2], r.at, None, r.fingerprint))
                elif len(open_) >= most:
                    out.append((r.entity, r.event_id, "capped", None, r.at, None, r.fingerprint))
                else:
                    open_.append([r.fingerprint, r.at, r.event_id, None])
                    out.append((r.entity, r.event_id, "created", r.event_id, r.at, None, r.fingerprint))
            yield _frame(out)
        yield _frame(left())

    return ordered.mapInPandas(run, FOLDED)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["entity", "event_id", "kind", "ref", "at", "until", "fingerprint"])
    return out.astype({"at": "Int64", "until": "Int64"})


def candidates_of(gated: DataFrame, spec: EventSpec) -> DataFrame:
    """What ``fold`` takes, from gated events."""
    return gated.where(F.col("gate") == "candidate").select(
        F.col(spec.entity).cast("string").alias("entity"), F.col(spec.event_id).alias("event_id"), F.col(spec.time).cast("timestamp").alias("at"), "fingerprint",
        F.coalesce(F.col("strongest").isin(*C.ENTITY_LEVEL_DETECTORS), F.lit(False)).alias("entity_level"),
    )


def decide(gated: DataFrame, spec: EventSpec, config: GateConfig = GateConfig(), open_cases: DataFrame | None = None) -> DataFrame:
    """Gated rows with ``decision``: struct<kind, ref> — a gate's name, or the fold's."""
    found = fold(candidates_of(gated, spec), config, open_cases).select(F.col("event_id").alias("_id"), "kind", "ref")
    rows = gated.join(found, F.col(spec.event_id).cast("string") == F.col("_id"), "left")
    kind = F.when(F.col("gate") == "candidate", F.col("kind")).otherwise(F.col("gate"))
    ref = F.when(F.col("gate") == "suppressed", F.col("policy_id")).otherwise(F.col("ref"))
    return rows.withColumn("decision", F.struct(kind.alias("kind"), ref.alias("ref"))).drop("_id", "kind", "ref")


def to_cases(decided: DataFrame, spec: EventSpec, tenant: str = "default", run_id: str = "run") -> DataFrame:
    """Case rows of the created decisions."""
    payload = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in spec.columns]))
    entity = F.col(spec.entity).cast("string")
    used = F.filter("results", lambda r: r["applicable"])
    return decided.where("decision.kind = 'created'").select(
        F.concat_ws("-", F.lit(run_id), F.col(spec.event_id).cast("string")).alias("id"), F.lit(tenant).alias("tenant_id"), F.lit(spec.name).alias("schema_id"), F.lit(run_id).alias("run_id"),
        F.lit(spec.entity_type).alias("entity_type"), entity.alias("entity_id"), F.col(spec.event_id).cast("string").alias("event_id"), "fingerprint",
        S.title(spec.entity_type, entity, F.col("reasons"), F.col("strongest")).alias("title"), F.col(spec.time).cast("timestamp").alias("detected_at"),
        F.col("score").alias("anomaly_score"), "severity", "confidence", F.col("case_scope").alias("baseline_scope"),
        F.map_from_entries(F.transform(used, lambda r: F.struct(r["detector"], r["version"]))).alias("detector_versions"), "reasons",
        F.struct(F.lit(None).cast("string").alias("weights"), F.col("weighted_mean"), F.col("strongest").alias("strongest_detector"), F.col("results").alias("detectors")).alias("evidence"),
        payload.alias("event_payload"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("assignee"), F.lit(None).cast("string").alias("resolution_note"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def not_stored(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New cases without an open stored one of the same entity and fingerprint."""
    live = stored.where(F.col("status").isin(*C.LIVE_STATUSES)).select("entity_id", "fingerprint")
    return new.join(live, ["entity_id", "fingerprint"], "left_anti")
