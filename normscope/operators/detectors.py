"""The six detectors as columns over events. Each adds one ``RESULT`` struct named ``d_<detector>``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkAttributeError, PySparkException, PySparkTypeError, PySparkValueError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..spec import EventSpec
from . import baselines, forest, peers, walks
from .walks import best_split  # noqa: F401
from .results import largest, listed, no_reasons, reason, result, shown


@dataclass(frozen=True)
class Learned:
    """What a training slice gives; every table is small beside the log. ``peers``: findings about the entities of ``peer_groups``;
    ``forests``: see ``forest.publish``."""

    samples: DataFrame
    numeric: DataFrame
    categorical: DataFrame
    peer_groups: DataFrame | None = None
    peers: DataFrame | None = None
    forests: DataFrame | None = None


@dataclass(frozen=True)
class Run:
    """What detectors are planned with: the declared roles, the training slice (None where a stored version scores) and what was learned."""

    spec: EventSpec
    training: DataFrame | None
    learned: Learned
    is_scored: Column

    @property
    def numeric(self) -> DataFrame:
        return self.learned.numeric

    @property
    def categorical(self) -> DataFrame:
        return self.learned.categorical


@dataclass(frozen=True)
class Detector:
    """An extension point: ``plan`` adds ``d_<name>``, a ``RESULT``, to the events. One of the whole log (``on_log``)
    sees it with the ordinal ``rn``, before the training slice goes; others see ``baseline_scope``."""

    name: str
    plan: Callable[[DataFrame, Run], DataFrame]
    on_log: bool = False


#: What the notes of detectors that raised begin with.
FAILED = "failed: "

#: In the order in which results are fused.
REGISTRY: dict[str, Detector] = {}


def register(detector: Detector) -> Detector:
    """Makes a detector known to runs; one of the same name is replaced."""
    REGISTRY[detector.name] = detector
    return detector


def abstained(name: str, note: str) -> Column:
    return result(name, F.lit(False), F.lit(0.0), no_reasons(), note=note)


#: Conditions of analysis that tell of storage, not of a detector's plan.
_STORAGE = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE")


def is_own(error: Exception) -> bool:
    """Whether an error of planning is the detector's own. Those of storage, of Spark jobs and of the session are not: they stop the run."""
    if isinstance(error, PySparkException):
        plan = isinstance(error, AnalysisException | PySparkTypeError | PySparkValueError | PySparkAttributeError)
        return plan and not str(error.getCondition() or "").startswith(_STORAGE)
    return not isinstance(error, OSError | Py4JError)


def planned(detector: Detector, events: DataFrame, run: Run) -> DataFrame:
    """``events`` with the detector's result. A detector that can't be planned abstains everywhere, and its
    notes say why: it never fails the run. What fails storage or Spark does."""
    column = f"d_{detector.name}"
    try:
        rows = detector.plan(events, run)
        if rows.schema[column].dataType != events.select(abstained("", "").alias("x")).schema["x"].dataType:
            raise TypeError(f"{column} isn't a result")
        return rows
    except Exception as error:
        if not is_own(error):
            raise
        return events.withColumn(column, abstained(detector.name, failure(error)))


def failure(error: Exception) -> str:
    """The note of a detector that raised; ``is_failure`` tells it from those that abstain for want of data."""
    return f"{FAILED}{type(error).__name__}: {error}"[:300]


def is_failure(result_: Column) -> Column:
    return ~result_["applicable"] & F.coalesce(result_["note"].startswith(FAILED), F.lit(False))


def failed_note(error: Column, otherwise: Column) -> Column:
    return F.coalesce(F.when(error.isNotNull(), F.concat(F.lit(FAILED), error)), otherwise)


def of_function(name: str, columns: Sequence[str], score: Callable[[pd.DataFrame], pd.Series], *, on_log: bool = False) -> Detector:
    """A detector from a function of a frame of ``columns`` to scores (NaN: abstains). Rows of a batch in
    which the function raises abstain, with the error as their note."""

    @F.pandas_udf("struct<score:double,error:string>")
    def guarded(*values: pd.Series) -> pd.DataFrame:
        frame = pd.concat(values, axis=1, keys=list(columns))
        try:
            found, error = pd.Series(score(frame), index=frame.index, dtype=float), None
        except Exception as e:
            found, error = pd.Series(np.nan, index=frame.index), f"{type(e).__name__}: {e}"[:300]
        return pd.DataFrame({"score": found, "error": error})

    def plan(events: DataFrame, run: Run) -> DataFrame:
        got = guarded(*[F.col(c) for c in columns])
        rows = events.withColumn("_found", got)
        score_ = F.col("_found.score")
        value = F.when(score_.isNotNull() & ~F.isnan(score_), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score_)))
        out = result(name, value.isNotNull(), value, no_reasons(), note="no score")
        note = F.when(~out["applicable"], failed_note(F.col("_found.error"), out["note"]))
        return rows.withColumn(f"d_{name}", out.withField("note", note)).drop("_found")

    return Detector(name, plan, on_log)


def robust_deviation(events: DataFrame, numeric: DataFrame, spec: EventSpec) -> DataFrame:
    """Distance from the resolved scope's median. ``events`` has ``baseline_scope``."""
    rows = events.join(baselines.stats_by_scope(numeric), "baseline_scope", "left")
    scores, why = [], []
    for f in spec.numeric:
        s, v = F.element_at("num", F.lit(f)), F.col(f).cast("double")
        d = S.squash(S.robust_z(v, s["median"], s["sigma"], s["zero_inflated"], s["informative"]), C.ROBUST_KNEE)
        scores.append(d)
        lo, hi = s["median"] - 3 * s["sigma"], s["median"] + 3 * s["sigma"]
        text = F.concat(F.lit(f"{f} is "), shown(v), F.lit("; usual for "), S.describe_scope(F.col("baseline_scope")), F.lit(" is "), shown(lo), F.lit(" to "), shown(hi))
        why.append((d >= C.ROBUST_REASON, reason("robust_deviation", F.lit(f), v.cast("string"), v, lo, hi, d, text, F.col("baseline_scope"))))
    ok = F.col("num").isNotNull() & F.lit(bool(spec.numeric))
    return rows.withColumn("d_robust_deviation", result("robust_deviation", ok, largest(scores), listed(why), scope=F.col("baseline_scope"), note="no numeric baseline")).drop("num")


def categorical_rarity(events: DataFrame, categorical: DataFrame, spec: EventSpec) -> DataFrame:
    """Rarity of values in the resolved scope; an unseen one has no frequency."""
    totals = categorical.groupBy(F.col("scope_key").alias("baseline_scope")).agg(
        F.map_from_entries(F.collect_set(F.struct("feature", F.struct("count", "distinct_values")))).alias("cat")
    )
    rows, scores, why = events.join(totals, "baseline_scope", "left"), [], []
    for i, f in enumerate(spec.categorical):
        side = categorical.where(F.col("feature") == f).select(F.col("scope_key").alias(f"_s{i}"), F.col("cat_value").alias(f"_v{i}"), F.col("share").alias(f"_share{i}"))
        v = F.col(f).cast("string")
        rows = rows.join(side, (F.col("baseline_scope") == F.col(f"_s{i}")) & (v == F.col(f"_v{i}")), "left")
        total, share = F.element_at("cat", F.lit(f)), F.coalesce(F.col(f"_share{i}"), F.lit(0.0))
        d = F.when(S.present(v) & total.isNotNull(), S.rarity(share, total["count"], total["distinct_values"]))
        scores.append(d)
        text = F.concat(
            F.lit(f"{f} {{"), v, F.lit("} "), F.when(share == 0, F.lit("is new")).otherwise(F.concat(F.lit("makes up "), F.round(100 * share, 2).cast("string"), F.lit(" %"))),
            F.lit(" among "), total["count"].cast("string"), F.lit(" events of "), S.describe_scope(F.col("baseline_scope")),
        )
        why.append((d >= C.RARITY_REASON, reason("categorical_rarity", F.lit(f), v, F.lit(None), F.lit(None), F.lit(None), d, text, F.col("baseline_scope"))))
    out = result("categorical_rarity", F.col("cat").isNotNull() & F.lit(bool(spec.categorical)), largest(scores), listed(why), scope=F.col("baseline_scope"), note="no categorical baseline")
    return rows.withColumn("d_categorical_rarity", out).drop("cat", *[f"_{n}{i}" for i in range(len(spec.categorical)) for n in ("s", "v", "share")])


def rolling_parts(spec: EventSpec) -> list[tuple[str, Column, Column, Column]]:
    """(feature, score or null, upper, median) from ``rq`` of ``walks``."""
    out = []
    for i, f in enumerate(spec.numeric):
        p, v = F.get("rq.parts", F.lit(i)), F.col(f).cast("double")
        inflated = (p["n"] - p["nz"]) / F.nullif(p["n"], F.lit(0)) >= C.ZERO_INFLATION_SHARE
        usable = (p["n"] >= C.ROLLING_MIN_HISTORY) & (~inflated | ((v != 0) & (p["nz"] >= C.MIN_INFORMATIVE)))
        out.append((f, F.when(usable, S.excess_score(v, p["upper"], p["median"])), p["upper"], p["median"]))
    return out


def _walked(events: DataFrame, spec: EventSpec, kind: str, only: Column | None) -> DataFrame:
    return events if kind in events.columns else walks.walked(events, spec, [kind], only)


def rolling_quantile(events: DataFrame, spec: EventSpec, only: Column | None = None) -> DataFrame:
    """Above the entity's own recent 90th percentile. ``events`` is the whole log with ``rn``, or has ``rq`` of ``walks``; of the
    rows that ``only`` holds for, if it is given."""
    rows = _walked(events, spec, "rq", only)
    scores, why = [], []
    for f, d, upper, median in rolling_parts(spec):
        scores.append(d)
        v = F.col(f).cast("double")
        text = F.concat(F.lit(f"{f} is "), shown(v), F.lit("; this entity's recent 90th percentile is "), shown(upper), F.lit(", its median "), shown(median))
        why.append((d >= C.ROLLING_REASON, reason("rolling_quantile", F.lit(f), v.cast("string"), v, median, upper, d, text, F.lit("entity_history"))))
    out = result("rolling_quantile", F.col("rq.n") >= C.ROLLING_MIN_HISTORY, largest(scores), listed(why), note="too few comparable earlier events")
    return rows.withColumn("d_rolling_quantile", _noted(out, F.col("rq.error"))).drop("rq")


def _noted(out: Column, error: Column) -> Column:
    return out.withField("note", F.when(~out["applicable"], failed_note(error, out["note"])))


def change_point(events: DataFrame, spec: EventSpec, only: Column | None = None) -> DataFrame:
    """A lasting shift of the entity's level. ``events`` is the whole log with ``rn``, or has ``cp`` of ``walks``; of the
    rows that ``only`` holds for, if it is given."""
    rows, scores, why = _walked(events, spec, "cp", only), [], []
    for i, f in enumerate(spec.numeric):
        c, v = F.get("cp.parts", F.lit(i)), F.col(f).cast("double")
        d = F.when(c["strength"] >= C.CHANGE_STRENGTH, c["strength"])
        scores.append(d)
        text = F.concat(F.lit(f"the mean of {f} "), F.when(c["after"] > c["before"], "rose").otherwise("fell"), F.lit(" from "), shown(c["before"]), F.lit(" to "), shown(c["after"]), F.lit(" and stayed"))
        lo, hi = F.least(c["before"], c["after"]), F.greatest(c["before"], c["after"])
        why.append((d.isNotNull(), reason("change_point", F.lit(f), v.cast("string"), v, lo, hi, d, text, F.lit("entity_history"))))
    out = result("change_point", F.col("cp.n") >= C.CHANGE_MIN_HISTORY, largest(scores), listed(why), note="too few comparable earlier events")
    return rows.withColumn("d_change_point", _noted(out, F.col("cp.error"))).drop("cp")


def peer_findings(training: DataFrame, spec: EventSpec) -> DataFrame:
    """What ``peer_group`` says of every entity of the training slice in every scope."""
    profile = peers.profiles(training, spec)
    return peers.findings(profile, peers.stats(profile))


def peer_group(events: DataFrame, training: DataFrame | None, spec: EventSpec, findings: DataFrame | None = None) -> DataFrame:
    """The entity's aggregate behaviour against comparable entities: those of the training slice, or stored ``findings``."""
    rows = peers.resolve(events, peer_findings(training, spec) if findings is None else findings, spec)
    out = result("peer_group", F.col("peer").isNotNull(), F.col("peer.score"), F.col("peer.reasons"), scope=F.col("peer.scope"), note="no group knows this entity")
    return rows.withColumn("d_peer_group", out).drop("peer")


def isolation_forest(events: DataFrame, training: DataFrame | None, spec: EventSpec, forests: DataFrame | None = None) -> DataFrame:
    """Odd combinations of values, by a forest for each scope: of the training slice, or stored ones. A scope whose forest didn't grow, and rows
    whose margin raises, abstain with the error as their note."""
    rows = forest.score(events, forest.publish(forest.fit(training, spec)) if forests is None else forests, spec, errors="forest_error")
    name = "+".join(spec.numeric)
    observed = F.to_json(F.struct(*[F.col(f).cast("double").alias(f) for f in spec.numeric])) if spec.numeric else F.lit(None)
    d = S.margin_score(F.col("forest_margin"))
    text = F.concat(F.lit(f"the values of {', '.join(spec.numeric)} seldom meet in "), S.describe_scope(F.col("baseline_scope")))
    why = [(d >= C.FOREST_REASON, reason("isolation_forest", F.lit(name), observed, F.lit(None), F.lit(None), F.lit(None), d, text, F.col("baseline_scope")))]
    out = result("isolation_forest", F.col("forest_margin").isNotNull(), d, listed(why), raw=F.col("forest_margin"), scope=F.col("baseline_scope"), note="no model, or a value is missing")
    return rows.withColumn("d_isolation_forest", _noted(out, F.col("forest_error"))).drop("forest_margin", "forest_error")


for _detector in (
    Detector("robust_deviation", lambda events, run: robust_deviation(events, run.numeric, run.spec)),
    Detector("categorical_rarity", lambda events, run: categorical_rarity(events, run.categorical, run.spec)),
    Detector("isolation_forest", lambda events, run: isolation_forest(events, run.training, run.spec, run.learned.forests)),
    Detector("rolling_quantile", lambda events, run: rolling_quantile(events, run.spec), on_log=True),
    Detector("change_point", lambda events, run: change_point(events, run.spec, only=run.is_scored), on_log=True),
    Detector("peer_group", lambda events, run: peer_group(events, run.training, run.spec, run.learned.peers)),
):
    register(_detector)
