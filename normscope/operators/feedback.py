"""Human labels: measured precision, and proposals that somebody has to promote."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..spec import EventSpec


def _confirmed():
    return F.col("label").isin(*C.CONFIRMING_LABELS)


def _rejected():
    return F.col("label").isin(*C.REJECTING_LABELS)


def quality(labelled: DataFrame) -> DataFrame:
    """(detector, total, confirmed, rejected, precision) by leading detector, from (strongest, label); most labels first."""
    rows = labelled.groupBy(F.coalesce(F.nullif("strongest", F.lit("")), F.lit("unknown")).alias("detector")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_confirmed()).alias("confirmed"), F.count_if(_rejected()).alias("rejected")
    )
    judged = F.col("confirmed") + F.col("rejected")
    rows = rows.withColumn("precision", F.when(judged > 0, F.round(F.col("confirmed") / judged, 4)).otherwise(F.lit(0.0)))
    return rows.orderBy(F.desc("total"), "detector")  # a row for each detector


def weights(labelled: DataFrame, current: Mapping[str, float] | None = None) -> DataFrame:
    """(detector, total, precision, current, suggested): half way to the precision for detectors with
    enough labels; nothing at all with too few labels in all."""
    known = F.create_map(*[F.lit(x) for pair in (current or {}).items() for x in pair]) if current else None
    now = F.coalesce(F.element_at(known, F.col("detector")), F.lit(1.0)) if known is not None else F.lit(1.0)
    every = labelled.agg(F.count(F.lit(1)).alias("labels"))
    rows = quality(labelled).withColumn("current", now).crossJoin(F.broadcast(every)).where(F.col("labels") >= C.FEEDBACK_OVERALL)  # one row
    target = F.greatest(F.lit(C.WEIGHT_FLOOR), F.least(F.lit(1.0), F.col("precision")))
    moved = F.round(F.col("current") + C.WEIGHT_STEP * (target - F.col("current")), 4)
    judged = (F.col("total") >= C.FEEDBACK_PER_DETECTOR) & (F.abs(moved - F.col("current")) >= C.WEIGHT_MIN_CHANGE)
    return rows.select("detector", "total", "precision", "current", F.when(judged, F.greatest(F.lit(C.WEIGHT_FLOOR), moved)).otherwise(F.col("current")).alias("suggested"))


def threshold(labelled: DataFrame, current: float = C.MIN_SCORE) -> DataFrame:
    """One row (labels, rejected, suggested): a higher threshold where most labels reject; else null."""
    totals = labelled.agg(F.count(F.lit(1)).alias("labels"), F.count_if(_rejected()).alias("rejected"), F.max(F.when(_rejected(), F.col("anomaly_score"))).alias("ceiling"))
    raised = F.least(F.lit(C.SCORE_CAP), F.greatest(F.lit(float(current)), F.round(F.col("ceiling") + C.SCORE_STEP, 1)))
    wanted = (F.col("labels") >= C.FEEDBACK_OVERALL) & (F.col("rejected") / F.greatest("labels", F.lit(1)) > C.REJECT_SHARE) & (raised > current)
    return totals.select("labels", "rejected", F.when(wanted, raised).alias("suggested"))


def policies(labelled: DataFrame) -> DataFrame:
    """Suppressions for repeated rejections of one detector in one scope, with a ceiling just above them; best supported first."""
    every = labelled.agg(F.count(F.lit(1)).alias("labels"))
    rows = labelled.where(_rejected()).groupBy("baseline_scope", "strongest").agg(
        F.count(F.lit(1)).alias("support"), F.max("anomaly_score").alias("ceiling"), F.slice(F.sort_array(F.collect_list("id")), 1, 10).alias("supporting")
    )
    rows = rows.where(F.col("support") >= C.POLICY_SUPPORT).crossJoin(F.broadcast(every)).where(F.col("labels") >= C.FEEDBACK_OVERALL)  # one row
    return rows.select(
        "baseline_scope", F.col("strongest").alias("detector"), "support", F.least(F.lit(C.POLICY_CEILING), F.round(F.col("ceiling") + C.POLICY_MARGIN, 1)).alias("max_score"),
        S.scope_match(F.col("baseline_scope")).alias("match"), "supporting",
    ).orderBy(F.desc("support"), "baseline_scope", "detector")


def promote(spec: EventSpec, labelled: DataFrame, *, apply_weights: bool = False, apply_threshold: bool = False) -> EventSpec:
    """The spec with the chosen parts of a proposal made from the labels as they are now."""
    from dataclasses import replace

    if apply_weights:
        made = {r["detector"]: r["suggested"] for r in weights(labelled, spec.detector_weights).collect() if r["detector"] in C.DETECTORS}
        spec = replace(spec, weights={**spec.weights, **made})
    if apply_threshold:
        raised = threshold(labelled, spec.min_score).first()["suggested"]
        spec = spec if raised is None else replace(spec, min_score=raised)
    return spec
