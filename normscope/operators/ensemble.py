"""Fusing detector results: the strongest is the floor, agreement lifts, abstaining counts nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..spec import EventSpec


def weighted(results: Column, weights: dict[str, float]) -> Column:
    """array<struct<detector, score, weight>> of the applicable results, in declared order."""
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.transform(
        F.filter(results, lambda r: r["applicable"]),
        lambda r: F.struct(r["detector"].alias("detector"), r["score"].alias("score"), F.coalesce(F.element_at(weight, r["detector"]), F.lit(1.0)).alias("weight")),
    )


def recomputed(results: Column, weights: dict[str, float]) -> Column:
    """The score from stored detector results."""
    return F.round(100 * S.combine(weighted(results, weights)), 2)


def strongest(parts: Column) -> Column:
    """The first detector of the best score; null where that is 0."""
    peak = F.array_max(F.transform(parts, lambda r: r["score"]))
    return F.when(peak > 0, F.element_at(F.filter(parts, lambda r: r["score"] == peak), 1)["detector"])


def all_reasons(results: Column) -> Column:
    """Reasons of all applicable detectors, the best detector's first."""
    used = F.filter(results, lambda r: r["applicable"])
    ordered = F.array_sort(F.transform(used, lambda r, i: F.struct((-r["score"]).alias("s"), i.alias("i"), r["reasons"].alias("r"))))
    return F.flatten(F.transform(ordered, lambda x: x["r"]))


def fuse(events: DataFrame, spec: EventSpec, detectors: tuple[str, ...] = C.DETECTORS) -> DataFrame:
    """From columns ``d_<detector>``: results, score (0 to 100), strongest, confidence, severity, reasons,
    support scope and weighted mean."""
    weights = spec.detector_weights
    rows = events.withColumn("results", F.array(*[F.col(f"d_{d}") for d in detectors])).drop(*[f"d_{d}" for d in detectors])
    rows = rows.withColumn("_parts", weighted(F.col("results"), weights))
    applicable = F.size("_parts")
    firing = F.size(F.filter("_parts", lambda r: r["score"] >= C.FIRING_SCORE))
    score = F.round(100 * S.combine(F.col("_parts")), 2)
    rows = rows.withColumns({
        "score": score, "strongest": strongest(F.col("_parts")), "confidence": S.confidence(applicable, firing, len(detectors)),
        "reasons": all_reasons(F.col("results")), "weighted_mean": F.round(S.weighted_mean(F.col("_parts")), 6), "n_applicable": applicable, "n_firing": firing,
        "case_scope": F.coalesce(*[F.nullif(F.col("results")[i]["scope"], F.lit("")) for i in range(len(detectors))], F.lit("")),
    })
    return rows.withColumn("severity", S.severity(F.col("score"))).drop("_parts")
