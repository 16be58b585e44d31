"""What detectors give: reasons and results as structs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

REASON = "struct<detector:string,feature:string,observed:string,observed_num:double,lo:double,hi:double,deviation:double,explanation:string,scope:string>"
RESULT = f"struct<detector:string,version:string,applicable:boolean,raw_score:double,score:double,scope:string,note:string,reasons:array<{REASON}>>"


def reason(detector: str, feature: Column, observed: Column, observed_num: Column, lo: Column, hi: Column, deviation: Column, explanation: Column, scope: Column) -> Column:
    return F.struct(
        F.lit(detector).alias("detector"), feature.alias("feature"), observed.alias("observed"), observed_num.cast("double").alias("observed_num"), lo.cast("double").alias("lo"),
        hi.cast("double").alias("hi"), F.round(deviation, 4).alias("deviation"), explanation.alias("explanation"), scope.alias("scope"),
    ).cast(REASON)


def no_reasons() -> Column:
    return F.array().cast(f"array<{REASON}>")


def sorted_reasons(reasons: Column) -> Column:
    """Largest deviation first; equal ones stay in order."""
    numbered = F.transform(reasons, lambda r, i: F.struct((-r["deviation"]).alias("d"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(numbered), lambda x: x["r"])


def listed(candidates: Sequence[tuple[Column, Column]]) -> Column:
    """Reasons whose condition holds, from (condition, reason) pairs."""
    if not candidates:
        return no_reasons()
    return sorted_reasons(F.array_compact(F.array(*[F.when(test, r) for test, r in candidates])))


def result(detector: str, applicable: Column, score: Column, reasons: Column, *, raw: Column | None = None, scope: Column | None = None, note: str = "") -> Column:
    """A detector's result; one that doesn't apply has no score and no reasons."""
    yes = F.coalesce(applicable, F.lit(False))
    value = F.when(yes, F.coalesce(score, F.lit(0.0))).otherwise(F.lit(0.0))
    return F.struct(
        F.lit(detector).alias("detector"), F.lit(C.DETECTOR_VERSION).alias("version"), yes.alias("applicable"),
        (value if raw is None else F.when(yes, raw).otherwise(F.lit(0.0))).alias("raw_score"), value.alias("score"),
        (F.lit(None).cast("string") if scope is None else F.when(yes, scope)).alias("scope"), F.when(~yes, F.lit(note or "too little history")).alias("note"),
        F.when(yes, reasons).otherwise(no_reasons()).alias("reasons"),
    ).cast(RESULT)


def largest(values: Sequence[Column]) -> Column:
    """The greatest of columns, nulls left out; 0 if all are null."""
    return F.coalesce(F.array_max(F.array(*values)), F.lit(0.0)) if values else F.lit(0.0)


def shown(value: Column) -> Column:
    return F.round(value, 2).cast("string")
