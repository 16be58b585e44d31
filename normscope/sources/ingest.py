"""Idempotent batch ingestion: validate, derive ids, drop what is known, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..spec import EventSpec

MAX_BATCH = 20_000
MAX_MISSING, MAX_ERRORS = 5, 50


def problems(spec: EventSpec, payload: Column, occurred_at: Column) -> Column:
    """What is wrong with an event, as text; a declared numeric key may be null but not missing."""
    entity = F.trim(F.coalesce(F.element_at(payload, F.lit(spec.entity)), F.when(F.map_contains_key(payload, F.lit(spec.entity)), F.lit("None"))))
    missing = F.filter(F.array(*[F.lit(f) for f in spec.numeric]).cast("array<string>"), lambda f: ~F.map_contains_key(payload, f))
    return F.array_compact(F.array(
        F.when(F.coalesce(entity, F.lit("")) == "", F.lit(f"no entity key '{spec.entity}'")),
        F.when(occurred_at.isNull(), F.lit(f"no readable '{spec.time}'")),
        F.when(F.size(missing) > 0, F.concat(F.lit("undeclared values of: "), F.array_join(F.slice(missing, 1, MAX_MISSING), ", "))),
    ))


def validated(batch: DataFrame, spec: EventSpec) -> DataFrame:
    """From (idx, external_id, occurred_at, payload map<string,string>): entity_id, at, key and problems."""
    payload = F.col("payload")
    at = F.coalesce(F.col("occurred_at").cast("timestamp"), S.parsed_time(F.element_at(payload, F.lit(spec.time))))
    entity = F.trim(F.coalesce(F.element_at(payload, F.lit(spec.entity)), F.lit("None")))
    derived = F.concat(entity, F.lit(":"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX"))
    key = F.coalesce(F.nullif("external_id", F.lit("")), F.nullif(F.element_at(payload, F.lit(spec.event_id)), F.lit("")), derived)
    return batch.select("idx", entity.alias("entity_id"), at.alias("at"), key.alias("external_key"), "payload", problems(spec, payload, at).alias("problems"))


def outcomes(batch: DataFrame, spec: EventSpec, known: DataFrame, *, bounded: bool = False) -> DataFrame:
    """``validated`` rows with ``outcome``: rejected, duplicate or accepted. A rejected row uses up no id;
    of equal ids in the batch the first stands. ``bounded``: the batch is known to have MAX_BATCH rows at most, so its keys go to where the store's lie."""
    rows = validated(batch, spec)
    good = rows.where(F.size("problems") == 0)
    first = F.row_number().over(Window.partitionBy("external_key").orderBy("idx")) == 1
    # the store's keys are met by the batch's, so no shuffle but of those that both have; of its key column alone, unsorted and as it lies
    asked = good.select("external_key").distinct()
    seen = known.select("external_key").join(F.broadcast(asked) if bounded else asked, "external_key", "left_semi").distinct().withColumn("_known", F.lit(True))
    good = good.withColumn("_first", first).join(seen, "external_key", "left")
    good = good.withColumn("outcome", F.when(F.col("_known").isNull() & F.col("_first"), "accepted").otherwise("duplicate")).drop("_first", "_known")
    return good.unionByName(rows.where(F.size("problems") > 0).withColumn("outcome", F.lit("rejected")))


def summary(outcome: DataFrame) -> DataFrame:
    return outcome.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("accepted", "accepted"), ("duplicate", "duplicates"), ("rejected", "rejected"))])


def errors(outcome: DataFrame) -> DataFrame:
    return outcome.where("outcome = 'rejected'").select("idx", "problems").orderBy("idx").limit(MAX_ERRORS)
