"""Peer groups: entities' profiles in every context, and how far each lies from comparable ones.

A finding depends on the entity and the group alone, so scores and reasons are made once for each
(scope, entity) and joined to events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..sources.tables import made_of
from ..spec import EventSpec
from . import quantiles
from .baselines import in_scopes
from .results import reason, sorted_reasons


def metrics(spec: EventSpec) -> list[str]:
    return [*(f"mean:{f}" for f in spec.numeric), *(f"rate:{f}" for f in spec.rates)]


def profiles(events: DataFrame, spec: EventSpec, min_events: int = C.PEER_MIN_EVENTS) -> DataFrame:
    """(scope_key, depth, entity, event_count, metric, value) of entities with enough events in the scope:
    means of the numeric features and non-zero shares of the rate features."""
    scoped = in_scopes(events.select(*dict.fromkeys([spec.entity, *spec.dimensions, *spec.numeric, *spec.rates])), spec.dimensions)
    aggregates = [F.avg(F.col(f).cast("double")).alias(f"mean:{f}") for f in spec.numeric]
    aggregates += [F.avg((F.col(f) != 0).cast("double")).alias(f"rate:{f}") for f in spec.rates]
    wide = scoped.groupBy("scope_key", "depth", F.col(spec.entity).alias("entity")).agg(F.count(F.lit(1)).alias("event_count"), *aggregates)
    wide = wide.where(F.col("event_count") >= min_events)
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in metrics(spec)])
    return wide.select("scope_key", "depth", "entity", "event_count", F.explode(cells).alias("c")).select("scope_key", "depth", "entity", "event_count", "c.*").where("value IS NOT NULL")


def stats(profile: DataFrame, min_entities: int = C.PEER_MIN_ENTITIES) -> DataFrame:
    """(scope_key, metric, median, sigma, peers) of groups and metrics with enough entities of finite values. The result is stored."""
    values = profile.select("scope_key", "metric", "value", F.lit(1).alias("n"))
    rows = quantiles.statistics(values, ("scope_key", "metric"), shares=(0.5,), least_values=min_entities, inflated=False)
    sigma = F.col("mad") * C.MAD_TO_SIGMA
    sigma = F.when(sigma > 0, sigma).otherwise((F.col("max") - F.col("min")) / 4)
    return made_of(rows.select("scope_key", "metric", F.col("q")[0].alias("median"), sigma.alias("sigma"), F.col("count").alias("peers")), rows)


def deviation(value: Column, median: Column, sigma: Column) -> Column:
    """Score of a value above its peers; null for one that isn't."""
    z = F.when(sigma > 0, (value - median) / sigma)
    return F.when(z > 0, S.squash(z, C.PEER_KNEE))


def findings(profile: DataFrame, stats_: DataFrame) -> DataFrame:
    """(scope_key, entity, peer_all, peer_rates): score and reasons over all metrics, and over the
    scale-free ones. Every profile of a group large enough is there, with or without a finding."""
    sizes = profile.select("scope_key", "entity").distinct().groupBy("scope_key").agg(F.count(F.lit(1)).alias("entities")).where(F.col("entities") >= C.PEER_MIN_ENTITIES)
    rows = profile.join(sizes, "scope_key").join(stats_, ["scope_key", "metric"], "left").withColumn("d", deviation(F.col("value"), F.col("median"), F.col("sigma")))
    kind, name = F.substring_index("metric", ":", 1), F.substring_index("metric", ":", -1)
    text = F.concat(
        F.when(kind == "rate", F.concat(F.lit("share of non-zero "), name)).otherwise(F.concat(F.lit("mean "), name)), F.lit(" is "), F.round("value", 4).cast("string"),
        F.lit(" over "), F.col("event_count").cast("string"), F.lit(" events; the median of "), F.col("peers").cast("string"), F.lit(" comparable entities is "), F.round("median", 4).cast("string"),
    )
    half = F.col("sigma") * C.PEER_KNEE
    why = reason("peer_group", F.col("metric"), F.round("value", 6).cast("string"), F.round("value", 6), F.col("median") - half, F.col("median") + half, F.col("d"), text, F.col("scope_key"))
    item = F.when(F.col("d").isNotNull(), F.struct(F.col("d"), (kind == "rate").alias("rate"), why.alias("why")))
    grouped = rows.groupBy("scope_key", "entity").agg(F.collect_list(item).alias("items"))

    def summary(items: Column) -> Column:
        strong = F.filter(items, lambda i: i["d"] >= C.PEER_REASON)
        return F.struct(F.coalesce(F.array_max(F.transform(items, lambda i: i["d"])), F.lit(0.0)).alias("score"), sorted_reasons(F.transform(strong, lambda i: i["why"])).alias("reasons"))

    return grouped.select("scope_key", "entity", summary(F.col("items")).alias("peer_all"), summary(F.filter("items", lambda i: i["rate"])).alias("peer_rates"))


def resolve(events: DataFrame, found: DataFrame, spec: EventSpec) -> DataFrame:
    """``events`` with ``peer``: struct<scope, score, reasons> of the finest group that knows the entity, over
    scale-free metrics where it isn't the event's own scope; null if none knows it."""
    rows, out = events, F.lit(None)
    keys = S.scope_keys(spec.dimensions)
    full = len(spec.dimensions)
    for depth in range(full, -1, -1):
        side = found.select(F.col("scope_key").alias(f"_p{depth}"), F.col("entity").alias(f"_e{depth}"), F.col("peer_all" if depth == full else "peer_rates").alias(f"_f{depth}"))
        rows = rows.withColumn(f"_s{depth}", keys[depth]).join(side, (F.col(f"_s{depth}") == F.col(f"_p{depth}")) & (F.col(spec.entity) == F.col(f"_e{depth}")), "left")
        own = F.when(F.col(f"_f{depth}").isNotNull(), F.struct(F.col(f"_s{depth}").alias("scope"), F.col(f"_f{depth}.score"), F.col(f"_f{depth}.reasons")))
        out = own if depth == full else F.coalesce(out, own)
    return rows.withColumn("peer", out).drop(*[f"_{n}{d}" for d in range(full + 1) for n in "pefs"])
