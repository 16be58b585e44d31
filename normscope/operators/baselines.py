"""Baselines of every context: robust numeric statistics and categorical frequencies.

The prefixes of the dimensions are a rollup: every event counts in its full scope, in each scope with
dimensions dropped from the right, and in ``*``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..sources.tables import made_of
from . import quantiles

STATS = ("count", "zero_share", "informative", "median", "mad", "sigma", "p05", "p25", "p75", "p95", "min", "max")


def in_scopes(events: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """One row for each event and prefix, with ``scope_key`` and ``depth``."""
    cells = F.array(*[F.struct(F.lit(k).alias("depth"), key.alias("scope_key")) for k, key in enumerate(S.scope_keys(dimensions))])
    return events.withColumn("_scope", F.explode(cells)).select("*", "_scope.depth", "_scope.scope_key").drop("_scope")


def scope_samples(events: DataFrame, dimensions: Sequence[str], min_samples: int = C.MIN_SCOPE_SAMPLES) -> DataFrame:
    """(scope_key, depth, sample_count, adequate); the global scope is always adequate."""
    counts = in_scopes(events.select(*dict.fromkeys(dimensions)), dimensions).groupBy("scope_key", "depth").agg(F.count(F.lit(1)).alias("sample_count"))
    return counts.withColumn("adequate", (F.col("sample_count") >= min_samples) | (F.col("depth") == 0))


def unpivot(rows: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., feature, value) of the non-null numeric values."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return rows.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.feature", "_c.value").where("value IS NOT NULL")


def numeric_stats(values: DataFrame, keys: Sequence[str], *, floor: bool = True, digits: int | None = 6, min_values: int = C.MIN_NUMERIC_VALUES, **layout: object) -> DataFrame:
    """Robust statistics of the finite ``value`` in every group of ``keys``. Where zeros make up the share
    ZERO_INFLATION_SHARE or more, they describe the non-zero values, unless those are fewer than
    three. A row stands for ``n`` equal values; ``layout``: see ``quantiles.statistics``. The result is stored."""
    rows = quantiles.statistics(values, keys, least_values=min_values, **layout)
    median, sigma = F.col("q")[0], F.col("mad") * C.MAD_TO_SIGMA
    if floor:
        sigma = F.greatest(sigma, F.abs(median) * C.RELATIVE_SIGMA_FLOOR)
    sigma = F.when(sigma > 0, sigma).otherwise((F.col("max") - F.col("min")) / 4)
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return made_of(rows.select(
        *keys, "count", F.round("exact_share", 4).alias("zero_share"), "informative", r(median).alias("median"), r(F.col("mad")).alias("mad"), r(sigma).alias("sigma"),
        *[r(F.col("q")[k]).alias(n) for k, n in ((1, "p05"), (2, "p25"), (3, "p75"), (4, "p95"))], r(F.col("min")).alias("min"), r(F.col("max")).alias("max"),
        (F.col("exact_share") >= C.ZERO_INFLATION_SHARE).alias("zero_inflated"),
    ), rows)


def numeric_baselines(events: DataFrame, features: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """(scope_key, depth, feature, STATS..., zero_inflated). Equal values of a full scope are counted first,
    so the prefixes repeat distinct values, not events; their cells are counted once and added up."""
    keys = list(dict.fromkeys(dimensions))
    values = unpivot(events.select(*dict.fromkeys([*features, *keys])), features, keys)
    counted = values.groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return numeric_stats(counted, ("scope_key", "depth", "feature"), base=(*keys, "feature"), widen=lambda rows: in_scopes(rows, dimensions).drop(*keys))


def categorical_baselines(events: DataFrame, features: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """(scope_key, depth, feature, cat_value, n, count, distinct_values, share)."""
    scoped = in_scopes(events.select(*dict.fromkeys([*features, *dimensions])), dimensions)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("cat_value")) for f in features])
    values = scoped.select("scope_key", "depth", F.explode(cells).alias("_c")).select("scope_key", "depth", "_c.*").where(S.present(F.col("cat_value")))
    counts = values.groupBy("scope_key", "depth", "feature", "cat_value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("scope_key", "feature").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("distinct_values"))
    return counts.join(totals, ["scope_key", "feature"]).select(
        "scope_key", "depth", "feature", "cat_value", "n", "count", "distinct_values", (F.col("n") / F.col("count")).alias("share")
    )


def parents(key: Column, dimensions: Sequence[str]) -> list[Column]:
    """Keys of the ancestors of a stored scope, nearest first, ending with ``*``. They are built from the
    scope's own conditions, so dimensions in any order of names work."""
    match = S.scope_match(key)
    out = []
    for k in range(len(dimensions) - 1, 0, -1):
        kept = sorted(dimensions[:k])
        known = F.element_at(match, F.lit(dimensions[k - 1])).isNotNull() & (F.size(match) > k)
        out.append(F.when(known, F.concat_ws("|", *[F.concat(F.lit(f"{d}="), F.element_at(match, F.lit(d))) for d in kept])))
    return [*out, F.when(key != "*", F.lit("*"))]


def with_fallback(numeric: DataFrame, samples: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Statistics for every scope and feature: thin scopes take those of the nearest adequate ancestor and
    say so in ``fallback_from``; their own ``sample_count`` stays."""
    keys = [c.alias(f"p{k}") for k, c in enumerate(parents(F.col("scope_key"), dimensions))]
    rows = samples.select("*", *keys)
    for k in range(len(keys)):
        ok = samples.where("adequate").select(F.col("scope_key").alias(f"p{k}"), F.lit(True).alias(f"ok{k}"))
        rows = rows.join(ok, f"p{k}", "left")
    source = F.when(F.col("adequate"), F.col("scope_key"))
    for k in range(len(keys)):
        source = F.coalesce(source, F.when(F.col(f"ok{k}"), F.col(f"p{k}")))
    rows = rows.select("scope_key", "depth", "sample_count", "adequate", source.alias("stats_scope"))
    stats = numeric.drop("depth").withColumnRenamed("scope_key", "stats_scope")
    return rows.join(stats, "stats_scope").withColumn("fallback_from", F.when(F.col("stats_scope") != F.col("scope_key"), F.col("stats_scope"))).drop("stats_scope")


def resolve_scope(events: DataFrame, samples: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """``events`` with ``baseline_scope``: the most specific adequate scope, never a thin one."""
    adequate = samples.where("adequate").select("scope_key", F.lit(True).alias("ok"))
    rows, chosen = events, F.lit(None).cast("string")
    keys = S.scope_keys(dimensions)
    for depth in range(len(dimensions), 0, -1):
        side = adequate.select(F.col("scope_key").alias(f"_k{depth}"), F.col("ok").alias(f"_ok{depth}"))
        rows = rows.withColumn(f"_k{depth}", keys[depth]).join(side, f"_k{depth}", "left")
        chosen = F.coalesce(chosen, F.when(F.col(f"_ok{depth}"), F.col(f"_k{depth}")))
    rows = rows.withColumn("baseline_scope", F.coalesce(chosen, F.lit("*")))
    return rows.drop(*[f"_{n}{d}" for d in range(1, len(dimensions) + 1) for n in ("k", "ok")])


def stats_by_scope(numeric: DataFrame) -> DataFrame:
    """(baseline_scope, num): one map of feature to statistics for each scope."""
    fields = [c for c in numeric.columns if c not in ("scope_key", "depth", "feature")]
    entry = F.struct(F.col("feature"), F.struct(*fields))
    return numeric.groupBy(F.col("scope_key").alias("baseline_scope")).agg(F.map_from_entries(F.collect_list(entry)).alias("num"))
