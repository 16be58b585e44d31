"""Order and history: the split in time, and an entity's earlier comparable events."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..spec import EventSpec

#: Rows that one task may order.
FEW_ROWS = 200_000


def _at(spec: EventSpec) -> Column:
    """The time in microseconds; an event without one is at the epoch."""
    return F.coalesce(F.unix_micros(F.col(spec.time).cast("timestamp")), F.lit(0))


def cutoff(events: DataFrame, spec: EventSpec, ratio: float = C.TRAIN_RATIO) -> tuple[object, object] | None:
    """(time in microseconds, id) of the last training event: the floor(n * ratio)-th in order. No global
    sort: hours are counted first, then seconds and microseconds of what holds the place, until few rows are left to
    order. Of one instant with many rows the ids are dealt out in ranges, and one range is ordered."""
    rows = events.select(_at(spec).alias("at"), F.col(spec.event_id).alias("id"))
    n = rows.count()
    place = math.floor(n * float(ratio))
    if place < 1:
        return None
    # narrower and narrower spans of time, by counts alone, until one instant or a few rows are left
    held, span = (None, None), 3_600_000_000
    while True:
        inside = rows if held[0] is None else rows.where(F.col("at").between(*held))
        counts = inside.groupBy(F.floor(F.col("at") / span).alias("span")).agg(F.count(F.lit(1)).alias("n"))
        order = Window.orderBy("span")  # one row for each span: hours of the log, then parts of one
        upto = counts.select("span", "n", F.sum("n").over(order).alias("upto")).where(F.col("upto") >= place).orderBy("span").first()
        place -= upto["upto"] - upto["n"]
        held = upto["span"] * span, upto["span"] * span + span - 1
        if span == 1 or upto["n"] <= FEW_ROWS:
            break
        span = max(1, span // 3600)
    inside = rows.where(F.col("at").between(*held))
    if upto["n"] <= FEW_ROWS:
        found = inside.withColumn("rn", F.row_number().over(Window.orderBy("at", "id"))).where(F.col("rn") == place).first()
    else:  # one instant: the place by ids, which are dealt out over tasks in order
        from ..sources.tables import materialised

        dealt = materialised(inside.repartitionByRange("id").select("id", F.spark_partition_id().alias("part")))
        parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", "n", F.sum("n").over(Window.orderBy("part")).alias("upto"))
        part = parts.where(F.col("upto") >= place).orderBy("part").first()
        place -= part["upto"] - part["n"]
        ids = dealt.where(F.col("part") == part["part"]).withColumn("rn", F.row_number().over(Window.orderBy("id"))).where(F.col("rn") == place).first()
        return held[0], ids["id"]
    return found["at"], found["id"]


def is_training(spec: EventSpec, cut: tuple[object, object] | None) -> Column:
    if cut is None:
        return F.lit(False)
    at = _at(spec)
    return (at < cut[0]) | ((at == cut[0]) & (F.col(spec.event_id) <= F.lit(cut[1])))


def split(events: DataFrame, spec: EventSpec, ratio: float = C.TRAIN_RATIO) -> DataFrame:
    """``events`` with ``training``: whether the event is among the first floor(n * ratio)."""
    return events.withColumn("training", is_training(spec, cutoff(events, spec, ratio)))


def with_ordinal(events: DataFrame, spec: EventSpec) -> DataFrame:
    """``rn``: an event's place among its entity's."""
    return events.withColumn("rn", F.row_number().over(Window.partitionBy(spec.entity).orderBy(F.col(spec.time), F.col(spec.event_id))))


def frame(spec: EventSpec, depth: int, limit: int = C.HISTORY_LIMIT):
    """The entity's last ``limit`` earlier events that agree on the first ``depth`` dimensions: a range over
    ``rn`` truncates first and filters then, without lists."""
    keys = [F.coalesce(F.col(d).cast("string"), F.lit("")) for d in spec.dimensions[:depth]]
    return Window.partitionBy(F.col(spec.entity), *keys).orderBy("rn").rangeBetween(-limit, -1)


def scope_frame(spec: EventSpec, limit: int = C.HISTORY_LIMIT):
    """The last ``limit`` earlier events of the full scope, whoever's: over ``scope_rn``, a place in the scope."""
    keys = [F.coalesce(F.col(d).cast("string"), F.lit("")) for d in spec.dimensions]
    return Window.partitionBy(*keys).orderBy("scope_rn").rangeBetween(-limit, -1)


def with_scope_ordinal(events: DataFrame, spec: EventSpec) -> DataFrame:
    """``scope_rn``: an event's place in its full scope."""
    keys = [F.coalesce(F.col(d).cast("string"), F.lit("")) for d in spec.dimensions]
    return events.withColumn("scope_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(spec.time), F.col(spec.event_id))))


def depth_for(spec: EventSpec, min_events: int, limit: int = C.HISTORY_LIMIT) -> Column:
    """The deepest prefix with ``min_events`` earlier events, else 1 (0 without dimensions)."""
    out = F.lit(min(1, len(spec.dimensions)))
    for depth in range(1, len(spec.dimensions) + 1):
        out = F.when(F.count(F.lit(1)).over(frame(spec, depth, limit)) >= min_events, F.lit(depth)).otherwise(out)
    return out


def at_depth(spec: EventSpec, depth_col: str, over) -> Column:
    """``over(frame)`` of the depth that ``depth_col`` names."""
    if not spec.dimensions:
        return over(frame(spec, 0))
    out = None
    for depth in range(1, len(spec.dimensions) + 1):
        test, value = F.col(depth_col) == depth, over(frame(spec, depth))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def rolling_windows(events: DataFrame, order: Sequence[str], n: int, values: str, partition: Sequence[str] = ()) -> DataFrame:
    """``events`` with ``window``: the ``values`` of the n rows before each."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-n, -1)
    return events.withColumn("window", F.collect_list(values).over(w))
