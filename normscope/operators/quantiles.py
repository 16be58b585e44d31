"""Exact quantiles and their deviations' medians, by selection: one way for groups of every size.

Every finite value has a cell on one scale for all groups, which rises with the value: its sign and the whole part of the logarithm of its
size. So cells are counted once, with map-side partials, and counts of fine groups add up to those of coarse ones. Running counts tell
which cells hold the wanted places. A cell of one value is done. One of at most LEAF rows is ordered by itself; a larger one is cut
between its least and greatest value into PARTS cells, and only those that hold a wanted place go on. Least and greatest part in every
round, and no interval between two doubles can be cut more than a few times, so no outlier and no crowd of near values brings more than LEAF
rows into one ordering.

The median of deviations starts from the same counts: the cells' distances from the median bound it from both sides, and only values of
cells between those bounds are looked at again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..sources.tables import discard, materialised

#: Cells for each factor e of size; parts that a crowded cell is cut into; rows that are ordered together.
CELLS, PARTS, LEAF = 64, 512, 2_000
QUANTILES = (0.5, 0.05, 0.25, 0.75, 0.95)
_FARTHEST = 50_000  # above the logarithms of all doubles, times CELLS


def cell(value: Column) -> Column:
    """Rises with the value."""
    size = F.floor(F.log(F.abs(value)) * CELLS).cast("int") + _FARTHEST
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size)


def _part(value: Column, lo: Column, hi: Column) -> Column:
    """The part of [lo, hi] that holds a value: the first has the least, the last the greatest, those outside are beyond."""
    share = (value / 4 - lo / 4) / F.nullif(hi / 4 - lo / 4, F.lit(0.0))  # quarters don't overflow; of the least doubles they vanish
    inside = F.least(F.lit(PARTS), F.greatest(F.lit(0), F.coalesce(F.floor(share * PARTS).cast("int"), F.lit(PARTS // 2))))
    return F.when(value < lo, -1).when(value > hi, PARTS + 1).when(value == lo, 0).when(value == hi, PARTS).otherwise(inside)


def _counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("rows"), F.min("value").alias("least"), F.max("value").alias("most"))


def _places(n: Column, shares: Sequence[float]) -> Column:
    """The places, from 0, that quantiles of n values lie between."""
    return F.array_distinct(F.array(*[f(F.lit(q) * (n - 1)).cast("long") for q in shares for f in (F.floor, F.ceil)]))


def _located(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cells that hold wanted places, with the number of values before them. ``cells``: (keys..., base, sub, held, rows, least, most,
    wanted); ``base`` values come before the first of those with the same base."""
    upto = F.sum("held").over(Window.partitionBy(*keys, "base").orderBy("sub"))  # a row for each cell
    rows = cells.withColumn("before", F.col("base") + upto - F.col("held"))
    rows = rows.withColumn("wanted", F.filter("wanted", lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("held"))))
    return rows.where(F.size("wanted") > 0)


def _selected(rows: DataFrame, cells: DataFrame, keys: Sequence[str], held: list[DataFrame], widen: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(keys..., at: map of wanted place to value). ``rows``: (..., base, sub, value, n), which ``widen`` gives keys; ``cells``: as
    ``_located`` takes them. ``held`` gets the tables that are stored on the way and may be deleted with the result stored."""
    found = None
    while True:
        seen = Observation()
        pending = _located(cells, keys).observe(seen, F.count_if((F.col("rows") > LEAF) & (F.col("least") < F.col("most"))).alias("large"))
        pending = materialised(pending)
        held.append(pending)
        single = pending.where("least = most").select(*keys, F.explode("wanted").alias("place"), F.col("least").alias("value"))
        small = pending.where((F.col("rows") <= LEAF) & (F.col("least") < F.col("most"))).select(*keys, "base", "sub", "before", "wanted")
        within = Window.partitionBy(*keys, "base", "sub").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ordered = widen(rows).join(small, [*keys, "base", "sub"]).withColumn("upto", F.col("before") + F.sum("n").over(within))
        own = F.filter("wanted", lambda p: (p >= F.col("upto") - F.col("n")) & (p < F.col("upto")))
        step = ordered.select(*keys, F.explode(own).alias("place"), "value").unionByName(single)
        found = step if found is None else found.unionByName(step)
        if not seen.get["large"]:
            break
        large = pending.where((F.col("rows") > LEAF) & (F.col("least") < F.col("most"))).select(*keys, "base", "sub", "before", "least", "most", "wanted")
        inner = widen(rows).join(large, [*keys, "base", "sub"])
        inner = inner.select(*keys, F.col("before").alias("base"), _part(F.col("value"), F.col("least"), F.col("most")).alias("sub"), "value", "n")
        rows, widen = materialised(inner), lambda rows: rows
        held.append(rows)
        cells = _counted(rows, [*keys, "base", "sub"]).join(large.select(*keys, F.col("before").alias("base"), "wanted"), [*keys, "base"])
    return found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("at"))


def _between(at: Column, n: Column, share: float) -> Column:
    """A quantile from the values at its two places, by linear interpolation."""
    place = F.lit(share) * (n - 1)
    low, high = F.floor(place), F.ceil(place)
    x, y = F.element_at(at, low.cast("long")), F.element_at(at, high.cast("long"))
    return F.when((low == high) | (x == y), x).otherwise((high - place) * x + (place - low) * y)


def statistics(
    values: DataFrame, keys: Sequence[str], *, base: Sequence[str] | None = None, widen: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    shares: Sequence[float] = QUANTILES, least_values: int = 1, inflated: bool = True,
) -> DataFrame:
    """(keys..., count, exact_share, informative, q, mad, min, max) of the finite values of every group with at least ``least_values``.
    A row of ``values`` stands for ``n`` equal ones. ``q``: the quantiles of ``shares``, whose first must be 0.5; ``mad``: the median of distances
    from the median. With ``inflated``, a group whose zeros make up ZERO_INFLATION_SHARE or more is described by its
    other values, unless those are fewer than MIN_NUMERIC_VALUES. ``base``: the columns of ``values`` that ``widen`` makes keys of, one row to
    several groups. The result is stored."""
    base, keys, spark = list(keys if base is None else base), list(keys), values.sparkSession
    value = F.col("value")
    finite = values.where(F.abs("value") < float("inf")).select(*base, F.lit(0).cast("long").alias("base"), cell(value).alias("sub"), value, F.col("n").cast("long").alias("n"))
    rows = materialised(finite)
    counted = widen(_counted(rows, [*base, "sub"])).groupBy(*keys, "sub").agg(*[f(c).alias(c) for c, f in (("held", F.sum), ("rows", F.sum), ("least", F.min), ("most", F.max))])
    counted = materialised(counted)
    held = [rows, counted]
    groups = counted.groupBy(*keys).agg(F.sum("held").alias("count"), F.coalesce(F.sum(F.when(F.col("sub") != 0, F.col("held"))), F.lit(0)).alias("other"))
    groups = groups.where(F.col("count") >= least_values).withColumn("exact_share", (F.col("count") - F.col("other")) / F.col("count"))
    without = (F.col("exact_share") >= C.ZERO_INFLATION_SHARE) & (F.col("other") >= C.MIN_NUMERIC_VALUES) if inflated else F.lit(False)
    groups = groups.withColumn("without", without).withColumn("informative", F.when(F.col("without"), F.col("other")).otherwise(F.col("count")))
    cells = counted.join(groups, keys).where(~F.col("without") | (F.col("sub") != 0)).withColumn("base", F.lit(0).cast("long"))
    ends = cells.groupBy(*keys).agg(F.min("least").alias("min"), F.max("most").alias("max"))
    at = _selected(rows, cells.withColumn("wanted", _places(F.col("informative"), shares)), keys, held, widen)
    first = groups.join(ends, keys).join(at, keys).withColumn("q", F.array(*[_between(F.col("at"), F.col("informative"), q) for q in shares])).drop("at", "other")
    first = materialised(first)

    # distances: bounds from the cells' own, then the values of cells between the bounds
    median = F.col("median")
    below, above = F.abs(F.col("least") - median), F.abs(F.col("most") - median)
    near = F.when(median.between(F.col("least"), F.col("most")), F.lit(0.0)).otherwise(F.least(below, above))
    away = cells.select(*keys, "sub", "held", "least", "most").join(first.select(*keys, "informative", F.col("q")[0].alias("median")), keys)
    away = away.select(*keys, "sub", "held", "median", _places(F.col("informative"), (0.5,)).alias("wanted"), near.alias("near"), F.greatest(below, above).alias("far"))
    by = lambda c: F.sum("held").over(Window.partitionBy(*keys).orderBy(c))
    away = away.withColumns({"nearest": by("near"), "farthest": by("far")})
    every = Window.partitionBy(*keys)
    away = away.withColumns({
        "lo": F.min(F.when(F.col("nearest") > F.array_min("wanted"), F.col("near"))).over(every),
        "hi": F.min(F.when(F.col("farthest") > F.array_max("wanted"), F.col("far"))).over(every),
    })
    away = away.withColumn("base", F.coalesce(F.sum(F.when(F.col("far") < F.col("lo"), F.col("held"))).over(every), F.lit(0)))
    away = away.where((F.col("far") >= F.col("lo")) & (F.col("near") <= F.col("hi"))).select(*keys, "sub", "base", "median", "lo", "hi", "wanted")
    distance = F.abs(value - F.col("median"))
    open_ = away.where("lo < hi")
    distances = widen(rows.drop("base")).join(open_, [*keys, "sub"]).select(*keys, "base", _part(distance, F.col("lo"), F.col("hi")).alias("sub"), distance.alias("value"), "n")
    cells = _counted(distances, [*keys, "base", "sub"]).join(open_.select(*keys, "wanted").distinct(), keys)
    found = _selected(distances, cells, keys, held)
    settled = away.where("lo = hi").select(*keys, F.col("lo").alias("mad_settled")).distinct()
    out = first.join(found, keys, "left").join(settled, keys, "left")
    mad = F.coalesce(F.col("mad_settled"), _between(F.col("at"), F.col("informative"), 0.5))
    out = materialised(out.select(*keys, "count", "exact_share", "informative", "q", mad.alias("mad"), "min", "max"))
    discard(spark, first, *held)
    return out
