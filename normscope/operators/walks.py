"""An entity's recent history, walked event by event: what its last HISTORY_LIMIT comparable events say of each.

Batch runs and streams share the walk. It keeps, for every prefix of the dimensions that occurs among the last events, the values in order of
time and in order of size, so that an event costs a few insertions, and quantiles are looked up. In a batch an entity's events are cut
into chunks of CHUNK places, each with the HISTORY_LIMIT places before it, so a hot entity is many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Collection, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..spec import EventSpec

#: Places of an entity that one task walks in a row.
CHUNK = 4_000
ROLLING = "struct<n:int,parts:array<struct<n:long,nz:long,upper:double,median:double>>,error:string>"
CHANGE = "struct<n:int,parts:array<struct<split:int,strength:double,before:double,after:double>>,error:string>"
KINDS = {"rq": ROLLING, "cp": CHANGE}


def best_split(series: np.ndarray, min_segment: int = C.CHANGE_MIN_SEGMENT) -> tuple[int, float, float, float] | None:
    """Place, strength and both means of the split with the least squared error, from prefix sums. The
    first of equal splits."""
    n = len(series)
    if n < 2 * min_segment:
        return None
    shift = series.mean()
    x = series - shift  # smaller numbers lose less
    upto, square = np.cumsum(x), np.cumsum(x * x)
    i = np.arange(min_segment, n - min_segment + 1)
    left, right = upto[i - 1], upto[-1] - upto[i - 1]
    errors = square[-1] - left**2 / i - right**2 / (n - i)
    errors = np.where(errors <= 1e-9 * max(square[-1], 1e-300), 0.0, errors)
    k = int(np.argmin(errors))
    at, error = int(i[k]), float(errors[k])
    before, after = float(left[k] / at + shift), float(right[k] / (n - at) + shift)
    gap = abs(after - before)
    if gap <= 1e-12 * max(abs(before), abs(after), 1e-300):
        return None
    pooled = np.sqrt(error / max(n - 2, 1))
    effect = gap / pooled if pooled > 0 else np.inf
    return at, 1.0 if np.isinf(effect) else float(effect / (effect + 2.0)), before, after


def quantile(values: Sequence[float], share: float) -> float:
    """Of ordered values, by linear interpolation."""
    place = share * (len(values) - 1)
    low = int(place)
    x, y = values[low], values[min(low + 1, len(values) - 1)]
    return x if place == low or x == y else (low + 1 - place) * x + (place - low) * y


class _Peers:
    """Comparable events: their number, and each feature's values in order of time and of size."""

    __slots__ = ("n", "series", "ordered")

    def __init__(self, features: int):
        self.n, self.series, self.ordered = 0, [deque() for _ in range(features)], [[] for _ in range(features)]


class Walk:
    """The state of one entity. Missing values (None, NaN) are no part of a feature's history."""

    def __init__(self, features: int, limit: int = C.HISTORY_LIMIT, history: Iterable[tuple[tuple, tuple]] = ()):
        self.features, self.limit = features, limit
        self.events: deque[tuple[tuple, tuple]] = deque()
        self.peers: dict[tuple, _Peers] = {}
        for where, values in history:
            self.push(where, values)

    def push(self, where: tuple, values: tuple) -> None:
        """One more event: where it lies, a value for each dimension, and its features' values."""
        for depth in range(min(1, len(where)), len(where) + 1):
            group = self.peers.setdefault(where[:depth], _Peers(self.features))
            group.n += 1
            for v, series, ordered in zip(values, group.series, group.ordered, strict=True):
                if v is not None and v == v:
                    series.append(v)
                    insort(ordered, v)
        self.events.append((where, values))
        if len(self.events) > self.limit:
            where, values = self.events.popleft()
            for depth in range(min(1, len(where)), len(where) + 1):
                group = self.peers[where[:depth]]
                group.n -= 1
                if not group.n:
                    del self.peers[where[:depth]]
                    continue
                for v, series, ordered in zip(values, group.series, group.ordered, strict=True):
                    if v is not None and v == v:
                        series.popleft()
                        del ordered[bisect_left(ordered, v)]

    def comparable(self, where: tuple, least: int) -> _Peers | None:
        """The events of the deepest prefix with at least ``least``, else of the first dimension's value."""
        for depth in range(len(where), 0, -1):
            group = self.peers.get(where[:depth])
            if group is not None and group.n >= least:
                return group
        return self.peers.get(where[:1])

    def rolling(self, where: tuple) -> tuple[int, list[tuple]]:
        """Events compared with, and of each feature: values, non-zero ones, upper quantile and median; of the
        non-zero values where zeros prevail."""
        group = self.comparable(where, C.ROLLING_MIN_HISTORY)
        if group is None:
            return 0, [(0, 0, None, None)] * self.features
        out = []
        for ordered in group.ordered:
            n = len(ordered)
            lo, hi = bisect_left(ordered, 0.0), bisect_right(ordered, 0.0)
            nz = n - (hi - lo)
            used = ordered[:lo] + ordered[hi:] if n and (n - nz) / n >= C.ZERO_INFLATION_SHARE else ordered
            out.append((n, nz, quantile(used, C.ROLLING_QUANTILE), quantile(used, 0.5)) if used else (n, nz, None, None))
        return group.n, out

    def change(self, where: tuple, values: tuple) -> tuple[int, list[tuple]]:
        """Events compared with, and of each feature the best split of its series up to the event."""
        group = self.comparable(where, C.CHANGE_MIN_HISTORY)
        if group is None:
            return 0, [(None,) * 4] * self.features
        out = []
        for v, series in zip(values, group.series, strict=True):
            long = v is not None and v == v and len(series) >= C.CHANGE_MIN_HISTORY
            out.append((best_split(np.array([*series, v])) if long and group.n >= C.CHANGE_MIN_HISTORY else None) or (None,) * 4)
        return group.n, out

    def judged(self, kind: str, where: tuple, values: tuple) -> tuple[int, list[tuple], str | None]:
        """``rolling`` or ``change`` of an event; what it raises abstains, with the error as a note."""
        try:
            return *(self.rolling(where) if kind == "rq" else self.change(where, values)), None
        except Exception as error:  # the detector's own: no Spark or storage is called here
            return 0, [(None,) * 4] * self.features, f"{type(error).__name__}: {error}"[:300]


def as_arrow(kind: str, found: Sequence[tuple[int, list[tuple], str | None] | None], features: int) -> pa.Array:
    """Results of a kind as a column; None for rows that aren't judged."""
    first, second = (pa.int64(), pa.int64()) if kind == "rq" else (pa.int32(), pa.float64())
    names = ("n", "nz", "upper", "median") if kind == "rq" else ("split", "strength", "before", "after")
    blank = (0, [(None,) * 4] * features, None)
    rows = [blank if f is None else f for f in found]
    columns = list(zip(*(p for _, parts, _ in rows for p in parts), strict=True)) or [()] * 4
    parts = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (first, second, pa.float64(), pa.float64()), strict=True)], names=names)
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * features)
    return pa.StructArray.from_arrays([pa.array([n for n, _, _ in rows], pa.int32()), pa.ListArray.from_arrays(offsets, parts), pa.array([e for *_, e in rows], pa.string())], names=("n", "parts", "error"))


def places(spec: EventSpec) -> list[Column]:
    """Dimensions as text, a missing one empty."""
    return [F.coalesce(F.col(d).cast("string"), F.lit("")) for d in spec.dimensions]


def walked(events: DataFrame, spec: EventSpec, kinds: Collection[str] = tuple(KINDS), only: Column | None = None) -> DataFrame:
    """``events`` (with ``rn``) and a column for each kind. Of the rows that ``only`` holds for, if it is given; the others are
    history alone and don't come back."""
    features, names, kinds = len(spec.numeric), events.columns, [k for k in KINDS if k in kinds]
    chunk, within = F.floor((F.col("rn") - 1) / CHUNK), (F.col("rn") - 1) % CHUNK
    after = F.when(within >= CHUNK - C.HISTORY_LIMIT, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    rows = events.withColumns({
        "_where": F.array(*places(spec)).cast("array<string>"), "_values": F.array(*[F.col(f).cast("double") for f in spec.numeric]).cast("array<double>"),
        "_own": chunk, "_chunk": F.explode(after), "_judged": F.lit(True) if only is None else F.coalesce(only, F.lit(False)), "_entity": F.col(spec.entity).cast("string"),
    })
    rows = rows.repartition("_entity", "_chunk").sortWithinPartitions("_entity", "_chunk", "rn")
    schema = T.StructType([*events.schema.fields, *(T.StructType.fromDDL(f"{k} {KINDS[k]}")[0] for k in kinds)])

    def walk(batches: Iterable[pa.RecordBatch]):
        key, state = None, Walk(features)
        for batch in batches:
            column = {name: batch.column(name).to_pylist() for name in ("_entity", "_chunk", "_own", "_where", "_values", "_judged")}
            mine = np.zeros(batch.num_rows, dtype=bool)
            found = {k: [] for k in kinds}
            for i, (entity, part, own, where, values, judged) in enumerate(zip(*column.values(), strict=True)):
                if key != (entity, part):
                    key, state = (entity, part), Walk(features)
                where, values = tuple(where), tuple(values)
                if part == own and judged:
                    mine[i] = True
                    for k in kinds:
                        found[k].append(state.judged(k, where, values))
                state.push(where, values)
            kept = batch.select(names).filter(pa.array(mine))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(as_arrow(k, found[k], features) for k in kinds)], names=[*names, *kinds])

    return rows.mapInArrow(walk, schema)
