"""Structured similarity of cases."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import constants as C
from ..functions import scalars as S

#: Cases of one schema that meet in a task, at most about so many of each side.
TARGETS, CANDIDATES = 20_000, 100_000
#: What sums of 32-bit floats may be off, as a share of the weights.
SLACK = 1e-5
PARTS, LABELS = ("reasons", "entity", "scope", "severity", "numeric"), ("entity_id", "baseline_scope", "severity")
#: Candidates of which those that can be among the best are told by rough totals first.
MANY = 200


def views(cases: DataFrame) -> DataFrame:
    """What is compared: reason keys and numeric observations instead of the reasons."""
    return cases.withColumns({"keys": S.reason_keys(F.col("reasons")), "values": S.numeric_values(F.col("reasons"))})


def similar(targets: DataFrame, candidates: DataFrame, *, weights: Mapping[str, float] = C.SIMILARITY_WEIGHTS, floor: float = C.SIMILARITY_FLOOR, limit: int = C.SIMILARITY_LIMIT) -> DataFrame:
    """The best ``limit`` candidates of every target of the same schema: from views with id, schema_id,
    entity_id, baseline_scope, severity, status, keys, values. Blocks of a schema's targets meet blocks of its
    candidates; a block's candidates are compared by what they share, and by numbers where these can matter."""
    sizes = lambda rows, size, name: rows.groupBy("schema_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = sizes(targets, TARGETS, "t_blocks").join(sizes(candidates, CANDIDATES, "c_blocks"), "schema_id", "full").fillna(0, ["t_blocks", "c_blocks"])
    large = F.broadcast(sizes.where("t_blocks > 1 OR c_blocks > 1"))  # never more rows than there are full blocks

    def dealt(rows: DataFrame, own: str, other: str, *more) -> DataFrame:
        """A row for each block of the other side."""
        rows = rows.where(F.col("schema_id").isNotNull() & F.col("id").isNotNull()).select(
            *[F.col(c).alias(c) for c in ("schema_id", "id")], *[F.col(c).cast("string").alias(c) for c in LABELS],
            F.array_distinct(F.coalesce(F.col("keys").cast("array<string>"), F.array().cast("array<string>"))).alias("keys"),
            F.coalesce(F.map_keys("values").cast("array<string>"), F.array().cast("array<string>")).alias("features"),
            F.coalesce(F.map_values("values").cast("array<double>"), F.array().cast("array<double>")).alias("numbers"), *more,
        )
        rows = rows.join(large, "schema_id", "left").fillna(1, ["t_blocks", "c_blocks"]).where(F.col(f"{other}s") > 0)
        rows = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}s")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        return rows.drop("t_blocks", "c_blocks").groupBy("schema_id", "t_block", "c_block")

    unsettled = (F.col("status") != "resolved").cast("int")
    kinds = [T.StructField("target_id", targets.schema["id"].dataType), *(T.StructField(c, candidates.schema[c].dataType) for c in ("id", "status")), *(T.StructField(c, T.DoubleType()) for c in (*(f"s_{k}" for k in PARTS), "total"))]
    weight, schema = tuple(float(weights[k]) for k in PARTS), T.StructType(kinds)
    out = to_arrow_schema(schema)

    def meet(t: pa.Table, c: pa.Table) -> pa.Table:
        return _block(t, c, weight, floor, limit, out)

    rows = dealt(targets, "t_block", "c_block").cogroup(dealt(candidates, "c_block", "t_block", "status", F.coalesce(unsettled, F.lit(-1)).alias("unsettled"))).applyInArrow(meet, schema)
    order = Window.partitionBy("target_id").orderBy(F.desc(F.round("total", 9)), unsettled, "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


# ---------------------------------------------------------------- a block


def _rounded(x: np.ndarray) -> np.ndarray:
    """Billionths, rounded as Spark does it (half up on the decimal text); NaN is above all."""
    scaled = x * 1e9
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4 + np.abs(scaled) * 1e-15):
        out[i] = int(Decimal(repr(float(x[i]))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(x), np.inf, out)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _codes(values: pa.Array, known: pa.Array) -> np.ndarray:
    """Places in ``known``, -1 where there is none."""
    return pc.index_in(values, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All items of lists, and where each list begins and the last ends."""
    return column.flatten(), np.append(0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs of two columns of codes from -1 on, without gaps."""
    return np.unique((a + 1) * (b.max(initial=0) + 2) + b + 1, return_inverse=True)[1].reshape(-1)


def _sets(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's set of codes, and a row of each set."""
    whole = codes[np.lexsort((codes, np.repeat(np.arange(len(at) - 1), np.diff(at))))].astype(np.int64).tobytes()
    seen, number, first = {}, [], []
    for row, (a, b) in enumerate(zip((8 * at[:-1]).tolist(), (8 * at[1:]).tolist(), strict=True)):
        number.append(seen.setdefault(whole[a:b], len(first)))
        if number[-1] == len(first):
            first.append(row)
    return np.array(number), np.array(first)


def _by_code(codes: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their codes, and where each code's places begin; those without a code are left out."""
    order = np.argsort(codes, kind="stable")
    return order, np.searchsorted(codes[order], np.arange(known + 1))


class Candidates:
    """A block's candidates. Those with equal keys, entity, scope and severity lie side by side as one profile; of those whose
    numbers are equal too, no more than ``limit`` and the target itself can matter (where no id comes twice)."""

    def __init__(self, c: pa.Table, limit: int):
        column = {name: c.column(name).combine_chunks() for name in c.column_names}
        self.ids = pc.unique(column["id"])
        place = np.empty(c.num_rows, np.int64)
        place[pc.sort_indices(pa.table({"u": column["unsettled"], "i": column["id"]}), sort_keys=[("u", "ascending"), ("i", "ascending")]).to_numpy()] = np.arange(c.num_rows)
        # equal sets of keys, and for each key the sets that hold it
        items, at = _lists(column["keys"])
        self.keys = pc.unique(items)
        codes = _codes(items, self.keys)
        keyset, first = _sets(codes, at)
        sizes = np.diff(at)[first]
        owner, (by, self.key_at) = np.repeat(np.arange(len(first)), sizes), _by_code(codes[_spread(at[first], sizes)], len(self.keys))
        self.key_sets, self.set_sizes = owner[by], sizes.astype(np.float32)
        # equal entities, scopes and severities, and for each of them the groups that hold it
        self.known, labels, group = {}, {}, np.zeros(c.num_rows, np.int64)
        for name in LABELS:
            self.known[name] = pc.unique(column[name]).drop_null()
            labels[name] = _codes(column[name], self.known[name])
            group = _joined(group, labels[name])
        _, one = np.unique(group, return_index=True)
        self.labels = {name: x[one] for name, x in labels.items()}
        self.label_groups = {name: _by_code(x, len(self.known[name])) for name, x in self.labels.items()}
        # profiles, and the rows in their order
        features, at = _lists(column["features"])
        numbers, _ = _lists(column["numbers"])
        self.features = pc.unique(features)
        feature, null = _codes(features, self.features), numbers.is_null().to_numpy(zero_copy_only=False)
        numbers = np.abs(numbers.fill_null(0.0).to_numpy(zero_copy_only=False))
        number = np.where(null, -1, np.unique(numbers, return_inverse=True)[1].reshape(-1))
        equal, _ = _sets(_joined(feature, number), at)
        profile = _joined(group, keyset)
        self.order = np.lexsort((place, equal, profile))
        begun = np.flatnonzero((np.diff(profile[self.order], prepend=-1) != 0) | (np.diff(equal[self.order], prepend=-1) != 0))
        if len(self.ids) == c.num_rows:
            self.order = self.order[np.arange(c.num_rows) - np.repeat(begun, np.diff(np.append(begun, c.num_rows))) <= limit]
        self.profile = profile[self.order]
        self.lengths = np.bincount(self.profile)
        self.starts = np.cumsum(self.lengths) - self.lengths
        one = self.order[self.starts]
        self.keyset, self.group = keyset[one], group[one]
        self.id_code, self.place = _codes(column["id"], self.ids)[self.order], place[self.order]
        # each feature's rows and numbers
        back = np.full(c.num_rows, -1)
        back[self.order] = np.arange(len(self.order))
        rows = np.repeat(back, np.diff(at))
        by = np.lexsort((rows, feature))
        by = by[rows[by] >= 0]
        cuts = np.searchsorted(feature[by], np.arange(1, len(self.features)))
        self.numbers = list(zip(*(np.split(x[by], cuts) for x in (rows, numbers, null)), strict=True)) if len(self.features) else []
        #: Rows with a number that isn't finite, and with one that is null: a total that isn't a number is above every bound.
        self.odd, self.blank = np.unique(rows[by][~np.isfinite(numbers[by])]), np.unique(rows[by][null[by]])

    def of(self, profiles: np.ndarray) -> np.ndarray:
        return _spread(self.starts[profiles], self.lengths[profiles])

    def common(self, keys: np.ndarray) -> np.ndarray:
        """How many of some keys each set holds."""
        count = np.zeros(len(self.set_sizes), np.float32)
        for k in keys:
            if k >= 0:
                count[self.key_sets[self.key_at[k] : self.key_at[k + 1]]] += 1
        return count

    def same(self, mine: Mapping[str, int], weight: Mapping[str, np.float32]) -> np.ndarray:
        """The weights of what each group has in common with a target."""
        total = np.zeros(len(self.labels["severity"]), np.float32)
        for name, code in mine.items():
            if code >= 0:
                groups, at = self.label_groups[name]
                total[groups[at[code] : at[code + 1]]] += weight[name]
        return total

    def proximity(self, numbers: list[tuple[int, float | None]], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``scalars.proximity`` has it, and where it is null: a null number counts as the other one, two give null."""
        total, shared, null = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows), bool)
        for feature, x in numbers:
            having, y, none = self.numbers[feature]
            at, here = rows, True
            if len(having) < len(self.order):
                at = np.minimum(np.searchsorted(having, rows), len(having) - 1)
                here = having[at] == rows
            y, none = y[at], none[at]
            if x is None:
                ratio = y / y
                null |= here & none
            else:
                y = np.where(none, x, y) if len(self.blank) else y
                most = np.maximum(x, y)
                ratio = np.fmin(x, y) / most
                ratio[(most == 0) & ~none] = 1.0
            total += ratio if here is True else np.where(here, ratio, 0.0)
            shared += here
        return np.where(shared > 0, total / np.maximum(shared, 1), 0.0), null


def _block(t: pa.Table, c: pa.Table, weight: tuple[float, ...], floor: float, limit: int, out: pa.Schema) -> pa.Table:
    """The best candidates of a block for each of its targets. A profile whose parts without numbers leave a total
    below the floor, or below ``limit`` totals that were found, is passed over."""
    if not t.num_rows or not c.num_rows or limit < 1:
        return out.empty_table()
    held = Candidates(c, limit)
    column = {name: t.column(name).combine_chunks() for name in t.column_names}
    own_id = _codes(column["id"], held.ids)
    label = {name: _codes(column[name], known) for name, known in held.known.items()}
    keys, keys_at = _lists(column["keys"])
    features, features_at = _lists(column["features"])
    keys, features, numbers = _codes(keys, held.keys), _codes(features, held.features), _lists(column["numbers"])[0].to_pylist()
    span, reach = sum(map(abs, weight)), max(weight[4], 0.0)
    slack, light = SLACK * span + 1e-8, dict(zip(("keys", *LABELS, "values"), np.array(weight, np.float32), strict=True))
    picked = []
    with np.errstate(all="ignore"):
        for k in range(t.num_rows):
            mine, own = {name: x[k] for name, x in label.items()}, slice(keys_at[k], keys_at[k + 1])
            common = held.common(keys[own])
            union = np.maximum(held.set_sizes + np.float32(own.stop - own.start) - common, np.float32(1))
            bound = (light["keys"] * (common / union))[held.keyset] + held.same(mine, light)[held.group]
            own = slice(features_at[k], features_at[k + 1])
            values = [(f, None if x is None else abs(x)) for f, x in zip(features[own], numbers[own], strict=True) if f >= 0]

            def scored(rows):
                """The best of some candidates, their totals in billionths, their parts and totals; added up in the order of the weights."""
                numeric, null = held.proximity(values, rows)  # noqa: B023
                use = ~null & (held.id_code[rows] != own_id[k])  # noqa: B023
                rows, numeric = rows[use], numeric[use]
                if len(rows) > max(MANY, limit):
                    rough = bound[held.profile[rows]] + weight[4] * numeric  # noqa: B023
                    rough[np.isnan(rough)] = np.inf
                    use = rough >= np.partition(rough, len(rows) - limit)[len(rows) - limit] - slack
                    rows, numeric = rows[use], numeric[use]
                profile = held.profile[rows]
                sets, groups = held.keyset[profile], held.group[profile]
                parts = [common[sets].astype(float) / union[sets], *((held.labels[name][groups] == x if x >= 0 else np.zeros(len(rows))).astype(float) for name, x in mine.items()), numeric]  # noqa: B023
                total = sum((w * x for w, x in zip(weight, parts, strict=True)), 0.0)
                rank = _rounded(total)
                use = np.lexsort((held.place[rows], -rank))[:limit]
                use = use[rank[use] / 1e9 >= floor]
                return rows[use], rank[use], [x[use] for x in (*parts, total)]

            # the profiles that share most, until there are enough candidates
            most = bound.max()
            for share in (0.0, 0.05, 0.1, 0.2, 0.4, 2.0):
                found = np.flatnonzero(bound >= most - share * span - slack)
                if held.lengths[found].sum() > limit:
                    break
            best = scored(held.of(found))
            # then all that can reach the last of these
            if not all(x is not None and np.isfinite(x) for _, x in values):
                best = scored(np.arange(len(held.order)))
            else:
                odd = np.union1d(held.odd, held.blank) if any(x == 0 for _, x in values) else held.odd
                least = max(floor, best[1][-1] / 1e9) if len(best[1]) == limit else floor
                more = np.flatnonzero(bound >= least - reach - slack)
                if len(more) > len(found) or len(odd):
                    best = scored(np.union1d(held.of(more), odd) if len(odd) else held.of(more))
            picked.append((np.full(len(best[0]), k), held.order[best[0]], *best[2]))
    target, row, *parts = (np.concatenate(x) for x in zip(*picked, strict=True))
    columns = [t.column("id").take(pa.array(target)), c.column("id").take(pa.array(row)), c.column("status").take(pa.array(row)), *map(pa.array, parts)]
    return pa.table([x.cast(f.type) for x, f in zip(columns, out, strict=True)], schema=out)
