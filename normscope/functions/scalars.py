"""Scalar functions: coercion, deviation scores, ensemble arithmetic, keys and text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

_NUMBER = r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$"


def number(value: Column, kind: str = "string") -> Column:
    """A double, or null: booleans are no numbers; text may use a decimal comma."""
    if kind == "boolean":
        return F.lit(None).cast("double")
    if kind != "string":
        return value.cast("double")
    text = F.trim(value)
    return F.when(text.rlike(_NUMBER), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))


def parsed_time(value: Column) -> Column:
    """ISO 8601 text as a timestamp, without a zone in the session's (UTC); else null."""
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(value.rlike(iso), F.try_to_timestamp(value))


def time_or_epoch(value: Column) -> Column:
    return F.coalesce(parsed_time(value), F.timestamp_seconds(F.lit(0)))


def present(value: Column) -> Column:
    """Whether a categorical value counts: not null, not empty."""
    return value.isNotNull() & (value.cast("string") != "")


# ---------------------------------------------------------------- scores


def robust_z(value: Column, median: Column, sigma: Column, zero_inflated: Column, informative: Column) -> Column:
    unjudged = zero_inflated & ((value == 0) | (informative < C.MIN_INFORMATIVE))
    return F.when(value.isNull() | median.isNull(), None).when((sigma <= 0) | unjudged, F.lit(0.0)).otherwise((value - median) / sigma)


def squash(z: Column, knee: float) -> Column:
    """A deviation in spreads as a score in [0, 1)."""
    return F.abs(z) / (F.abs(z) + F.lit(knee))


def unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def rarity(share: Column, count: Column, distinct: Column) -> Column:
    """How rare a value of this share is among ``distinct`` values seen ``count`` times in all."""
    smoothed = (share * count + 1) / (count + distinct + 1) * (distinct + 1)
    return F.when(count <= 0, F.lit(0.0)).otherwise(unit(1 - smoothed))


def excess_score(observed: Column, upper: Column, median: Column) -> Column:
    """Null where the observed value isn't above ``upper`` or there is no spread."""
    spread = F.greatest(upper - median, F.abs(median) * C.ROLLING_SPREAD_FLOOR)
    ratio = F.when(spread > 0, (observed - upper) / spread)
    return F.when(ratio > 0, ratio / (ratio + 2.0))


def margin_score(margin: Column) -> Column:
    return unit(-C.FOREST_GAIN * margin)


def combine(results: Column) -> Column:
    """From array<struct<score, weight>> of the applicable detectors: the strongest score, lifted by the
    weighted mean of the others. Empty: 0."""
    scores = F.transform(results, lambda r: r["score"])
    peak = F.array_max(scores)
    at = F.array_position(scores, peak).cast("int")
    total = lambda f: F.aggregate(results, F.lit(0.0), lambda a, r: a + f(r))
    first = F.element_at(results, at)
    weight = total(lambda r: r["weight"]) - first["weight"]
    mean = F.when((F.size(results) >= 2) & (weight > 1e-12), (total(lambda r: r["weight"] * r["score"]) - first["weight"] * first["score"]) / weight).otherwise(F.lit(0.0))
    return F.when(F.size(results) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), peak + (1 - peak) * mean * C.AGREEMENT_WEIGHT))


def weighted_mean(results: Column) -> Column:
    total = lambda f: F.aggregate(results, F.lit(0.0), lambda a, r: a + f(r))
    weight = total(lambda r: r["weight"])
    return F.when(weight > 0, total(lambda r: r["weight"] * r["score"]) / weight).otherwise(F.lit(0.0))


def confidence(applicable: Column, firing: Column, total: int = len(C.DETECTORS)) -> Column:
    raw = 0.35 + 0.35 * applicable / F.lit(float(total)) + F.when(applicable > 0, 0.30 * firing / applicable).otherwise(F.lit(0.0))
    return F.when(applicable == 0, F.lit(0.0)).otherwise(F.round(F.least(F.lit(0.95), raw), 4))


def severity(score: Column) -> Column:
    out = F.lit("low")
    for cut, name in reversed(C.SEVERITY_CUTS):
        out = F.when(score >= cut, name).otherwise(out)
    return out


# ---------------------------------------------------------------- scopes


def scope_key(dimensions: Sequence[str], prefix: str = "") -> Column:
    """``d=v`` pairs by dimension name, joined by bars; ``*`` for none. Null values are empty."""
    if not dimensions:
        return F.lit("*")
    return F.concat_ws("|", *[F.concat(F.lit(f"{d}="), F.coalesce(F.col(prefix + d).cast("string"), F.lit(""))) for d in sorted(dimensions)])


def scope_keys(dimensions: Sequence[str]) -> list[Column]:
    """The key of every prefix of the dimensions, from none to all."""
    return [scope_key(dimensions[:k]) for k in range(len(dimensions) + 1)]


def describe_scope(key: Column) -> Column:
    return F.when(key == "*", "all data").otherwise(F.replace(key, F.lit("|"), F.lit(", ")))


def scope_match(key: Column) -> Column:
    """The conditions of a scope key as a map; a value may hold an equals sign."""
    parts = F.filter(F.split(key, r"\|"), lambda p: F.instr(p, "=") > 0)
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substr(p, F.instr(p, "=") + 1).alias("value")))
    return F.when((key == "*") | (key == "") | key.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(pairs))


# ---------------------------------------------------------------- cases


def fingerprint(entity: Column, strongest: Column, reasons: Column) -> Column:
    """Which problem of which entity this is: the leading detector and the features of its reasons (of all
    reasons if it gave none)."""
    own = F.filter(reasons, lambda r: r["detector"] == strongest)
    used = F.when(F.size(own) > 0, own).otherwise(reasons)
    features = F.array_sort(F.array_distinct(F.filter(F.transform(used, lambda r: r["feature"]), lambda f: f.isNotNull() & (f != ""))))
    raw = F.concat(F.coalesce(entity, F.lit("")), F.lit("|"), F.coalesce(strongest, F.lit("")), F.lit("|"), F.array_join(features, "|"))
    return F.substring(F.sha1(raw.cast("binary")), 1, 32)


def title(entity_type: str, entity: Column, reasons: Column, strongest: Column) -> Column:
    """One line about the first reason."""
    first = F.get(reasons, F.lit(0))
    feature = first["feature"]
    detector = F.coalesce(first["detector"], strongest)
    who = F.concat(F.lit(f"{entity_type} "), entity)
    name = F.substring_index(feature, ":", -1)
    text = {
        "robust_deviation": F.concat(feature, F.lit(" of "), who, F.lit(" lies far from its usual range")),
        "categorical_rarity": F.concat(F.lit("Uncommon "), feature, F.lit(" at "), who),
        "isolation_forest": F.concat(F.lit("Values of "), who, F.lit(" rarely occur together")),
        "rolling_quantile": F.concat(who, F.lit(" exceeds its own recent "), feature),
        "change_point": F.concat(F.lit("Level of "), feature, F.lit(" moved at "), who),
    }
    peer = F.when(F.startswith(feature, F.lit("rate:")), F.concat(who, F.lit(" has "), name, F.lit(" more often than comparable ones"))).otherwise(
        F.concat(who, F.lit(" averages more "), name, F.lit(" than comparable ones"))
    )
    out = F.when(detector == "peer_group", peer)
    for k, v in text.items():
        out = out.when(detector == k, v)
    return F.when(F.size(reasons) == 0, F.concat(who, F.lit(" behaves unusually"))).otherwise(out)


def policy_covers(policy: dict[str, object], event: dict[str, Column], score: Column, strongest: Column) -> Column:
    """Whether an active policy hides a result: below its ceiling, of its detectors, all conditions equal."""
    tests = [F.lit(bool(policy.get("active", True))), score <= F.lit(float(policy["max_score"]))]
    if policy.get("detectors"):
        tests.append(F.coalesce(strongest.isin(*policy["detectors"]), F.lit(False)))
    for key, value in dict(policy.get("match") or {}).items():
        tests.append(F.coalesce(event[key].cast("string"), F.lit("")) == str(value) if key in event else F.lit(str(value) == ""))
    return reduce(lambda a, b: a & b, tests)


# ---------------------------------------------------------------- similarity


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def proximity(a: Column, b: Column) -> Column:
    """Mean ratio of the smaller to the larger magnitude over the keys that two maps share."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))

    def ratio(k: Column) -> Column:
        x, y = F.abs(F.element_at(a, k)), F.abs(F.element_at(b, k))
        return F.when((x == 0) & (y == 0), F.lit(1.0)).otherwise(F.least(x, y) / F.greatest(x, y))

    total = F.aggregate(shared, F.lit(0.0), lambda s, k: s + ratio(k))
    return F.when(F.size(shared) > 0, total / F.size(shared)).otherwise(F.lit(0.0))


def reason_keys(reasons: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(reasons, lambda r: F.coalesce(r["feature"] != "", F.lit(False))), lambda r: F.concat_ws(":", F.coalesce(r["detector"], F.lit("")), r["feature"])))


def numeric_values(reasons: Column) -> Column:
    """The last numeric observation of each feature."""
    known = F.filter(reasons, lambda r: r["observed_num"].isNotNull() & r["feature"].isNotNull())
    last = F.filter(known, lambda r, i: ~F.exists(F.slice(known, i + 2, F.greatest(F.size(known), F.lit(1))), lambda o: o["feature"] == r["feature"]))
    return F.map_from_entries(F.transform(last, lambda r: F.struct(r["feature"], r["observed_num"])))


# ---------------------------------------------------------------- text

# The patterns that redaction replaces, in this order.
EMAIL, IBAN, PHONE = r"[\w.+-]+@[\w-]+\.[\w.]+", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", r"(?<!\d)(\+?\d[\d\s\-()]{7,}\d)(?!\d)"


def redact(text: Column) -> Column:
    for pattern, mark in ((EMAIL, "[email]"), (IBAN, "[iban]"), (PHONE, "[phone]")):
        text = F.regexp_replace(text, pattern, mark)
    return text


def redact_all(value: Column, kind) -> Column:
    """Redaction at any depth of arrays, structs and map values."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StringType):
        return redact(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: redact_all(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: redact_all(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[redact_all(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


# The marks that may enclose a text.
FENCE_START, FENCE_END = r"^`{3}[a-zA-Z]*\n?", r"\n?`{3}$"


def strip_code_fence(text: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.trim(text), FENCE_START, ""), FENCE_END, "")
    return F.when(F.startswith(F.trim(text), F.lit("`")), F.trim(inner)).otherwise(F.trim(text))


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)
