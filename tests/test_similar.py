"""Similar cases against a plain version on odd rows, and that no step makes a row for each pair."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from normscope import constants as C
from normscope.operators import similarity

SCHEMA = "id string, schema_id string, entity_id string, baseline_scope string, severity string, status string, keys array<string>, values map<string,double>"


def divided(a, b):
    return a / b if b and not (math.isinf(a) and math.isinf(b)) else math.nan


def ratio(x, y):
    """A null number counts as the other one; NaN is above all numbers."""
    if x is None or y is None:
        x = y = y if x is None else x
        return None if x is None else divided(abs(x), abs(y))
    x, y = sorted((abs(x), abs(y)), key=lambda v: (math.isnan(v), v))
    return 1.0 if x == y == 0 else divided(x, y)


def parts(t, c):
    a, b = set(t["keys"] or ()), set(c["keys"] or ())
    out = [len(a & b) / len(a | b) if a | b else 0.0, *(float(t[k] is not None and t[k] == c[k]) for k in ("entity_id", "baseline_scope", "severity"))]
    ratios = [ratio(x, c["values"][k]) for k, x in (t["values"] or {}).items() if k in (c["values"] or {})]
    return None if None in ratios else [*out, sum(ratios, 0.0) / len(ratios) if ratios else 0.0]


def rounded(x):
    return math.inf if math.isnan(x) else int(Decimal(repr(x)).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP)) / 1e9


def plain(targets, candidates, limit):
    out = []
    for t in targets:
        found = []
        for c in candidates:
            if None in (t["schema_id"], t["id"], c["id"]) or t["schema_id"] != c["schema_id"] or t["id"] == c["id"] or (p := parts(t, c)) is None:
                continue
            total = sum((w * x for w, x in zip(C.SIMILARITY_WEIGHTS.values(), p, strict=True)), 0.0)
            if rounded(total) >= C.SIMILARITY_FLOOR:
                found.append((-rounded(total), -1 if c["status"] is None else int(c["status"] != "resolved"), c["id"], p, total))
        out += [(t["id"], c, i + 1, total, p) for i, (_, _, c, p, total) in enumerate(sorted(found, key=lambda x: x[:3])[:limit])]
    return out


def drawn(n, seed, repeated):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        keys = r.choice([None, [], ["a"], ["a", "b"], ["b", "a", "b"], ["a", "b", "c"], ["d", None], ["e", "f", "g", "h"], [f"k{r.randrange(9)}" for _ in range(r.randrange(6))]])
        number = lambda: r.choice([0.0, -0.0, 1.0, -2.0, 3.5, r.randrange(50), r.random() * 1000, r.random() * 1000])
        odd = lambda: r.choice([math.nan, math.inf, -math.inf, None])
        values = {k: float(number()) if r.random() < 0.96 or (v := odd()) is None and r.random() < 0.5 else v for k in r.sample(["x", "y", "z"], r.randrange(4))}
        rows.append({
            "id": f"c{i:04d}" if i % 97 else None, "schema_id": r.choice(["one", "one", "one", "two", None]), "entity_id": r.choice(["p", "q", "q", "\U0001f600", None]), "baseline_scope": r.choice(["s", "t", "u", None]),
            "severity": r.choice(["low", "high", "high", None]), "status": r.choice(["open", "resolved", "dismissed", None]), "keys": keys, "values": values if r.random() < 0.95 else None,
        })
        if i % 5 == 4:  # copies but for the id and the status
            rows[-1] = rows[-2] | {"id": rows[-1]["id"], "status": rows[-1]["status"]}
        if i % 40 in repeated:
            rows[-1]["id"] = rows[-2]["id"]
    return rows


@pytest.mark.parametrize(("blocks", "limit", "repeated"), [((20_000, 100_000), 5, ()), ((20, 100), 5, (1, 11)), ((1000, 70), 2, ()), ((1000, 1000), 1, (1, 11))])
def test_odd_rows(spark, monkeypatch, blocks, limit, repeated):
    monkeypatch.setattr(similarity, "TARGETS", blocks[0])
    monkeypatch.setattr(similarity, "CANDIDATES", blocks[1])
    rows = drawn(900, limit, repeated)
    views = spark.createDataFrame([tuple(x.values()) for x in rows], SCHEMA)
    targets = spark.createDataFrame([tuple(x.values()) for x in rows[::8]], SCHEMA)
    got = {(r["target_id"], r["place"]): r for r in similarity.similar(targets, views, limit=limit).collect()}
    want = plain(rows[::8], rows, limit)
    assert len(got) == len(want) > 30 * limit
    same = lambda a, b: math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-12
    for t, c, place, total, p in want:
        r = got[t, place]
        assert r["id"] == c and same(r["total"], total) and all(same(r[f"s_{k}"], x) for k, x in zip(C.SIMILARITY_WEIGHTS, p, strict=True)), (r, c, total, p)


def test_no_rows(spark):
    views = spark.createDataFrame([tuple(x.values()) for x in drawn(20, 1, ())], SCHEMA)
    assert similarity.similar(views.where("false"), views).count() == similarity.similar(views, views.where("false")).count() == 0


def test_numbered_schemas(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TARGETS", 2)
    monkeypatch.setattr(similarity, "CANDIDATES", 3)
    rows = [(i, i % 3 if i % 3 < 2 else None, "p", "s", "low", "open", ["a"], {"x": 1.0}) for i in range(30)]
    views = spark.createDataFrame(rows, SCHEMA.replace("id string, schema_id string", "id long, schema_id int"))
    best = sorted((r["target_id"], r["place"], r["id"]) for r in similarity.similar(views, views).collect())
    assert best == [(t, k + 1, c) for t in range(30) if t % 3 < 2 for k, c in enumerate([c for c in range(t % 3, 30, 3) if c != t][:5])]


def test_few_large_groups(spark):
    """Equal profiles with many numbers, and equal rows, of which the least ids count."""
    rows = [(f"c{i:05d}", "one", "p", "s", "low", "open", ["a"], {"x": float(i % 2_000) + 1} if i < 3_000 else {"x": 7.0, "y": 1.0}) for i in range(6_000)]
    views = spark.createDataFrame(rows, SCHEMA)
    best = similarity.similar(views.where(F.col("id").isin("c00049", "c05000")), views).orderBy("target_id", "place").select("target_id", "id").collect()
    assert [r["id"] for r in best if r["target_id"] == "c05000"] == ["c00006", "c02006", "c03000", "c03001", "c03002"]
    assert [r["id"] for r in best if r["target_id"] == "c00049"] == ["c02049", "c00050", "c02050", "c00048", "c02048"]


def nodes(plan):
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        yield from nodes(plan.executedPlan())
    elif name.endswith("QueryStage"):
        yield from nodes(plan.plan())
    else:
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))


def test_no_row_for_each_pair(spark):
    rows = spark.range(2_000).select(
        F.format_string("c%04d", "id").alias("id"), F.lit("one").alias("schema_id"), F.concat(F.lit("e"), F.col("id") % 7).alias("entity_id"), F.lit("s").alias("baseline_scope"), F.lit("low").alias("severity"),
        F.lit("open").alias("status"), F.array(F.concat(F.lit("k"), F.col("id") % 11)).alias("keys"), F.create_map(F.lit("x"), F.col("id").cast("double")).alias("values"),
    )
    found = similarity.similar(rows.where("id < 'c0400'"), rows)
    assert len(found.collect()) == 2_000
    most = max(p.metrics().apply("numOutputRows").value() for p in nodes(found._jdf.queryExecution().executedPlan()) if p.metrics().contains("numOutputRows"))
    assert most <= 3 * 2_000
