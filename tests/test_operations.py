"""Operations on stored tables, detectors that fail or are added, and quantiles without lists."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from normscope.operators import baselines, cases, detectors, history, peers, quantiles, queue
from normscope.plans import detection, operations
from normscope.sources import ingest, logs, tables
from normscope.sources.tables import Catalog
from normscope.spec import EventSpec

SPEC = EventSpec(name="s", entity="e", time="t", event_id="k", numeric=("v", "w"), categorical=("c",), dimensions=("c",), min_score=40.0)


def events(spark, n=160):
    r = np.random.default_rng(1)
    value = r.uniform(10, 20, n)
    value[-3:] = 900.0
    return spark.createDataFrame(pd.DataFrame({
        "k": [f"k{i:04d}" for i in range(n)], "e": [f"e{i % 4}" for i in range(n)], "t": pd.Timestamp("2025-01-01") + pd.to_timedelta(np.arange(n), unit="h"),
        "v": value, "w": r.uniform(0, 1, n), "c": ["x"] * n,
    }))


@pytest.fixture
def store(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/store", "t1")


def test_a_run_over_stored_events(spark, store):
    operations.register(store, SPEC)
    with pytest.raises(ValueError):
        operations.register(store, SPEC)
    assert operations.schema(store, "s") == SPEC and [r["schema_id"] for r in operations.schemas(store).collect()] == ["s"]
    shown = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in SPEC.columns]))
    batch = events(spark).select(F.substring("k", 2, 9).cast("int").alias("idx"), F.col("k").alias("external_id"), F.col("t").alias("occurred_at"), shown.alias("payload"))
    assert ingest.summary(operations.add_events(store, SPEC, batch)).first()["accepted"] == 160
    assert tuple(ingest.summary(operations.add_events(store, SPEC, batch)).first()) == (0, 160, 0)
    with pytest.raises(ValueError):
        operations.add_events(store, SPEC, batch.limit(0))
    assert [r["k"] for r in operations.events(store, SPEC, 3).collect()] == ["k0000", "k0001", "k0002"]
    use = ("robust_deviation", "categorical_rarity")
    first = operations.run_detection(store, SPEC, use=use)
    done = operations.run(store, first).first()
    found = operations.current_cases(store)
    assert done["status"] == "completed" and done["cases_created"] == found.count() >= 1
    operations.run_detection(store, SPEC, use=use)
    assert operations.current_cases(store).count() == found.count()  # the like of an open case isn't stored again
    one = found.first()["id"]
    operations.change_case(store, queue.resolve(found, one, "resolved").where(F.col("id") == one))
    assert operations.current_cases(store).where("status = 'resolved'").select("id").collect() == [(one,)]
    labels = spark.createDataFrame([("l1", one, "false_positive", None, "ann")], "id string, exception_id string, label string, note string, author string")
    operations.add_feedback(store, labels)
    with pytest.raises(LookupError):
        operations.add_feedback(store, labels.withColumn("exception_id", F.lit("gone")))
    seen = queue.overview_of(operations.current_cases(store), store.read("events"), queue.labelled(operations.current_cases(store), store.read("feedback"))).first()
    assert seen["events"] == 160 and seen["precision"] == 0.0 and seen["resolved"] == 1 and all(a["anomaly_score"] >= b["anomaly_score"] for a, b in zip(seen["top"], seen["top"][1:], strict=False))
    operations.add_policy(store, {"id": "p", "match": {"c": "x"}, "max_score": 100.0})
    assert [r["id"] for r in operations.policies(store, "s").collect()] == ["p"]
    hidden = operations.run(store, operations.run_detection(store, SPEC, use=use)).first()
    assert hidden["cases_created"] == 0 and hidden["suppressed"] >= 1
    operations.deactivate_policy(store, "p")
    assert operations.policies(store, "s").count() == 0
    with pytest.raises(ValueError):
        operations.run_detection(store, SPEC, "broken", train_ratio=float("nan"), use=use)
    assert operations.run(store, "broken").first()["status"] == "failed"
    other = Catalog(spark, store.path("").rstrip("/"), "t2")
    assert other.read("events").count() == 0


def test_learned_tables_have_versions(spark, store):
    made = operations.learn(store, SPEC, events(spark))
    assert made == {"baselines": 1, "peer_groups": 1, "models": 1} and operations.learn(store, SPEC, events(spark))["models"] == 2
    assert store.versions("baselines", SPEC).where("active").agg(F.min("version")).first()[0] == 2 and store.active("models", SPEC).count() >= 1


def test_promotion(spark, store):
    operations.register(store, SPEC)
    rows = [(str(i), "peer_group", "c=x", "true_exception" if i % 5 < 2 else "false_positive", 60.0 + i) for i in range(20)]
    labels = spark.createDataFrame(rows, "id string, strongest string, baseline_scope string, label string, anomaly_score double")
    changed = operations.promote(store, SPEC, labels, weights=True, threshold=True, suppress=True)
    assert operations.schema(store, "s") == changed and changed.weights["peer_group"] == 0.7
    held = operations.policies(store, "s").first()
    assert held["match"] == {"c": "x"} and held["detectors"] == ["peer_group"]


def test_failing_and_added_detectors(spark):
    log = events(spark)
    plain = detection.score(log, SPEC, use=("robust_deviation",))
    try:
        detectors.register(detectors.of_function("raises", ["v"], lambda frame: 1 / 0))
        detectors.register(detectors.Detector("unplanned", lambda rows, run: rows.withColumn("d_unplanned", F.col("no_such_column"))))
        detectors.register(detectors.of_function("steady", ["v", "w"], lambda frame: (frame["v"] > 100).astype(float)))
        spec = EventSpec(**{**{f: getattr(SPEC, f) for f in ("name", "entity", "time", "event_id", "numeric", "categorical", "dimensions")}, "extra_detectors": ("raises", "unplanned", "steady"), "weights": {"steady": 0.5}})
        rows = detection.score(log, spec, use=("robust_deviation", "raises", "unplanned", "steady"))
        got = rows.select("k", F.map_from_entries(F.transform("results", lambda r: F.struct(r["detector"], r))).alias("r"), "score").collect()
    finally:
        for name in ("raises", "unplanned", "steady"):
            detectors.REGISTRY.pop(name, None)
    assert len(got) == plain.count() > 0
    assert all(not x["r"][n]["applicable"] and what in x["r"][n]["note"] for x in got for n, what in (("raises", "ZeroDivision"), ("unplanned", "no_such_column")))
    assert {x["k"] for x in got if x["r"]["steady"]["score"] == 1} == {"k0157", "k0158", "k0159"}


def test_calls_of_a_provider_are_stored(spark, store):
    held = spark.createDataFrame([("1", "a", 90.0, "high", "*")], "id string, title string, anomaly_score double, severity string, baseline_scope string")
    held = held.withColumns({"reasons": F.array(F.struct(F.lit("why").alias("explanation"))), "evidence": F.struct(F.lit("peer_group").alias("strongest_detector"))})
    assert operations.explain(store, held, lambda frame: 1 / 0).first()["summary"] == "a (score 90.0, high)"
    assert [(r["id"], r["ok"], r["purpose"]) for r in store.read("provider_calls").collect()] == [("1", False, "explain")]


def test_explained_cases(spark):
    held = spark.createDataFrame([("1", "a", 90.0, "high", "*"), ("2", "b", 80.0, "high", "*")], "id string, title string, anomaly_score double, severity string, baseline_scope string")
    reasons = F.array(F.struct(F.lit("why").alias("explanation")))
    held = held.withColumns({"reasons": reasons, "evidence": F.struct(F.lit("peer_group").alias("strongest_detector"))})

    def provider(frame):
        return pd.DataFrame({"summary": ["told" if i == "1" else None for i in frame["id"]], "cause": "c", "facts": [["f"]] * len(frame), "steps": [["s"]] * len(frame), "caveats": [[]] * len(frame)})

    told, calls = queue.explained(held, provider)
    assert {r["id"]: r["summary"] for r in told.collect()} == {"1": "told", "2": "b (score 80.0, high)"} and {r["id"]: r["ok"] for r in calls.collect()} == {"1": True, "2": False}
    told, calls = queue.explained(held, lambda frame: 1 / 0)
    assert told.where("summary LIKE '%score%'").count() == 2 and all("ZeroDivision" in r["error"] for r in calls.collect())


@pytest.mark.parametrize("leaf", [1, 40, 2_000])
def test_statistics_equal_percentiles(spark, monkeypatch, leaf):
    monkeypatch.setattr(quantiles, "LEAF", leaf)
    r = np.random.default_rng(5)
    parts = {
        "even": r.uniform(-5, 5, 401), "tail": np.exp(r.normal(0, 3, 500)), "zeros": np.where(r.random(300) < 0.7, 0.0, r.normal(0, 4, 300)), "one": np.full(40, 3.25),
        "far": 1e9 + r.normal(0, 1e-3, 200), "few": np.array([1.0, 2.0, 9.0]), "signs": np.concatenate([np.zeros(60), -np.arange(1.0, 21), np.arange(1.0, 11)]), "big": np.array([1e300, -1e300, 5.0, 7.0]),
        "next": 1000 + np.arange(300) * 2.0**-43, "tiny": np.array([5e-324, -5e-324, 1e-310, 3e-308, 1e-300]), "two": np.array([0.1] * 20 + [0.2] * 20),
        "least": np.arange(1, 6) * 5e-324,
    }
    odd = [("even", v, 1) for v in (float("nan"), float("inf"), float("-inf"), None)]
    values = spark.createDataFrame([(k, float(v), 1) for k, x in parts.items() for v in x] + odd, "g string, value double, n long")
    got = {x["g"]: x for x in baselines.numeric_stats(values, ["g"], digits=None).collect()}
    assert got.keys() == parts.keys()
    for k, x in parts.items():
        zeros = (x == 0).mean() >= 0.4 and (x != 0).sum() >= 3
        y = x[x != 0] if zeros else x
        median = np.quantile(y, 0.5)
        assert got[k]["median"] == pytest.approx(median, rel=1e-12) and got[k]["mad"] == pytest.approx(np.median(np.abs(y - median)), rel=1e-6, abs=1e-12)
        assert [got[k][c] for c in ("p05", "p25", "p75", "p95")] == pytest.approx(np.quantile(y, (0.05, 0.25, 0.75, 0.95)).tolist(), rel=1e-12)
        assert (got[k]["count"], got[k]["informative"], got[k]["min"], got[k]["max"]) == (x.size, y.size, y.min(), y.max())


def test_a_crowd_and_an_outlier(spark, monkeypatch):
    """100,000 values near one and one far away: no ordering sees more than LEAF rows."""
    ordered = []
    plain = quantiles.materialised

    def watched(rows):
        out = plain(rows)
        if "before" in out.columns and "least" in out.columns:
            ordered.append(out.where((F.col("rows") <= quantiles.LEAF) & (F.col("least") < F.col("most"))).agg(F.max("rows")).first()[0] or 0)
        return out

    monkeypatch.setattr(quantiles, "materialised", watched)
    near = spark.range(100_000).select(F.lit("g").alias("g"), (1000 + F.col("id") * 1e-9).alias("value"), F.lit(1).alias("n"))
    found = baselines.numeric_stats(near.unionByName(spark.createDataFrame([("g", 1e15, 1)], "g string, value double, n int")), ["g"], digits=None).first()
    x = np.append(1000 + np.arange(100_000) * 1e-9, 1e15)
    assert found["median"] == np.median(x) and found["mad"] == np.median(np.abs(x - np.median(x))) and found["max"] == 1e15
    assert len(ordered) >= 3 and ordered[0] == 0 and 0 < max(ordered) <= quantiles.LEAF  # the first cell is cut, then its parts are ordered


@pytest.mark.parametrize("leaf", [1, 2_000])
def test_peers_leave_out_what_is_not_finite(spark, monkeypatch, leaf):
    monkeypatch.setattr(quantiles, "LEAF", leaf)
    profile = spark.createDataFrame([("*", "mean:v", v) for v in [*map(float, range(1, 10)), float("inf"), float("nan")]], "scope_key string, metric string, value double")
    assert tuple(peers.stats(profile).first())[2:] == (5.0, 2 * 1.4826, 9)


def test_cut_of_a_bulk_load(spark, monkeypatch):
    """Everything at one instant, and more rows than one task may order."""
    monkeypatch.setattr(history, "FEW_ROWS", 50)
    spec = EventSpec(entity="e", time="t", event_id="k", numeric=("v",))
    log = spark.range(1000).select(F.col("id").alias("k"), F.lit("e").alias("e"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("t"), F.lit(1.0).alias("v"))
    assert history.split(log, spec, 0.6).where("training").agg(F.count("*"), F.max("k")).first()[:] == (600, 599)
    spread = log.withColumn("t", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("k") * 37))
    assert history.split(spread, spec, 0.25).where("training").agg(F.count("*"), F.max("k")).first()[:] == (250, 249)


def test_lists_and_shares(spark):
    counted = spark.createDataFrame([("b", 4, 1), ("a", 4, 2), ("c", 0, 0)], "schema_id string, event_count long, open_cases long")
    assert queue.busiest(counted).first()["schema_id"] == "a"
    assert {r["schema_id"]: r["case_share"] for r in queue.with_share(counted).collect()} == {"b": 0.25, "a": 0.5, "c": None}
    rows = history.with_scope_ordinal(logs.events(spark, "/root/testdata/sf0.001"), logs.EVENTS)
    seen = rows.withColumn("n", F.count(F.lit(1)).over(history.scope_frame(logs.EVENTS, 20)))
    assert seen.where("n <> least(scope_rn - 1, 20)").count() == 0
    key, stored = operations.new_key()
    assert operations.is_key(key, stored) and not operations.is_key("x", stored)
    recorder = tables.Recorder()
    assert tables.deliver(counted, recorder).first()["status"] == "delivered" and len(recorder.payloads) == 3
    assert cases.GateConfig().max_open == 3
