"""Baselines, detectors, cases, queue, feedback and ingestion on hand-made logs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from normscope import constants as C
from normscope.operators import baselines, cases, detectors, ensemble, feedback, forest, history, peers, queue, similarity
from normscope.plans import detection
from normscope.sources import ingest, tables
from normscope.sources.demo import BURSTING, CSV_COLUMNS, CSV_DECIMALS, DRIFTING, NEW, SPEC, WASTEFUL, batches, log
from normscope.spec import EventSpec

START = dt.datetime(2026, 5, 1)
ONE = EventSpec(numeric=("v",), categorical=("c",), dimensions=("d",), rates=("v",))


def rows(spark, values, entity="S", d="books", c="card"):
    made = [(i, entity, START + dt.timedelta(minutes=i), float(v), c, d) for i, v in enumerate(values)]
    return spark.createDataFrame(made, "event_id long, entity_id string, ts timestamp, v double, c string, d string")


def stats_of(spark, values):
    return baselines.numeric_baselines(rows(spark, values), ("v",), ()).first()


def test_dense_and_constant(spark):
    s = stats_of(spark, [20 + i % 4 for i in range(60)])
    assert (s["median"], s["mad"], s["sigma"]) == (21.5, 1.0, 1.4826)
    assert stats_of(spark, [50] * 40)["sigma"] == 0.5


def test_zero_inflation(spark):
    s = stats_of(spark, [0] * 80 + [50] * 20)
    assert s["zero_inflated"] and s["zero_share"] == 0.8 and s["median"] == 50.0 and s["informative"] == 20
    assert stats_of(spark, [0] * 90 + [50, 51, 49])["informative"] == 3


def test_scopes_and_fallback(spark):
    log_ = rows(spark, [20 + i % 3 for i in range(60)]).unionByName(rows(spark, [4000], d="luxury"))
    samples = baselines.scope_samples(log_, ("d",))
    numeric = baselines.numeric_baselines(log_, ("v",), ("d",))
    found = {r["scope_key"]: r for r in baselines.with_fallback(numeric, samples, ("d",)).collect()}
    assert found["d=luxury"]["fallback_from"] == "*" and found["d=luxury"]["sample_count"] == 1 and found["d=books"]["fallback_from"] is None
    looked = baselines.resolve_scope(log_, samples, ("d",)).groupBy("d").agg(F.max("baseline_scope").alias("s")).collect()
    assert {r["d"]: r["s"] for r in looked} == {"books": "d=books", "luxury": "*"}


def test_fallback_through_a_middle_scope(spark):
    base = rows(spark, range(50)).withColumn("e", F.lit("x"))
    rare = rows(spark, [1]).withColumn("e", F.lit("y"))
    log_ = base.unionByName(rare)
    found = baselines.with_fallback(baselines.numeric_baselines(log_, ("v",), ("d", "e")), baselines.scope_samples(log_, ("d", "e")), ("d", "e"))
    assert found.where("scope_key = 'd=books|e=y'").first()["fallback_from"] == "d=books"


def test_split_and_windows(spark):
    log_ = rows(spark, range(4008))
    assert history.split(log_, ONE).where("training").count() == 2404
    w = history.rolling_windows(rows(spark, range(5)), ["ts"], 2, "v").orderBy("ts").select("window").collect()
    assert [r[0] for r in w] == [[], [0.0], [0.0, 1.0], [1.0, 2.0], [2.0, 3.0]]


def test_scoped_history_against_brute_force(spark):
    r = np.random.default_rng(3)
    n = 300
    made = [(i, f"e{r.integers(3)}", START + dt.timedelta(minutes=i), float(i), "c", f"d{r.integers(3)}") for i in range(n)]
    log_ = spark.createDataFrame(made, "event_id long, entity_id string, ts timestamp, v double, c string, d string")
    got = history.with_ordinal(log_, ONE).select("event_id", F.count(F.lit(1)).over(history.frame(ONE, 1, 40)).alias("n")).collect()
    for row in got:
        me = made[row["event_id"]]
        past = [x for x in made[: row["event_id"]] if x[1] == me[1]][-40:]
        assert row["n"] == sum(x[5] == me[5] for x in past)


def test_rolling_quantile(spark):
    log_ = rows(spark, [100 + i % 10 for i in range(40)] + [5000])
    d = detectors.rolling_quantile(history.with_ordinal(log_, ONE), ONE).orderBy("ts").select("d_rolling_quantile.*").collect()
    assert d[-1]["score"] == pytest.approx(0.997868, abs=1e-6) and d[-1]["reasons"] and not d[5]["applicable"] and d[20]["score"] == 0
    inflated = rows(spark, ([0, 0, 0, 50] * 15) + [9000])
    assert detectors.rolling_quantile(history.with_ordinal(inflated, ONE), ONE).orderBy(F.desc("ts")).first()["d_rolling_quantile"]["score"] == pytest.approx(0.999442, abs=1e-6)


@pytest.mark.parametrize(("series", "split", "strength"), [([100] * 30 + [900] * 31, 30, 1.0), ([100 + i % 5 for i in range(59)] + [9000, 102], 56, 0.462017)])
def test_best_split(series, split, strength):
    got = detectors.best_split(np.array(series, dtype=float))
    assert got[0] == split and got[1] == pytest.approx(strength, abs=1e-6)


def test_best_split_against_brute_force():
    r = np.random.default_rng(5)
    for _ in range(30):
        x = r.normal(size=40)
        cost = {i: ((x[:i] - x[:i].mean()) ** 2).sum() + ((x[i:] - x[i:].mean()) ** 2).sum() for i in range(5, 36)}
        assert detectors.best_split(x)[0] == min(cost, key=cost.get)
    assert detectors.best_split(np.full(30, 2.0)) is None and detectors.best_split(np.arange(6.0)) is None


def test_peers(spark):
    made = []
    for k in range(12):
        share = 0.5 if k == 11 else 0.1
        made += [(k * 100 + i, f"S{k}", START, 10.0 if i < 40 * share else 0.0, "c", "d") for i in range(40)]
    log_ = spark.createDataFrame(made, "event_id long, entity_id string, ts timestamp, v double, c string, d string")
    profile = peers.profiles(log_, ONE)
    stats = peers.stats(profile).where("scope_key = '*' AND metric = 'rate:v'").first()
    assert stats["sigma"] == pytest.approx(0.1) and stats["peers"] == 12
    found = {(r["scope_key"], r["entity"]): r for r in peers.findings(profile, peers.stats(profile)).collect()}
    assert found["*", "S11"]["peer_rates"]["score"] == pytest.approx(0.615385, abs=1e-6) and found["*", "S1"]["peer_rates"]["score"] == 0
    stranger = rows(spark, [1.0], entity="new")
    assert not detectors.peer_group(stranger, log_, ONE).first()["d_peer_group"]["applicable"]


def test_forest(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 1))
    points = np.hstack([x, x + r.normal(scale=0.05, size=(400, 1))])
    f = forest.Forest(points)
    margins = f.margin(np.array([[0.0, 0.0], [1.5, -1.5]]))
    assert margins[1] < margins[0] and (forest.Forest(points).margin(points) == f.margin(points)).all()
    spec = EventSpec(numeric=("a", "b"), categorical=())
    log_ = spark.createDataFrame([(i, "e", START, float(a), float(b)) for i, (a, b) in enumerate(points)], "event_id long, entity_id string, ts timestamp, a double, b double")
    models = forest.fit(log_, spec)
    once = forest.score(log_.withColumn("baseline_scope", F.lit("*")), models, spec).orderBy("event_id").toPandas()["forest_margin"]
    again = forest.score(log_.repartition(7).withColumn("baseline_scope", F.lit("*")), forest.fit(log_.repartition(5), spec), spec).orderBy("event_id").toPandas()["forest_margin"]
    assert (once == again).all()
    missing = log_.limit(1).withColumns({"a": F.lit(None).cast("double"), "baseline_scope": F.lit("*")})
    assert forest.score(missing, models, spec).first()["forest_margin"] is None


def candidates(spark, made):
    return spark.createDataFrame([(e, str(i), START + dt.timedelta(hours=h), fp, level) for i, (e, h, fp, level) in enumerate(made)], "entity string, event_id string, at timestamp, fingerprint string, entity_level boolean")


def test_fold(spark):
    made = [("a", 0, "x", False), ("a", 1, "x", False), ("a", 74, "x", False), ("a", 75, "y", True), ("a", 500, "y", True), ("a", 501, "z", False), ("b", 0, "x", False)]
    got = {r["event_id"]: (r["kind"], r["ref"]) for r in cases.fold(candidates(spark, made)).collect()}
    # an accepted case anchors the window: 74 hours after it is a new one; the cap counts all that is open
    assert got == {"0": ("created", "0"), "1": ("duplicate", "0"), "2": ("created", "2"), "3": ("created", "3"), "4": ("duplicate", "3"), "5": ("capped", None), "6": ("created", "6")}


def test_fold_with_stored_cases(spark):
    stored = spark.createDataFrame([("a", "case-1", START, "x")], "entity string, case_id string, at timestamp, fingerprint string")
    got = cases.fold(candidates(spark, [("a", 1, "x", False)]), open_cases=stored).first()
    assert (got["kind"], got["ref"]) == ("duplicate", "case-1")


def test_fold_against_brute_force(spark):
    r = np.random.default_rng(9)
    made = [(f"e{r.integers(4)}", int(h), f"f{r.integers(4)}", bool(r.random() < 0.3)) for h in np.sort(r.integers(0, 400, 200))]
    expected, open_ = {}, {}
    for i, (e, h, fp, level) in sorted(enumerate(made), key=lambda x: (x[1][1], x[0])):
        mine = open_.setdefault(e, [])
        same = next((o for o in mine if o[0] == fp and (level or o[1] >= h - 72)), None)
        if same:
            expected[str(i)] = "duplicate"
        elif len(mine) >= 3:
            expected[str(i)] = "capped"
        else:
            mine.append((fp, h))
            expected[str(i)] = "created"
    assert {x["event_id"]: x["kind"] for x in cases.fold(candidates(spark, made)).collect()} == expected


@pytest.fixture(scope="module")
def demo(spark):
    found = tables.materialised(detection.detect(log(spark), SPEC))
    return found, cases.to_cases(found, SPEC).toPandas()


def test_planted_anomalies_are_found(demo):
    _, made = demo
    machines = set(made["entity_id"])
    assert 1 <= len(made) <= 30 and {WASTEFUL, DRIFTING, BURSTING} <= machines and NEW not in machines
    assert made.groupby("entity_id").size().max() <= 3
    assert made["evidence"].map(lambda e: e["strongest_detector"]).nunique() >= 4
    assert (made["event_payload"].map(lambda p: p["process"]) == "furnace").sum() <= 2
    found, _ = demo
    assert found.where("decision.kind = 'duplicate'").count() > len(made)
    assert ((made["confidence"] > 0) & (made["confidence"] <= 0.95)).all() and (made["reasons"].map(len) > 0).all()


def test_scores_recompute(demo):
    found, _ = demo
    again = ensemble.recomputed(F.col("results"), SPEC.detector_weights)
    assert found.where(F.abs(again - F.col("score")) > 0.01).count() == 0


def test_policy_and_threshold(spark, demo):
    found, made = demo
    scored = found.drop("gate", "policy_id", "fingerprint", "decision")
    policy = {"id": "p", "match": {"process": "lathe"}, "detectors": [], "max_score": 100.0}
    hidden = cases.to_cases(cases.decide(cases.gate(scored, SPEC, policies=[policy]), SPEC), SPEC)
    assert hidden.where("event_payload['process'] = 'lathe'").count() == 0
    high = cases.to_cases(cases.decide(cases.gate(scored, SPEC, cases.GateConfig(min_score=85.0)), SPEC), SPEC).count()
    assert high < len(made)
    again = cases.to_cases(cases.decide(cases.gate(scored, SPEC), SPEC), SPEC)
    assert again.count() == len(made) and cases.not_stored(again, again).count() == 0


def test_similar_and_narrative(spark, demo):
    found, made = demo
    stored = cases.to_cases(found, SPEC)
    views = similarity.views(stored)
    best = similarity.similar(views, views).toPandas()
    assert (best["total"] >= 0.25 - 1e-9).all() and best.groupby("target_id").size().max() <= 5 and (best["target_id"] != best["id"]).all()
    assert queue.narrative(stored).count() == len(made) and queue.notifications(stored, force=True).count() == len(made)


def test_cases_by_component(spark, demo):
    found, made = demo
    stored = cases.to_cases(found, SPEC)
    for d in C.DETECTORS:
        want = {i for i, e in zip(made["id"], made["evidence"], strict=True) if any(r["detector"] == d and r["applicable"] and r["score"] >= 0.4 for r in e["detectors"])}
        assert {r["id"] for r in queue.with_component(stored, d).select("id").collect()} == want


def test_a_batch_meets_the_store_without_a_shuffle_of_it(spark):
    spec = EventSpec(entity="e", time="t", event_id="k", numeric=("v",))
    batch = spark.createDataFrame([(i, f"{i}", None, {"e": "x", "t": "2026-05-01", "v": "1"}) for i in range(20)], "idx int, external_id string, occurred_at timestamp, payload map<string,string>")
    known = spark.range(100_000).select(F.col("id").cast("string").alias("external_key")).where("cast(external_key as int) % 2 = 0")
    out = ingest.outcomes(batch, spec, known.union(known), bounded=True)
    assert tuple(ingest.summary(out).first()) == (10, 10, 0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "broadcast" in plan


def test_events_without_a_time_are_at_the_epoch(spark):
    log_ = rows(spark, range(10)).unionByName(rows(spark, [1.0, 2.0]).withColumns({"ts": F.lit(None).cast("timestamp"), "event_id": F.col("event_id") + 100}))
    assert {r["event_id"] for r in history.split(log_, ONE, 0.25).where("training").collect()} == {100, 101, 0}


def test_queue_life(spark):
    made = spark.createDataFrame([("1", "t", "open", 70.0), ("2", "t", "open", 90.0)], "id string, tenant_id string, status string, anomaly_score double")
    made = made.withColumns({c: F.lit(None).cast(t) for c, t in (("assignee", "string"), ("resolution_note", "string"), ("resolved_at", "timestamp"))})
    assert [r["id"] for r in queue.top(made, 1).collect()] == ["2"]
    one = queue.assign(made, "1", "ann").where("id = '1'").first()
    assert (one["status"], one["assignee"]) == ("acknowledged", "ann") and queue.assign(made, "1", "ann", tenant="other").where("assignee IS NOT NULL").count() == 0
    assert queue.resolve(made, "1", "resolved").where("id = '1'").first()["resolved_at"] is not None and queue.resolve(made, "1", "in_progress").where("id = '1'").first()["resolved_at"] is None
    with pytest.raises(ValueError):
        queue.resolve(made, "1", "gone")
    labels = spark.createDataFrame([("a", "1", "false_positive", 1), ("b", "1", "true_exception", 2)], "id string, exception_id string, label string, created_at int")
    assert queue.latest_label(made, labels).where("id = '1'").first()["feedback_label"] == "true_exception" and queue.labelled(made, labels).count() == 2


def test_feedback(spark):
    made = [(str(i), "peer_group", "d=x", "true_exception" if i % 5 < 2 else "false_positive", 60.0 + i) for i in range(20)]
    labels = spark.createDataFrame(made, "id string, strongest string, baseline_scope string, label string, anomaly_score double")
    q = feedback.quality(labels).first()
    assert (q["total"], q["confirmed"], q["rejected"], q["precision"]) == (20, 8, 12, 0.4)
    assert feedback.weights(labels).first()["suggested"] == 0.7
    assert feedback.threshold(labels).first()["suggested"] == 80.0
    p = feedback.policies(labels).first()
    assert p["support"] == 12 and p["max_score"] == 81.0 and p["match"] == {"d": "x"} and len(p["supporting"]) == 10
    few = labels.limit(14)
    assert feedback.weights(few).count() == 0 and feedback.policies(few).count() == 0 and feedback.threshold(few).first()["suggested"] is None
    promoted = feedback.promote(SPEC, labels, apply_weights=True, apply_threshold=True)
    assert promoted.weights["peer_group"] == 0.7 and promoted.min_score == 80.0 and feedback.promote(SPEC, labels) == SPEC


def test_ingest_is_idempotent(spark):
    spec = EventSpec(entity="e", time="t", event_id="k", numeric=("v",))
    made = [
        (0, "a", None, {"e": "x", "t": "2026-05-01", "v": "1"}), (1, "a", None, {"e": "x", "t": "2026-05-01", "v": "1"}), (2, None, None, {"e": " ", "t": "2026-05-01", "v": "1"}),
        (3, None, None, {"e": "x", "t": "soon", "v": "1"}), (4, None, None, {"e": "x", "t": "2026-05-01"}), (5, None, None, {"e": "x", "t": "2026-05-01T01:00:00Z", "v": None}), (6, "known", None, {"e": "x", "t": "2026-05-01", "v": "1"}),
    ]
    batch = spark.createDataFrame(made, "idx int, external_id string, occurred_at timestamp, payload map<string,string>")
    known = spark.createDataFrame([("known",)], "external_key string")
    out = ingest.outcomes(batch, spec, known)
    assert tuple(ingest.summary(out).first()) == (2, 2, 3) and [r["idx"] for r in ingest.errors(out).collect()] == [2, 3, 4]
    assert out.where("idx = 5").first()["external_key"] == "x:2026-05-01T01:00:00Z"
    again = ingest.outcomes(batch, spec, out.where("outcome = 'accepted'").select("external_key").unionByName(known))
    assert ingest.summary(again).first()["accepted"] == 0
    assert ingest.summary(ingest.outcomes(batch.limit(0), spec, known)).first()["accepted"] == 0
    assert tables.typed_events(out.where("outcome = 'accepted'").withColumnRenamed("at", "at"), spec).count() == 2


def test_catalog(spark, tmp_path):
    a, b = tables.Catalog(spark, f"file://{tmp_path}", "a"), tables.Catalog(spark, f"file://{tmp_path}", "b")
    assert not a.exists("cases")
    a.append("cases", spark.range(3))
    b.append("cases", spark.range(5))
    assert a.read("cases").count() == 3 and b.read("cases").count() == 5
    numeric = baselines.numeric_baselines(rows(spark, range(40)), ("v",), ("d",))
    assert [a.save_baselines(ONE, numeric), a.save_baselines(ONE, numeric)] == [1, 2]
    assert a.active_baselines(ONE).agg(F.min("version"), F.count("*")).first()[0:2] == (2, 2)
    a.audit("run", "schema", "s")
    assert a.read("audit").count() == 1


def test_csv(spark, tmp_path):
    tables.write_csv(log(spark, 40), f"{tmp_path}/csv", CSV_COLUMNS, CSV_DECIMALS)
    back = spark.read.csv(f"{tmp_path}/csv", header=True)
    assert back.columns == list(CSV_COLUMNS) and back.count() == len(batches(40)) and all("." in r["energy_kwh"] for r in back.collect())


def test_deliver_reports_failure(spark):
    def broken(_):
        raise RuntimeError

    assert tables.deliver(spark.range(1), broken).first()["status"] == "failed" and tables.deliver(spark.range(1), lambda _: None).first()["status"] == "delivered"


def test_empty_log(spark):
    assert detection.detect(rows(spark, []), ONE, use=C.DETECTORS).count() == 0
