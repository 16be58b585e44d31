"""A detector that raises costs its own score alone; storage and Spark failures stop the run. What runs learn is stored and scores again."""

import os
import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from normscope import constants as C
from normscope.operators import cases, detectors, forest, history, walks
from normscope.plans import detection, operations
from normscope.sources import tables
from normscope.sources.tables import Catalog
from normscope.spec import EventSpec

SPEC = EventSpec(name="s", entity="e", time="t", event_id="k", numeric=("v", "w"), categorical=("c",), dimensions=("c",), rates=("w",), min_score=40.0)


def events(spark, n=400):
    r = np.random.default_rng(1)
    value = r.uniform(10, 20, n)
    value[-3:] = 900.0
    return spark.createDataFrame(pd.DataFrame({
        "k": [f"k{i:04d}" for i in range(n)], "e": [f"e{i % 8}" for i in range(n)], "t": pd.Timestamp("2025-01-01") + pd.to_timedelta(np.arange(n), unit="h"),
        "v": value, "w": r.uniform(0, 1, n), "c": ["x"] * n,
    }))


def scores(rows):
    """{event: {detector: (applicable, score)}} and the notes of failures."""
    got = rows.select("k", "results").collect()
    return {r["k"]: {d["detector"]: (d["applicable"], round(d["score"], 9)) for d in r["results"]} for r in got}, {(d["detector"], d["note"]) for r in got for d in r["results"] if (d["note"] or "").startswith(detectors.FAILED)}


@pytest.fixture(scope="module")
def plain(spark):
    got, failed = scores(detection.score(events(spark), SPEC))
    assert not failed and all(any(e[d][0] for e in got.values()) for d in C.DETECTORS)
    return got


def raises(*args, **kwargs):
    raise ZeroDivisionError("planted")


def broken_plan(events_, run):
    return events_.withColumn("d_x", F.col("no_such_column"))


#: Where each detector can raise: in a batch of its Python code, or in its plan.
PLACES = {
    "change_point": [(walks, "best_split")], "rolling_quantile": [(walks, "quantile")], "isolation_forest": [(forest.Forest, "_grow")],
    "robust_deviation": [None], "categorical_rarity": [None], "peer_group": [None],
}


@pytest.mark.parametrize(("name", "place"), [(n, p) for n, places in PLACES.items() for p in places])
def test_a_raising_detector_leaves_the_others(spark, plain, monkeypatch, name, place):
    if place is None:
        monkeypatch.setitem(detectors.REGISTRY, name, detectors.Detector(name, broken_plan))
    elif place[0] is walks:  # tasks import the module anew: the failing walk goes along by value
        kind = "cp" if name == "change_point" else "rq"

        class Failing(walks.Walk):
            def rolling(self, where):
                return raises() if kind == "rq" else super().rolling(where)

            def change(self, where, values):
                return raises() if kind == "cp" else super().change(where, values)

        monkeypatch.setattr(walks, "Walk", Failing)
    else:

        class Broken(forest.Forest):
            pass

        setattr(Broken, place[1], raises)
        monkeypatch.setattr(forest, "Forest", Broken)
    rows = detection.score(events(spark), SPEC)
    got, failed = scores(rows)
    assert {d for d, _ in failed} == {name} and all("ZeroDivision" in n or "no_such_column" in n for _, n in failed)
    assert got.keys() == plain.keys()
    for k, of in got.items():
        assert not of[name][0] and {d: s for d, s in of.items() if d != name} == {d: s for d, s in plain[k].items() if d != name}
    decided = cases.decide(cases.gate(rows, SPEC), SPEC)
    assert tables.run_metrics(decided, "r").first()["detector_failures"] == {name: len(got)}


def test_a_margin_that_raises_leaves_the_others(spark, plain, tmp_path):
    """A file that can be read, of something that has no margins."""
    log = events(spark)
    cut = history.cutoff(log, SPEC)
    learned = detection.learn(log.where(history.is_training(SPEC, cut)), SPEC)
    with open(f"{tmp_path}/odd", "wb") as f:
        f.write(pickle.dumps(3))
    odd = learned.forests.withColumn("file", F.lit(f"file://{tmp_path}/odd"))
    got, failed = scores(detection.score(log, SPEC, learned=detectors.Learned(learned.samples, learned.numeric, learned.categorical, learned.peer_groups, learned.peers, odd)))
    assert {d for d, _ in failed} == {"isolation_forest"} and all("AttributeError" in n for _, n in failed)
    for k, of in got.items():
        assert not of["isolation_forest"][0] and {d: s for d, s in of.items() if d != "isolation_forest"} == {d: s for d, s in plain[k].items() if d != "isolation_forest"}


def test_failing_storage_fails_the_run(spark, monkeypatch, tmp_path):
    def full(*_args, **_kwargs):
        raise OSError("no space")

    monkeypatch.setattr(forest, "publish", full)
    with pytest.raises(OSError):
        detection.score(events(spark), SPEC)
    store = Catalog(spark, f"file://{tmp_path}/store", "t")
    operations.register(store, SPEC)
    store.append("events", events(spark, 40).select(F.lit("s").alias("schema_id"), F.col("k").alias("external_key"), F.col("e").alias("entity_id"), F.col("t").alias("at"), F.create_map(F.lit("v"), F.col("v").cast("string"), F.lit("w"), F.col("w").cast("string"), F.lit("c"), F.col("c")).alias("payload")))
    with pytest.raises(OSError):
        operations.run_detection(store, SPEC, "r")
    assert operations.run(store, "r").first()["status"] == "failed"


def test_a_lost_model_file_fails_the_run(spark):
    log = events(spark)
    learned = detection.learn(log, SPEC)
    lost = learned.forests.withColumn("file", F.concat("file", F.lit("-lost"))).withColumn("error", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="lost"):
        detection.score(log, SPEC, learned=detectors.Learned(learned.samples, learned.numeric, learned.categorical, learned.peer_groups, learned.peers, lost), train_ratio=0.0)


def test_stored_versions_score_again(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/store", "t")
    operations.register(store, SPEC)
    shown = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in ("v", "w", "c")]))
    put = lambda rows: store.append("events", rows.select(F.lit("s").alias("schema_id"), F.col("k").alias("external_key"), F.col("e").alias("entity_id"), F.col("t").alias("at"), shown.alias("payload")))
    put(events(spark))
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    first = operations.run_detection(store, SPEC)
    assert len(set(os.listdir(root)) - before) <= 1  # a run leaves no tables beside the tenant's, but the cases' small one
    done = operations.run(store, first).first()
    assert (done["status"], done["version"], done["scored"], done["detector_failures"]) == ("completed", 1, 160, {})
    assert {r["status"] for r in store.read("runs").collect()} == {"running", "completed"}
    again = detection.score(operations.events(store, SPEC), SPEC, learned=operations.load_learned(store, SPEC, 1))
    assert scores(again) == scores(detection.score(operations.events(store, SPEC), SPEC, learned=operations.load_learned(store, SPEC)))
    assert scores(again) == scores(detection.score(operations.events(store, SPEC), SPEC))  # as the fit that was stored
    # other events change what a new run learns, not what version 1 says of the old ones
    put(events(spark).withColumns({"k": F.concat(F.lit("n"), "k"), "v": F.col("v") * 3, "t": F.col("t") + F.expr("INTERVAL 400 HOURS")}))
    second = operations.run_detection(store, SPEC, version=1, train_ratio=0.0)
    assert operations.run(store, second).first()["version"] == 1 and operations.run(store, second).first()["scored"] == 800
    assert operations.run(store, operations.run_detection(store, SPEC)).first()["version"] == 2
    kept = operations.load_learned(store, SPEC, 1).numeric.where("scope_key = '*' AND feature = 'v'").first()["median"]
    moved = operations.load_learned(store, SPEC).numeric.where("scope_key = '*' AND feature = 'v'").first()["median"]
    assert kept < 20 and moved > kept
    with pytest.raises(LookupError):
        operations.load_learned(store, SPEC, 9)


def test_ten_thousand_policies(spark):
    r = np.random.default_rng(4)
    columns = ("c", "e", "gone")
    made = []
    for i in range(10_000):
        of = [c for c in columns if r.random() < (0.1 if c == "gone" else 0.6)]
        match = {c: str({"c": r.choice(["x", "y", ""]), "e": f"e{r.integers(40)}", "gone": r.choice(["", "z"])}[c]) for c in of}
        made.append((i + 1, f"p{i}", match, [str(d) for d in r.choice(C.DETECTORS, r.integers(0, 3), replace=False)], float(r.uniform(0, 60 if match else 10)), bool(r.random() < 0.9)))
    rows = [(f"k{i}", f"e{r.integers(50)}", [None, "x", "y"][r.integers(3)], float(r.uniform(0, 100)), [None, *C.DETECTORS][r.integers(7)]) for i in range(500)]
    spec = EventSpec(entity="e", time="t", event_id="k", numeric=("v",), dimensions=("c",))
    scored = spark.createDataFrame(rows, "k string, e string, c string, score double, strongest string").withColumns({"t": F.current_timestamp(), "v": F.lit(1.0)})
    held = spark.createDataFrame(made, "ordinal int, id string, match map<string,string>, detectors array<string>, max_score double, active boolean")
    got = cases.with_policy(scored, spec, held)
    found = {x["k"]: x["policy_id"] for x in got.select("k", "policy_id").collect()}
    for k, e, c, score, strongest in rows:
        value = {"c": c or "", "e": e, "gone": ""}
        want = next((p for _, p, match, names, most, active in made if active and score <= most and (not names or strongest in names) and all(value[m] == v for m, v in match.items())), None)
        assert found[k] == want, k
    assert sum(p is not None for p in found.values()) > 50
    few = cases.with_policy(scored, spec, held.limit(200))
    size = lambda df: str(df._jdf.queryExecution().optimizedPlan().toString()).count("Join")
    assert size(got) <= size(few) + 2 and set(got.columns) == {*scored.columns, "policy_id"}


def test_a_hot_entity_is_many_tasks(spark, monkeypatch):
    """Chunks of an entity with their history give what one walk gives."""
    log = events(spark, 900).withColumn("e", F.lit("one")).withColumn("rn", F.expr("cast(substring(k, 2) as int) + 1"))
    whole = {r["k"]: (r["rq"], r["cp"]) for r in walks.walked(log, SPEC).collect()}
    monkeypatch.setattr(walks, "CHUNK", 420)
    cut = {r["k"]: (r["rq"], r["cp"]) for r in walks.walked(log, SPEC).collect()}
    assert whole == cut and len(cut) == 900
    only = walks.walked(log, SPEC, ["rq"], F.col("v") > 100)
    assert {r["k"]: r["rq"] for r in only.collect()} == {f"k{i:04d}": whole[f"k{i:04d}"][0] for i in (897, 898, 899)}


def test_walk_against_windows_by_hand():
    r = np.random.default_rng(8)
    made = [((f"a{r.integers(2)}", f"b{r.integers(3)}"), (None if r.random() < 0.1 else float(r.choice([0.0, *r.normal(5, 2, 2)])),)) for _ in range(300)]
    walk = walks.Walk(1, limit=50)
    for k, (where, values) in enumerate(made):
        past = made[max(0, k - 50) : k]
        same = next((x for d in (2, 1) if len(x := [v for w, v in past if w[:d] == where[:d]]) >= C.ROLLING_MIN_HISTORY), [v for w, v in past if w[:1] == where[:1]])
        x = np.array([v for (v,) in same if v is not None])
        n, ((m, nz, upper, median),) = walk.rolling(where)
        assert (n, m, nz) == (len(same), len(x), int((x != 0).sum()))
        used = x[x != 0] if len(x) and (x == 0).mean() >= C.ZERO_INFLATION_SHARE else x
        if len(used):
            assert (upper, median) == pytest.approx(tuple(np.quantile(used, (C.ROLLING_QUANTILE, 0.5))))
        walk.push(where, values)


def test_each_payload_has_its_status(spark, tmp_path):
    sent = f"{tmp_path}/sent"
    rows = spark.createDataFrame([(str(i), f"t{i}") for i in range(6)], "exception_id string, title string").repartition(3)

    def send(key, payload):
        with open(sent, "a") as f:
            f.write(f"{payload['exception_id']} {key}\n")
        if payload["exception_id"] in ("2", "4"):
            raise ConnectionError(payload["title"])

    got = tables.deliver_each(rows, send, tries=2)
    assert {r["exception_id"]: (r["status"], r["attempts"]) for r in got.collect()} == {str(i): ("failed", 2) if i in (2, 4) else ("delivered", 1) for i in range(6)}
    assert all("ConnectionError" in r["error"] for r in got.where("status = 'failed'").collect())
    lines = [x.split() for x in open(sent)]
    assert len(lines) == 8 and len({k for _, k in lines}) == 6  # tries of one payload share a key
    again = tables.deliver_each(rows, send, tries=1, known=got)
    assert {r["exception_id"] for r in again.collect()} == {"2", "4"}
    assert tables.deliver(rows, lambda _: 1 / 0).first()["error"].startswith("ZeroDivision")
