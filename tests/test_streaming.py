"""Streams against what a batch run has learned."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from normscope.operators import cases, detectors, history
from normscope.plans import detection
from normscope.spec import EventSpec
from normscope.streaming import micro

SPEC = EventSpec(numeric=("v",), categorical=("c",), dimensions=("d",))
SCHEMA = "event_id long, entity_id string, ts timestamp, v double, c string, d string"
START = dt.datetime(2026, 5, 1)


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_micro_batches(spark, tmp_path):
    log = spark.createDataFrame([(i, "e", START + dt.timedelta(minutes=i), 20.0 + i % 4, "card", "books") for i in range(60)], SCHEMA)
    learned = detection.learn(log, SPEC)
    new = [(100, "e", START + dt.timedelta(days=1), 5000.0, "card", "books"), (101, "e", START + dt.timedelta(days=1), 21.0, "card", "books"), (100, "e", START + dt.timedelta(days=1), 5000.0, "card", "books")]
    spark.createDataFrame(new, SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    drained(micro.scored(micro.deduplicated(stream, SPEC), learned, SPEC).select("event_id", "score", "severity"), "scored")
    got = {r["event_id"]: r for r in spark.table("scored").collect()}
    assert spark.table("scored").count() == 2 and got[100]["score"] > 99 and got[100]["severity"] == "critical" and got[101]["score"] < 50
    drained(micro.hourly_levels(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), SPEC, "v").select("scope_key", "n", F.col("largest")), "levels", "complete")
    assert spark.table("levels").first()["n"] == 3


def everything(spark, n=520):
    """A log with two numeric features, two dimensions, zeros, level shifts and odd values."""
    r = np.random.default_rng(11)
    rows = []
    for i in range(n):
        e = i % 9
        v = float(20 + r.integers(5) + 60 * (e == 1 and i > 180) + 900 * (i in (200, 230)))
        rows.append((i, f"e{e}", START + dt.timedelta(minutes=7 * i), v, float(0 if r.random() < 0.5 else r.uniform(1, 9)), "cash" if i == 240 else "card", "books" if i % 6 else "toys"))
    return spark.createDataFrame(rows, "event_id long, entity_id string, ts timestamp, v double, w double, c string, d string")


WIDE = EventSpec(numeric=("v", "w"), categorical=("c",), dimensions=("d",), rates=("w",))


@pytest.fixture
def timers(spark):
    """The state store that timers need, for streams alone."""
    before = spark.conf.get(micro.STATE_STORE[0])
    spark.conf.set(*micro.STATE_STORE)
    yield
    spark.conf.set(micro.STATE_STORE[0], before)


def shuffled_batches(spark, log, folder, batches=4):
    """The log in files that overlap in time, each row shuffled within, some rows twice; then an event that moves the watermark past all."""
    r = np.random.default_rng(3)
    rows = log.collect()
    size = -(-len(rows) // batches)
    # each event comes up to a third of a batch late: out of order, but within the watermark
    order = sorted(range(len(rows)), key=lambda i: i + r.integers(0, size // 3))
    parts = [order[k : k + size] for k in range(0, len(order), size)]
    parts = [[*p, *r.choice(p, 5).tolist(), *(parts[k - 1][-3:] if k else [])] for k, p in enumerate(parts)]
    end = START + dt.timedelta(days=60)
    for p in [*parts, None, None]:
        made = [rows[i] for i in r.permutation(p)] if p else [(9999 + int(r.integers(10**6)), "end", end := end + dt.timedelta(days=1), 1.0, 1.0, "card", "books")]
        spark.createDataFrame(made, log.schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_gives_the_fused_scores_of_a_batch(spark, tmp_path, timers):
    log = everything(spark)
    cut = history.cutoff(log, WIDE, 0.5)
    learned = detection.learn(log.where(history.is_training(WIDE, cut)), WIDE)
    shuffled_batches(spark, log, f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drained(micro.fused(stream, learned, WIDE, watermark="6 hours").select("event_id", "score", "severity", "confidence", "strongest", "results"), "fused")
    got = [r for r in spark.table("fused").collect() if r["event_id"] < 9999]
    batch = {r["event_id"]: r for r in detection.score(log, WIDE, learned=learned, train_ratio=0.0).collect()}
    assert len(got) == len(batch) == 520  # each once, none lost
    for r in got:
        want = batch[r["event_id"]]
        assert (r["score"], r["severity"], r["confidence"], r["strongest"]) == (want["score"], want["severity"], want["confidence"], want["strongest"])
        assert [(d["detector"], d["applicable"], d["score"], len(d["reasons"])) for d in r["results"]] == [(d["detector"], d["applicable"], d["score"], len(d["reasons"])) for d in want["results"]]
    assert {d["detector"] for r in got for d in r["results"] if d["applicable"]} == set(detectors.REGISTRY)


def test_old_state_goes(spark, tmp_path, timers):
    """After the time to live an entity starts anew."""
    rows = [(i, "e", START + dt.timedelta(minutes=i), 20.0, "card", "books") for i in range(30)]
    rows += [(100 + i, "e", START + dt.timedelta(days=40, minutes=i), 20.0, "card", "books") for i in range(3)]
    rows += [(200, "x", START + dt.timedelta(days=20), 1.0, "card", "books"), (201, "x", START + dt.timedelta(days=30), 1.0, "card", "books"), (202, "x", START + dt.timedelta(days=90), 1.0, "card", "books"), (203, "x", START + dt.timedelta(days=91), 1.0, "card", "books")]
    for part in (rows[:30], rows[33:34], rows[34:35], rows[30:33], rows[35:36], rows[36:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drained(micro.walked(stream, SPEC, watermark="1 hour", ttl=5 * 86_400_000), "aged")
    n = {r["event_id"]: r["rq"]["n"] for r in spark.table("aged").collect()}
    assert n[29] == 29 and n[100] == 0 and n[102] == 2


def made_candidates(spark, n=240):
    r = np.random.default_rng(9)
    rows = [(f"e{r.integers(4)}", str(i), START + dt.timedelta(hours=float(h)), f"f{r.integers(4)}", bool(r.random() < 0.3)) for i, h in enumerate(np.sort(r.integers(0, 900, n)))]
    return rows, "entity string, event_id string, at timestamp, fingerprint string, entity_level boolean"


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_any_cut_folds_as_a_batch(spark, tmp_path, monkeypatch, cuts):
    rows, schema = made_candidates(spark)
    whole = spark.createDataFrame(rows, schema)
    closing = [(r["entity"], r["event_id"], rows[int(r["event_id"])][2] + dt.timedelta(hours=30)) for r in cases.fold(whole).where("kind = 'created'").collect() if int(r["event_id"]) % 2]
    spark.createDataFrame(closing, micro.RESOLUTION).write.parquet(f"{tmp_path}/closed")
    closed = spark.read.parquet(f"{tmp_path}/closed")
    want = sorted(map(tuple, cases.fold(whole, resolutions=closed).select("entity", "event_id", "kind", "ref").collect()))
    assert sum(x[2] == "created" for x in want) > sum(r["kind"] == "created" for r in cases.fold(whole).collect())
    monkeypatch.setattr(cases, "gate", lambda scored, *_: scored)
    monkeypatch.setattr(cases, "candidates_of", lambda gated, _: gated)
    sink = micro.FoldSink(spark, f"file://{tmp_path}/cases", SPEC, cases.GateConfig(), resolutions=f"file://{tmp_path}/closed")
    size = -(-len(rows) // cuts)
    for batch in range(cuts):
        part = spark.createDataFrame(rows[batch * size : (batch + 1) * size], schema)
        sink(part, batch)
        sink(part, batch)  # a replay adds nothing
    assert sorted(map(tuple, sink.decisions().select("entity", "event_id", "kind", "ref").collect())) == want


def test_stream_into_cases(spark, tmp_path, timers):
    """From shuffled micro-batches to the decisions that a batch run makes."""
    log = everything(spark)
    learned = detection.learn(log.where("event_id < 130"), WIDE)
    shuffled_batches(spark, log, f"{tmp_path}/in", 3)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    config = cases.GateConfig(min_score=40.0, min_confidence=0.1)
    sink = micro.FoldSink(spark, f"file://{tmp_path}/cases", WIDE, config)
    q = micro.fused(stream, learned, WIDE, watermark="6 hours").writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["event_id"]: (r["kind"], r["ref"]) for r in sink.decisions().collect() if int(r["event_id"]) < 9999}
    decided = detection.detect(log, WIDE, learned=learned, train_ratio=0.0, config=config).where("gate = 'candidate'")
    want = {str(r["event_id"]): (r["decision"]["kind"], r["decision"]["ref"]) for r in decided.collect()}
    assert got == want and {k for k, _ in want.values()} >= {"created", "duplicate"}
