"""The registered queries: one for each operator, over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..operators import baselines, cases, detectors, ensemble, feedback, forest, history, peers, queue, results, similarity
from ..sources import ingest, logs, tables
from ..spec import EventSpec
from . import detection



def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs.events(spark, sf_dir)
    return history.split(log, logs.EVENTS).where("training").drop("training")


# ---------------------------------------------------------------- runs


def flagship_case_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a detection run, from the log to its cases."""
    found = detection.case_queue(logs.events(spark, sf_dir), logs.EVENTS)
    return found.select("id", "entity_id", "event_id", "fingerprint", "title", "anomaly_score", "severity", "confidence", "baseline_scope", F.size("reasons").alias("n_reasons"))


STATED = tuple(d for d in C.DETECTORS if d != "isolation_forest")


def detector_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run without the forest, whose trees no SQL states: every scored event's fused result and gate, from the detectors themselves."""
    scored = detection.score(logs.events(spark, sf_dir), logs.EVENTS, use=STATED)
    rows = cases.gate(scored, logs.EVENTS)
    return rows.select("event_id", "score", "strongest", F.col("n_applicable").cast("long"), F.col("n_firing").cast("long"), "confidence", "gate")


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = detection.detect(logs.events(spark, sf_dir), logs.EVENTS)
    return tables.run_metrics(decided, "run").drop("finished_at", "error", "version", "revision", "detector_failures")


# ---------------------------------------------------------------- split, baselines


def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.split(logs.events(spark, sf_dir), logs.EVENTS).select("event_id", "training")


def baseline_rollup_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.numeric_baselines(_training(spark, sf_dir), logs.EVENTS.numeric, logs.EVENTS.dimensions)


def baseline_rollup_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.numeric_baselines(logs.lineitem(spark, sf_dir), logs.LINEITEM.numeric, logs.LINEITEM.dimensions)


def baseline_zero_inflated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.numeric_baselines(logs.events(spark, sf_dir), ("error_cost",), ())


def baseline_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = baselines.categorical_baselines(logs.lineitem(spark, sf_dir), logs.LINEITEM.categorical, logs.LINEITEM.dimensions)
    return found.withColumn("share", F.round("share", 6))


FALLBACK_DIMENSIONS, FALLBACK_MIN = ("c_mktsegment", "o_orderpriority"), 600


def baseline_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.orders(spark, sf_dir).join(logs.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("c_mktsegment", "o_orderpriority", "o_totalprice")
    numeric = baselines.numeric_baselines(rows, ("o_totalprice",), FALLBACK_DIMENSIONS)
    samples = baselines.scope_samples(rows, FALLBACK_DIMENSIONS, FALLBACK_MIN)
    found = baselines.with_fallback(numeric, samples, FALLBACK_DIMENSIONS)
    return found.select("scope_key", "sample_count", "adequate", "fallback_from", "median", "sigma")


LOOKUP_MIN = 1200


def baseline_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = baselines.scope_samples(_training(spark, sf_dir), logs.EVENTS.dimensions, LOOKUP_MIN)
    return baselines.resolve_scope(logs.events(spark, sf_dir), samples, logs.EVENTS.dimensions).select("event_id", "baseline_scope")


# ---------------------------------------------------------------- detectors


def _scored_slice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, EventSpec]:
    spec = logs.EVENTS
    rows = history.split(logs.events(spark, sf_dir), spec)
    training = rows.where("training")
    samples = baselines.scope_samples(training, spec.dimensions)
    return baselines.resolve_scope(rows.where(~F.col("training")), samples, spec.dimensions), training, spec


def _robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, training, spec = _scored_slice(spark, sf_dir)
    return detectors.robust_deviation(rows, baselines.numeric_baselines(training, spec.numeric, spec.dimensions), spec)


def robust_deviation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d_robust_deviation")
    return _robust(spark, sf_dir).select("event_id", "baseline_scope", d["applicable"].alias("applicable"), F.round(d["score"], 6).alias("score"))


def robust_deviation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _robust(spark, sf_dir).select("event_id", F.explode("d_robust_deviation.reasons").alias("r"))
    return rows.select("event_id", "r.feature", F.round("r.observed_num", 6).alias("observed_num"), F.round("r.lo", 4).alias("lo"), F.round("r.hi", 4).alias("hi"), "r.deviation")


def categorical_rarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, rows = logs.ORDERS, logs.orders(spark, sf_dir)
    found = baselines.categorical_baselines(rows, spec.categorical, spec.dimensions)
    rows = baselines.resolve_scope(rows, baselines.scope_samples(rows, spec.dimensions), spec.dimensions)
    d = F.col("d_categorical_rarity")
    return detectors.categorical_rarity(rows, found, spec).select("o_orderkey", F.round(d["score"], 6).alias("score"), F.size(d["reasons"]).cast("long").alias("n_reasons"))


def rolling_window_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.rolling_windows(logs.events(spark, sf_dir), ["ts", "event_id"], 20, "value", ["user_id"])
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return rows.select("event_id", F.size("window").cast("long").alias("n"), F.round(total, 4).alias("total"))


def scoped_history_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = logs.EVENTS
    rows = history.with_ordinal(logs.events(spark, sf_dir), spec).withColumn("depth", history.depth_for(spec, C.ROLLING_MIN_HISTORY))
    return rows.select("event_id", "rn", "depth", history.at_depth(spec, "depth", lambda w: F.count(F.lit(1)).over(w)).alias("n"))


def rolling_quantile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detectors.rolling_quantile(history.with_ordinal(logs.events(spark, sf_dir), logs.EVENTS), logs.EVENTS)
    d = F.col("d_rolling_quantile")
    return rows.select("event_id", d["applicable"].alias("applicable"), F.round(d["score"], 5).alias("score"), F.size(d["reasons"]).cast("long").alias("n_reasons"))


def change_point_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detectors.change_point(history.with_ordinal(logs.events(spark, sf_dir), logs.EVENTS), logs.EVENTS)
    d = F.col("d_change_point")
    return rows.select("event_id", d["applicable"].alias("applicable"), F.round(d["score"], 5).alias("score"), F.size(d["reasons"]).cast("long").alias("n_reasons"))


def peer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.profiles(logs.lineitem(spark, sf_dir), logs.LINEITEM).withColumn("value", F.round("value", 3))


def peer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = peers.stats(peers.profiles(logs.lineitem(spark, sf_dir), logs.LINEITEM))
    return found.withColumns({c: F.round(c, 5) for c in ("median", "sigma")})


def peer_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = peers.profiles(logs.lineitem(spark, sf_dir), logs.LINEITEM)
    found = peers.findings(profile, peers.stats(profile))
    return found.select("scope_key", "entity", F.round("peer_all.score", 5).alias("score"), F.round("peer_rates.score", 5).alias("rate_score"))


def peer_group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, training, spec = _scored_slice(spark, sf_dir)
    d = F.col("d_peer_group")
    return detectors.peer_group(rows, training, spec).select("event_id", d["applicable"].alias("applicable"), d["scope"].alias("scope"), F.round(d["score"], 5).alias("score"))


def isolation_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, training, spec = _scored_slice(spark, sf_dir)
    found = forest.score(rows, forest.fit(training, spec), spec)
    return found.select("event_id", "baseline_scope", F.round("forest_margin", 6).alias("margin"), F.round(S.margin_score(F.col("forest_margin")), 6).alias("score"))


# ---------------------------------------------------------------- ensemble and gates


def _made_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with results of all six detectors made by arithmetic on their ids, so that the oracle can
    make the same."""
    rows = logs.events(spark, sf_dir)
    made = []
    for i, d in enumerate(C.DETECTORS):
        applies = F.pmod(F.col("event_id") + i, F.lit(i + 2)) != 0
        score = F.when(F.pmod(F.col("event_id"), F.lit(7)) == 0, F.lit(0.0)).otherwise(F.pmod(F.col("event_id") * (37 + 12 * i) + 11 * i, F.lit(997)) / 997.0)
        why = F.when(score >= 0.5, F.array(results.reason(d, F.lit(("value", "k")[i % 2]), F.lit(None), F.col("value"), F.lit(None), F.lit(None), score, F.lit(f"by {d}"), F.lit("*")))).otherwise(results.no_reasons())
        made.append(results.result(d, applies, score, why, scope=S.scope_key(logs.EVENTS.dimensions)).alias(f"d_{d}"))
    return ensemble.fuse(rows.select("*", *made), logs.EVENTS)


def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made_results(spark, sf_dir).select("event_id", "score", "weighted_mean")


def confidence_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made_results(spark, sf_dir).select("event_id", F.col("n_applicable").cast("long"), F.col("n_firing").cast("long"), "confidence", "severity")


def strongest_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made_results(spark, sf_dir).select("event_id", "strongest", F.size("reasons").cast("long").alias("n_reasons"))


def recompute_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made_results(spark, sf_dir)
    again = ensemble.recomputed(F.col("results"), logs.EVENTS.detector_weights)
    return rows.select("event_id", again.alias("recomputed"), (F.abs(again - F.col("score")) < 0.01).alias("matches"))


POLICIES = (
    {"id": "p1", "match": {"event_type": "error"}, "detectors": ["peer_group", "change_point"], "max_score": 95.0},
    {"id": "p2", "match": {"event_type": "view"}, "detectors": [], "max_score": 80.0},
    {"id": "p3", "match": {}, "detectors": ["isolation_forest"], "max_score": 90.0, "active": True},
    {"id": "p4", "match": {}, "detectors": [], "max_score": 100.0, "active": False},
)


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the policies as a table."""
    rows = [(k, p["id"], p["match"], p["detectors"], p["max_score"], p.get("active", True)) for k, p in enumerate(POLICIES)]
    held = spark.createDataFrame(rows, "ordinal int, id string, match map<string,string>, detectors array<string>, max_score double, active boolean")
    return cases.gate(tables.materialised(_made_results(spark, sf_dir)), logs.EVENTS, cases.GateConfig(), held)


def policy_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).where("policy_id IS NOT NULL").select("event_id", "policy_id")


def gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).groupBy("gate").agg(F.count(F.lit(1)).alias("events"))


def case_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).where("gate = 'candidate'").select("event_id", "fingerprint")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("entity"), "event_id", F.col("ts").alias("at"), F.pmod("event_id", F.lit(5)).cast("string").alias("fingerprint"),
        (F.pmod("event_id", F.lit(5)) == 0).alias("entity_level"),
    )


def dedup_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = cases.fold(_candidates(spark, sf_dir))
    return folded.select(F.col("event_id").cast("long").alias("event_id"), "kind", F.col("ref").cast("long").alias("ref"))


# ---------------------------------------------------------------- queue


def _order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the part of cases: priority is severity, status O is open."""
    rows = logs.orders(spark, sf_dir)
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("resolved")
    severity = F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("2"), "high").when(F.col("o_orderpriority").startswith("3"), "medium").otherwise("low")
    return rows.select(
        F.col("o_orderkey").alias("id"), F.lit("t").alias("tenant_id"), F.col("o_orderpriority").alias("schema_id"), F.col("o_custkey").alias("entity_id"), status.alias("status"),
        severity.alias("severity"), F.round("o_totalprice", 2).alias("anomaly_score"),
    )


def case_queue_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.filtered(_order_cases(spark, sf_dir), tenant="t", status="open", severity="critical").select("id", "entity_id", "anomaly_score")


def case_queue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.top(queue.unresolved(_order_cases(spark, sf_dir)), 100).select("id", "status", "anomaly_score")


def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.overview(_order_cases(spark, sf_dir))


def schema_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _order_cases(spark, sf_dir)
    return queue.schema_counts(found.select("schema_id").distinct(), found.select("schema_id"), found)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as labelled cases: source is the detector, language the scope."""
    labels, docs = logs.table(spark, sf_dir, "labels"), logs.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    label = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "duplicate").otherwise("true_exception")).otherwise("false_positive")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("source").alias("strongest"), F.concat(F.lit("lang="), "lang").alias("baseline_scope"), label.alias("label"),
        (F.pmod(F.col("n_chars"), F.lit(100)) * 1.0).alias("anomaly_score"),
    )


def latest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as labels of their conversation."""
    turns = logs.table(spark, sf_dir, "conversations")
    given = turns.select(F.col("conv_id").alias("exception_id"), F.col("role").alias("label"), F.col("turn").alias("created_at"), F.col("turn").alias("id"))
    return queue.latest_label(turns.select(F.col("conv_id").alias("id")).distinct(), given)


def labelled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = logs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    given = logs.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("exception_id"), F.col("quality").cast("string").alias("label"))
    return queue.labelled(docs, given)


def detector_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.quality(_verdicts(spark, sf_dir))


def retraining_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.weights(_verdicts(spark, sf_dir), {"src1": 0.7, "src2": 0.3})


def proposed_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = _verdicts(spark, sf_dir).withColumn("label", F.when(F.col("label") == "true_exception", F.lit("expected_behavior")).otherwise(F.col("label")))
    return feedback.threshold(low)


def proposed_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feedback.policies(_verdicts(spark, sf_dir))
    return found.select("baseline_scope", "detector", "support", "max_score", F.element_at("match", F.lit("lang")).alias("lang"), F.array_join("supporting", ",").alias("supporting"))


def similar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cases of their type's first word, those whose key 50 divides as targets."""
    part = logs.table(spark, sf_dir, "part")
    keys = F.array_distinct(F.split("p_name", " "))
    views = part.select(
        F.col("p_partkey").alias("id"), F.substring_index("p_type", " ", 1).alias("schema_id"), F.col("p_brand").alias("entity_id"), F.col("p_type").alias("baseline_scope"),
        F.pmod("p_size", F.lit(4)).alias("severity"), F.when(F.col("p_size") > 25, "resolved").otherwise("open").alias("status"), keys.alias("keys"),
        F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice")).alias("values"),
    )
    found = similarity.similar(views.where(F.pmod("id", F.lit(50)) == 0), views)
    return found.select("target_id", "id", F.round("total", 6).alias("total"), F.col("place").cast("long").alias("place"))


# ---------------------------------------------------------------- ingestion and text

INGEST = EventSpec(name="in", entity="entity", time="at", event_id="key", numeric=("value", "k"))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a batch with faults: every 7th has no entity, every 11th no readable time, every 13th lacks
    ``k``; every 5th repeats the id before it."""
    e = F.col("event_id")
    mod = lambda n: F.pmod(e, F.lit(n)) == 0
    pairs = F.array(
        F.struct(F.lit("entity").alias("key"), F.when(mod(7), F.lit(" ")).otherwise(F.col("user_id").cast("string")).alias("value")),
        F.struct(F.lit("at").alias("key"), F.when(mod(11), F.lit("soon")).otherwise(F.lit("2024-01-02T03:04:05Z")).alias("value")),
        F.struct(F.lit("value").alias("key"), F.col("value").cast("string").alias("value")),
        F.when(~mod(13), F.struct(F.lit("k").alias("key"), F.col("k").cast("string").alias("value"))),
    )
    external = (e - mod(5).cast("long")).cast("string")
    return logs.events(spark, sf_dir).select(e.alias("idx"), external.alias("external_id"), F.lit(None).cast("timestamp").alias("occurred_at"), F.map_from_entries(F.array_compact(pairs)).alias("payload"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.events(spark, sf_dir).where(F.pmod("event_id", F.lit(17)) == 0).select(F.col("event_id").cast("string").alias("external_key"))


def ingest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.validated(_batch(spark, sf_dir), INGEST)
    return rows.select("idx", F.size("problems").cast("long").alias("n_problems"), F.trim("entity_id").alias("entity_id"), F.col("at").isNotNull().alias("has_time"))


def ingest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.outcomes(_batch(spark, sf_dir), INGEST, _known(spark, sf_dir)).select("idx", "outcome")


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.summary(ingest.outcomes(_batch(spark, sf_dir), INGEST, _known(spark, sf_dir)))


def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.errors(ingest.outcomes(_batch(spark, sf_dir), INGEST, _known(spark, sf_dir)))
    return rows.select("idx", F.size("problems").cast("long").alias("n_problems"))


def number_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as text in many forms, good and bad."""
    price, n = F.round("l_extendedprice", 2).cast("decimal(15,2)").cast("string"), F.col("l_linenumber")
    text = F.when(n == 1, F.concat(F.lit(" "), price, F.lit(" "))).when(n == 2, F.replace(price, F.lit("."), F.lit(","))).when(n == 3, F.concat(price, F.lit("d"))).when(
        n == 4, F.concat(F.lit("-"), price)).when(n == 5, F.lit("NaN")).when(n == 6, F.concat(price, F.lit("e2"))).otherwise(F.lit(""))
    rows = logs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", "raw", F.round(S.number(F.col("raw")), 4).alias("number"))


def pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.table(spark, sf_dir, "documents").select("doc_id", F.md5(S.redact(F.col("text"))).alias("redacted_md5"))


def strip_code_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.when(F.pmod("turn", F.lit(2)) == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return logs.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(S.strip_code_fence(fenced)).alias("inner_md5"))


def notification_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.materialised(_made_results(spark, sf_dir)).select(F.col("event_id").alias("id"), F.lit("t").alias("title"), "severity", F.col("score").alias("anomaly_score"), "reasons")
    found = queue.notifications(rows)
    return found.select(F.col("exception_id").alias("event_id"), "severity", "score", F.array_join("explanations", "; ").alias("explanations"))


def scope_key_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.lineitem(spark, sf_dir).select("l_returnflag", "l_linestatus").distinct()
    rows = baselines.in_scopes(rows, logs.LINEITEM.dimensions).select("scope_key", "depth").distinct()
    match = S.scope_match(F.col("scope_key"))
    return rows.select(
        "scope_key", F.col("depth").cast("long").alias("depth"), S.describe_scope(F.col("scope_key")).alias("described"), F.element_at(match, F.lit("l_returnflag")).alias("flag"),
        F.element_at(match, F.lit("l_linestatus")).alias("status"),
    )


def tenant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tenants that own a key of their name."""
    rows = logs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant_id"), F.col("c_name").alias("slug"), S.key_hash(F.col("c_name")).alias("key_hash"))
    return tables.tenant_of(rows, "Customer#000000007").unionByName(tables.tenant_of(rows, None, demo="Customer#000000001"))


def policy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as policies: active by balance, the nation as schema, none for every 4th."""
    rows = logs.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("active"), F.when(F.pmod("s_suppkey", F.lit(4)) != 0, F.col("s_nationkey").cast("string")).alias("schema_id"))
    return tables.active_policies(rows, "3").select("id", "schema_id")


def time_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events as text in four forms, one of them unreadable."""
    ts, n = F.date_trunc("second", "ts"), F.pmod("event_id", F.lit(4))
    text = F.when(n == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(n == 2, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.lit("31/12/2024"))
    rows = logs.events(spark, sf_dir).select("event_id", text.alias("raw"))
    return rows.select("event_id", "raw", F.unix_seconds(S.time_or_epoch(F.col("raw"))).alias("seconds"))


QUERIES = {f.__name__: f for f in (
    flagship_case_queue, run_metrics, detector_gates, temporal_split, baseline_rollup_numeric, baseline_rollup_lineitem, baseline_zero_inflated, baseline_categorical, baseline_fallback, baseline_lookup,
    robust_deviation_scores, robust_deviation_reasons, categorical_rarity_scores, rolling_window_history, scoped_history_depth, rolling_quantile_scores, change_point_scores,
    peer_profiles, peer_stats, peer_findings, peer_group_scores, isolation_forest_scores, ensemble_scores, confidence_severity, strongest_detector, recompute_scores,
    policy_suppression, gate_outcomes, case_fingerprint, dedup_fold, case_queue_filtered, case_queue_topk, overview_counts, schema_counts, latest_label, labelled_cases,
    detector_precision, retraining_weights, proposed_threshold, proposed_policies, similar_cases, ingest_validate, ingest_dedupe, ingest_summary, ingest_errors, number_coercion,
    pii_redaction, strip_code_fence, notification_payload, scope_key_roundtrip, tenant_lookup, policy_scan, time_parsing,
)}
