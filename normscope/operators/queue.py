"""The case queue: filters, ranking, counts, labels and the life of a case."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def filtered(cases: DataFrame, *, tenant: str | None = None, schema: str | None = None, status: str | None = None, severity: str | None = None, entity: str | None = None) -> DataFrame:
    wanted = {"tenant_id": tenant, "schema_id": schema, "status": status, "severity": severity, "entity_id": entity}
    for column, value in wanted.items():
        cases = cases if value is None else cases.where(F.col(column) == value)
    return cases


def top(cases: DataFrame, limit: int = 100, score: str = "anomaly_score", tie: str = "id") -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    return cases.orderBy(F.desc(score), tie).limit(limit)


def unresolved(cases: DataFrame) -> DataFrame:
    return cases.where(F.col("status").isin(*C.LIVE_STATUSES))


def overview(cases: DataFrame, *, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row of counts; ``critical`` counts every status."""
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("status") == "open").alias("open_cases"), F.count_if(F.col("status").isin(*C.LIVE_STATUSES)).alias("unresolved"),
        F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("status") == "resolved").alias("resolved"), *[c.alias(n) for n, c in (extra or {}).items()],
    )


def overview_of(cases: DataFrame, events: DataFrame, labelled: DataFrame, *, limit: int = 10) -> DataFrame:
    """One row: events, the counts of ``overview``, precision over all labels (null without one that judges), and
    the unresolved cases of the highest scores."""
    judged = F.col("label").isin(*C.CONFIRMING_LABELS, *C.REJECTING_LABELS)
    good = labelled.agg(F.count_if(F.col("label").isin(*C.CONFIRMING_LABELS)).alias("confirmed"), F.count_if(judged).alias("judged"))
    best = top(unresolved(cases), limit).agg(F.sort_array(F.collect_list(F.struct((-F.col("anomaly_score")).alias("order"), F.col("id").cast("string").alias("id"), "anomaly_score", "severity"))).alias("best"))
    rows = overview(cases)
    for one in (events.agg(F.count(F.lit(1)).alias("events")), good, best):  # one row each
        rows = rows.crossJoin(F.broadcast(one))
    precision = F.when(F.col("judged") > 0, F.round(F.col("confirmed") / F.col("judged"), 4))
    return rows.withColumns({"precision": precision, "top": F.transform("best", lambda x: x.dropFields("order"))}).drop("confirmed", "judged", "best")


def busiest(counted: DataFrame, key: str = "schema_id") -> DataFrame:
    """The schema with most events, of equal ones the first by name, from ``schema_counts``."""
    return counted.orderBy(F.desc("event_count"), key).limit(1)


def with_share(counted: DataFrame) -> DataFrame:
    """``schema_counts`` with cases for each event; null without events."""
    return counted.withColumn("case_share", F.try_divide(F.col("open_cases").cast("double"), F.col("event_count")))


def by_name(rows: DataFrame, name: str = "name") -> DataFrame:
    return rows.orderBy(name)


def newest(rows: DataFrame, at: str = "created_at", tie: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(at), tie)


def schema_counts(schemas: DataFrame, events: DataFrame, cases: DataFrame, key: str = "schema_id") -> DataFrame:
    """Every schema with its number of events and of open cases."""
    n_events = events.groupBy(key).agg(F.count(F.lit(1)).alias("event_count"))
    n_open = cases.where(F.col("status") == "open").groupBy(key).agg(F.count(F.lit(1)).alias("open_cases"))
    rows = schemas.join(n_events, key, "left").join(n_open, key, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("event_count", "open_cases")})


def latest_label(cases: DataFrame, feedback: DataFrame) -> DataFrame:
    """Cases with the label given last; equal times go to the larger id."""
    last = feedback.groupBy("exception_id").agg(F.max_by("label", F.struct("created_at", "id")).alias("feedback_label"))
    return cases.join(last, cases["id"] == last["exception_id"], "left").drop("exception_id")


def labelled(cases: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row for each label."""
    return cases.join(feedback.select("exception_id", "label"), cases["id"] == F.col("exception_id")).drop("exception_id")


def with_component(cases: DataFrame, detector: str, least: float = C.FIRING_SCORE) -> DataFrame:
    """Cases to which a detector contributed at least a score, by their stored evidence."""
    return cases.where(F.exists("evidence.detectors", lambda r: r["applicable"] & (r["detector"] == detector) & (r["score"] >= least)))


def detail(cases: DataFrame, feedback: DataFrame, recomputed: Column) -> DataFrame:
    """Cases with all their labels, oldest first, and the score computed again."""
    listed = feedback.groupBy("exception_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "label", "note", "author"))).alias("feedback"))
    rows = cases.join(listed, cases["id"] == listed["exception_id"], "left").drop("exception_id")
    return rows.withColumns({"recomputed_score": recomputed, "score_matches": F.abs(recomputed - F.col("anomaly_score")) < 0.01})


def _change(cases: DataFrame, case_id: str, values: dict[str, Column], tenant: str | None) -> DataFrame:
    hit = F.col("id") == case_id if tenant is None else (F.col("id") == case_id) & (F.col("tenant_id") == tenant)
    return cases.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def assign(cases: DataFrame, case_id: str, assignee: str, *, tenant: str | None = None) -> DataFrame:
    """An open case becomes acknowledged."""
    status = F.when(F.col("status") == "open", F.lit("acknowledged")).otherwise(F.col("status"))
    return _change(cases, case_id, {"assignee": F.lit(assignee), "status": status}, tenant)


def resolve(cases: DataFrame, case_id: str, status: str, note: str | None = None, *, at: Column | None = None, tenant: str | None = None) -> DataFrame:
    """Any of the five statuses; only resolved and dismissed set ``resolved_at``."""
    if status not in C.STATUSES:
        raise ValueError(f"unknown status {status!r}")
    when = (at if at is not None else F.current_timestamp()) if status in ("resolved", "dismissed") else F.lit(None).cast("timestamp")
    return _change(cases, case_id, {"status": F.lit(status), "resolution_note": F.lit(note).cast("string"), "resolved_at": when}, tenant)


def label_rows(feedback: DataFrame) -> DataFrame:
    """Labels of the known vocabulary; others raise when they are read."""
    known = F.col("label").isin(*C.LABELS)
    return feedback.withColumn("label", F.when(known, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("label", F.lit("null"))))))


def notifications(cases: DataFrame, *, force: bool = False, target: str = "") -> DataFrame:
    """Payloads of critical and high cases (of all, if forced) with the first three explanations."""
    rows = cases if force else cases.where(F.col("severity").isin("critical", "high"))
    return rows.select(
        F.col("id").alias("exception_id"), F.lit(target).alias("target"), "title", "severity", F.col("anomaly_score").alias("score"),
        F.slice(F.transform("reasons", lambda r: r["explanation"]), 1, 3).alias("explanations"),
    )


NARRATIVE = "struct<summary:string,cause:string,facts:array<string>,steps:array<string>,caveats:array<string>>"


def explained(cases: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], *, purpose: str = "explain") -> tuple[DataFrame, DataFrame]:
    """Accounts by a provider, a function from a frame (id, title, anomaly_score, severity, facts) to
    NARRATIVE's fields; and the log of its calls (id, purpose, ok, error). Where it raises or leaves the summary
    out, the template's account stands, so an account never fails."""
    from ..sources.tables import materialised

    @F.pandas_udf(f"struct<account:{NARRATIVE},error:string>")
    def asked(*values: pd.Series) -> pd.DataFrame:
        given = pd.concat(values, axis=1, keys=["id", "title", "anomaly_score", "severity", "facts"])
        try:
            made = provider(given).reset_index(drop=True)
            accounts = made[["summary", "cause", "facts", "steps", "caveats"]].to_dict("records")
            errors = [None if isinstance(x["summary"], str) and x["summary"] else "no summary" for x in accounts]
        except Exception as e:
            accounts, errors = [None] * len(given), [f"{type(e).__name__}: {e}"[:300]] * len(given)
        empty = {"summary": None, "cause": None, "facts": None, "steps": None, "caveats": None}
        return pd.DataFrame({"account": [empty if e else a for a, e in zip(accounts, errors, strict=True)], "error": pd.Series(errors, dtype=object)})

    facts = F.transform("reasons", lambda r: r["explanation"])
    rows = materialised(cases.select("id", asked(F.col("id").cast("string"), F.col("title"), F.col("anomaly_score"), F.col("severity"), facts).alias("got")))
    fixed = narrative(cases)
    fields = [c for c in fixed.columns if c != "id"]
    told = fixed.join(rows, "id").select("id", *[F.coalesce(F.when(F.col("got.error").isNull(), F.col(f"got.account.{c}")), F.col(c)).alias(c) for c in fields])
    calls = rows.select("id", F.lit(purpose).alias("purpose"), F.col("got.error").isNull().alias("ok"), F.col("got.error").alias("error"))
    return told, calls


def narrative(cases: DataFrame) -> DataFrame:
    """An account of a case from its stored evidence alone, by a fixed template."""
    facts = F.transform("reasons", lambda r: r["explanation"])
    return cases.select(
        "id",
        F.concat(F.col("title"), F.lit(" (score "), F.col("anomaly_score").cast("string"), F.lit(", "), F.col("severity"), F.lit(")")).alias("summary"),
        F.concat(F.lit("Led by "), F.coalesce(F.col("evidence.strongest_detector"), F.lit("no detector")), F.lit("; compared with "), F.col("baseline_scope")).alias("cause"),
        facts.alias("facts"), F.array(F.lit("Compare the event with its source record"), F.lit("Look for similar cases and what was done")).alias("steps"),
        F.array(F.lit("Only measured values are stated")).alias("caveats"),
    )
