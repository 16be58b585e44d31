"""A detection run: learn from the first part of a log, score the rest, raise cases."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import baselines, cases, detectors, ensemble, forest, history, peers, walks
from ..operators.detectors import Learned
from ..sources import tables
from ..spec import EventSpec


EMPTY_NUMERIC = (
    "scope_key string, depth int, feature string, count long, zero_share double, informative long, median double, mad double, sigma double, p05 double, p25 double, p75 double, p95 double, "
    "min double, max double, zero_inflated boolean"
)
EMPTY_CATEGORICAL = "scope_key string, depth int, feature string, cat_value string, n long, count long, distinct_values long, share double"


def learn(
    training: DataFrame, spec: EventSpec, min_samples: int = C.MIN_SCOPE_SAMPLES, *, use: Collection[str] = C.DETECTORS, models: str | None = None,
) -> Learned:
    """What the detectors in ``use`` score with, stored; the forests' files below the folder ``models``, or a fresh one. The
    tables don't depend on each other: their jobs run side by side."""
    empty = training.sparkSession.createDataFrame

    def peer_tables() -> tuple[DataFrame | None, DataFrame | None]:
        if "peer_group" not in use:
            return None, None
        profile = tables.materialised(peers.profiles(training, spec))
        groups = peers.stats(profile)
        found = tables.materialised(peers.findings(profile, groups))
        tables.discard(training.sparkSession, profile)
        return groups, found

    made = {
        "samples": lambda: tables.materialised(baselines.scope_samples(training, spec.dimensions, min_samples)),
        "numeric": lambda: baselines.numeric_baselines(training, spec.numeric, spec.dimensions) if spec.numeric and "robust_deviation" in use else empty([], EMPTY_NUMERIC),
        "categorical": lambda: tables.materialised(baselines.categorical_baselines(training, spec.categorical, spec.dimensions)) if spec.categorical and "categorical_rarity" in use
        else empty([], EMPTY_CATEGORICAL),
        "peers": peer_tables,
        "forests": lambda: forest.publish(forest.fit(training, spec), models) if "isolation_forest" in use else None,
    }
    with ThreadPoolExecutor(len(made)) as pool:
        jobs = {name: pool.submit(inheritable_thread_target(training.sparkSession)(make)) for name, make in made.items()}
        found = {name: job.result() for name, job in jobs.items()}
    groups, findings = found.pop("peers")
    return Learned(**found, peer_groups=groups, peers=findings)


def score(
    log: DataFrame, spec: EventSpec, *, train_ratio: float = C.TRAIN_RATIO, min_samples: int = C.MIN_SCOPE_SAMPLES, use: Collection[str] = C.DETECTORS,
    learned: Learned | None = None, keep: Callable[[Learned], None] | None = None, models: str | None = None,
) -> DataFrame:
    """Every event after the split with its fused score, stored. An event is compared with strictly earlier events
    alone: tables come from the training slice, windows end before the row. ``use`` names registered detectors; one
    that fails abstains. With ``learned``, nothing is fitted: the tables of an earlier run score. ``keep`` is handed what was learned."""
    cut = history.cutoff(log, spec, train_ratio)
    rows = history.with_ordinal(log.select(*spec.columns).withColumn("_training", history.is_training(spec, cut)), spec)
    training = None
    chosen = [d for name, d in detectors.REGISTRY.items() if name in use]
    if learned is None:
        training = log.select(*spec.columns).where(history.is_training(spec, cut))
        learned = learn(training, spec, min_samples, use=use, models=models)
        if keep is not None:
            keep(learned)
    run = detectors.Run(spec, training, learned, ~F.col("_training"))
    kinds = [kind for kind, name in (("rq", "rolling_quantile"), ("cp", "change_point")) if name in {d.name for d in chosen}]
    rows = walks.walked(rows, spec, kinds, None if any(d.on_log and d.name not in C.DETECTORS for d in chosen) else run.is_scored) if kinds else rows
    for detector in (d for d in chosen if d.on_log):
        rows = detectors.planned(detector, rows, run)
    scored = baselines.resolve_scope(rows.where(run.is_scored), learned.samples, spec.dimensions)
    for detector in (d for d in chosen if not d.on_log):
        scored = detectors.planned(detector, scored, run)
    # stored once, fused: later steps name scores and results many times
    return tables.materialised(ensemble.fuse(scored.drop("_training", "rn"), spec, tuple(d.name for d in chosen)))


def detect(
    log: DataFrame, spec: EventSpec, *, policies: Sequence[dict] | DataFrame = (), config: cases.GateConfig | None = None, open_cases: DataFrame | None = None, **options: object,
) -> DataFrame:
    """Scored events with their ``decision``; ``options`` are those of ``score``, whose stored table ``tables.discard`` deletes by the result."""
    config = config or cases.GateConfig(min_score=spec.min_score)
    scored = score(log, spec, **options)
    return tables.made_of(cases.decide(cases.gate(scored, spec, config, policies), spec, config, open_cases), scored)


def case_queue(log: DataFrame, spec: EventSpec, **options: object) -> DataFrame:
    """The created cases of a run."""
    return cases.to_cases(detect(log, spec, **options), spec)
