"""Isolation forests in numpy, one for each scope.

A tree sees at most 256 rows: those of the lowest hashes of all rows of its scope, the hash salted with the
tree's number. So every row can be drawn, the fit is one task of bounded memory for each scope (trees times
256 rows), and the same in any partitioning.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..spec import EventSpec
from .baselines import in_scopes

SAMPLE = 256
#: Rows of a scope below which no row is set aside before a tree's rows are ordered; of larger scopes so many
#: are expected for each tree, of which fewer than SAMPLE have a chance of about 1e-34.
EXPECTED = 2 * SAMPLE
MODELS, FILES = "scope_key string, model binary, error string", "scope_key string, file string, error string"
#: Rows whose margins are found together.
MARGIN_ROWS = 2_000
#: Models that a worker keeps, those asked for last.
KEPT_MODELS = 64


def _path_length(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    long = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as parallel arrays over the nodes of all of them: split feature (-1 for a leaf), threshold, children, leaf depth. The
    first nodes are the roots."""

    def __init__(self, rows: np.ndarray, trees: int = C.FOREST_TREES, seed: int = C.FOREST_SEED):
        r = np.random.default_rng(seed)
        size = min(SAMPLE, len(rows))
        self._grow([rows[r.choice(len(rows), size, replace=False)] for _ in range(trees)], r)

    @classmethod
    def of_samples(cls, samples: list[np.ndarray], seed: int = C.FOREST_SEED) -> Forest:
        """A tree of each sample."""
        self = cls.__new__(cls)
        self._grow(samples, np.random.default_rng(seed))
        return self

    def _grow(self, samples: list[np.ndarray], r: np.random.Generator) -> None:
        """All trees at once, level by level: a node's rows lie side by side."""
        self.n_trees, self.sample = len(samples), max(map(len, samples))
        limit = max(1, math.ceil(math.log2(max(2, self.sample))))
        x, node = np.concatenate(samples), np.repeat(np.arange(len(samples)), [len(s) for s in samples])
        made, base, level, owner = [], 0, 0, np.arange(len(samples))
        while len(x):
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            counts = np.diff(np.append(starts, len(x)))
            lo, hi = np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)
            splits = (hi > lo).any(axis=1) & (counts > 1) & (level < limit)
            chance = np.where(hi > lo, r.random(lo.shape), -1.0)
            f, at = chance.argmax(axis=1), np.arange(len(starts))
            low, high = lo[at, f], hi[at, f]
            t = low + r.random(len(starts)) * (high - low)
            t = np.where(t < high, t, low)  # a side is never empty
            child = base + len(starts) + 2 * (np.cumsum(splits) - 1)
            made.append((owner, np.where(splits, f, -1), np.where(splits, t, 0.0), np.where(splits, child, 0), np.where(splits, child + 1, 0), np.where(splits, 0.0, level + _path_length(counts))))
            of = np.repeat(at, counts)
            going = splits[of]
            x, of = x[going], of[going]
            node = child[of] + (x[np.arange(len(x)), f[of]] > t[of])
            order = np.argsort(node, kind="stable")
            x, node = x[order], node[order]
            base, level, owner = base + len(starts), level + 1, np.repeat(owner[splits], 2)
        self.tree, self.feature, self.threshold, self.left, self.right, self.depth = (np.concatenate(c) for c in zip(*made, strict=True))

    @property
    def trees(self) -> list[tuple[np.ndarray, ...]]:
        """Each tree's part of the arrays."""
        order = np.argsort(self.tree, kind="stable")
        parts = [np.split(x[order], np.searchsorted(self.tree[order], np.arange(1, self.n_trees))) for x in (self.feature, self.threshold, self.left, self.right, self.depth)]
        return list(zip(*parts, strict=True))

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """0.5 less the anomaly score: below 0 for outliers."""
        return np.concatenate([self._margin(rows[k : k + MARGIN_ROWS]) for k in range(0, len(rows), MARGIN_ROWS)]) if len(rows) else np.zeros(0)

    def _margin(self, rows: np.ndarray) -> np.ndarray:
        at = np.repeat(np.arange(self.n_trees)[:, None], len(rows), axis=1)  # by tree and row
        row = np.arange(len(rows))[None, :]
        while True:
            f = self.feature[at]
            going = f >= 0
            if not going.any():
                break
            below = rows[row, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(going, np.where(below, self.left[at], self.right[at]), at)
        scale = float(_path_length(self.sample))
        return 0.5 - 2.0 ** (-self.depth[at].mean(axis=0) / max(scale, 1e-12))


def fit(training: DataFrame, spec: EventSpec, min_rows: int = C.FOREST_MIN_ROWS) -> DataFrame:
    """(scope_key, model binary, error) of every scope with enough complete rows: a forest, or why it didn't grow."""
    features = list(spec.numeric)
    empty = training.sparkSession.createDataFrame([], MODELS)
    if len(features) < 2:
        return empty
    values = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]
    rows = in_scopes(training.select(F.col(spec.event_id).alias("_id"), *spec.dimensions, *values), spec.dimensions)
    complete = rows.dropna(subset=[f"_x{i}" for i in range(len(features))])
    xs = [f"_x{i}" for i in range(len(features))]
    sizes = complete.groupBy("scope_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    place = lambda tree: F.shiftrightunsigned(F.xxhash64("_h", tree), 11).cast("double") / float(1 << 53)
    drawn = F.filter(F.sequence(F.lit(0), F.lit(C.FOREST_TREES - 1)), lambda tree: place(tree) * F.col("_n") < EXPECTED)
    rows = complete.join(sizes, "scope_key").withColumn("_h", F.xxhash64("_id", *xs))
    rows = rows.select("scope_key", "_id", "_h", *xs, F.explode(drawn).alias("_tree"))
    order = Window.partitionBy("scope_key", "_tree").orderBy(place(F.col("_tree")), "_id", *xs)
    sample = rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= SAMPLE).select("scope_key", "_tree", "_rn", *xs)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        samples = [tree[xs].to_numpy(dtype=float) for _, tree in pdf.sort_values(["_tree", "_rn"]).groupby("_tree")]
        model = error = None
        try:
            model = pickle.dumps(Forest.of_samples(samples))
        except Exception as e:  # the growth's own: nothing of Spark or storage is called here
            error = f"{type(e).__name__}: {e}"[:300]
        return pd.DataFrame({"scope_key": [pdf["scope_key"].iloc[0]], "model": [model], "error": [error]})

    return sample.groupBy("scope_key").applyInPandas(grow, MODELS)


def publish(models: DataFrame, folder: str | None = None) -> DataFrame:
    """(scope_key, file, error): each model in a file of its own on shared storage, below ``folder`` or a fresh one. Workers load the models
    of the scopes they meet, so no model travels in a row or to every task. Each attempt of a task writes under names of its own, and the table holds those
    of finished tasks alone."""
    from ..sources.tables import materialised, shared_path

    folder = folder or shared_path(models.sparkSession, "forests")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        for part in parts:
            files = []
            for model in part["model"]:
                files.append(None if model is None else f"{folder}/{uuid.uuid4().hex}")
                if model is not None:
                    with system.open_output_stream(f"{path}/{files[-1].rpartition('/')[2]}") as out:
                        out.write(model)
            yield part[["scope_key"]].assign(file=files, error=part["error"])

    return materialised(models.select("scope_key", "model", "error").mapInPandas(write, FILES))


@lru_cache(maxsize=KEPT_MODELS)
def _load(file: str) -> Forest:
    system, path = fs.FileSystem.from_uri(file)
    with system.open_input_stream(path) as data:
        return pickle.loads(data.read())


def score(events: DataFrame, models: DataFrame, spec: EventSpec, *, errors: str | None = None) -> DataFrame:
    """``events`` (with ``baseline_scope``) with ``forest_margin``: null without a model or with a value missing. ``models``: those of ``fit``,
    or the files of ``publish``. What a margin raises is in the column ``errors``, or raises if none is named; a file that can't be read raises."""
    features = [F.col(f).cast("double") for f in spec.numeric]
    if len(features) < 2:
        rows = events.withColumn("forest_margin", F.lit(None).cast("double"))
        return rows.withColumn(errors, F.lit(None).cast("string")) if errors else rows
    held = models if "file" in models.columns else publish(models)
    held = held.select(F.col("scope_key").alias("baseline_scope"), F.col("file").alias("_file"), F.col("error").alias("_grown"))

    @F.pandas_udf("struct<margin:double,error:string>")
    def margins(file: pd.Series, *xs: pd.Series) -> pd.DataFrame:
        x = np.column_stack([c.to_numpy(dtype=float) for c in xs])
        out, error = np.full(len(x), np.nan), np.full(len(x), None, dtype=object)
        whole = ~np.isnan(x).any(axis=1)
        for key in file[whole].dropna().unique():
            model = _load(key)
            rows = whole & (file == key).to_numpy()
            try:
                out[rows] = model.margin(x[rows])
            except Exception as e:
                if errors is None:
                    raise
                error[rows] = f"{type(e).__name__}: {e}"[:300]
        return pd.DataFrame({"margin": pd.Series(np.where(np.isnan(out), None, out), dtype=object), "error": pd.Series(error, dtype=object)})

    rows = events.join(held, "baseline_scope", "left").withColumn("_found", margins(F.col("_file"), *features))
    rows = rows.withColumn("forest_margin", F.col("_found.margin"))
    if errors:
        rows = rows.withColumn(errors, F.coalesce("_found.error", "_grown"))
    return rows.drop("_found", "_file", "_grown")
