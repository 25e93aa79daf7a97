"""Gaussian mixtures by expectation-maximization, the baseline.

``fit_mixture`` is Spark ML's estimator. ``gmm_step`` is one EM iteration on a
table of components, and ``em_fit`` repeats it for any number of runs at once:
every iteration is one pass over the points, held in memory, for all of them.

Components are ``run_id, comp, weight, mean array<double>, cov array<array<double>>``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

import numpy as np
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..runtime import bounded_rows, held, held_blocks, model_table
from .. import kernels
from .partials import task_sums

COMPONENT_SCHEMA = (
    "run_id bigint, comp bigint, weight double, mean array<double>, cov array<array<double>>"
)
TASK_BYTES = 1 << 20  # of coordinates in a task of a loop
REG = 1e-6  # added to the diagonal of every covariance


def assemble(points: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Points with the vector column Spark ML expects."""
    return VectorAssembler(inputCols=list(dims), outputCol="features").transform(points)


def fit_mixture(
    points: DataFrame,
    dims: Sequence[str],
    k: int,
    seed: int = 7,
    max_iter: int = 100,
    tol: float = 0.01,
) -> GaussianMixtureModel:
    """Full-covariance mixture of ``k`` Gaussians."""
    estimator = GaussianMixture(k=k, seed=seed, maxIter=max_iter, tol=tol)
    return estimator.fit(assemble(points, dims))


def predict_mixture(model: GaussianMixtureModel, points: DataFrame, dims: Sequence[str]):
    """Points with ``prediction``, the most probable component."""
    labelled = model.transform(assemble(points, dims))
    return labelled.select(*points.columns, F.col("prediction").cast("bigint").alias("prediction"))


def mixture_components(model: GaussianMixtureModel, run_id: int = 0) -> DataFrame:
    """Weights, means and covariances of a fitted model as a component table."""
    shapes = model.gaussiansDF.collect()
    rows = [
        (run_id, k, float(w), [float(v) for v in s.mean], s.cov.toArray().tolist())
        for k, (w, s) in enumerate(zip(model.weights, shapes))
    ]
    return model_table(model.gaussiansDF.sparkSession, rows, COMPONENT_SCHEMA)


def _mixtures(comps: DataFrame) -> list[tuple]:
    """Collected components as ``(run_id, weights, means, inverse Cholesky factors)``."""
    rows = sorted(bounded_rows(comps), key=lambda r: (r.run_id, r.comp))
    found = []
    for run_id, group in groupby(rows, key=lambda r: r.run_id):
        group = list(group)
        factors = [_inverse_factor(r["cov"]) for r in group]
        means = [np.array(r["mean"], dtype=float) for r in group]
        found.append((run_id, [r.weight for r in group], means, factors))
    return found


def _inverse_factor(cov) -> np.ndarray:
    return np.linalg.inv(np.linalg.cholesky(np.array(cov, dtype=float)))


def _step(
    points: DataFrame,
    mixtures: list[tuple],
    dims: Sequence[str],
    reg: float,
    hard: bool = False,
    tasks: int | None = None,
):
    """Component rows after one EM step, and the mean log-likelihood per run.
    A task sends one array of 1 + k (1 + d + d * d) numbers per run."""
    d = len(dims)
    kernel = kernels.em_sums(list(dims), mixtures, hard, reg)
    if points.columns != ["block"]:
        points = points.select(*dims)
    sums = task_sums(points.mapInArrow(kernel, "key bigint, sums array<double>"), tasks)
    rows, logs = [], {}
    for at, (run_id, weights, means, _) in enumerate(mixtures):
        width = len(weights) * (1 + d + d * d)
        whole = sums.get(at, np.zeros(1 + width))
        table = whole[1:].reshape(len(weights), -1)
        n = table[:, 0].sum()
        logs[run_id] = whole[0] / n
        for c, row in enumerate(table):
            mass = row[0] + 10 * np.finfo(float).eps
            move = row[1 : 1 + d] / mass
            cov = row[1 + d :].reshape(d, d) / mass - np.outer(move, move) + reg * np.eye(d)
            mean = means[c] + move
            rows.append((run_id, c, float(mass / n), mean.tolist(), cov.tolist()))
    return rows, logs


def gmm_step(
    points: DataFrame, comps: DataFrame, dims: Sequence[str], reg: float = REG
) -> DataFrame:
    """The components after one E-step and M-step. Sums are taken around the
    old means, which keeps the covariances accurate far from the origin."""
    rows, _ = _step(points, _mixtures(comps), dims, reg)
    return model_table(points.sparkSession, rows, COMPONENT_SCHEMA)


def seed_centres(
    points: DataFrame, dims: Sequence[str], k: int, seed: int, runs: int
) -> list[list[list[float]]]:
    """``k`` starting centres per run: a random point, then points drawn with
    probability proportional to the squared distance from the centres so far.

    The draw is a race: the point with the smallest exponential time at rate
    distance wins, so each centre of all runs takes one pass, in which the task
    draws the numbers of ``functions.rng`` itself. A run that has no other points
    left repeats its first centre.
    """
    chosen: list[list[list[float]]] = [[] for _ in range(runs)]
    drawn = points.select("point_id", *dims)
    for turn in range(k):
        kernel = kernels.seed_races(list(dims), [np.array(c) for c in chosen], seed, turn)
        raced = drawn.mapInArrow(kernel, "run_id bigint, time double, point_id bigint, at array<double>")
        won = raced.groupBy("run_id").agg(F.min(F.struct("time", "point_id", "at")).alias("best")).collect()
        centres = {r.run_id: list(r.best["at"]) for r in won}
        for run in range(runs):
            chosen[run].append(centres[run] if run in centres else chosen[run][0])
    return chosen


def kmeans_start(
    points: DataFrame,
    dims: Sequence[str],
    k: int,
    seed: int,
    runs: int = 1,
    turns: int = 5,
    reg: float = REG,
) -> DataFrame:
    """Components from a short k-means of every run, the usual start of EM; all
    runs share the passes. Points need ``point_id``."""
    d = len(dims)
    unit = [np.eye(d)] * k
    rows: list[tuple] = []
    with held(points, ["point_id", *dims]) as narrow, held_blocks(narrow, dims, TASK_BYTES) as (blocks, tasks):
        centres = seed_centres(narrow, dims, k, seed, runs)
        for _ in range(turns):
            mixtures = [
                (run, [1 / k] * k, [np.array(c) for c in at], unit) for run, at in enumerate(centres)
            ]
            rows, _ = _step(blocks, mixtures, dims, reg, True, tasks)
            centres = [[r[3] for r in rows if r[0] == run] for run in range(runs)]
    return model_table(points.sparkSession, rows, COMPONENT_SCHEMA)


def em_fit(
    points: DataFrame,
    start: DataFrame,
    dims: Sequence[str],
    max_iter: int = 100,
    tol: float = 1e-3,
    reg: float = REG,
) -> DataFrame:
    """EM from the given components until the mean log-likelihood of a run
    grows by less than ``tol``. Finished runs drop out of later passes."""
    active = {m[0]: m for m in _mixtures(start)}
    last = dict.fromkeys(active, -np.inf)
    done: dict[int, list] = {}
    with held_blocks(points, dims, TASK_BYTES) as (blocks, tasks):
        for turn in range(1, max_iter + 1):
            rows, logs = _step(blocks, list(active.values()), dims, reg, tasks=tasks)
            for run_id in list(active):
                mine = [r for r in rows if r[0] == run_id]
                if abs(logs[run_id] - last[run_id]) < tol or turn == max_iter:
                    done[run_id] = mine
                    del active[run_id]
                    continue
                last[run_id] = logs[run_id]
                factors = [_inverse_factor(r[4]) for r in mine]
                means = [np.array(r[3]) for r in mine]
                active[run_id] = (run_id, [r[2] for r in mine], means, factors)
            if not active:
                break
    final = [row for run_id in sorted(done) for row in done[run_id]]
    return model_table(points.sparkSession, final, COMPONENT_SCHEMA)


def em_predict(
    points: DataFrame, comps: DataFrame, dims: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """``keep.., run_id, prediction`` for every point and mixture."""
    narrow = points.select(*dict.fromkeys([*keep, *dims]))
    schema = narrow.select(*keep).schema.add("run_id", "long").add("prediction", "long")
    return narrow.mapInArrow(kernels.em_labels(list(dims), _mixtures(comps), list(keep)), schema)


def em_cells(points: DataFrame, comps: DataFrame, dims: Sequence[str], label: str) -> DataFrame:
    """``run_id, label, prediction, n``: the contingency table of ``em_predict``
    per mixture, counted in the tasks, so that no row is written per point."""
    narrow = points.select(*dict.fromkeys([label, *dims]))
    schema = StructType([StructField("run_id", LongType()), points.select(label).schema[0]])
    for name in ("prediction", "n"):
        schema = schema.add(name, "long")
    counts = narrow.mapInArrow(kernels.em_counts(list(dims), _mixtures(comps), label), schema)
    return counts.groupBy("run_id", label, "prediction").agg(F.sum("n").alias("n"))


def component_ellipse(comps: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Axes and angle of the two-dimensional components: ``width`` along the
    direction of least variance, ``height`` across it, both 2 * sqrt(2) standard
    deviations, and ``angle`` of the width axis in degrees, in (90, 270].

    ``used`` keeps only the components some point was given to (``run_id, comp``).
    """
    if used is not None:
        given = used.selectExpr("run_id AS run__", "comp AS comp__").distinct()
        same = F.col("run_id").eqNullSafe(F.col("run__")) & F.col("comp").eqNullSafe(F.col("comp__"))
        comps = comps.join(given, same, "left_semi")
    axis = "2D * sqrt(2D) * sqrt(greatest(0D, {}))"
    return (
        comps.selectExpr(
            "run_id", "comp", "mean[0] AS x", "mean[1] AS y",
            "cov[0][0] AS a", "cov[0][1] AS b", "cov[1][1] AS c",
        )
        .selectExpr(
            "*",
            "(a + c) / 2D AS middle",
            "sqrt((a - c) * (a - c) / 4D + b * b) AS reach",
            # Half the double angle points along the greatest variance.
            "degrees(atan2(2D * b, a - c)) / 2D AS major",
        )
        .selectExpr(
            "run_id", "comp", "x", "y",
            f"{axis.format('middle - reach')} AS width",
            f"{axis.format('middle + reach')} AS height",
            "180D + if(major > 0D, major - 90D, major + 90D) AS angle",
        )
    )


def model_vectors(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """A vector column taken apart into one double column per component."""
    values = vector_to_array(F.col(vector))
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, *[values[k].alias(n) for k, n in enumerate(names)])
