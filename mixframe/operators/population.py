"""The population: first individuals, partner draws, mutation and crossover.

A population is ``run_id, id, c0.., s0..`` with ids 0 .. pop_size-1 in every
run. Everything random is a counter-based hash, see ``functions.rng``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..config import EvolveConfig
from ..functions import digest, hash_below, uniform
from ..runtime import bounded_rows, by_run, model_table
from .. import kernels
from .scaling import domain

# Farthest points fetched per pass; each pass then yields as many centres as
# can be decided from them alone.
CANDIDATES = 256
# Above so many partitions the farthest points are merged in two steps, in one
# step above so many.
WIDE, NARROW = 64, 16


def sample_points(points: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Bernoulli sample without replacement, decided per ``point_id``."""
    return points.where(hash_below(fraction, seed, "'sample'", "point_id"))


def slots(points: DataFrame, cfg: EvolveConfig) -> DataFrame:
    """One row per individual to be made: ``run_id, id``."""
    return points.sparkSession.range(0, cfg.runs * cfg.pop_size, 1, 1).selectExpr(
        f"id div {cfg.pop_size} AS run_id", f"id % {cfg.pop_size} AS id"
    )


def _first_by_hash(points: DataFrame, cfg: EvolveConfig, k: int, n: int) -> list[Row]:
    """The ``min(k, n)`` points with the smallest hash, in hash order.

    A threshold on the hash keeps little more than ``k`` rows, so no task sorts
    or merges more than that; if chance leaves too few, it is raised and the
    scan repeated.
    """
    hashed = (cfg.seed, "'point'", "point_id")
    expect = k + 8 * math.sqrt(k) + 64
    while True:
        fraction = min(1.0, expect / n)
        picked = points.where(hash_below(fraction, *hashed))
        # about ``expect`` rows, so the limit follows the number of slots
        found = picked.selectExpr(f"{digest(*hashed)} AS hash", "point_id", *cfg.dims)
        rows = bounded_rows(found, int(2 * expect) + 1000)
        if len(rows) >= min(k, n) or fraction >= 1:
            return sorted(rows, key=lambda r: (r["hash"], r.point_id))[:k]
        expect *= 4


def random_centres(points: DataFrame, cfg: EvolveConfig, n: int) -> DataFrame:
    """Every slot draws one of ``n`` points uniformly, with replacement.

    Slots draw numbers below ``n``; the distinct numbers, in order, stand for
    the points in hash order. That gives the law of independent draws with one
    hash per point, however many slots there are.
    """
    total = cfg.runs * cfg.pop_size
    leaders = _first_by_hash(points, cfg, total, n)
    fields = ", ".join(f"{c} double" for c in cfg.centre_cols)
    rows = [(rank, *[r[d] for d in cfg.dims]) for rank, r in enumerate(leaders, start=1)]
    ranked = model_table(points.sparkSession, rows, f"pick int, {fields}")
    number = f"floor({uniform(cfg.seed, 'run_id', 0, "'draw'", 'id')} * {float(n)!r}D) AS number"
    draws = slots(points, cfg).selectExpr("run_id", "id", number)
    # The unpartitioned window holds one row per slot only.
    picks = draws.selectExpr("run_id", "id", "dense_rank() OVER (ORDER BY number) AS pick")
    return picks.join(F.broadcast(ranked), "pick").drop("pick")


def _farthest_candidates(
    points: DataFrame, dims: Sequence[str], centres: dict[int, np.ndarray], m: int
) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per run the ``m`` farthest points: gaps, ids and coordinates. Arrays of
    many tasks are merged on the cluster, and the driver sees one per run."""
    schema = "key bigint, gaps array<double>, ids array<bigint>, at array<double>"
    found = points.select("point_id", *dims).mapInArrow(kernels.farthest_points(list(dims), centres, m), schema)
    parts = found.rdd.getNumPartitions()
    for fewer in ([math.isqrt(parts)] if parts > WIDE else []) + ([1] if parts > NARROW else []):
        found = found.repartition(fewer).mapInArrow(kernels.merge_farthest(m), schema)
    best: dict[int, list[tuple]] = {}
    for row in found.collect():
        gap = np.array(row["gaps"])
        best.setdefault(row["key"], []).append((gap, np.array(row["ids"]), np.array(row["at"]).reshape(len(gap), -1)))
    out = {}
    for run, several in best.items():
        gap, ids, at = (np.concatenate(x) for x in zip(*several))
        first = np.lexsort((ids, -gap))[:m]
        out[run] = gap[first], ids[first], at[first]
    return out


def _more_centres(chosen: list[np.ndarray], found: tuple, size: int, m: int) -> None:
    """Append what can be decided from the candidates alone: a point outside them
    can only come closer, so as long as the best one still ranks at or before
    the last one fetched, it is the overall best."""
    gap, ids, at = found
    last = (-gap[-1], ids[-1]) if len(gap) == m else (math.inf, 0)
    while len(chosen) < size:
        best = np.lexsort((ids, -gap))[0]
        if (-gap[best], ids[best]) > last:
            return
        chosen.append(at[best])
        moved = 0.0
        for k in range(at.shape[1]):
            moved = moved + (at[:, k] - at[best, k]) ** 2
        gap = np.minimum(gap, moved)


def farthest_centres(points: DataFrame, cfg: EvolveConfig) -> DataFrame:
    """First a random point, then always the point whose nearest chosen centre
    is farthest away (lowest id on ties). Each pass fetches the ``CANDIDATES``
    farthest points of every run that is not complete."""
    here = f"struct({', '.join(cfg.dims)})"
    firsts = [
        f"min_by({here}, struct({digest(cfg.seed, run, 0, chr(39) + 'first' + chr(39), 'point_id')} AS h, point_id)) AS r{run}"
        for run in range(cfg.runs)
    ]
    start = points.agg(*[F.expr(f) for f in firsts]).first()
    chosen = {run: [np.array([start[f"r{run}"][d] for d in cfg.dims], dtype=float)] for run in range(cfg.runs)}
    m = max(CANDIDATES, cfg.pop_size)
    while short := {run: np.array(c) for run, c in chosen.items() if len(c) < cfg.pop_size}:
        for run, found in _farthest_candidates(points, cfg.dims, short, m).items():
            _more_centres(chosen[run], found, cfg.pop_size, m)
    rows = [(run, i, *map(float, centre)) for run, own in chosen.items() for i, centre in enumerate(own)]
    fields = ", ".join(f"{c} double" for c in cfg.centre_cols)
    return model_table(points.sparkSession, rows, f"run_id bigint, id bigint, {fields}")


def init_population(
    points: DataFrame, cfg: EvolveConfig, extent: Row | None = None, method: str | None = None
) -> DataFrame:
    """First population. ``extent`` is the row of ``domain`` where known."""
    source = points
    if cfg.sample_fraction is not None and cfg.sample_fraction < 1:
        source, extent = sample_points(points, cfg.sample_fraction, cfg.seed), None
    if extent is None:
        extent = domain(source, cfg.dims)
    if (method or cfg.init) == "farthest":
        centres = farthest_centres(source, cfg)
    else:
        centres = random_centres(source, cfg, extent["n"])
    spreads = []
    for k, d in enumerate(cfg.dims):
        reach = (extent[f"max_{d}"] - extent[f"min_{d}"]) / cfg.beta
        drawn = uniform(cfg.seed, "run_id", 0, "'spread'", "id", k)
        spreads.append(f"{cfg.eps!r}D + {drawn} * {reach!r}D AS s{k}")
    return centres.selectExpr("run_id", "id", *cfg.centre_cols, *spreads)


def partners(pop: DataFrame, cfg: EvolveConfig, gen: int) -> DataFrame:
    """The population with ``r1, r2, r3``: three different individuals of the
    run for each one, none of them itself.

    A draw among the n - k indices still free is shifted past the taken ones in
    ascending order, which needs no join of the population with itself.
    """

    def draw(k: int) -> str:
        u = uniform(cfg.seed, "run_id", gen, "'partner'", "id", k)
        return f"floor({u} * {cfg.pop_size - k}D)"

    shift = "aggregate(array_sort(array({taken})), {draw}, (r, t) -> if(r >= t, r + 1, r)) AS r{k}"
    for k, taken in enumerate(("id", "id, r1", "id, r1, r2"), start=1):
        pop = pop.selectExpr("*", shift.format(taken=taken, draw=draw(k), k=k))
    return pop


def vary(pop: DataFrame, cfg: EvolveConfig, gen: int) -> DataFrame:
    """Children: each component, centre or spread, becomes
    r3 + weight * (r1 - r2) with probability ``crossover`` and stays otherwise.
    Spreads are made positive and floored at ``eps``. A child keeps its
    parent's id.

    Each run is one group; the random numbers are drawn before, row by row.
    """
    parts = cfg.centre_cols + cfg.spread_cols
    chances = [f"{uniform(cfg.seed, 'run_id', gen, chr(39) + 'mutate' + chr(39), 'id', chr(39) + p + chr(39))} AS u_{p}" for p in parts]
    drawn = partners(by_run(pop.select("run_id", "id", *parts), cfg.runs), cfg, gen).selectExpr("*", *chances)
    kernel = kernels.mutate(parts, cfg.spread_cols, cfg.pop_size, cfg.weight, cfg.crossover, cfg.eps)
    schema = ", ".join(["run_id bigint", "id bigint", *[f"{p} double" for p in parts]])
    return drawn.groupBy("run_id").applyInArrow(kernel, schema)
