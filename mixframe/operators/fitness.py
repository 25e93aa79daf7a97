"""How well each individual describes the data."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Row

from .. import kernels
from ..config import EvolveConfig
from ..runtime import bounded_rows, model_table
from .partials import task_arrays


def model_arrays(rows: Sequence[Row], n_dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and spreads of collected model rows."""
    centres = np.array([[r[f"c{k}"] for k in range(n_dims)] for r in rows], dtype=float)
    spreads = np.array([[r[f"s{k}"] for k in range(n_dims)] for r in rows], dtype=float)
    if len(rows) and not (spreads > 0).all():
        raise ValueError("spreads must be positive")
    return centres.reshape(-1, n_dims), spreads.reshape(-1, n_dims)


def fitness(
    pop: DataFrame,
    points: DataFrame,
    dims: Sequence[str],
    key: str = "id",
    tasks: int | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """The population with ``fitness`` = norm factor * sum over points of
    exp(-distance / 2) / size of the row's own run, and ``log_fitness``, its
    natural logarithm, by which individuals are compared: it neither overflows
    nor vanishes however many dimensions there are.

    One pass over the points serves all runs. A task sends one array of exact
    sums, so what reaches the driver does not depend on the points, and the
    result not on how they are dealt out. Equal Gaussians are measured once, and
    those of ``known``, a population of the same runs with both columns, not again.
    """
    base = [c for c in pop.columns if c not in ("fitness", "log_fitness")]
    rows = sorted(bounded_rows(pop.select(*base)), key=lambda r: (r.run_id, r[key]))
    schema = pop.select(*base).schema.add("fitness", "double").add("log_fitness", "double")
    sizes = Counter(r.run_id for r in rows)
    body = [f"{part}{k}" for part in "cs" for k in range(len(dims))]
    shapes = [tuple(r[c] for c in body) for r in rows]
    rated = {}
    if known is not None:
        carried = bounded_rows(known.select("run_id", *body, "fitness", "log_fitness"))
        rated = {(r.run_id, *(r[c] for c in body)): (r.fitness, r.log_fitness) for r in carried}
    first = {}
    for r, shape in zip(rows, shapes):
        if (r.run_id, *shape) not in rated:
            first.setdefault(shape, r)
    sums = dict(zip(first, _exact_sums(list(first.values()), points, dims, tasks)))
    for r, shape in zip(rows, shapes):
        if shape in sums:
            rated.setdefault((r.run_id, *shape), _of_limbs(*sums[shape], sizes[r.run_id]))
    whole = [(*r, *rated[(r.run_id, *shape)]) for r, shape in zip(rows, shapes)]
    return model_table(pop.sparkSession, whole, schema)


def _exact_sums(rows: Sequence[Row], points: DataFrame, dims: Sequence[str], tasks: int | None) -> list:
    """``grid, high, low`` of every row over all points, in one pass."""
    if not rows:
        return []
    centres, spreads = model_arrays(rows, len(dims))
    source = points if points.columns == ["block"] else points.select(*dims)
    partial = source.mapInArrow(kernels.kernel_sums(list(dims), centres, spreads), "key bigint, sums array<bigint>")
    return kernels.joined_limbs([v for _, v in task_arrays(partial, kernels.merge_limbs, tasks)]) or [(0, 0, 0)] * len(rows)


def _of_limbs(grid: int, high: int, low: int, size: int) -> tuple[float, float]:
    """Value and logarithm of an exact sum over ``size``."""
    total = (high << kernels.LIMB) + low
    if not total:
        return 0.0, -math.inf
    bits = total.bit_length() - 53
    mantissa = total / (1 << bits) if bits > 0 else float(total)
    shift = grid - kernels.LIMB + max(bits, 0)
    log = math.log(mantissa) + shift * math.log(2) - math.log(size)
    try:
        return math.ldexp(mantissa, shift) / size, log
    except OverflowError:
        return math.inf, log


def point_distances(points: DataFrame, pop: DataFrame, cfg: EvolveConfig, nearest: int = 5) -> DataFrame:
    """``point_id, run_id, id, distance`` of every point to the ``nearest``
    individuals of each run, in the individual's spread. A search tree per run
    travels to the tasks; nothing is joined or shuffled."""
    rows = sorted(bounded_rows(pop), key=lambda r: (r.run_id, r.id))
    runs = []
    for run_id, group in groupby(rows, key=lambda r: r.run_id):
        group = list(group)
        runs.append((run_id, np.array([r.id for r in group]), *model_arrays(group, len(cfg.dims))))
    kernel = kernels.nearest_members(list(cfg.dims), runs, nearest)
    schema = "point_id bigint, run_id bigint, id bigint, distance double"
    return points.select("point_id", *cfg.dims).mapInArrow(kernel, schema)
