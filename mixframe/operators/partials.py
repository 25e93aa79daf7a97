"""Arrays that tasks send, added up."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .. import kernels

#: Tasks whose arrays the driver adds itself; those of more are added in two steps.
FEW = 64


def task_arrays(partial: DataFrame, merge: Callable = kernels.add_arrays, tasks: int | None = None) -> list[tuple]:
    """The rows that tasks send, one per task and key: a key, then arrays.
    Those of many tasks are merged in two steps, the first on the cluster, so
    that the driver sees about the square root of their number. ``tasks`` is how
    many there are, where that is known."""
    parts = partial.rdd.getNumPartitions() if tasks is None else tasks
    if parts > FEW:
        partial = partial.repartition(math.isqrt(parts)).mapInArrow(merge, partial.schema)
    return [tuple(row) for row in partial.collect()]


def task_sums(partial: DataFrame, tasks: int | None = None) -> dict[int, np.ndarray]:
    """Sums of ``sums`` by ``key`` over all tasks."""
    found: dict[int, np.ndarray] = {}
    for key, values in task_arrays(partial, tasks=tasks):
        found[key] = found[key] + np.array(values) if key in found else np.array(values)
    return found
