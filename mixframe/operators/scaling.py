"""Bounds and scaling. The statistics are one aggregate over all dimensions;
they are fetched as a single row and enter the projection as constants, so the
scaled table is a narrow map over the scan."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import kernels
from .partials import task_arrays

#: Dimensions from which the ranges are taken in a kernel: generated code for so
#: many aggregates takes longer to compile than to run.
WIDE = 12


def bounds(points: DataFrame, dims: Sequence[str]) -> DataFrame:
    """One row: ``n`` and ``min_``/``max_`` of every dimension."""
    extremes = [
        f(d).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))
    ]
    return points.agg(F.count(F.lit(1)).alias("n"), *extremes)


def _only_numbers(row: Row | dict, dims: Sequence[str]) -> None:
    """Refuse coordinates that are null, NaN or infinite, with their number."""
    bad = {d: row[f"bad_{d}"] for d in dims if row[f"bad_{d}"]}
    if bad:
        raise ValueError(f"coordinates that are no finite numbers: {bad}; see usable() and rejected_count()")


def _bad(dims: Sequence[str]) -> list[Column]:
    finite = [F.coalesce(F.abs(d) < F.lit(float("inf")), F.lit(False)) for d in dims]
    return [F.count_if(~ok).alias(f"bad_{d}") for d, ok in zip(dims, finite)]


def _bounds_row(points: DataFrame, dims: Sequence[str]) -> Row | dict:
    if len(dims) >= WIDE:
        return _wide_bounds(points, dims)
    extremes = [
        f(d).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))
    ]
    row = points.agg(F.count(F.lit(1)).alias("n"), *extremes, *_bad(dims)).first()
    _only_numbers(row, dims)
    return row


def _wide_bounds(points: DataFrame, dims: Sequence[str]) -> dict:
    found = points.select(*dims).mapInArrow(kernels.coordinate_ranges(list(dims)), "key bigint, sums array<double>")
    rows = [values for _, values in task_arrays(found, kernels.merge_ranges)]
    d = len(dims)
    whole = kernels.joined_ranges(rows) if rows else np.concatenate([np.zeros(1 + d), np.full(2 * d, np.nan)])
    bad, low, high = whole[1 : 1 + d], whole[1 + d : 1 + 2 * d], whole[1 + 2 * d :]
    out: dict = {"n": int(whole[0])}
    for k, name in enumerate(dims):
        ends = (float(low[k]), float(high[k])) if np.isfinite(low[k]) else (None, None)
        out |= {f"bad_{name}": int(bad[k]), f"min_{name}": ends[0], f"max_{name}": ends[1]}
    _only_numbers(out, dims)
    return out


def domain(points: DataFrame, dims: Sequence[str]) -> Row | dict:
    """The bounds, checked: all coordinates are finite numbers, and every
    dimension spans more than one value."""
    row = _bounds_row(points, dims)
    for d in dims:
        low, high = row[f"min_{d}"], row[f"max_{d}"]
        if low is None or not low < high:
            raise ValueError(f"dimension {d} has no extent: min {low}, max {high}")
    return row


def _replace(points: DataFrame, scaled: dict[str, str]) -> DataFrame:
    """``scaled`` are SQL texts: one call, however many dimensions there are."""
    return points.selectExpr(*[f"{scaled[c]} AS `{c}`" if c in scaled else f"`{c}`" for c in points.columns])


def minmax_scale(points: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Every dimension onto [0, 1]; a constant one becomes 0.5."""
    row = _bounds_row(points, dims)
    scaled = {}
    for d in dims:
        low, high = row[f"min_{d}"], row[f"max_{d}"]
        if low is None or low == high:
            scaled[d] = f"if(`{d}` IS NOT NULL, 0.5D, NULL)"
        else:
            scaled[d] = f"(`{d}` - {float(low)!r}D) / {float(high - low)!r}D"
    return _replace(points, scaled)


def zscore_scale(points: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant dimension becomes 0."""
    stats = [
        f(d).alias(f"{name}_{d}")
        for d in dims
        for name, f in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
    ]
    row = points.agg(*stats, *_bad(dims)).first()
    _only_numbers(row, dims)
    scaled = {}
    for d in dims:
        mean, std = row[f"avg_{d}"], row[f"std_{d}"]
        if mean is None or row[f"min_{d}"] == row[f"max_{d}"]:
            scaled[d] = f"if(`{d}` IS NOT NULL, 0D, NULL)"
        else:
            scaled[d] = f"(`{d}` - {float(mean)!r}D) / {float(std)!r}D"
    return _replace(points, scaled)
