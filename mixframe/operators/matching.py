"""Nearest individuals between two populations, and who survives.

Individuals only meet others of their run. Each run is one group, searched
through a tree in its task; runs go in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kernels
from ..config import SELECTIONS, EvolveConfig
from ..functions import prefixed, scaled_sq_distance
from ..runtime import by_run

KEYS = ["run_id", "id"]


def _sided(pop: DataFrame, cfg: EvolveConfig, run: str, key: str, prefix: str) -> DataFrame:
    parts = cfg.centre_cols + cfg.spread_cols
    return pop.selectExpr(f"run_id AS {run}", f"id AS {key}", *[f"{c} AS {prefix}{c}" for c in parts])


def _all_pairs(left: DataFrame, right: DataFrame, cfg: EvolveConfig, scale: str) -> DataFrame:
    distance = scaled_sq_distance(
        prefixed("l", cfg.centre_cols),
        prefixed("r", cfg.centre_cols),
        prefixed("l" if scale == "left" else "r", cfg.spread_cols),
    )
    a, b = _sided(left, cfg, "run_id", "id1", "l"), _sided(right, cfg, "run__", "id2", "r")
    pairs = a.join(F.broadcast(b), F.col("run_id").eqNullSafe(F.col("run__")))
    return pairs.selectExpr("run_id", "id1", "id2", f"{distance} AS distance")


def pair_distances(
    left: DataFrame, right: DataFrame, cfg: EvolveConfig, scale: str = "left", nearest: int | None = None
) -> DataFrame:
    """``run_id, id1, id2, distance`` of each left individual and every right one
    of its run, or with a number only the ``nearest``, measured in the spread of
    the ``scale`` side."""
    if nearest is None:
        return _all_pairs(left, right, cfg, scale)
    parts = [*KEYS, *cfg.centre_cols, *cfg.spread_cols]
    sides = [by_run(df.select(*parts), cfg.runs).groupBy("run_id") for df in (left, right)]
    kernel = kernels.nearest_within(cfg.centre_cols, cfg.spread_cols, nearest, scale == "left")
    found = sides[0].cogroup(sides[1]).applyInArrow(kernel, "run_id bigint, id bigint, match_id bigint, distance double")
    return found.selectExpr("run_id", "id AS id1", "match_id AS id2", "distance")


def nearest_by_window(pairs: DataFrame) -> DataFrame:
    """Nearest ``id2`` per ``id1`` over a table of pairs, lowest id on ties."""
    own = "OVER (PARTITION BY run_id, id1"
    return (
        pairs.selectExpr("*", f"min(distance) {own}) AS least")
        .where("distance = least")
        .selectExpr("*", f"row_number() {own} ORDER BY distance, id2) AS place")
        .where("place = 1")
        .selectExpr("run_id", "id1 AS id", "id2 AS match_id", "distance")
    )


def nearest(
    left: DataFrame, right: DataFrame, cfg: EvolveConfig, scale: str = "left"
) -> DataFrame:
    """``run_id, id, match_id, distance``: for each left individual the nearest
    right one of its run, lowest id on ties."""
    found = pair_distances(left, right, cfg, scale, nearest=1)
    return found.selectExpr("run_id", "id1 AS id", "id2 AS match_id", "distance")


def select(
    parents: DataFrame, children: DataFrame, cfg: EvolveConfig, mode: str | None = None
) -> DataFrame:
    """Next population by the configured rule; both sides carry ``fitness``, and
    are compared by ``log_fitness`` where both have it.

    ``greedy``: child i replaces parent i where it is strictly fitter.
    ``crowding``: a child competes with the parent nearest to it, in the child's
    spread. With ``slot="self"`` a winner is written to its own slot; with
    ``slot="competitor"`` it takes the place of the parent it beat, the fittest
    winner first, then the lowest id. ``nearest_child``: a parent competes with
    the child nearest to it, in the parent's spread; it stays where it is
    strictly fitter, a tie goes to the child.
    """
    mode = mode or cfg.selection
    if mode not in SELECTIONS:
        raise ValueError(f"selection must be one of {SELECTIONS}")
    logs = ["log_fitness"] if "log_fitness" in parents.columns and "log_fitness" in children.columns else []
    body = [*cfg.centre_cols, *cfg.spread_cols, "fitness", *logs]
    kernel = kernels.survive(mode, cfg.slot, cfg.centre_cols, cfg.spread_cols, body, body[-1])
    sides = [by_run(df.select(*KEYS, *body), cfg.runs).groupBy("run_id") for df in (parents, children)]
    schema = ", ".join(["run_id bigint", "id bigint", *[f"{c} double" for c in body]])
    return sides[0].cogroup(sides[1]).applyInArrow(kernel, schema)
