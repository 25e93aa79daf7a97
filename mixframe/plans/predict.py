"""From points to cluster numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..config import EvolveConfig
from ..operators.assignment import assign, assignment_cells
from ..operators.leaders import leaders, refine
from ..operators.metrics import scores
from ..runtime import cut_model
from .evolve import evolve


def representatives(pop: DataFrame, points: DataFrame, cfg: EvolveConfig) -> DataFrame:
    """Labelled representatives of every run, refined on the points unless
    switched off, and materialized: they are small and read more than once."""
    reps = leaders(pop, cfg)
    return cut_model(refine(reps, points, cfg) if cfg.refine else reps, cfg.runs)


def predict(points: DataFrame, cfg: EvolveConfig, keep: Sequence[str] = ()) -> DataFrame:
    """``run_id, point_id, keep.., cluster, is_outlier``."""
    return assign(points, representatives(evolve(points, cfg), points, cfg), cfg, keep)


def predicted_scores(points: DataFrame, cfg: EvolveConfig, label: str = "label") -> DataFrame:
    """Scores per run against ``label``; the assignment itself is only counted."""
    reps = representatives(evolve(points, cfg), points, cfg)
    return scores(assignment_cells(points, reps, cfg, label), ["run_id"])
