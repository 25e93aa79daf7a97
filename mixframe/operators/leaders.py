"""From a population to labelled representatives.

Both steps visit individuals in id order and depend on what came before, so
each run is one small ordered fold; runs and threshold settings go in parallel.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EvolveConfig
from ..functions import prefixed, scaled_sq_distance
from ..runtime import by_run
from .fitness import fitness

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lead(
    centres: np.ndarray, spreads: np.ndarray, delta1: float, delta2: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, centres and spreads of the representatives.

    The first individual opens the list with label 1. Every later one looks up
    its closest representative by the share of the summed distances. Within
    ``delta1`` of it, by share or in its own spread, it adds the merger of the
    two under a new label; beyond ``delta2`` on both counts it adds itself under
    a new label; in between it adds itself under the closest one's label, unless
    that very entry exists.
    """
    n = len(centres)
    at, width = np.empty_like(centres), np.empty_like(spreads)
    label = np.empty(n, dtype="int64")
    at[0], width[0], label[0] = centres[0], spreads[0], 1
    size, fresh = 1, 2
    for c, s in zip(centres[1:], spreads[1:]):
        gaps = (((c - at[:size]) / width[:size]) ** 2).sum(axis=1)
        near = int(np.argmin(gaps))
        total = gaps.sum()
        # All gaps zero leaves no share; every comparison with it is false.
        share = gaps[near] / total if total > 0 else np.nan
        own = (((c - at[near]) / s) ** 2).sum()
        if share <= delta1 or own <= delta1:
            entry = ((c + at[near]) / 2, np.maximum(s, width[near]), fresh)
        elif share > delta2 and own > delta2:
            entry = (c, s, fresh)
        else:
            entry = (c, s, label[near])
            same = (at[:size] == c).all(axis=1) & (width[:size] == s).all(axis=1)
            if (same & (label[:size] == label[near])).any():
                continue
        at[size], width[size], label[size] = entry
        fresh += entry[2] == fresh
        size += 1
    return label[:size], at[:size], width[:size]


def merge_labels(
    labels: np.ndarray,
    centres: np.ndarray,
    spreads: np.ndarray,
    fit: np.ndarray,
    delta2: float,
) -> np.ndarray:
    """Close representatives of different label take the fitter one's label
    (the first gives way on ties). Pairs are visited in order and see earlier
    changes; at most as many passes as representatives, since a pair of fitter
    neighbours can pull a third one back and forth for ever. Once a state of the
    labels comes back, only what is left after whole cycles is still done."""
    labels = labels.copy()
    gaps = (((centres[:, None, :] - centres[None, :, :]) / spreads[:, None, :]) ** 2).sum(axis=2)
    close = (gaps <= delta2) | (gaps.T <= delta2)
    pairs = np.argwhere(np.triu(close, k=1))
    seen, turn, most = {labels.tobytes(): 0}, 0, len(labels)
    while turn < most:
        changed = False
        for i, j in pairs:
            if labels[i] != labels[j]:
                changed = True
                if fit[i] > fit[j]:
                    labels[j] = labels[i]
                else:
                    labels[i] = labels[j]
        if not changed:
            break
        turn += 1
        before = seen.setdefault(labels.tobytes(), turn)
        if before != turn:
            most, turn, seen = (most - turn) % (turn - before), 0, {}
    return labels


def reps_schema(n_dims: int) -> str:
    parts = [f"{p}{k} double" for p in "cs" for k in range(n_dims)]
    return ", ".join(["run_id bigint", "rep_id bigint", "label bigint", *parts])


def reps_frame(run_id: int, labels, centres, spreads) -> pd.DataFrame:
    d = centres.shape[1]
    out = {"run_id": run_id, "rep_id": np.arange(len(labels)), "label": labels}
    out.update({f"c{k}": centres[:, k] for k in range(d)})
    out.update({f"s{k}": spreads[:, k] for k in range(d)})
    return pd.DataFrame(out)


def leaders(pop: DataFrame, cfg: EvolveConfig) -> DataFrame:
    """``run_id, rep_id, label, c*, s*`` of every run."""
    centre_cols, spread_cols = cfg.centre_cols, cfg.spread_cols
    delta1, delta2 = cfg.delta1, cfg.delta2

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        found = lead(pdf[centre_cols].to_numpy(), pdf[spread_cols].to_numpy(), delta1, delta2)
        return reps_frame(pdf["run_id"].iloc[0], *found)

    members = pop.select("run_id", "id", *centre_cols, *spread_cols)
    return by_run(members, cfg.runs).groupBy("run_id").applyInPandas(fold, reps_schema(len(cfg.dims)))


def refine_with(
    rated: DataFrame, cfg: EvolveConfig, delta2: str | float, runs: int | None = None
) -> DataFrame:
    """Label refinement of representatives that carry ``log_fitness``; ``delta2``
    is a number or the column that holds it, ``runs`` how many there are."""
    centre_cols, spread_cols = cfg.centre_cols, cfg.spread_cols
    limit = F.col(delta2) if isinstance(delta2, str) else F.lit(float(delta2))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep_id")
        at, width = pdf[centre_cols].to_numpy(), pdf[spread_cols].to_numpy()
        labels = merge_labels(
            pdf["label"].to_numpy(), at, width, pdf["log_fitness"].to_numpy(), pdf["limit"].iloc[0]
        )
        return reps_frame(pdf["run_id"].iloc[0], labels, at, width)

    wanted = ["run_id", "rep_id", "label", "log_fitness", *centre_cols, *spread_cols]
    dealt = by_run(rated.select(*wanted, limit.alias("limit")), cfg.runs if runs is None else runs)
    grouped = dealt.groupBy("run_id")
    return grouped.applyInPandas(fold, reps_schema(len(cfg.dims)))


def refine(reps: DataFrame, points: DataFrame, cfg: EvolveConfig) -> DataFrame:
    """Representatives with labels merged by fitness on ``points``."""
    return refine_with(fitness(reps, points, cfg.dims, key="rep_id"), cfg, cfg.delta2)


def close_pairs(reps: DataFrame, cfg: EvolveConfig) -> DataFrame:
    """Pairs of representatives that refinement would look at: different label
    and within ``delta2`` in either spread. Each row searches the packed list of
    its run, so only the pairs found become rows."""
    parts = ["rep_id", "label", *cfg.centre_cols, *cfg.spread_cols]
    packed = reps.groupBy("run_id").agg(F.collect_list(F.struct(*parts)).alias("others"))
    other = prefixed("o.", cfg.centre_cols)
    gaps = [
        scaled_sq_distance(cfg.centre_cols, other, scale)
        for scale in (cfg.spread_cols, prefixed("o.", cfg.spread_cols))
    ]
    later = "filter(others, o -> o.rep_id > rep_id AND o.label <> label)"
    measured = (
        f"transform({later}, o -> struct(o.rep_id AS rep2, o.label AS label2, "
        f"{gaps[0]} AS distance1, {gaps[1]} AS distance2))"
    )
    near = f"filter({measured}, m -> least(m.distance1, m.distance2) <= {float(cfg.delta2)!r}D)"
    return (
        reps.join(F.broadcast(packed), "run_id")
        .selectExpr("run_id", "rep_id AS rep1", "label AS label1", f"inline({near})")
        .select("run_id", "rep1", "rep2", "label1", "label2", "distance1", "distance2")
    )
