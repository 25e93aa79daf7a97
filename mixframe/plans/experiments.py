"""Threshold search, replicated runs and comparison tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EvolveConfig
from ..operators.assignment import counted_kinds, move_small, rep_models
from ..operators.fitness import fitness, model_arrays
from ..operators.leaders import lead, refine_with, reps_frame, reps_schema
from ..operators.metrics import SCORES, cluster_scores, scores
from ..operators.mixture import em_cells, em_fit, kmeans_start
from ..runtime import MAX_MODEL_ROWS, bounded_rows, cut_lineage, cut_model, model_table
from .evolve import working_points
from .predict import predicted_scores

GRID_STEP = 0.05
GRID_TOP = 20


def delta_grid(spark: SparkSession, top: int = GRID_TOP) -> DataFrame:
    """All thresholds ``delta1 < delta2 < delta3`` in steps of 0.05 up to 1,
    with their step numbers ``i, j, k``."""
    return (
        spark.range(1, top - 1)
        .selectExpr("id AS i", f"explode(sequence(id + 1, {top - 1}L)) AS j")
        .selectExpr("i", "j", f"explode(sequence(j + 1, {top}L)) AS k")
        .selectExpr("i", "j", "k", *[f"{s} * {GRID_STEP}D AS delta{n}" for n, s in enumerate("ijk", 1)])
    )


def _reps_of_grid(spark, rows, pairs: list, points: DataFrame, cfg: EvolveConfig) -> DataFrame:
    """Representatives of one population under each ``(set_id, delta1, delta2)``;
    ``run_id`` is the set."""
    centres, spreads = model_arrays(rows, len(cfg.dims))

    def fold(batches):
        for pdf in batches:
            for set_id, delta1, delta2 in pdf.itertuples(index=False):
                yield reps_frame(int(set_id), *lead(centres, spreads, delta1, delta2))

    table = model_table(spark, pairs, "set_id bigint, delta1 double, delta2 double")
    tasks = min(len(pairs), spark.sparkContext.defaultParallelism)
    folded = table.repartition(tasks).mapInPandas(fold, reps_schema(len(cfg.dims)))
    reps = cut_model(folded.repartition(1))
    if not cfg.refine:
        return reps
    # Settings share most of their Gaussians; each one is measured once.
    body = cfg.centre_cols + cfg.spread_cols
    each = reps.groupBy(*body).agg(F.min("rep_id").alias("rep_id"), F.min("run_id").alias("first"))
    alone = each.selectExpr("0L AS run_id", "first", "rep_id AS id", *body)
    rated = fitness(alone, points, cfg.dims).select(*body, "log_fitness")
    limits = table.selectExpr("set_id AS run_id", "delta2 AS delta2")
    joined = reps.join(F.broadcast(rated), body).join(F.broadcast(limits), "run_id")
    return cut_lineage(refine_with(joined, cfg, "delta2", len(pairs)))


def _shared_sets(reps: DataFrame, cfg: EvolveConfig) -> DataFrame:
    """``set_id, geometry_id, labelled_id, labels, n_labels, n_reps``: sets with
    the same Gaussians share a geometry, and with equal labels all results."""
    place = F.struct("rep_id", *cfg.centre_cols, *cfg.spread_cols)
    sets = reps.groupBy(F.col("run_id").alias("set_id")).agg(
        F.sort_array(F.collect_list(place)).alias("places"),
        F.sort_array(F.collect_list(F.struct("rep_id", "label"))).alias("pairs"),
    )
    return sets.selectExpr(
        "set_id",
        "min(set_id) OVER (PARTITION BY places) AS geometry_id",
        "min(set_id) OVER (PARTITION BY places, pairs) AS labelled_id",
        "pairs.label AS labels",
        "bigint(size(array_distinct(pairs.label))) AS n_labels",
        "bigint(size(pairs)) AS n_reps",
    )


def _scores_of_sets(
    points: DataFrame, reps: DataFrame, trials: DataFrame, steps: list, cfg: EvolveConfig, label: str
) -> DataFrame:
    """``trial`` and the scores for trials ``trial, set_id, step``.

    One pass over the points measures each distinct geometry once. Labels and
    delta3 come in afterwards: points are counted by label, their two nearest
    representatives and the first grid step at or above either distance, and
    every combination is read off those counts.
    """
    shared = cut_model(_shared_sets(reps, cfg))
    kept = shared.select(F.col("geometry_id").alias("run_id")).distinct()
    models = rep_models(reps.join(F.broadcast(kept), "run_id", "left_semi"), len(cfg.dims))
    places = [(run, c, s, np.arange(len(c))) for run, c, s, _ in models]

    counts = counted_kinds(points, places, cfg, steps, label).withColumnsRenamed({"run_id": "geometry_id", label: "label"})
    if cfg.second == "rep1":
        counts = counts.withColumn("place2", F.expr("if(place2 < 0, place2, 1L)"))
    wanted = trials.join(shared, "set_id")
    cases = wanted.drop("trial", "set_id").dropDuplicates(["labelled_id", "step"])
    case = ["labelled_id", "step"]
    cells = (
        counts.join(F.broadcast(cases), "geometry_id")
        .selectExpr(
            *case, "label", "n_labels", "n_reps",
            "if(bin1 <= step, get(labels, int(place1)), 0L) AS cluster",
            "if(bin2 <= step, get(labels, int(place2)), -1L) AS alt", "n",
        )
        .groupBy(*case, "label", "n_labels", "n_reps", "cluster", "alt")
        .agg(F.sum("n").alias("n"))
    )
    table = (
        move_small(cells, case)
        .groupBy(*case, "label", F.col("moved").alias("cluster"))
        .agg(F.sum("n").alias("n"))
    )
    return wanted.select("trial", *case).join(scores(table, case), case).select("trial", *SCORES)


def delta_search(
    points: DataFrame,
    snapshot: DataFrame,
    cfg: EvolveConfig,
    grid: DataFrame | None = None,
    label: str = "label",
) -> DataFrame:
    """``i, j, k, delta1, delta2, delta3`` and the scores of every threshold
    triple, for the one population in ``snapshot``."""
    spark = points.sparkSession
    grid = delta_grid(spark) if grid is None else grid
    trials = bounded_rows(grid.select("i", "j", "k", "delta1", "delta2", "delta3"))
    rows = sorted(bounded_rows(snapshot), key=lambda r: (r.run_id, r.id))
    if len({r.run_id for r in rows}) != 1:
        raise ValueError("a threshold search takes the population of one run")
    steps = sorted({t.delta3 for t in trials})
    pair_ids = {p: n for n, p in enumerate(sorted({(t.delta1, t.delta2) for t in trials}))}
    table = model_table(
        spark,
        [
            (n, pair_ids[t.delta1, t.delta2], steps.index(t.delta3), *t)
            for n, t in enumerate(trials)
        ],
        "trial bigint, set_id bigint, step int, i bigint, j bigint, k bigint, "
        "delta1 double, delta2 double, delta3 double",
    )
    pairs = [(n, *p) for p, n in pair_ids.items()]
    chunk = max(1, MAX_MODEL_ROWS // len(rows))
    parts = []
    with working_points(points, cfg, keep=[label]) as narrow:
        for start in range(0, len(pairs), chunk):
            some = pairs[start : start + chunk]
            reps = _reps_of_grid(spark, rows, some, narrow, cfg)
            mine = table.where(f"set_id BETWEEN {some[0][0]} AND {some[-1][0]}")
            wanted = mine.select("trial", "set_id", "step")
            parts.append(cut_lineage(_scores_of_sets(narrow, reps, wanted, steps, cfg, label)))
    found = reduce(DataFrame.unionByName, parts)
    keys = ["i", "j", "k", "delta1", "delta2", "delta3"]
    return table.join(F.broadcast(found), "trial").select(*keys, *SCORES)


def best_deltas(report: DataFrame) -> DataFrame:
    """The triple with the highest adjusted Rand index; the smallest on ties."""
    return report.agg(
        F.expr(
            "max_by(struct(delta1, delta2, delta3, ari),"
            " struct(ari, -delta1 AS a, -delta2 AS b, -delta3 AS c)) AS best"
        )
    ).select("best.*")


def replicates(
    points: DataFrame,
    cfg: EvolveConfig,
    n: int,
    k: int,
    label: str = "label",
    mixture_points: DataFrame | None = None,
) -> DataFrame:
    """``run_id, algorithm`` and the four scores of ``n`` evolutions and ``n``
    EM fits with ``k`` components. All runs of an algorithm share each pass over
    the points. EM may be given other (unscaled) points."""
    evolved = predicted_scores(points, cfg.with_(runs=n), label).select(
        "run_id", F.lit("evolution").alias("algorithm"), *SCORES
    )
    plain = points if mixture_points is None else mixture_points
    with working_points(plain, cfg, ["point_id", label]) as narrow:
        comps = em_fit(narrow, kmeans_start(narrow, cfg.dims, k, cfg.seed, n), cfg.dims)
        cells = cut_lineage(em_cells(narrow, comps, cfg.dims, label))
    cells = cells.withColumnsRenamed({label: "label", "prediction": "cluster"})
    fitted = scores(cells, ["run_id"]).select("run_id", F.lit("em").alias("algorithm"), *SCORES)
    return evolved.unionByName(fitted)


def long_scores(wide: DataFrame, keys: Sequence[str] = ("algorithm",)) -> DataFrame:
    """``keys.., metric, value``, one row per score."""
    return wide.unpivot(list(keys), list(SCORES), "metric", "value")


def mean_scores(wide: DataFrame) -> DataFrame:
    """Mean of every score per algorithm."""
    return wide.groupBy("algorithm").agg(*[F.avg(s).alias(s) for s in SCORES])


def describe_scores(wide: DataFrame, metrics: Sequence[str] = SCORES) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per
    algorithm and metric."""
    return (
        long_scores(wide, ["algorithm"])
        .where(F.col("metric").isin(*metrics))
        .groupBy("algorithm", "metric")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.percentile("value", F.lit(0.25)).alias("p25"),
            F.percentile("value", F.lit(0.5)).alias("p50"),
            F.percentile("value", F.lit(0.75)).alias("p75"),
            F.max("value").alias("max"),
        )
    )


def compare_algorithms(
    assigned: dict[str, DataFrame], label: str = "label", cluster: str = "cluster"
) -> DataFrame:
    """``algorithm, metric, value`` for labelled clusterings by name."""
    tables = [
        cluster_scores(df, label, cluster).select(F.lit(name).alias("algorithm"), *SCORES)
        for name, df in assigned.items()
    ]
    return long_scores(reduce(DataFrame.unionByName, tables))


def sorted_results(results: DataFrame, by: str = "seconds") -> DataFrame:
    """Results in ascending order, for reports."""
    return results.orderBy(by)
