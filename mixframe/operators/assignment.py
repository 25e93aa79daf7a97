"""Points to clusters.

What happens to a point depends only on its two nearest representatives, and
whether a cluster counts as small only on how many points there are of each
such kind. So one narrow pass classifies the points, one count over
(cluster, alternative) settles sizes, moves and final numbers, and that small
table is broadcast back. The points themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import MAX_MODEL_ROWS, EvolveConfig
from ..runtime import bounded_rows, cut_lineage, model_table
from .. import kernels
from .fitness import model_arrays

# Rows of the final-number table up to which it is broadcast.
BROADCAST_KINDS = 1_000_000


def rep_models(reps: DataFrame, n_dims: int) -> list[tuple]:
    """Collected representatives as ``(run_id, centres, spreads, labels)``."""
    rows = sorted(bounded_rows(reps), key=lambda r: (r.run_id, r.rep_id))
    models = []
    for run_id, group in groupby(rows, key=lambda r: r.run_id):
        group = list(group)
        labels = np.array([r.label for r in group], dtype="int64")
        models.append((run_id, *model_arrays(group, n_dims), labels))
    return models


def nearest_reps(
    points: DataFrame, models: list[tuple], cfg: EvolveConfig, keep: Sequence[str]
) -> DataFrame:
    """``keep.., run_id, label1, d1, label2, d2`` per point and run."""
    narrow = points.select(*dict.fromkeys([*keep, *cfg.dims]))
    schema = narrow.select(*keep).schema
    for name, kind in (
        ("run_id", "long"),
        ("label1", "long"),
        ("d1", "double"),
        ("label2", "long"),
        ("d2", "double"),
    ):
        schema = schema.add(name, kind)
    kernel = kernels.nearest_two(list(cfg.dims), models, list(keep), cfg.second == "rep1")
    return narrow.mapInArrow(kernel, schema)


def counted_kinds(
    points: DataFrame, models: list[tuple], cfg: EvolveConfig, steps: Sequence[float], label: str | None = None
) -> DataFrame:
    """``run_id, [label], place1, place2, bin1, bin2, n``: points counted in the
    tasks by their two nearest representatives and the number of ``steps``
    below either distance, then over all tasks."""
    named = [label] if label else []
    schema = points.select(*named).schema
    for name in ("place1", "place2", "bin1", "bin2", "n"):
        schema = schema.add(name, "long")
    schema.fields.insert(0, StructField("run_id", LongType()))
    schema = StructType(schema.fields)
    kernel = kernels.count_two(list(cfg.dims), models, list(steps), label)
    counts = points.select(*dict.fromkeys([*named, *cfg.dims])).mapInArrow(kernel, schema)
    keys = [c for c in counts.columns if c != "n"]
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"))


def labelled_kinds(
    points: DataFrame, models: list[tuple], cfg: EvolveConfig, label: str | None = None
) -> DataFrame:
    """``run_id, [label], cluster, alt, n`` as ``kinds`` has them."""
    rows = [(run, place, int(x)) for run, *_, labels in models for place, x in enumerate(labels)]
    of_place = F.broadcast(model_table(points.sparkSession, rows, "run_id bigint, place bigint, label_of bigint"))
    counts = counted_kinds(points, models, cfg, [float(cfg.delta3)], label)
    if cfg.second == "rep1":
        # the second one's place is fixed, where there is one
        counts = counts.withColumn("place2", F.expr("if(place2 < 0, place2, 1L)"))
    first = of_place.selectExpr("run_id", "place AS place1", "label_of AS first")
    second = of_place.selectExpr("run_id", "place AS place2", "label_of AS second")
    named = [label] if label else []
    return (
        counts.join(F.broadcast(first), ["run_id", "place1"])
        .join(F.broadcast(second), ["run_id", "place2"], "left")
        .selectExpr(
            "run_id", *named, "if(bin1 = 0, first, 0L) AS cluster",
            "if(bin2 = 0, coalesce(second, -1L), -1L) AS alt", "n",
        )
        .groupBy("run_id", *named, "cluster", "alt")
        .agg(F.sum("n").alias("n"))
    )


def kinds(near: DataFrame, cfg: EvolveConfig, keep: Sequence[str]) -> DataFrame:
    """``cluster``: nearest label within ``delta3``, else 0 for an outlier;
    ``alt``: second label within ``delta3``, else -1."""
    limit = f"{float(cfg.delta3)!r}D"
    return near.selectExpr(
        *keep,
        "run_id",
        f"if(d1 <= {limit}, label1, 0L) AS cluster",
        f"if(d2 <= {limit}, label2, -1L) AS alt",
    )


def nearest_labels(
    points: DataFrame, reps: DataFrame, cfg: EvolveConfig, keep: Sequence[str]
) -> DataFrame:
    """``keep.., run_id, cluster, alt`` per point and run, before any move."""
    models = rep_models(reps, len(cfg.dims))
    return kinds(nearest_reps(points, models, cfg, keep), cfg, keep)


def model_facts(spark, models: list[tuple]) -> DataFrame:
    """Per run: how many labels and representatives there are."""
    rows = [(run, len(set(labels.tolist())), len(labels)) for run, _, _, labels in models]
    return model_table(spark, rows, "run_id bigint, n_labels bigint, n_reps bigint")


def move_small(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``moved`` to counts ``n`` of ``by.., cluster, alt``.

    A cluster with fewer than N / (4 * labels) points gives those points away
    whose alternative is near enough. Sizes are taken once, before any move.
    Expects ``n_labels`` and ``n_reps`` on the rows.
    """
    whole = ", ".join(by)
    return counts.selectExpr(
        "*",
        f"sum(n) OVER (PARTITION BY {whole}) AS points",
        f"sum(n) OVER (PARTITION BY {whole}, cluster) AS size",
    ).selectExpr(
        *counts.columns,
        "if(n_reps > 1 AND cluster <> 0 AND alt <> -1 "
        "AND size < points / (4D * n_labels), alt, cluster) AS moved",
    )


def final_numbers(counts: DataFrame, models: list[tuple]) -> DataFrame:
    """``run_id, cluster, alt, final, is_outlier`` of ``labelled_kinds``: final
    cluster numbers are 1.. in the order of the labels left in the run, outliers
    included."""
    facts = F.broadcast(model_facts(counts.sparkSession, models))
    return move_small(counts.join(facts, "run_id"), ["run_id"]).selectExpr(
        "run_id",
        "cluster",
        "alt",
        "CAST(dense_rank() OVER (PARTITION BY run_id ORDER BY moved) AS BIGINT) AS final",
        "moved = 0 AS is_outlier",
    )


def assign(
    points: DataFrame, reps: DataFrame, cfg: EvolveConfig, keep: Sequence[str] = ()
) -> DataFrame:
    """``run_id, point_id, keep.., cluster, is_outlier`` for every point."""
    models = rep_models(reps, len(cfg.dims))
    keep = list(dict.fromkeys(["point_id", *keep]))
    near = kinds(nearest_reps(points, models, cfg, keep), cfg, keep)
    numbers = final_numbers(labelled_kinds(points, models, cfg), models)
    size = sum((len(set(labels.tolist())) + 1) ** 2 for *_, labels in models)
    if size <= BROADCAST_KINDS:
        numbers = F.broadcast(numbers)
    return near.join(numbers, ["run_id", "cluster", "alt"]).selectExpr(
        "run_id", *keep, "final AS cluster", "is_outlier"
    )


def assignment_cells(
    points: DataFrame, reps: DataFrame, cfg: EvolveConfig, label: str = "label"
) -> DataFrame:
    """``run_id, label, cluster, n`` after all moves: the contingency table of
    an assignment without writing the assignment, in one pass."""
    models = rep_models(reps, len(cfg.dims))
    counts = labelled_kinds(points, models, cfg, label)
    facts = F.broadcast(model_facts(points.sparkSession, models))
    moved = move_small(counts.join(facts, "run_id"), ["run_id"])
    return moved.groupBy("run_id", F.col(label).alias("label"), F.col("moved").alias("cluster")).agg(
        F.sum("n").alias("n")
    )


def _numbered(values: DataFrame, name: str) -> DataFrame:
    """Distinct values numbered from 1 in sorted order, in many tasks: ranges of
    values are counted, and each starts where those before it end."""
    cores = values.sparkSession.sparkContext.defaultParallelism
    ranges = cut_lineage(values.repartitionByRange(cores, name)).withColumn("range__", F.spark_partition_id())
    ranges = cut_lineage(ranges)
    sizes = sorted(ranges.groupBy("range__").count().collect())  # one row per range
    starts, before = [], 0
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = model_table(values.sparkSession, starts, "range__ int, before__ bigint")
    place = f"before__ + row_number() OVER (PARTITION BY range__ ORDER BY {name}) AS dense"
    return ranges.join(F.broadcast(offsets), "range__").selectExpr(name, f"{place}")


def relabel_dense(
    assigned: DataFrame, cluster: str = "cluster", by: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Cluster values become 1..K in sorted order within ``by``. The rank is
    taken over the distinct values, not over the points; the points are joined
    by broadcast where there are few values, else with Spark's skew handling.
    A null cluster stays null and takes no number."""
    values = assigned.select(*by, cluster).where(F.col(cluster).isNotNull()).distinct()
    if by:
        over = f"PARTITION BY {', '.join(by)} ORDER BY {cluster}"
        ranked = values.selectExpr(*by, cluster, f"CAST(dense_rank() OVER ({over}) AS BIGINT) AS dense")
    else:
        ranked = _numbered(values, cluster)
    rows = ranked.limit(MAX_MODEL_ROWS + 1).collect()
    if len(rows) <= MAX_MODEL_ROWS:
        ranked = F.broadcast(model_table(assigned.sparkSession, rows, ranked.schema))
    kept = [c for c in assigned.columns if c != cluster]
    ranked = ranked.withColumnsRenamed({c: f"{c}__" for c in (*by, cluster)})
    same = F.col(cluster) == F.col(f"{cluster}__")
    for key in by:
        same = same & F.col(key).eqNullSafe(F.col(f"{key}__"))
    return assigned.join(ranked, same, "left").selectExpr(*kept, f"dense AS {cluster}")
