"""External quality of a clustering, from the counts of label against cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORES = ("homogeneity", "completeness", "v_measure", "ari")


def contingency(
    assigned: DataFrame,
    label: str = "label",
    cluster: str = "cluster",
    by: Sequence[str] = (),
) -> DataFrame:
    """``by.., label, cluster, n``."""
    keys = [F.col(label).alias("label"), F.col(cluster).alias("cluster")]
    return assigned.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("n"))


def scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by.., homogeneity, completeness, v_measure, ari`` of a contingency table.

    Row, column and cell totals come from one set of grouping sets over the
    table; mutual information is the difference of their entropies.
    """
    by = list(by)
    totals = cells.groupingSets(
        [[*by, "label", "cluster"], [*by, "label"], [*by, "cluster"]], *by, "label", "cluster"
    ).agg(
        F.sum(F.col("n").cast("double")).alias("m"),
        (F.grouping("cluster") * 2 + F.grouping("label")).alias("level"),
    )

    def over(level: int, value: str) -> str:
        return f"sum(if(level = {level}, {value}, 0D))"

    cell, row, col = 0, 2, 1
    sums = totals.groupBy(*by).agg(
        F.expr(f"{over(cell, 'm')} AS n"),
        *[
            F.expr(f"{over(level, 'm * ln(m)')} AS e_{name}")
            for name, level in (("cell", cell), ("row", row), ("col", col))
        ],
        *[
            F.expr(f"{over(level, 'm * (m - 1D) / 2D')} AS p_{name}")
            for name, level in (("cell", cell), ("row", row), ("col", col))
        ],
        F.expr(f"{over(row, '1D')} AS rows"),
        F.expr(f"{over(col, '1D')} AS cols"),
    )
    return (
        sums.where("n > 0")
        .selectExpr(
            *by,
            "if(rows = 1, 0D, ln(n) - e_row / n) AS h_label",
            "if(cols = 1, 0D, ln(n) - e_col / n) AS h_cluster",
            "greatest(0D, ln(n) + (e_cell - e_row - e_col) / n) AS mi",
            "p_cell",
            "if(n > 1, p_row * p_col / (n * (n - 1D) / 2D), 0D) AS expected",
            "(p_row + p_col) / 2D AS most",
        )
        .selectExpr(
            *by,
            "if(h_label = 0, 1D, mi / nullif(h_label, 0D)) AS homogeneity",
            "if(h_cluster = 0, 1D, mi / nullif(h_cluster, 0D)) AS completeness",
            "if(most = expected, 1D, (p_cell - expected) / nullif(most - expected, 0D)) AS ari",
        )
        .selectExpr(
            *by,
            "homogeneity",
            "completeness",
            "coalesce(2D * homogeneity * completeness / nullif(homogeneity + completeness, 0D), 0D)"
            " AS v_measure",
            "ari",
        )
    )


def cluster_scores(
    assigned: DataFrame,
    label: str = "label",
    cluster: str = "cluster",
    by: Sequence[str] = (),
) -> DataFrame:
    """The four scores of every clustering told apart by ``by``."""
    return scores(contingency(assigned, label, cluster, by), by)


def adjusted_rand(assigned: DataFrame, label: str = "label", cluster: str = "cluster") -> float:
    """The adjusted Rand index of one clustering as a number."""
    return cluster_scores(assigned, label, cluster).first()["ari"]


def label_count(points: DataFrame, label: str = "label") -> DataFrame:
    """One row ``k``: number of classes when labels count from 0."""
    return points.agg((F.max(label) + 1).cast("bigint").alias("k"))
