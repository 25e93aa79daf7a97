"""Reading point tables: one row per point with a key, one double column per
dimension and, where known, the true label on the same row."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import digest


def dataset_uri(name: str, base: str | None = None) -> str:
    """Join a dataset name onto a base folder; a full URI or an absolute path
    is passed through unchanged."""
    if base is None or "://" in name or name.startswith("/"):
        return name
    return posixpath.join(base, name)


def point_schema(n_dims: int, label_type: T.DataType | None = None) -> T.StructType:
    """Schema of a delimited file: the dimensions, then the label."""
    fields = [T.StructField(f"_c{k}", T.DoubleType()) for k in range(n_dims)]
    fields.append(T.StructField(f"_c{n_dims}", label_type or T.IntegerType()))
    return T.StructType(fields)


def split_label(table: DataFrame) -> tuple[list[str], str]:
    """Feature columns and label column by position: the label comes last."""
    *features, label = table.columns
    if not features:
        raise ValueError("a point table needs a feature column before its label")
    return features, label


def as_points(
    table: DataFrame,
    features: Sequence[str | Column],
    label: str | Column | None = None,
    point_id: str | Column | None = None,
    ids: str = "content",
) -> DataFrame:
    """Project any table to ``point_id, x0.., label``.

    Without a key column ids are made by ``content_ids``: the same rows get the
    same ids however the files are split. That costs one exchange of the columns
    used; ``ids="position"`` takes ``monotonically_increasing_id`` instead, which
    costs nothing and changes with files and splits.
    """
    if ids not in ("content", "position"):
        raise ValueError("ids must be content or position")

    def as_column(value):
        return value if isinstance(value, Column) else F.col(value)

    key = F.monotonically_increasing_id() if point_id is None else as_column(point_id)
    columns = [] if point_id is None and ids == "content" else [key.cast("bigint").alias("point_id")]
    columns += [as_column(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)]
    if label is not None:
        columns.append(as_column(label).alias("label"))
    found = table.select(*columns)
    return found if "point_id" in found.columns else content_ids(found)


def content_ids(table: DataFrame) -> DataFrame:
    """``point_id`` in front of the columns: 60 bits of a hash of the row's values
    and of its number among equal rows. Equal rows are interchangeable, so they
    are counted and written out again; a row that makes up a third of the table
    is one row until then."""
    names = [f"`{c}`" for c in table.columns]
    copies = table.groupBy(*table.columns).agg(F.count(F.lit(1)).alias("copies__"))
    each = copies.selectExpr(*names, "explode(sequence(1L, copies__)) AS copy__")
    # a null must not look like a missing or an empty value
    texts = [f"coalesce('=' || CAST({n} AS STRING), 'null')" for n in names]
    number = f"CAST(conv(substr({digest(*texts, 'copy__')}, 1, 15), 16, 10) AS BIGINT) AS point_id"
    return each.selectExpr(number, *names)


def read_delimited(
    spark: SparkSession,
    path: str,
    n_dims: int | None = None,
    delimiter: str = " ",
    base: str | None = None,
    label_type: T.DataType | None = None,
    features: Sequence[str | Column] | None = None,
    label: str | Column | None = None,
    point_id: str | Column | None = None,
    mode: str = "FAILFAST",
    **options,
) -> DataFrame:
    """Headerless delimited text whose last column is the class label. With
    ``n_dims`` the schema is fixed and the file is read once; without it Spark
    infers the types in a pass of its own. Other columns can be named as
    ``_c0``, ``_c1``, ... in ``features``, ``label`` and ``point_id``. A cell
    that does not fit its type fails the read; ``mode="PERMISSIVE"`` makes it
    null, ``"DROPMALFORMED"`` leaves its row out."""
    reader = spark.read.options(header="false", sep=delimiter, mode=mode).options(**options)
    if n_dims is None:
        reader = reader.option("inferSchema", "true")
    else:
        reader = reader.schema(point_schema(n_dims, label_type))
    table = reader.csv(dataset_uri(path, base))
    if features is None:
        features, last = split_label(table)
        label = last if label is None else label
        features = [f for f in features if f != point_id]
    return as_points(table, features, label, point_id)


def read_points(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    features: Sequence[str | Column] | None = None,
    label: str | Column | None = None,
    point_id: str | Column | None = None,
    base: str | None = None,
    **options,
) -> DataFrame:
    """Points from any Spark source. Without ``features`` the columns are taken
    by position, label last."""
    if fmt in ("csv", "dat", "text"):
        chosen = dict(features=features, label=label, point_id=point_id)
        return read_delimited(spark, path, base=base, **chosen, **options)
    table = spark.read.format(fmt).options(**options).load(dataset_uri(path, base))
    if features is None:
        features, label = split_label(table)
    return as_points(table, features, label, point_id)


def usable(points: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows whose coordinates are all present and finite."""
    return points.where(_all_numbers(dims))


def rejected_count(points: DataFrame, dims: Sequence[str]) -> DataFrame:
    """One row: how many points ``usable`` keeps and how many it drops."""
    good = F.when(_all_numbers(dims), 1).otherwise(0)
    return points.agg(
        F.coalesce(F.sum(good), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(1 - good), F.lit(0)).alias("rejected"),
    )


def _all_numbers(dims: Sequence[str]) -> Column:
    keep = F.lit(True)
    for name in dims:
        # NaN compares as larger than infinity
        keep = keep & F.coalesce(F.abs(name) < F.lit(float("inf")), F.lit(False))
    return keep
