from .points import (
    as_points,
    content_ids,
    dataset_uri,
    point_schema,
    read_delimited,
    read_points,
    rejected_count,
    split_label,
    usable,
)
from .snapshots import read_population, write_population, write_report

__all__ = [
    "as_points",
    "content_ids",
    "dataset_uri",
    "point_schema",
    "read_delimited",
    "read_points",
    "read_population",
    "rejected_count",
    "split_label",
    "usable",
    "write_population",
    "write_report",
]
