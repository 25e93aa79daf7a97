"""What the operators need from the session: checked collects of small tables,
lineage cuts that survive lost executors, and enough partitions to use the
cluster."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .config import MAX_MODEL_ROWS
from .kernels import pack


def bounded_rows(df: DataFrame, limit: int = MAX_MODEL_ROWS) -> list[Row]:
    """Collect a model table, refusing anything longer than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"model table has more than {limit} rows; split it by run_id")
    return rows


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: the one already set, else the one
    named in ``spark.checkpoint.dir``. Only a local session gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="mixframe-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that an iterative plan does not nest."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def by_run(df: DataFrame, runs: int) -> DataFrame:
    """A model table dealt out by run: as many partitions as there are runs, or
    cores where those are fewer. Steps within a run need no further exchange."""
    n = min(runs, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, "run_id") if n > 1 else df.coalesce(1)


def cut_model(df: DataFrame, runs: int = 1) -> DataFrame:
    """Checkpoint of a model table, dealt out by run. Of a single partition the
    outer ``coalesce`` only tells the planner so."""
    cut = cut_lineage(by_run(df, runs))
    return cut.coalesce(1) if runs == 1 else cut


def model_table(spark: SparkSession, rows: Sequence[Sequence], schema: StructType | str) -> DataFrame:
    """A model table from driver rows, as a local relation of known size."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(schema)
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(values, field.type) for values, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def spread_out(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Repartition to ``partitions``; by default only where the scan has fewer
    tasks than the cluster has cores (a small file), so that a large scan is
    left as it is split. Pass a number for a table that is not a plain scan:
    counting its partitions would run its shuffles."""
    if partitions is None:
        cores = df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
    return df.repartition(partitions)


@contextmanager
def held(points: DataFrame, columns: Sequence[str], partitions: int | None = None, persist: bool = True):
    """``columns`` of the points, spread over the cluster and kept while the
    block runs. A table that is kept already is taken as it is."""
    if points.is_cached:
        yield points
        return
    narrow = spread_out(points.select(*dict.fromkeys(columns)), partitions)
    if not persist:
        yield narrow
        return
    narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield narrow
    finally:
        narrow.unpersist()


@contextmanager
def held_blocks(points: DataFrame, dims: Sequence[str], task_bytes: int = 128 << 10):
    """The coordinates of the points in blocks, kept while the block runs, for
    loops that read nothing else of them; and in how many tasks they are read.
    A task has ``task_bytes`` of them at least: below it another task costs more
    than it saves."""
    made = points.select(*dims).mapInArrow(pack(list(dims)), "block binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size = made.agg(F.sum(F.octet_length("block"))).first()[0] or 0
        parts = made.rdd.getNumPartitions()
        tasks = max(1, min(parts, size // task_bytes))
        yield (made.coalesce(tasks) if tasks < parts else made), tasks
    finally:
        made.unpersist()
