"""Point sets taken from the given tables, and the settings of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe import EvolveConfig, as_points, minmax_scale

DIMS = ("x0", "x1")
# Event types and return flags in the order of their label numbers.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
RETURN_FLAGS = ("A", "N", "R")

EVENTS_CFG = EvolveConfig(dims=DIMS, pop_size=20, generations=3, crossover=0.5, seed=11)
FITNESS_CFG = EvolveConfig(dims=DIMS, pop_size=40, seed=7)
FARTHEST_CFG = EvolveConfig(pop_size=8, init="farthest", runs=2, seed=5)
# In 64 dimensions all but the widest Gaussians are far from every point.
SEARCH_CFG = EvolveConfig(pop_size=12, seed=3, beta=0.05)
NEAREST_CFG = EvolveConfig(pop_size=5, seed=11)
SEQUENTIAL_CFG = EvolveConfig.sequential(dims=DIMS, generations=2, seed=13)
# One data set, three algorithms: both evolutions for five generations.
COMPARE_CFG = EvolveConfig(dims=DIMS, seed=11)
COMPARE_SEQUENTIAL_CFG = EvolveConfig.sequential(dims=DIMS, generations=5, seed=13)
REPLICATES, REPLICATES_CFG = 20, EvolveConfig(dims=DIMS, seed=11)
START_K, START_SEED = 3, 7
SAMPLE_FRACTION = 0.05


def _numbered(column: str, values: tuple[str, ...]):
    number = F.when(F.col(column) == values[0], 0)
    for k, value in enumerate(values[1:], start=1):
        number = number.when(F.col(column) == value, k)
    return number.cast("bigint")


# The columns used, so that no job is spent on reading footers for the schema.
SCHEMAS = {
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, event_type string, value double",
    "part": "p_partkey bigint, p_brand string, p_size int, p_retailprice double",
    "lineitem": "l_quantity double, l_extendedprice double, l_returnflag string",
    "orders": "o_orderkey bigint, o_orderstatus string, o_totalprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def all_dims(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """A name for every component of the embeddings."""
    width = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    return tuple(f"x{k}" for k in range(width or 0))


def embeddings(spark: SparkSession, sf_dir: str) -> tuple[tuple[str, ...], DataFrame]:
    """Names of all components of the embeddings, and these as points."""
    dims = all_dims(spark, sf_dir)
    parts = [f"CAST(embedding[{k}] AS DOUBLE) AS {d}" for k, d in enumerate(dims)]
    source = table(spark, sf_dir, "embeddings")
    return dims, source.selectExpr("vec_id AS point_id", *parts, "CAST(label AS BIGINT) AS label")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "events")
    hours = F.hour("ts") + F.minute("ts") / F.lit(60.0)
    return as_points(source, ["value", hours], _numbered("event_type", EVENT_TYPES), "event_id")


def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the day of the month beside the point columns."""
    source = table(spark, sf_dir, "events")
    hours = F.hour("ts") + F.minute("ts") / F.lit(60.0)
    label = _numbered("event_type", EVENT_TYPES)
    return source.select(
        F.dayofmonth("ts").cast("bigint").alias("day"),
        F.col("value").alias("x0"),
        hours.alias("x1"),
        label.alias("label"),
    )


def scaled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_scale(events(spark, sf_dir), DIMS)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "part")
    return as_points(source, ["p_size", "p_retailprice"], "p_brand", "p_partkey")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines; they have no key, so none is made up."""
    source = table(spark, sf_dir, "lineitem")
    return source.select(
        F.col("l_quantity").alias("x0"),
        F.col("l_extendedprice").alias("x1"),
        _numbered("l_returnflag", RETURN_FLAGS).alias("label"),
    )
