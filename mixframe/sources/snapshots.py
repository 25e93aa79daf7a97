"""Writing and reading populations and search reports."""

from __future__ import annotations

import hashlib
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..config import EvolveConfig
from ..runtime import by_run


def write_population(pop: DataFrame, path: str) -> None:
    pop.write.mode("overwrite").partitionBy("run_id").parquet(path)


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """Population with ``run_id`` first again and of type long."""
    pop = spark.read.parquet(path)
    rest = [c for c in pop.columns if c != "run_id"]
    return pop.select(pop.run_id.cast("bigint").alias("run_id"), *rest)


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """Scores of a threshold search, one record per trial."""
    report.write.mode("overwrite").format(fmt).save(path)


class GenerationLog:
    """Populations of an evolution, one folder per generation. A folder counts
    once its writer has marked it complete."""

    def __init__(self, spark: SparkSession, path: str, cfg: EvolveConfig):
        same = {k: v for k, v in asdict(cfg).items() if k not in ("generations", "persist_points", "partitions")}
        name = hashlib.sha256(repr(sorted(same.items())).encode()).hexdigest()[:16]
        self.spark, self.cfg, self.folder = spark, cfg, f"{path}/{name}"

    def _at(self, gen: int) -> str:
        return f"{self.folder}/generation-{gen:06d}"

    def write(self, pop: DataFrame, gen: int) -> DataFrame:
        """The population, written and read back."""
        by_run(pop, self.cfg.runs).write.mode("overwrite").parquet(self._at(gen))
        return self.spark.read.schema(pop.schema).parquet(self._at(gen))

    def latest(self, most: int) -> tuple[int | None, DataFrame | None]:
        """The last complete generation up to ``most``, and its number."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for gen in range(most, -1, -1):
            if files.exists(path(f"{self._at(gen)}/_SUCCESS")):
                return gen, self.spark.read.parquet(self._at(gen))
        return None, None
