"""The generation loop."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame

from ..config import EvolveConfig
from ..operators.fitness import fitness
from ..operators.matching import select
from ..operators.population import init_population, vary
from ..operators.scaling import domain
from ..runtime import cut_model, held, held_blocks
from ..sources.snapshots import GenerationLog


def working_points(points: DataFrame, cfg: EvolveConfig, keep: Sequence[str] = ("point_id",)):
    """The dimensions and ``keep`` only, spread over the cluster and, if so
    configured, kept while the block runs: every generation reads them."""
    return held(points, [*keep, *cfg.dims], cfg.partitions, cfg.persist_points)


def generation(
    pop: DataFrame, points: DataFrame, cfg: EvolveConfig, gen: int, tasks: int | None = None
) -> DataFrame:
    """Next population; only children that differ from their parents' generation
    are measured, parents carry theirs."""
    known = pop if "log_fitness" in pop.columns else None
    children = fitness(vary(pop, cfg, gen), points, cfg.dims, tasks=tasks, known=known)
    return select(pop, children, cfg)


def evolve(points: DataFrame, cfg: EvolveConfig, log: str | None = None) -> DataFrame:
    """Final population ``run_id, id, c*, s*, fitness`` of all runs. One pass
    over the points per generation, whatever the number of runs.

    ``log`` names a folder all executors can reach. Every generation is written
    there, and a loop that was cut short goes on from the last one complete. The
    settings must be the same but for the number of generations.
    """
    spark = points.sparkSession
    done = GenerationLog(spark, log, cfg) if log else None
    start, pop = done.latest(cfg.generations) if done else (None, None)
    if start == cfg.generations:
        return pop.drop("log_fitness")
    with working_points(points, cfg) as narrow:
        if pop is None:
            first = init_population(narrow, cfg, domain(narrow, cfg.dims))
        with _passes(narrow, cfg) as (source, tasks):
            if pop is None:
                start, pop = 0, fitness(first, source, cfg.dims, tasks=tasks)
                pop = done.write(pop, 0) if done else cut_model(pop, cfg.runs)
            for gen in range(start + 1, cfg.generations + 1):
                pop = generation(pop, source, cfg, gen, tasks)
                pop = done.write(pop, gen) if done else cut_model(pop, cfg.runs)
    return pop.drop("log_fitness")


@contextmanager
def _passes(points: DataFrame, cfg: EvolveConfig):
    """What the generations read: blocks of coordinates, if they may be kept."""
    if cfg.persist_points and cfg.generations:
        with held_blocks(points, cfg.dims) as blocks:
            yield blocks
    else:
        yield points, None
