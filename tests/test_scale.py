"""Sums, searches, ids and loops that must not depend on how rows are dealt out."""

import importlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import mixframe as mf
from mixframe import kernels
from mixframe.runtime import by_run, cut_model


def body(df):
    return sorted(tuple(r) for r in df.collect())


def test_evolution_is_equal_to_the_last_bit_after_a_repartition(blobs):
    cfg = mf.EvolveConfig(pop_size=6, generations=2, runs=2)
    want = body(mf.evolve(blobs, cfg))
    assert body(mf.evolve(blobs.repartition(5), cfg)) == want
    assert body(mf.evolve(blobs, cfg.with_(persist_points=False, partitions=3))) == want


def test_powers_of_two_scale_exactly():
    r = np.rint(np.random.default_rng(0).uniform(-40, 32, 10_000) * 2.0**40) * 2.0**-40
    assert (np.exp2(r - 32) * 2.0**32 == np.exp2(r)).all()


@pytest.mark.parametrize("spread", [1e-3, 1.0, 1e4])
def test_fitness_in_two_hundred_dimensions(spark, spread):
    d = 200
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, d))
    dims = [f"x{k}" for k in range(d)]
    points = spark.createDataFrame(x.tolist(), ", ".join(f"{c} double" for c in dims)).repartition(4)
    centres = rng.normal(size=(4, d))
    columns = ", ".join(["run_id bigint", "id bigint", *[f"c{k} double" for k in range(d)], *[f"s{k} double" for k in range(d)]])
    pop = spark.createDataFrame([(0, i, *map(float, c), *[spread] * d) for i, c in enumerate(centres)], columns)
    got = {r.id: r.log_fitness for r in mf.fitness(pop, points, dims).select("id", "log_fitness").collect()}
    for i, c in enumerate(centres):
        logs = -0.5 * (((x - c) / spread) ** 2).sum(axis=1) - 0.5 * d * math.log(spread)
        want = logs.max() + math.log(np.exp(logs - logs.max()).sum()) - math.log(4)
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-7)


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("m", [1, 4])
def test_search_tree_equals_brute_force(own, m):
    rng = np.random.default_rng(m)
    centres = np.round(rng.normal(size=(1500, 3)), 1)  # many ties
    places = np.round(rng.normal(size=(200, 3)), 1)
    scales, spreads = np.round(rng.uniform(0.1, 2, (200, 3)), 1), np.round(rng.uniform(0.1, 2, (1500, 3)), 1)
    at, gap = kernels.SearchTree(centres, None if own else spreads).nearest(places, scales if own else None, m)
    for q in range(200):
        total = np.zeros(1500)
        for k in range(3):
            part = (places[q, k] - centres[:, k]) / (scales[q, k] if own else spreads[:, k])
            total += part * part
        want = np.lexsort((np.arange(1500), total))[:m]
        assert at[q].tolist() == want.tolist() and gap[q].tolist() == total[want].tolist()


def test_runs_go_in_parallel(spark):
    pop = spark.range(80).selectExpr("id % 8 AS run_id", "id div 8 AS id", "rand(1) AS c0", "rand(2) AS c1", "rand(3) AS s0", "rand(4) AS s1")
    cores = spark.sparkContext.defaultParallelism
    assert by_run(pop, 8).rdd.getNumPartitions() == min(8, cores)
    assert cut_model(pop, 8).rdd.getNumPartitions() == min(8, cores)
    assert cut_model(pop).rdd.getNumPartitions() == 1


def test_ids_from_content(spark):
    rows = [(1.0, 2.0, "a"), (1.0, 2.0, "a"), (None, 2.0, "a"), (1.0, 2.0, None), (1.0, 2.0, "null")]
    table = spark.createDataFrame(rows, "u double, v double, w string")
    first = body(mf.as_points(table.repartition(1), ["u", "v"], "w").select("point_id"))
    again = body(mf.as_points(table.repartition(4), ["u", "v"], "w").select("point_id"))
    assert first == again and len(set(first)) == 5
    assert mf.as_points(table, ["u"], ids="position").select("point_id").distinct().count() == 5


def test_dense_numbers_over_many_tasks(spark):
    values = spark.range(500).selectExpr("id AS point_id", "if(id % 50 = 0, NULL, pmod(hash(id), 97) * 3) AS cluster").repartition(6)
    got = mf.relabel_dense(values, by=()).toPandas()
    plain = values.toPandas().merge(got, on="point_id")
    order = {v: i for i, v in enumerate(sorted(plain["cluster_x"].dropna().unique()), 1)}
    assert all((math.isnan(a) and math.isnan(b)) or order[a] == b for a, b in zip(plain["cluster_x"], plain["cluster_y"]))


def test_a_loop_cut_short_goes_on(blobs, tmp_path):
    cfg = mf.EvolveConfig(pop_size=6, generations=4, runs=2)
    log = str(tmp_path / "log")
    want = body(mf.evolve(blobs, cfg))
    mf.evolve(blobs, cfg.with_(generations=2), log)
    # a generation that was not completed does not count
    folder = next((tmp_path / "log").iterdir())
    (folder / "generation-000003").mkdir()
    assert body(mf.evolve(blobs, cfg, log)) == want
    assert body(mf.evolve(blobs, cfg, log)) == want
    assert len(list(folder.glob("generation-*/_SUCCESS"))) == 5


def test_counts_by_kind_equal_the_assignment(blobs):
    points = mf.minmax_scale(blobs, ["x0", "x1"])
    for second in ("own", "rep1"):
        cfg = mf.EvolveConfig(pop_size=8, generations=1, second=second)
        reps = mf.representatives(mf.evolve(points, cfg), points, cfg)
        counted = mf.operators.assignment.assignment_cells(points, reps, cfg)
        near = mf.nearest_labels(points, reps, cfg, ["label"])
        assert counted.agg(F.sum("n")).first()[0] == 300
        assert near.where("cluster = 0").count() >= (counted.where("cluster = 0").agg(F.sum("n")).first()[0] or 0)


def test_equal_gaussians_are_measured_once(spark, blobs, monkeypatch):
    module = importlib.import_module("mixframe.operators.fitness")
    measured, sums = [], module._exact_sums
    monkeypatch.setattr(module, "_exact_sums", lambda rows, *a: measured.append(len(rows)) or sums(rows, *a))
    schema = "run_id bigint, id bigint, c0 double, c1 double, s0 double, s1 double"
    shapes = [(1.0, 1.0, 2.0, 2.0), (3.0, 1.0, 1.0, 2.0), (1.0, 1.0, 2.0, 2.0), (9.0, 2.0, 1.0, 1.0)]
    pop = spark.createDataFrame([(run, i, *s) for run in (0, 1) for i, s in enumerate(shapes[: 4 - run])], schema)
    dims = ["x0", "x1"]
    parents = cut_model(module.fitness(pop, blobs, dims))
    alone = [module.fitness(pop.where(f"run_id = {run} AND id = {i}"), blobs, dims).first() for run, i in ((0, 3), (1, 0))]
    got = {(r.run_id, r.id): r for r in parents.collect()}
    # the fitness is a share of the size of the run
    assert got[0, 3].fitness == alone[0].fitness / 4 and got[1, 0].fitness == alone[1].fitness / 3
    assert got[0, 0].log_fitness == got[0, 2].log_fitness != got[1, 0].log_fitness
    moved = pop.selectExpr("run_id", "id", "if(id = 1, c0 + 1, c0) AS c0", "c1", "s0", "s1")
    again = {(r.run_id, r.id): r for r in module.fitness(moved, blobs, dims, known=parents).collect()}
    fresh = {(r.run_id, r.id): r for r in module.fitness(moved, blobs, dims).collect()}
    assert again == fresh
    assert measured == [3, 1, 1, 1, 3]
