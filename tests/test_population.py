import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import mixframe as mf
from mixframe.functions import hash_below, uniform
from mixframe.operators import population as population_module

SLOW = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def bodies(df):
    return {(r.run_id, r.id): tuple(r)[2:] for r in df.collect()}


def test_uniform_is_the_hash_of_its_parts(spark):
    got = spark.range(3).selectExpr(f"{uniform(7, 'id', chr(39) + 'tag' + chr(39))} AS u").collect()
    for k, row in enumerate(got):
        digits = hashlib.md5(f"7|{k}|tag".encode()).hexdigest()[:13]
        assert row.u == int(digits, 16) / 16**13


def test_hash_below_keeps_about_the_fraction(spark):
    n = spark.range(20_000).where(hash_below(0.1, 3, "id")).count()
    assert 1_800 < n < 2_200
    assert spark.range(10).where(hash_below(1.0, 3, "id")).count() == 10


def test_scaling(spark):
    pts = spark.createDataFrame(
        [(1, 0.0, 5.0, "a"), (2, 2.0, 5.0, "b"), (3, 4.0, 5.0, "a")],
        "point_id bigint, x0 double, x1 double, label string",
    )
    scaled = mf.minmax_scale(pts, ["x0", "x1"]).orderBy("point_id").collect()
    assert [(r.x0, r.x1) for r in scaled] == [(0.0, 0.5), (0.5, 0.5), (1.0, 0.5)]
    standard = mf.zscore_scale(pts, ["x0", "x1"]).orderBy("point_id").collect()
    assert np.allclose([r.x0 for r in standard], [-1.5**0.5, 0, 1.5**0.5])
    assert [r.x1 for r in standard] == [0.0, 0.0, 0.0]
    assert scaled[0].label == "a"


def test_degenerate_domain_is_refused(spark):
    pts = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 2.0)], "point_id long, x0 double, x1 double")
    with pytest.raises(ValueError, match="x1"):
        mf.domain(pts, ["x0", "x1"])


@pytest.mark.parametrize(
    "changes",
    [{"pop_size": 3}, {"init": "other"}, {"dims": ()}, {"runs": 0}, {"sample_fraction": 0.0},
     {"pop_size": 2000, "runs": 100}],
)
def test_config_contracts(changes):
    with pytest.raises(ValueError):
        mf.EvolveConfig(**changes)


def test_sequential_settings():
    assert mf.EvolveConfig.sequential(150).pop_size == 75
    cfg = mf.EvolveConfig.sequential(10_000)
    assert (cfg.pop_size, cfg.generations, cfg.crossover) == (100, 300, 0.8)


def test_random_centres_are_points(blobs):
    cfg = mf.EvolveConfig(pop_size=30, runs=3)
    pop = mf.init_population(blobs, cfg)
    centres = {(r.c0, r.c1) for r in pop.collect()}
    points = {(r.x0, r.x1) for r in blobs.collect()}
    assert pop.count() == 90 and centres <= points
    assert pop.select("run_id", "id").distinct().count() == 90
    extent = mf.domain(blobs, ["x0"])
    top = cfg.eps + (extent["max_x0"] - extent["min_x0"]) / cfg.beta
    assert pop.where(f"s0 < {cfg.eps} OR s0 > {top}").count() == 0


def test_draws_are_with_replacement_and_uniform(spark):
    pts = spark.range(5).selectExpr("id AS point_id", "double(id) AS x0")
    cfg = mf.EvolveConfig(dims=("x0",), pop_size=1000, runs=2)
    counts = {r.c0: r["count"] for r in mf.init_population(pts, cfg).groupBy("c0").count().collect()}
    assert set(counts) == {0.0, 1.0, 2.0, 3.0, 4.0}
    assert all(330 < n < 470 for n in counts.values())


def test_init_does_not_depend_on_partitions(blobs):
    cfg = mf.EvolveConfig(pop_size=10)
    assert bodies(mf.init_population(blobs, cfg)) == bodies(
        mf.init_population(blobs.repartition(7, "x1"), cfg)
    )


def test_too_low_a_threshold_is_raised(blobs, monkeypatch):
    want = bodies(mf.init_population(blobs, mf.EvolveConfig(pop_size=10)))
    monkeypatch.setattr(population_module.math, "sqrt", lambda k: -8.9)
    assert bodies(mf.init_population(blobs, mf.EvolveConfig(pop_size=10))) == want


def brute_farthest(points, first, k):
    chosen = [first]
    while len(chosen) < k:
        best = max(
            sorted(points),
            key=lambda p: (min((p[1] - c[1]) ** 2 + (p[2] - c[2]) ** 2 for c in chosen), -p[0]),
        )
        chosen.append(best)
    return [c[1:] for c in chosen]


@pytest.mark.parametrize("candidates", [256, 4])
def test_farthest_first(blobs, monkeypatch, candidates):
    monkeypatch.setattr(population_module, "CANDIDATES", candidates)
    monkeypatch.setattr(population_module, "WIDE", 2)
    cfg = mf.EvolveConfig(pop_size=12, init="farthest", seed=5)
    got = [r[2:4] for r in mf.init_population(blobs.repartition(5), cfg).orderBy("id").collect()]
    points = [(r.point_id, r.x0, r.x1) for r in blobs.collect()]
    first = next(p for p in points if p[1:] == got[0])
    assert got == brute_farthest(points, first, 12)


def test_farthest_with_repeated_points(spark):
    rows = [(1, 0.0), (2, 0.0), (3, 9.0), (4, 9.0)]
    pts = spark.createDataFrame(rows, "point_id bigint, x0 double")
    cfg = mf.EvolveConfig(dims=("x0",), pop_size=6, init="farthest")
    got = [r.c0 for r in mf.init_population(pts, cfg).orderBy("id").collect()]
    assert set(got[:2]) == {0.0, 9.0}
    assert got[2:] == [0.0] * 4  # nothing is left at a distance: the lowest id


@SLOW
@given(seed=st.integers(0, 10_000), gen=st.integers(1, 50), size=st.integers(4, 9))
def test_partners_are_distinct_and_not_oneself(spark, seed, gen, size):
    cfg = mf.EvolveConfig(pop_size=size, seed=seed, runs=2)
    ids = spark.range(2 * size).selectExpr(f"id div {size} AS run_id", f"id % {size} AS id")
    for r in mf.partners(ids, cfg, gen).collect():
        picked = {r.id, r.r1, r.r2, r.r3}
        assert len(picked) == 4 and min(picked) >= 0 and max(picked) < size


def test_partners_cover_all_triples(spark):
    cfg = mf.EvolveConfig(pop_size=5, runs=600)
    ids = spark.range(3000).selectExpr("id div 5 AS run_id", "id % 5 AS id")
    rows = mf.partners(ids, cfg, 1).where("id = 2").groupBy("r1", "r2", "r3").count().collect()
    assert len(rows) == 24 and all(8 <= r["count"] <= 48 for r in rows)


@SLOW
@given(seed=st.integers(0, 10_000), crossover=st.sampled_from([0.0, 0.3, 1.0]))
def test_variation_rule(spark, pop4, seed, crossover):
    cfg = mf.EvolveConfig(pop_size=4, seed=seed, crossover=crossover)
    old = bodies(pop4)
    drawn = {r.id: (r.r1, r.r2, r.r3) for r in mf.partners(pop4, cfg, 1).collect()}
    for (run, i), child in bodies(mf.vary(pop4, cfg, 1)).items():
        r1, r2, r3 = (old[run, r] for r in drawn[i])
        for k, value in enumerate(child):
            mutated = r3[k] + cfg.weight * (r1[k] - r2[k])
            own = old[run, i][k]
            if k >= 2:
                mutated, own = max(abs(mutated), cfg.eps), max(own, cfg.eps)
                assert value >= cfg.eps
            allowed = {0.0: [own], 1.0: [mutated]}.get(crossover, [own, mutated])
            assert any(abs(value - a) < 1e-12 for a in allowed)


def test_wrong_population_size_is_refused(pop4):
    with pytest.raises(Exception, match="configured size"):
        mf.vary(pop4, mf.EvolveConfig(pop_size=5), 1).collect()


def brute_fitness(pop, points):
    out = {}
    for key, (c0, c1, s0, s1) in pop.items():
        total = sum(
            np.exp(-0.5 * (((c0 - x) / s0) ** 2 + ((c1 - y) / s1) ** 2)) for x, y in points
        )
        out[key] = total / np.sqrt(s0 * s1) / len(pop)
    return out


def test_fitness(blobs, pop4):
    got = {(r.run_id, r.id): r.fitness for r in mf.fitness(pop4, blobs, ["x0", "x1"]).collect()}
    want = brute_fitness(bodies(pop4), [(r.x0, r.x1) for r in blobs.collect()])
    assert got.keys() == want.keys()
    assert all(np.isclose(got[k], want[k]) for k in want)


def test_fitness_of_no_points_and_of_many_dimensions(spark, pop4, blobs):
    none = mf.fitness(pop4, blobs.where("x0 < -1"), ["x0", "x1"])
    assert [r.fitness for r in none.collect()] == [0.0] * 4
    d = 80  # the plain product of spreads would underflow
    dims = [f"x{k}" for k in range(d)]
    pts = spark.range(2).selectExpr("id AS point_id", *[f"0.001D AS {n}" for n in dims])
    pop = spark.range(1).selectExpr(
        "0L AS run_id", "id", *[f"0.001D AS c{k}" for k in range(d)], *[f"0.00001D AS s{k}" for k in range(d)]
    )
    got = mf.fitness(pop, pts, dims).first().fitness
    assert np.isclose(got, 2 * 1e-5 ** (-d / 2))


def test_runs_are_measured_apart(blobs, pop4):
    two = pop4.unionByName(pop4.withColumn("run_id", F.lit(1).cast("bigint")))
    both = mf.fitness(two, blobs, ["x0", "x1"]).collect()
    alone = {r.id: r.fitness for r in mf.fitness(pop4, blobs, ["x0", "x1"]).collect()}
    assert len(both) == 8 and all(np.isclose(r.fitness, alone[r.id]) for r in both)


def test_point_distances(blobs, pop4):
    cfg = mf.EvolveConfig(pop_size=4)
    got = mf.point_distances(blobs, pop4, cfg)
    assert got.count() == 1200
    p = blobs.where("point_id = 7").first()
    row = got.where("point_id = 7 AND id = 1").first()
    assert np.isclose(row.distance, ((1 - p.x0) / 0.5) ** 2 + (p.x1 / 1.0) ** 2)
