import numpy as np
import pytest
from pyspark.sql import functions as F

import mixframe as mf
from catalog.queries import QUERIES

CFG = mf.EvolveConfig(pop_size=4)
SCHEMA = "run_id bigint, id bigint, c0 double, c1 double, s0 double, s1 double, fitness double"
PARENTS = [
    (0, 0, 0.0, 0.0, 1.0, 1.0, 5.0),
    (0, 1, 1.0, 0.0, 0.1, 1.0, 1.0),
    (0, 2, 0.0, 2.0, 1.0, 0.5, 3.0),
    (0, 3, 5.0, 5.0, 2.0, 2.0, 2.0),
]
CHILDREN = [
    (0, 0, 1.1, 0.0, 0.5, 0.5, 2.0),
    (0, 1, 0.9, 0.1, 0.5, 0.5, 4.0),
    (0, 2, 4.0, 4.0, 3.0, 3.0, 3.0),
    (0, 3, 0.2, 0.1, 0.3, 0.3, 4.5),
]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(PARENTS, SCHEMA), spark.createDataFrame(CHILDREN, SCHEMA)


def brute_nearest(left, right):
    out = {}
    for a in left:
        gaps = [
            (((a[2] - b[2]) / a[4]) ** 2 + ((a[3] - b[3]) / a[5]) ** 2, b[1]) for b in right
        ]
        out[a[1]] = min(gaps)[::-1]
    return out


def picked(df):
    return {r.id: tuple(r)[2:] for r in df.collect()}


def test_nearest_forms_agree(sides):
    parents, children = sides
    want = brute_nearest(CHILDREN, PARENTS)
    for got in (
        mf.nearest(children, parents, CFG),
        mf.nearest_by_window(mf.pair_distances(children, parents, CFG)),
    ):
        rows = {r.id: (r.match_id, r.distance) for r in got.collect()}
        assert {k: v[0] for k, v in rows.items()} == {k: v[0] for k, v in want.items()}
        assert all(np.isclose(rows[k][1], want[k][1]) for k in want)


def test_scale_of_the_other_side(sides):
    parents, children = sides
    right = mf.pair_distances(parents, children, CFG, scale="right")
    row = right.where("id1 = 1 AND id2 = 0").first()
    assert np.isclose(row.distance, ((1.0 - 1.1) / 0.5) ** 2)
    one = mf.nearest(parents, children, CFG, scale="right").where("id = 1").first()
    assert one.match_id == 0


def test_ties_go_to_the_lowest_id(spark):
    left = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, 1.0)], SCHEMA.rsplit(",", 1)[0])
    right = spark.createDataFrame(
        [(0, 9, 1.0, 0.0, 1.0, 1.0), (0, 4, -1.0, 0.0, 1.0, 1.0)], SCHEMA.rsplit(",", 1)[0]
    )
    assert mf.nearest(left, right, CFG).first().match_id == 4
    assert mf.nearest_by_window(mf.pair_distances(left, right, CFG)).first().match_id == 4


def test_greedy(sides):
    got = picked(mf.select(*sides, CFG, "greedy"))
    assert got == {0: PARENTS[0][2:], 1: CHILDREN[1][2:], 2: PARENTS[2][2:], 3: CHILDREN[3][2:]}


def test_crowding_into_own_slot(sides):
    near = {k: v[0] for k, v in brute_nearest(CHILDREN, PARENTS).items()}
    want = {
        i: CHILDREN[i][2:] if CHILDREN[i][6] > PARENTS[near[i]][6] else PARENTS[i][2:]
        for i in range(4)
    }
    assert picked(mf.select(*sides, CFG, "crowding")) == want


def test_crowding_into_the_beaten_slot(sides):
    near = {k: v[0] for k, v in brute_nearest(CHILDREN, PARENTS).items()}
    want = {i: PARENTS[i][2:] for i in range(4)}
    for child in sorted(CHILDREN, key=lambda c: (c[6], -c[1])):
        if child[6] > PARENTS[near[child[1]]][6]:
            want[near[child[1]]] = child[2:]
    got = picked(mf.select(*sides, CFG.with_(slot="competitor"), "crowding"))
    assert got == want and got[1] == CHILDREN[1][2:]


def test_nearest_child(sides):
    near = {k: v[0] for k, v in brute_nearest(PARENTS, CHILDREN).items()}
    want = {
        i: PARENTS[i][2:] if PARENTS[i][6] > CHILDREN[near[i]][6] else CHILDREN[near[i]][2:]
        for i in range(4)
    }
    assert picked(mf.select(*sides, CFG, "nearest_child")) == want


def test_runs_do_not_mix(sides):
    parents, children = (
        df.unionByName(df.withColumn("run_id", F.lit(1).cast("bigint"))) for df in sides
    )
    for mode in ("greedy", "crowding", "nearest_child"):
        rows = mf.select(parents, children, CFG, mode).collect()
        assert len(rows) == 8
        assert {tuple(r)[1:] for r in rows if r.run_id == 0} == {
            tuple(r)[1:] for r in rows if r.run_id == 1
        }


@pytest.mark.parametrize("mode", ["greedy", "crowding", "nearest_child"])
def test_evolution(blobs, mode):
    cfg = mf.EvolveConfig(pop_size=8, generations=2, runs=2, selection=mode)
    pop = mf.evolve(blobs, cfg)
    assert pop.count() == 16 and pop.select("run_id", "id").distinct().count() == 16
    assert pop.where("s0 <= 0 OR s1 <= 0 OR fitness IS NULL").count() == 0


def test_best_fitness_never_falls_under_greedy(blobs):
    best = [
        mf.evolve(blobs, mf.EvolveConfig(pop_size=8, generations=g, selection="greedy"))
        .agg(F.max("fitness"))
        .first()[0]
        for g in (0, 1, 3)
    ]
    assert best == sorted(best)


def test_evolution_repeats_and_ignores_partitions(blobs):
    cfg = mf.EvolveConfig(pop_size=6, generations=2)

    def body(points, cfg):
        rows = mf.evolve(points, cfg).orderBy("id").collect()
        return np.array([tuple(r)[1:] for r in rows])

    assert np.allclose(body(blobs, cfg), body(blobs.repartition(3), cfg))
    assert np.allclose(body(blobs, cfg), body(blobs, cfg.with_(persist_points=False, partitions=2)))


def test_lineage_is_cut(blobs):
    pop = mf.evolve(blobs, mf.EvolveConfig(pop_size=4, generations=2))
    plan = pop._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Range" not in plan


def test_every_pair_of_a_run_is_measured(spark):
    # more members than a few nearest ones, and two runs
    rows = [(run, i, float(i), run + 0.5 * i, 1.0 + i, 2.0) for run in range(2) for i in range(9)]
    pop, other = (spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0]) for _ in range(2))
    cfg = CFG.with_(runs=2)
    for scale, side in (("left", 0), ("right", 1)):
        got = {(r.run_id, r.id1, r.id2): r.distance for r in mf.pair_distances(pop, other, cfg, scale).collect()}
        assert len(got) == 2 * 9 * 9
        for (run, *ids), distance in got.items():
            a, b = (np.array(rows[run * 9 + i][2:]) for i in ids)
            spread = (a, b)[side][2:]
            assert np.isclose(distance, (((a[:2] - b[:2]) / spread) ** 2).sum())
    assert mf.pair_distances(pop, other, cfg, nearest=5).count() == 2 * 9 * 5


def test_population_distance_returns_every_pair(spark, tmp_path):
    table = spark.range(200).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 7) AS ts",
        "'view' AS event_type", "double(id % 17) AS value",
    )
    table.write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["population_distance"](spark, str(tmp_path)).collect()
    assert len({(r.id1, r.id2) for r in found}) == len(found) == 20 * 20
