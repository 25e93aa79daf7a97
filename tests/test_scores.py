import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import mixframe as mf

SLOW = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def frame(spark, labels, clusters):
    return spark.createDataFrame(list(zip(labels, clusters)), "label long, cluster long")


def scored(spark, labels, clusters):
    return mf.cluster_scores(frame(spark, labels, clusters)).first().asDict()


def pair_ari(labels, clusters):
    """Adjusted Rand index by looking at every pair."""
    n = len(labels)
    both = same_l = same_c = 0
    for i in range(n):
        for j in range(i + 1, n):
            a, b = labels[i] == labels[j], clusters[i] == clusters[j]
            both, same_l, same_c = both + (a and b), same_l + a, same_c + b
    expected = same_l * same_c / (n * (n - 1) / 2)
    most = (same_l + same_c) / 2
    return 1.0 if most == expected else (both - expected) / (most - expected)


def entropy_scores(labels, clusters):
    def entropy(values):
        _, counts = np.unique(values, return_counts=True, axis=0)
        p = counts / counts.sum()
        return float(-(p * np.log(p)).sum())

    h_l, h_c = entropy(np.array(labels)), entropy(np.array(clusters))
    mi = h_l + h_c - entropy(np.array(list(zip(labels, clusters))))
    hom = mi / h_l if h_l else 1.0
    com = mi / h_c if h_c else 1.0
    return hom, com, 2 * hom * com / (hom + com) if hom + com > 1e-12 else 0.0


@SLOW
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=2, max_size=40)
)
def test_scores_against_pairs_and_entropies(spark, rows):
    labels, clusters = zip(*rows)
    got = scored(spark, labels, clusters)
    hom, com, v = entropy_scores(labels, clusters)
    assert math.isclose(got["ari"], pair_ari(labels, clusters), abs_tol=1e-9)
    assert math.isclose(got["homogeneity"], hom, abs_tol=1e-9)
    assert math.isclose(got["completeness"], com, abs_tol=1e-9)
    assert math.isclose(got["v_measure"], v, abs_tol=1e-7)
    swapped = scored(spark, clusters, labels)
    assert math.isclose(got["ari"], swapped["ari"], abs_tol=1e-9)
    assert math.isclose(got["homogeneity"], swapped["completeness"], abs_tol=1e-9)


def test_corner_cases(spark):
    same = scored(spark, [0, 0, 1, 2], [5, 5, 3, 9])
    assert all(math.isclose(v, 1.0) for v in same.values())
    one = scored(spark, [0, 1, 2], [1, 1, 1])
    assert (one["homogeneity"], one["completeness"], one["v_measure"]) == (0.0, 1.0, 0.0)
    assert one["ari"] == 0.0
    single = scored(spark, [4], [2])
    assert set(single.values()) == {1.0}
    assert mf.cluster_scores(frame(spark, [1], [1]).where("label > 1")).count() == 0


def test_contingency_and_label_count(spark):
    df = frame(spark, [0, 0, 1, 3], [1, 1, 1, 2])
    cells = {(r.label, r.cluster): r.n for r in mf.contingency(df).collect()}
    assert cells == {(0, 1): 2, (1, 1): 1, (3, 2): 1}
    assert mf.label_count(df).first().k == 4
    assert mf.adjusted_rand(df) == pytest.approx(pair_ari([0, 0, 1, 3], [1, 1, 1, 2]))


def test_scores_by_group(spark):
    df = frame(spark, [0, 1, 0, 1], [0, 1, 0, 0]).withColumn(
        "run_id", F.when(F.monotonically_increasing_id() >= 0, F.col("label") * 0)
    )
    assert mf.cluster_scores(df, by=["run_id"]).count() == 1


def test_delta_grid(spark):
    rows = mf.delta_grid(spark).collect()
    assert len(rows) == 1140
    assert all(r.delta1 < r.delta2 < r.delta3 <= 1.0 for r in rows)
    assert len({(r.i, r.j, r.k) for r in rows}) == 1140


@pytest.mark.parametrize("changes", [{}, {"second": "rep1", "refine": False}])
def test_search_equals_one_prediction_per_triple(spark, blobs, changes):
    points = mf.minmax_scale(blobs, ["x0", "x1"])
    cfg = mf.EvolveConfig(pop_size=10, generations=1, **changes)
    snapshot = mf.evolve(points, cfg)
    grid = mf.delta_grid(spark).where("i IN (1, 4) AND j IN (5, 9) AND k IN (10, 18)")
    report = mf.delta_search(points, snapshot, cfg, grid)
    rows = report.collect()
    assert len(rows) == 8
    for r in rows:
        own = cfg.with_(delta1=r.delta1, delta2=r.delta2, delta3=r.delta3)
        reps = mf.representatives(snapshot, points, own)
        want = mf.cluster_scores(mf.assign(points, reps, own, ["label"])).first()
        assert math.isclose(r.ari, want.ari, abs_tol=1e-9)
        assert math.isclose(r.v_measure, want.v_measure, abs_tol=1e-9)
    best = mf.best_deltas(report).first()
    assert best.ari == max(r.ari for r in rows)
    first = min((r.delta1, r.delta2, r.delta3) for r in rows if r.ari == best.ari)
    assert (best.delta1, best.delta2, best.delta3) == first


def test_search_in_chunks(spark, blobs, monkeypatch):
    from mixframe.plans import experiments

    points = mf.minmax_scale(blobs, ["x0", "x1"])
    cfg = mf.EvolveConfig(pop_size=6, generations=0)
    snapshot = mf.evolve(points, cfg)
    grid = mf.delta_grid(spark).where("i IN (1, 4) AND j IN (5, 9) AND k = 12")
    whole = sorted(mf.delta_search(points, snapshot, cfg, grid).collect())
    monkeypatch.setattr(experiments, "MAX_MODEL_ROWS", 6)
    assert sorted(mf.delta_search(points, snapshot, cfg, grid).collect()) == whole


def test_search_takes_one_run(spark, blobs, pop4):
    two = pop4.unionByName(pop4.withColumn("run_id", F.lit(1).cast("bigint")))
    with pytest.raises(ValueError):
        mf.delta_search(blobs, two, mf.EvolveConfig(pop_size=4), mf.delta_grid(spark))


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "a", *rng.random(4).tolist()) for k in range(7)]
    wide = spark.createDataFrame(
        rows,
        "run_id long, algorithm string, homogeneity double, completeness double, v_measure double, ari double",
    )
    want = pd.DataFrame([r[2:] for r in rows], columns=["homogeneity", "completeness", "v_measure", "ari"]).describe()
    for r in mf.describe_scores(wide, ["v_measure", "ari"]).collect():
        got = [r.n, r["mean"], r["std"], r["min"], r.p25, r.p50, r.p75, r["max"]]
        assert np.allclose(got, want[r.metric])
    mean = mf.mean_scores(wide).first()
    assert math.isclose(mean.ari, want["ari"]["mean"])
    assert mf.long_scores(wide, ["run_id"]).count() == 28


def test_comparison_table(spark):
    df = frame(spark, [0, 0, 1], [0, 0, 1])
    table = mf.compare_algorithms({"x": df, "y": df})
    assert table.count() == 8
    values = [r.value for r in mf.sorted_results(table, "value").collect()]
    assert values == sorted(values)


def test_replicates(blobs):
    points = mf.minmax_scale(blobs, ["x0", "x1"])
    got = mf.replicates(points, mf.EvolveConfig(pop_size=6, generations=1), n=2, k=3)
    rows = got.collect()
    assert sorted((r.algorithm, r.run_id) for r in rows) == [
        ("em", 0), ("em", 1), ("evolution", 0), ("evolution", 1),
    ]
    assert all(r.ari > 0.99 for r in rows if r.algorithm == "em")
