"""Leaders, refinement and assignment against list-based restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import mixframe as mf
from mixframe.operators.leaders import lead, merge_labels

CFG = mf.EvolveConfig(pop_size=4)
REPS = "run_id bigint, rep_id bigint, label bigint, c0 double, c1 double, s0 double, s1 double"


def gap(a, b, s):
    return sum(((x - y) / w) ** 2 for x, y, w in zip(a, b, s))


def listed_leaders(pop, delta1, delta2):
    reps, fresh = [(*pop[0], 1)], 2
    for c, s in pop[1:]:
        q = [gap(c, rc, rs) for rc, rs, _ in reps]
        total = sum(q)
        q = [v / total if total else float("nan") for v in q]
        at = 0 if total == 0 else q.index(min(q))
        rc, rs, label = reps[at]
        e = gap(c, rc, s)
        if q[at] <= delta1 or e <= delta1:
            mid = tuple((x + y) / 2 for x, y in zip(c, rc))
            reps.append((mid, tuple(max(x, y) for x, y in zip(s, rs)), fresh))
            fresh += 1
        elif q[at] > delta2 and e > delta2:
            reps.append((c, s, fresh))
            fresh += 1
        elif (c, s, label) not in reps:
            reps.append((c, s, label))
    return reps


@pytest.mark.parametrize("deltas", [(0.01, 0.05), (0.0, 0.4), (0.3, 0.6), (0.05, 0.95)])
@pytest.mark.parametrize("seed", range(6))
def test_leader_fold(seed, deltas):
    rng = np.random.default_rng(seed)
    at = rng.random((25, 2)).round(1)  # coarse: repeats and zero gaps occur
    width = rng.random((25, 2)).round(1) + 0.1
    pop = [(tuple(c), tuple(s)) for c, s in zip(at, width)]
    want = listed_leaders(pop, *deltas)
    labels, centres, spreads = lead(at, width, *deltas)
    assert labels.tolist() == [r[2] for r in want]
    assert np.allclose(centres, [r[0] for r in want]) and np.allclose(spreads, [r[1] for r in want])


def test_identical_individuals():
    at, width = np.ones((3, 2)), np.ones((3, 2))
    labels, *_ = lead(at, width, 0.01, 0.05)
    assert labels.tolist() == [1, 2, 3]  # each merger is a new entry


def listed_refinement(labels, at, width, fit, delta2):
    labels = list(labels)
    for _ in labels:
        change = False
        for i in range(len(labels)):
            for j in range(i + 1, len(labels)):
                near = gap(at[i], at[j], width[i]) <= delta2 or gap(at[i], at[j], width[j]) <= delta2
                if labels[i] != labels[j] and near:
                    change = True
                    if fit[i] > fit[j]:
                        labels[j] = labels[i]
                    else:
                        labels[i] = labels[j]
        if not change:
            break
    return labels


@pytest.mark.parametrize("seed", range(8))
def test_label_refinement(seed):
    rng = np.random.default_rng(seed)
    n = 15
    at, width, fit = rng.random((n, 2)), rng.random((n, 2)) + 0.5, rng.random(n).round(1)
    labels = np.arange(1, n + 1)
    got = merge_labels(labels, at, width, fit, 0.1)
    assert got.tolist() == listed_refinement(labels, at, width, fit, 0.1)
    assert labels.tolist() == list(range(1, n + 1))


def test_a_label_can_flip_for_ever():
    at = np.array([[0.0], [1.0], [2.0]])
    got = merge_labels(np.array([1, 2, 3]), at, np.ones((3, 1)), np.array([2.0, 1.0, 3.0]), 1.5)
    assert got.tolist() == listed_refinement([1, 2, 3], at, np.ones((3, 1)), [2.0, 1.0, 3.0], 1.5)


def test_leaders_per_run(spark, pop4):
    two = pop4.unionByName(pop4.withColumn("run_id", F.lit(1).cast("bigint")))
    rows = mf.leaders(two, CFG).collect()
    pop = [((r.c0, r.c1), (r.s0, r.s1)) for r in pop4.orderBy("id").collect()]
    want = [r[2] for r in listed_leaders(pop, CFG.delta1, CFG.delta2)]
    for run in (0, 1):
        mine = sorted((r for r in rows if r.run_id == run), key=lambda r: r.rep_id)
        assert [r.label for r in mine] == want


def test_close_pairs(spark):
    rows = [(0, 0, 1, 0.0, 0.0, 1.0, 1.0), (0, 1, 2, 0.1, 0.0, 1.0, 1.0),
            (0, 2, 2, 0.0, 0.1, 1.0, 1.0), (0, 3, 3, 9.0, 9.0, 1.0, 1.0)]
    got = mf.close_pairs(spark.createDataFrame(rows, REPS), CFG).collect()
    assert sorted((r.rep1, r.rep2) for r in got) == [(0, 1), (0, 2)]


def listed_assignment(points, reps, delta3, second="own"):
    """Cluster per point, before numbers are made dense."""
    out, alts = [], []
    for p in points:
        order = sorted((gap(c, p, s), k) for k, (c, s, _) in enumerate(reps))
        out.append(reps[order[0][1]][2] if order[0][0] <= delta3 else 0)
        alts.append(order[1] if len(order) > 1 else (float("inf"), -1))
    small = len(points) / (4 * len({r[2] for r in reps}))
    sizes = {c: out.count(c) for c in set(out)}
    final = []
    for c, (d, k) in zip(out, alts):
        if len(reps) > 1 and c != 0 and sizes[c] < small and d <= delta3:
            c = reps[k][2] if second == "own" else reps[1][2]
        final.append(c)
    return final


def dense(values):
    rank = {v: k for k, v in enumerate(sorted(set(values)), start=1)}
    return [rank[v] for v in values]


def assigned(spark, points, reps, cfg):
    pts = spark.createDataFrame(
        [(k, *p) for k, p in enumerate(points)], "point_id bigint, x0 double, x1 double"
    )
    table = spark.createDataFrame(
        [(0, k, label, *c, *s) for k, (c, s, label) in enumerate(reps)], REPS
    )
    return mf.assign(pts.repartition(3), table, cfg).orderBy("point_id").collect()


@pytest.mark.parametrize("second", ["own", "rep1"])
@pytest.mark.parametrize("seed", range(3))
def test_assignment(spark, seed, second):
    rng = np.random.default_rng(seed)
    points = [tuple(p) for p in rng.random((200, 2)).tolist()]
    reps = [
        (tuple(c), tuple(s), int(label))
        for c, s, label in zip(
            rng.random((9, 2)).tolist(), (rng.random((9, 2)) * 0.3 + 0.02).tolist(), rng.integers(1, 8, 9)
        )
    ]
    rows = assigned(spark, points, reps, CFG.with_(second=second))
    want = listed_assignment(points, reps, CFG.delta3, second)
    assert [r.cluster for r in rows] == dense(want)
    assert [r.is_outlier for r in rows] == [w == 0 for w in want]


def test_small_cluster_is_given_away(spark):
    points = [(0.0, 0.0)] * 20 + [(0.5, 0.0)]
    reps = [((0.0, 0.0), (1.0, 1.0), 1), ((0.5, 0.0), (0.1, 0.1), 2), ((9.0, 9.0), (1.0, 1.0), 3)]
    rows = assigned(spark, points, reps, CFG)
    assert {r.cluster for r in rows} == {1}


def test_one_representative_and_outliers_only(spark):
    rows = assigned(spark, [(0.0, 0.0), (9.0, 9.0)], [((0.0, 0.0), (1.0, 1.0), 5)], CFG)
    assert [(r.cluster, r.is_outlier) for r in rows] == [(2, False), (1, True)]
    far = assigned(spark, [(8.0, 8.0), (9.0, 9.0)], [((0.0, 0.0), (1.0, 1.0), 5)], CFG)
    assert [(r.cluster, r.is_outlier) for r in far] == [(1, True)] * 2


def test_equal_distance_takes_the_first_representative(spark):
    reps = [((-1.0, 0.0), (2.0, 2.0), 7), ((1.0, 0.0), (2.0, 2.0), 3)]
    near = mf.nearest_labels(
        spark.createDataFrame([(0, 0.0, 0.0)], "point_id bigint, x0 double, x1 double"),
        spark.createDataFrame([(0, k, l, *c, *s) for k, (c, s, l) in enumerate(reps)], REPS),
        CFG,
        ["point_id"],
    ).first()
    assert (near.cluster, near.alt) == (7, 3)


def test_dense_relabel_keeps_contiguous_labels_apart(spark):
    df = spark.createDataFrame([(0, k, k % 4) for k in range(12)], "run_id bigint, point_id bigint, cluster bigint")
    got = mf.relabel_dense(df).collect()
    assert {(r.point_id % 4, r.cluster) for r in got} == {(0, 1), (1, 2), (2, 3), (3, 4)}


def test_relabel_is_a_bijection(spark):
    values = [40, -3, 40, 7, 0, 7]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "point_id long, cluster long")
    rows = mf.relabel_dense(df, by=()).orderBy("point_id").collect()
    assert [r.cluster for r in rows] == dense(values)


def test_pipeline_recovers_blobs(blobs):
    points = mf.minmax_scale(blobs, ["x0", "x1"])
    cfg = mf.EvolveConfig(pop_size=20, generations=8, crossover=0.8, seed=2, delta3=9.0)
    found = mf.predict(points, cfg, keep=["label"])
    assert found.count() == 300
    assert mf.adjusted_rand(found) > 0.9


def test_scores_without_assignment_equal_scores_with_it(blobs):
    points = mf.minmax_scale(blobs, ["x0", "x1"])
    cfg = mf.EvolveConfig(pop_size=6, generations=1, runs=2)
    direct = {r.run_id: r for r in mf.predicted_scores(points, cfg).collect()}
    full = mf.cluster_scores(mf.predict(points, cfg, keep=["label"]), by=["run_id"]).collect()
    for r in full:
        assert np.allclose(tuple(r)[1:], tuple(direct[r.run_id])[1:])


def test_relabel_keeps_rows_without_a_cluster(spark):
    rows = [(0, 1, 5), (0, 2, None), (None, 3, 7), (0, 4, 9)]
    table = spark.createDataFrame(rows, "run_id bigint, point_id bigint, cluster bigint")
    got = {r.point_id: r.cluster for r in mf.relabel_dense(table).collect()}
    assert got == {1: 1, 2: None, 3: 1, 4: 2}


def test_labels_that_flip_for_ever_end_as_all_passes_would():

    def all_passes(labels, at, width, fit, delta2):
        labels = labels.copy()
        gaps = (((at[:, None] - at[None]) / width[:, None]) ** 2).sum(axis=2)
        pairs = np.argwhere(np.triu((gaps <= delta2) | (gaps.T <= delta2), k=1))
        for _ in range(len(labels)):
            for i, j in pairs:
                if labels[i] != labels[j]:
                    labels[[i, j]] = labels[i] if fit[i] > fit[j] else labels[j]
        return labels

    made = np.random.default_rng(5)
    for n in (3, 8, 25):
        for _ in range(20):
            at, width, fit = made.random((n, 2)), np.full((n, 2), 0.3), made.random(n)
            want = all_passes(np.arange(n), at, width, fit, 0.6)
            assert (merge_labels(np.arange(n), at, width, fit, 0.6) == want).all()
