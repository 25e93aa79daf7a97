import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import VectorAssembler

import mixframe as mf
from mixframe import kernels
from mixframe.functions import uniform
from mixframe.operators.mixture import COMPONENT_SCHEMA, seed_centres

DIMS = ["x0", "x1"]


def numpy_step(x, weights, means, covs, reg):
    logs = []
    for w, m, c in zip(weights, means, covs):
        diff = x - m
        maha = np.einsum("ni,ij,nj->n", diff, np.linalg.inv(c), diff)
        logs.append(np.log(w) - 0.5 * (maha + np.log(np.linalg.det(2 * np.pi * c))))
    dens = np.exp(np.array(logs))
    r = dens / dens.sum(axis=0)
    out = []
    for k in range(len(weights)):
        n = r[k].sum()
        mean = (r[k][:, None] * x).sum(axis=0) / n
        diff = x - mean
        out.append((n / len(x), mean, (r[k][:, None] * diff).T @ diff / n + reg * np.eye(x.shape[1])))
    return out


@pytest.mark.parametrize("shift", [0.0, 1e5])
def test_one_step(spark, blobs, shift):
    pts = blobs.selectExpr("point_id", f"x0 + {shift}D AS x0", f"x1 + {shift}D AS x1")
    x = np.array(pts.select("x0", "x1").collect())
    weights = [0.5, 0.5]
    means = [x[:100].mean(axis=0), x[100:].mean(axis=0) + 1]
    covs = [np.array([[40.0, 3.0], [3.0, 20.0]]), np.array([[30.0, -2.0], [-2.0, 10.0]])]
    comps = spark.createDataFrame(
        [(0, k, weights[k], means[k].tolist(), covs[k].tolist()) for k in range(2)], COMPONENT_SCHEMA
    )
    got = mf.gmm_step(pts, comps, DIMS).orderBy("comp").collect()
    for r, (w, mean, cov) in zip(got, numpy_step(x, weights, means, covs, 1e-6)):
        assert np.isclose(r.weight, w) and np.allclose(r["mean"], mean)
        assert np.allclose(np.array(r["cov"]), cov, rtol=1e-6, atol=1e-6)


def test_seeds_are_spread_points(blobs):
    points = {(r.x0, r.x1) for r in blobs.collect()}
    runs = seed_centres(blobs, DIMS, 3, seed=4, runs=20)
    assert all({tuple(c) for c in centres} <= points for centres in runs)
    # A third seed lands in a group already taken about once in 200 draws.
    spread = [len({c[0] // 10 for c in centres}) == 3 for centres in runs]
    assert sum(spread) >= 18


def test_seeds_run_out_of_distinct_points(spark):
    pts = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 5.0)], "point_id long, x0 double")
    centres = seed_centres(pts, ["x0"], 4, seed=1, runs=1)[0]
    assert {c[0] for c in centres[:2]} == {0.0, 5.0} and centres[2:] == [centres[0]] * 2


def test_runs_start_and_end_apart(blobs):
    comps = mf.em_fit(blobs, mf.kmeans_start(blobs, DIMS, 3, seed=9, runs=2), DIMS)
    rows = comps.collect()
    assert sorted((r.run_id, r.comp) for r in rows) == [(a, b) for a in range(2) for b in range(3)]
    assert sum(r.weight for r in rows) == pytest.approx(2.0)


def test_em_finds_the_blobs(blobs):
    comps = mf.em_fit(blobs, mf.kmeans_start(blobs, DIMS, 3, seed=1), DIMS)
    assert sorted(round(r.weight, 3) for r in comps.collect()) == [0.333, 0.333, 0.333]
    found = mf.em_predict(blobs, comps, DIMS, ["label"])
    assert mf.adjusted_rand(found, cluster="prediction") == pytest.approx(1.0)


def test_spark_ml_mixture(blobs):
    model = mf.fit_mixture(blobs, DIMS, 3, seed=3)
    labelled = mf.predict_mixture(model, blobs, DIMS)
    assert labelled.columns == [*blobs.columns, "prediction"] and labelled.count() == 300
    comps = mf.mixture_components(model).collect()
    assert sum(r.weight for r in comps) == pytest.approx(1.0)
    assert all(len(r["mean"]) == 2 and len(r["cov"]) == 2 for r in comps)


def test_ellipse_against_eigen_decomposition(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(20):
        a = rng.normal(size=(2, 2))
        rows.append((0, k, 0.05, [1.0, 2.0], (a @ a.T).tolist()))
    comps = spark.createDataFrame(rows, COMPONENT_SCHEMA)
    used = comps.where("comp <> 3")
    got = {r.comp: r for r in mf.component_ellipse(comps, used).collect()}
    assert 3 not in got and len(got) == 19
    for k, r in got.items():
        values, vectors = np.linalg.eigh(np.array(rows[k][4]))
        width, height = 2 * np.sqrt(2) * np.sqrt(values)
        angle = 180 + np.degrees(np.arctan(vectors[1, 0] / vectors[0, 0]))
        assert np.allclose([r.width, r.height, r.angle], [width, height, angle])


def test_vector_taken_apart(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(df).select("id", "v")
    assert mf.model_vectors(df, "v", ["p", "q"]).first() == (1, 2.0, 3.0)


def test_numbers_drawn_in_tasks_are_those_of_the_expression(spark):
    ids = [0, 5, -7, 12, None, 123456789012, 99, -(2**63)]
    rows = spark.createDataFrame([(i,) for i in ids], "point_id bigint")
    for parts in ((7, 19, 4), (2**62, 0, 123456789)):
        want = [r.u for r in rows.selectExpr(f"{uniform(*parts, chr(39) + 'seed' + chr(39), 'point_id')} AS u").collect()]
        assert kernels.Draws(pa.array(ids, pa.int64())).uniform(*parts, "seed").tolist() == want
        assert kernels.Draws(pa.array(ids, pa.int64()).slice(3)).uniform(*parts, "seed").tolist() == want[3:]
    long = hashlib.md5(b"x" * 100 + b"|5").hexdigest()
    assert kernels.Draws(pa.array([5])).uniform("x" * 100).tolist() == [int(long[:13], 16) / 16**13]


def summed(dims, columns, mixtures, hard):
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=dims)
    found = list(kernels.em_sums(dims, mixtures, hard, 1e-6)(iter([batch])))
    return np.array([v for b in found for v in b.column("sums").to_pylist()])


@pytest.mark.parametrize("d", [1, 2, 3])
@pytest.mark.parametrize("hard", [False, True])
@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e7, 1.0), (0.0, 1e4)])
def test_em_sums_by_products_and_point_by_point(monkeypatch, d, hard, shift, scale):
    rng = np.random.default_rng(d)
    x = rng.random((6000, d)) * scale + shift
    mixtures = []
    for run in range(3):
        covs = [np.eye(d) if hard else scale**2 * (0.02 * np.eye(d) + 0.005) for _ in range(4)]
        factors = [np.linalg.inv(np.linalg.cholesky(c)) for c in covs]
        mixtures.append((run, [0.1, 0.2, 0.3, 0.4], list(x[rng.integers(0, 6000, 4)]), factors))
    dims = [f"x{k}" for k in range(d)]
    used, soft, firm = [], kernels._Plane.soft, kernels._Plane.hard
    monkeypatch.setattr(kernels._Plane, "soft", lambda self, *a: used.append(1) or soft(self, *a))
    monkeypatch.setattr(kernels._Plane, "hard", lambda self, *a: used.append(1) or firm(self, *a))
    fast = summed(dims, list(x.T), mixtures, hard)
    assert bool(used) == (scale == 1)  # far apart the products would not be exact
    monkeypatch.setattr(kernels, "PLANE", 0)
    plain = summed(dims, list(x.T), mixtures, hard)
    assert np.allclose(fast[:, 1:], plain[:, 1:], rtol=1e-9, atol=1e-8)
    assert hard or np.allclose(fast[:, 0], plain[:, 0])


def test_cells_are_counted_as_predictions_are(spark, blobs):
    some = blobs.selectExpr("point_id", "if(point_id % 10 = 0, NULL, label) AS label", "x0 / 25 AS x0", "x1 / 25 AS x1")
    comps = mf.em_fit(some, mf.kmeans_start(some, DIMS, 3, 5, runs=3), DIMS)
    want = mf.contingency(mf.em_predict(some, comps, DIMS, ["label"]), "label", "prediction", ["run_id"])
    got = mf.operators.em_cells(some, comps, DIMS, "label")
    assert sorted(map(str, got.collect())) == sorted(
        str(r) for r in want.withColumnRenamed("cluster", "prediction").collect()
    )
