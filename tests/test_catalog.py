"""Registered queries that have no SQL, on tables of a few rows."""

import pytest

import mixframe as mf
from catalog.queries import QUERIES


@pytest.fixture
def late_groups(spark, tmp_path):
    """Vectors that differ by group from the fifth of twelve components on."""
    rows = [
        (i, [((i * 37 + k * 11) % 101) / 101 for k in range(4)] + [i % 3 + ((i * k) % 7) / 100 for k in range(8)], i % 3)
        for i in range(150)
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_mixtures_read_every_component(spark, late_groups, monkeypatch):
    asked, fit = [], mf.fit_mixture
    monkeypatch.setattr(mf, "fit_mixture", lambda points, dims, **more: asked.append(dims) or fit(points, dims, **more))
    found = QUERIES["em_fit_predict"](spark, late_groups).collect()
    groups = {(r.point_id % 3, r.prediction) for r in found}
    assert len(found) == 150 and len(groups) == len({p for _, p in groups}) == 3
    assert sum(r.n for r in QUERIES["gmm_fit_predict"](spark, late_groups).collect()) == 150
    assert [len(dims) for dims in asked] == [12]


@pytest.fixture
def few_events(spark, tmp_path):
    kinds = "array('click', 'error', 'purchase', 'signup', 'view')"
    table = spark.range(200).selectExpr(
        "id AS event_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 7) AS ts",
        f"{kinds}[id % 5] AS event_type",
        "id % 5 * 10D + pmod(hash(id), 100) / 50D AS value",
    )
    table.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_summaries_are_those_of_twenty_runs_of_both_algorithms(spark, few_events):
    found = QUERIES["replicate_summary"](spark, few_events).collect()
    assert {(r.algorithm, r.n) for r in found} == {("evolution", 20), ("em", 20)}


def test_ellipses_of_every_component(spark, few_events):
    found = QUERIES["component_ellipse"](spark, few_events).collect()
    assert sorted(r.comp for r in found) == [0, 1, 2, 3, 4]


def test_ellipse_of_a_component_without_number(spark):
    comps = spark.createDataFrame([(0, None, 1.0, [0.0, 0.0], [[1.0, 0.0], [0.0, 2.0]])], mf.operators.mixture.COMPONENT_SCHEMA)
    assert mf.component_ellipse(comps, comps.select("run_id", "comp")).count() == 1
