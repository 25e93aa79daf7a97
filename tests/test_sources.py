import pytest

import mixframe as mf
from mixframe.runtime import bounded_rows, shared_folder, spread_out


def test_delimited_scan_fixed_and_inferred(spark, tmp_path):
    (tmp_path / "a.dat").write_text("1.5 2 0\n3 4.5 1\n")
    fixed = mf.read_delimited(spark, "a.dat", n_dims=2, base=str(tmp_path))
    inferred = mf.read_delimited(spark, str(tmp_path / "a.dat"))
    assert fixed.columns == inferred.columns == ["point_id", "x0", "x1", "label"]
    want = [(1.5, 2.0, 0), (3.0, 4.5, 1)]
    for df in (fixed, inferred):
        assert sorted(map(tuple, df.select("x0", "x1", "label").collect())) == want
        assert df.select("point_id").distinct().count() == 2


def test_other_delimiter(spark, tmp_path):
    (tmp_path / "b.csv").write_text("1,2,7\n")
    got = mf.read_points(spark, str(tmp_path / "b.csv"), fmt="csv", n_dims=2, delimiter=",")
    assert got.select("x0", "x1", "label").first() == (1.0, 2.0, 7)


def test_uri_is_not_joined():
    assert mf.dataset_uri("gs://bucket/a.dat", "/data") == "gs://bucket/a.dat"
    assert mf.dataset_uri("/abs/a.dat", "/data") == "/abs/a.dat"
    assert mf.dataset_uri("a.dat", "/data") == "/data/a.dat"
    assert mf.dataset_uri("a.dat") == "a.dat"


def test_label_is_the_last_column(spark):
    table = spark.createDataFrame([(1.0, 2.0, 3)], "a double, b double, c int")
    assert mf.split_label(table) == (["a", "b"], "c")
    with pytest.raises(ValueError):
        mf.split_label(table.select("c"))


def test_parquet_by_position(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1.0, 2.0, 3)], "a double, b double, c int").write.parquet(path)
    assert mf.read_points(spark, path).select("x0", "x1", "label").first() == (1.0, 2.0, 3)


def test_unusable_points_are_counted(spark):
    rows = [(1, 1.0, 1.0), (2, None, 1.0), (3, 1.0, float("nan")), (4, 2.0, 2.0)]
    pts = spark.createDataFrame(rows, "point_id bigint, x0 double, x1 double")
    assert tuple(mf.rejected_count(pts, ["x0", "x1"]).first()) == (2, 2)
    kept = mf.usable(pts, ["x0", "x1"]).orderBy("point_id").collect()
    assert [r.point_id for r in kept] == [1, 4]


def test_population_snapshot(spark, pop4, tmp_path):
    path = str(tmp_path / "pop")
    mf.write_population(pop4, path)
    back = mf.read_population(spark, path)
    assert back.columns == pop4.columns
    assert sorted(back.collect()) == sorted(pop4.collect())


def test_report_sink(spark, tmp_path):
    report = spark.createDataFrame([(0.05, 0.1, 0.15, 0.5)], "d1 double, d2 double, d3 double, ari double")
    mf.write_report(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).select("ari").first()[0] == 0.5


def test_model_tables_are_size_checked(spark):
    assert len(bounded_rows(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        bounded_rows(spark.range(6), 5)


def test_spread_out_leaves_wide_scans(spark):
    assert spread_out(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 8
    assert spread_out(spark.range(0, 100, 1, 20)).rdd.getNumPartitions() == 20
    assert spread_out(spark.range(0, 10, 1, 1), 3).rdd.getNumPartitions() == 3


def test_checkpoints_go_to_the_session_folder(spark):
    folder = shared_folder(spark)
    assert folder == spark.sparkContext.getCheckpointDir()


def test_infinite_and_missing_coordinates_are_refused(spark):
    rows = [(1, 0.0, 1.0), (2, float("inf"), 2.0), (3, float("nan"), 3.0), (4, None, 4.0), (5, 5.0, 6.0)]
    points = spark.createDataFrame(rows, "point_id bigint, x0 double, x1 double")
    assert [r.point_id for r in mf.usable(points, ["x0", "x1"]).orderBy("point_id").collect()] == [1, 5]
    assert tuple(mf.rejected_count(points, ["x0", "x1"]).first()) == (2, 3)
    for scale in (mf.minmax_scale, mf.zscore_scale):
        with pytest.raises(ValueError, match="'x0': 3"):
            scale(points, ["x0", "x1"])
        assert scale(mf.usable(points, ["x0", "x1"]), ["x0", "x1"]).count() == 2


def test_a_bad_cell_fails_the_read(spark, tmp_path):
    (tmp_path / "p.dat").write_text("0.5 1.5 0\n0.3 x 1\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        mf.read_delimited(spark, str(tmp_path), n_dims=2).collect()
    rows = mf.read_delimited(spark, str(tmp_path), n_dims=2, mode="DROPMALFORMED").collect()
    assert [(r.x0, r.x1, r.label) for r in rows] == [(0.5, 1.5, 0)]


def test_named_columns_of_a_delimited_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text("7,0.5,1.5,0\n9,2.5,3.5,1\n")
    points = mf.read_points(
        spark, str(tmp_path), fmt="csv", delimiter=",", features=["_c1", "_c2"], label="_c3", point_id="_c0"
    )
    assert sorted(tuple(r) for r in points.collect()) == [(7, 0.5, 1.5, 0), (9, 2.5, 3.5, 1)]
