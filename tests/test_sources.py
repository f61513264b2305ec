import pytest
from pyspark.sql import functions as F

from mendcast.operators import clean as cl
from mendcast.sources import names as nm, series_io as io


def test_csv_formats(spark, tmp_path):
    files = {
        "std.csv": "t,v\n2024-01-01,1.5\n2024-01-02,2.5\n", "eu.csv": "t;v\n2024-01-01;1,5\n2024-01-02;2,5\n",
        "semi.csv": "t;v\n2024-01-01;1.5\n", "text.csv": "t,v\n2024-01-01,abc\n", "single.csv": "t\n1\n",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    got = {r.file.rsplit("/", 1)[1]: (r.sep, r.decimal) for r in io.detect_csv_format(spark, str(tmp_path)).collect()}
    assert got == {"std.csv": (",", "."), "eu.csv": (";", ","), "semi.csv": (";", "."), "text.csv": (",", "."), "single.csv": (",", ".")}
    raw = io.read_series_csv(spark, str(tmp_path) + "/*", {"eu": (";", ","), "semi": (";", ".")})
    assert {r.series_id for r in raw.collect()} == {"std", "eu", "semi", "text", "single"}
    points, report = cl.clean_series(raw.where(F.col("series_id").isin("std", "eu")))
    assert [(r.series_id, r.pos, r.value) for r in points.orderBy("series_id", "pos").collect()] == [
        ("eu", 0, 1.5), ("eu", 1, 2.5), ("std", 0, 1.5), ("std", 1, 2.5)]
    assert {r.axis for r in cl.clean_index(raw.where("series_id = 'single'")).collect()} == {"numeric"}


def test_degraded_files(spark, tmp_path):
    (tmp_path / "my_set_MCAR_20p_3.csv").write_text("t,v\n3,1.0\n1, \n2,\n4,x\n")
    rows = io.read_degraded(spark, str(tmp_path) + "/*.csv").orderBy("pos").collect()
    assert [(r.series_id, r.technique, r.rate_percent, r.iteration) for r in rows] == [("my_set", "MCAR", 20, 3)] * 4
    assert [(r.x, r.value) for r in rows] == [(3.0, 1.0), (1.0, None), (2.0, None), (4.0, None)]


def test_cleaning_rules(spark):
    rows = [("s", 0, "2", "5"), ("s", 1, "1", "x"), ("s", 2, "2", "7"), ("s", 3, "1", "3"), ("s", 4, "0.5", "nan")]
    raw = spark.createDataFrame(rows, "series_id string, input_ord bigint, raw_index string, raw_value string")
    points, report = cl.clean_series(raw)
    assert [(r.pos, r.x, r.value) for r in points.orderBy("pos").collect()] == [(0, 1.0, 3.0), (1, 2.0, 5.0)]
    r = report.first()
    assert (r.rows_before, r.rows_all_missing, r.duplicates, r.rows_after) == (5, 2, 1, 2)
    with pytest.raises(ValueError):
        cl.clean_series(raw.drop("raw_value"))


def test_split(make):
    parts = cl.temporal_split(make({"a": [1.0] * 50, "b": [1.0] * 9, "c": [1.0], "d": [1.0] * 3}), 10)
    got = {r.series_id: r for r in cl.split_report(parts, 10).collect()}
    assert {k: (r.n_train, r.n_test, r.status) for k, r in got.items()} == {
        "a": (40, 10, "ok"), "b": (8, 1, "shortened"), "c": (0, 0, "too short"), "d": (2, 1, "shortened")}
    assert [r.pos for r in parts.where("series_id = 'a' AND step = 1").collect()] == [40]
    with pytest.raises(ValueError):
        cl.temporal_split(parts, 0)


def test_names(spark):
    names = ["a_b_MCAR_20p_1_knn_temporal_holt_winters_iter3.csv", "x_original_last_value.csv", "a_MNAR_5p_2_mean_other.csv", "broken.csv"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r for r in nm.parse_prediction_name(df, ["winters", "holt_winters", "last_value"]).collect()}
    r = got[names[0]]
    assert (r.dataset_name, r.technique, r.rate_percent, r.reconstruction_iteration) == ("a_b", "MCAR", 20, 1)
    assert (r.reconstruction_model, r.prediction_model, r.prediction_iteration) == ("knn_temporal", "holt_winters", 3)
    r = got[names[1]]
    assert (r.source_type, r.dataset_name, r.prediction_model, r.technique, r.prediction_iteration) == ("original", "x", "last_value", None, 1)
    r = got[names[2]]
    assert (r.reconstruction_model, r.prediction_model) == ("mean", "other")
    assert got[names[3]].source_type is None
    runs = spark.createDataFrame([("r_20240101_120000.csv",), ("r_20240301_000000.csv",), ("r.csv",)], "f string")
    assert [r.f for r in nm.latest_snapshot(runs, "f").collect()] == ["r_20240301_000000.csv"]
    one = spark.range(1)
    assert one.select(nm.normalize_id(F.lit(" a b//c "))).first()[0] == "a_b_c"
    with pytest.raises(Exception):
        one.select(nm.normalize_id(F.lit("//"))).collect()


def test_writes_skip_finished_cells(spark, make, tmp_path):
    path = str(tmp_path / "out")
    cell = lambda df, m: df.withColumns({"technique": F.lit("MCAR"), "rate_percent": F.lit(10), "iteration": F.lit(1), "model": F.lit(m)})
    io.write_points(cell(make({"a": [1.0]}), "x"), path)
    io.write_points(cell(make({"a": [2.0], "b": [3.0]}), "x"), path)
    assert sorted((r.series_id, r.value) for r in spark.read.parquet(path).collect()) == [("a", 1.0), ("b", 3.0)]
    io.export_filtered_csv(make({"a": [3.0, 1.0, 2.0]}), str(tmp_path / "csv"), ["value"])
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted(float(r.value) for r in back.collect()) == [1.0, 2.0, 3.0]


def test_text_axis_is_sorted(spark):
    raw = spark.createDataFrame([("s", 1, "c", "1"), ("s", 2, "a", "2"), ("s", 3, "b", "3")], "series_id string, input_ord bigint, raw_index string, raw_value string")
    assert [r.value for r in cl.clean_series(raw)[0].orderBy("pos").collect()] == [2.0, 3.0, 1.0]


def test_writer_replaces_cells_only(spark, tmp_path):
    schema = "series_id string, technique string, rate_percent int, pos bigint, value double"
    rows = [(s, t, 10, p, 1.0) for s in "ab" for t in ("X", "Y") for p in range(3)]
    path = f"file://{tmp_path}/t"
    stored = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("series_id", "technique", "rate_percent", "pos", "value").collect())
    io.write_points(spark.createDataFrame(rows, schema), path, overwrite=True)
    new = [("a", "X", 10, p, 2.0) for p in range(2)]
    io.write_points(spark.createDataFrame(new, schema), path, overwrite=True)
    want = sorted([r for r in rows if (r[0], r[1]) != ("a", "X")] + new)
    assert stored() == want
    io.write_points(spark.createDataFrame(rows, schema), path)  # one cell is short of a row and is completed, others are skipped
    assert stored() == sorted(rows)
    io.write_points(spark.createDataFrame(rows, schema), path)
    assert stored() == sorted(rows)


def test_unnamed_scratch_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace

    from mendcast import layout

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError):
        layout.scratch_dir(session)
    session.conf = SimpleNamespace(get=lambda key, default: "hdfs://shared/")
    assert layout.scratch_dir(session) == "hdfs://shared"


def test_scratch_run_leaves_nothing(spark):
    import os

    from mendcast import layout

    with layout.scratch_run(spark) as tables:
        kept = layout.materialise(spark.range(5))
        assert kept.count() == 5 and len(tables) == 1 and os.path.isdir(tables[0].removeprefix("file://"))
    assert not os.path.exists(tables[0].removeprefix("file://"))
