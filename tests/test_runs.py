import pytest
from pyspark.sql import functions as F

from mendcast.operators import mask, repair as rp, sweep as sw
from mendcast.operators.grid import experiment_grid
from mendcast.plans import pipeline as pl, registry as rg


@pytest.fixture
def points(make):
    return make({"a": [float(i % 7) for i in range(60)], "b": [float(i) for i in range(45)]})


def test_full_run(spark, points):
    cfg = pl.RunConfig(points=points, n_test=6, rates=(0.2,), models=("mean", "linear"), forecasters=("last_value",), learner="linear", lags=3)
    run = pl.pipeline_full(spark, cfg)
    assert list(run) == ["points", "split", "test", "degraded", "repaired", "recon_results", "predictions", "pred_results", "pred_errors"]
    board = pl.leaderboard(run["recon_results"]).collect()
    assert {r.model for r in board} == {"mean", "linear"}
    exact = run["recon_results"].where("series_id = 'b' AND model = 'linear' AND technique = 'MCAR'").first()
    assert exact.n_missing > 0 and exact.n_total == 39
    res = run["pred_results"].collect()
    # two series, original + three techniques x two repairs, two forecasters
    assert len(res) == 2 * (1 + 3 * 2) * 2 and all(r.n_samples == 6 and r.mase is not None for r in res)
    assert run["pred_errors"].count() == 0


def test_run_stops_at_the_failing_step(spark, points):
    with pytest.raises(ValueError):
        pl.pipeline_full(spark, pl.RunConfig(points=points, n_test=0))
    with pytest.raises(KeyError):
        pl.pipeline_full(spark, pl.RunConfig(points=points, n_test=5, models=("nope",)))
    with pytest.raises(pl.StepFailed) as e:
        pl.pipeline_full(spark, pl.RunConfig(points=points.limit(0), n_test=5, learner="linear"))
    assert e.value.step == "clean" and e.value.completed == []


def test_raw_rows_to_scores(spark):
    rows = [("s", i, f"2024-01-{i + 1:02d}", str(float(i))) for i in range(28)]
    raw = spark.createDataFrame(rows, "series_id string, input_ord bigint, raw_index string, raw_value string")
    run = pl.pipeline_reconstruction(spark, pl.RunConfig(raw=raw, n_test=4, techniques=("MNAR",), rates=(0.25,), models=("ffill",)))
    assert next(iter(run)) == "clean_report"
    assert run["recon_results"].first().n_missing <= 6


def test_user_methods(points):
    rg.register_missingness_technique("FIRST", lambda s, rate, seed: s.where(s.index >= int(len(s) * rate)), kind="series")
    rg.register_reconstruction_model("linear", lambda s: s.fillna(42.0), kind="series")
    with pytest.raises(ValueError):
        rg.register_reconstruction_model("linear", len)
    with pytest.raises(ValueError):
        rg.register_prediction_model(" ", len)
    with pytest.raises(TypeError):
        rg.register_missingness_technique("x", 3)
    out = mask.degrade(points, experiment_grid(points, ["FIRST", "MCAR"], [0.1], 1, 1), keep_truth=True)
    assert out.where("technique = 'FIRST' AND value IS NULL").count() == 10
    fixed = rp.reconstruct(out, ["linear", "mean"])
    assert {r.value for r in fixed.where("technique = 'FIRST' AND model = 'linear' AND pos < 4").collect()} == {42.0}
    rg.register_prediction_model("gpu_one", len, gpu=True, deterministic=False)
    assert rg.custom_forecasters()["gpu_one"].gpu and not rg.custom_forecasters()["gpu_one"].deterministic


def test_block_form_equals_the_whole_series(points, monkeypatch):
    monkeypatch.setattr(rg, "BLOCK", 8)

    def near_mean(s):
        return s.fillna(s.rolling(5, center=True, min_periods=1).mean())

    rg.register_reconstruction_model("blocks", near_mean, kind="block", halo=2)
    rg.register_reconstruction_model("whole", near_mean, kind="series")
    gaps = points.withColumn("value", F.when(F.col("pos") % 3 != 1, F.col("value")))
    rows = rp.reconstruct(gaps, ["blocks", "whole"]).groupBy("series_id", "pos").agg(F.countDistinct("value").alias("n"), F.count("value").alias("c")).collect()
    assert rows and all(r.n == 1 and r.c == 2 for r in rows)
    with pytest.raises(ValueError):
        rg.register_prediction_model("b", len, kind="block")


def test_sweep(points):
    deg = mask.degrade(points, experiment_grid(points, ["MCAR"], [0.3], 1, 5), keep_truth=True)
    scores = sw.sweep_scores(deg, [1, 2, 5], "knn_temporal", ["mad"], block=8)
    assert scores.count() == 6
    best = sw.sweep_best(scores, "mad", True).first()
    means = {r.param: r.m for r in scores.groupBy("param").agg(F.avg("mad").alias("m")).collect()}
    assert best.param == min(means, key=means.get) and best.metric_value == pytest.approx(min(means.values()))
    wide = sw.sweep_scores(deg, [2, 6], "spline", ["rmse"], block=8)
    assert {r.param for r in wide.collect()} == {2, 6}
    with pytest.raises(ValueError):
        sw.sweep_scores(deg, [1], "mean")


def test_run_stops_when_nothing_can_be_held_out(spark, points):
    one = points.where("pos = 0")
    with pytest.raises(pl.StepFailed) as e:
        pl.pipeline_full(spark, pl.RunConfig(points=one, n_test=5))
    assert e.value.step == "split" and e.value.completed == ["clean"]
