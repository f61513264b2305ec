"""Stored runs: nothing is done twice, a killed run goes on, stored models forecast the same."""

import os

import pytest
from pyspark.sql import functions as F

from mendcast.operators import forecast as fc
from mendcast.plans import pipeline as pl, registry as rg
from mendcast.plans.store import RunStore, load_model, save_model, wanted


@pytest.fixture
def points(make):
    return make({"a": [float((i * i) % 7) for i in range(50)], "b": [float(i % 5) for i in range(45)], "c": [2.0 + i for i in range(30)]})


def config(points, path, **kw):
    return pl.RunConfig(points=points, n_test=6, techniques=("MCAR", "MNAR"), rates=(0.2,), models=("mean", "linear"), forecasters=("last_value",),
                        learners=("linear", "series_boosting", "boosting"), replicates=2, trees=4, depth=2, lags=3, store=path, training_metrics=True, **kw)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names}


def rows(df):
    """Rows in a fixed order; sums of doubles may differ in their last bits."""
    short = [F.round(F.col(c) + 3.7e-10, 7).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]
    return sorted(map(str, df.select(*short).collect()))


def test_a_second_run_writes_nothing(spark, points, tmp_path):
    path = f"{tmp_path}/run"
    first = pl.pipeline_full(spark, config(points, f"file://{path}"))
    got = {k: rows(first[k]) for k in ("degraded", "repaired", "recon_results", "pred_results", "training_metrics")}
    kept = files(path)
    assert kept
    second = pl.pipeline_full(spark, config(points, f"file://{path}"))
    assert {k: rows(second[k]) for k in got} == got
    assert files(path) == kept
    plain = pl.pipeline_full(spark, config(points, None))
    for name in ("degraded", "recon_results"):
        assert rows(plain[name]) == got[name]
    iterations = {(r.prediction_model, r.prediction_iteration) for r in second["pred_results"].collect()}
    assert iterations == {("last_value", 1), ("linear_lag_model", 1), ("series_boosting_lag_model", 1), ("boosting_lag_model", 1), ("boosting_lag_model", 2)}
    seeds = {(r.model, r.iteration): r.seed for r in second["training_metrics"].collect()}
    assert seeds == {("linear", 1): 43, ("series_boosting", 1): 43, ("boosting", 1): 43, ("boosting", 2): 44}
    # one more repair only adds its cells
    wider = config(points, f"file://{path}")
    wider.models = ("mean", "linear", "ffill")
    third = pl.pipeline_reconstruction(spark, wider)
    assert {r.model for r in third["recon_results"].select("model").distinct().collect()} == {"mean", "linear", "ffill"}
    assert rows(third["degraded"]) == got["degraded"]
    with pytest.raises(ValueError):
        pl.pipeline_full(spark, config(points, f"file://{path}", seed=7))


def test_a_killed_run_goes_on(spark, points, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/run"
    real, calls = RunStore.commit, []

    def dies(self, step, cells, df):
        if len(calls) == 3:  # while it writes: the folder stays half done and gets no record
            df.limit(3).write.parquet(self.new_path(step))
            raise RuntimeError("killed")
        calls.append((step, len(cells)))
        real(self, step, cells, df)

    monkeypatch.setattr(RunStore, "commit", dies)
    with pytest.raises(pl.StepFailed) as e:
        pl.pipeline_full(spark, config(points, path, commit_every=1))
    assert e.value.step == "reconstruct" and e.value.completed == ["clean", "split", "degrade"]
    assert calls == [("split", 1), ("degrade", 1), ("degrade", 1)]
    later = []
    monkeypatch.setattr(RunStore, "commit", lambda self, step, cells, df: (later.append(step), real(self, step, cells, df))[1])
    done = pl.pipeline_full(spark, config(points, path, commit_every=1))
    assert later.count("reconstruct") == 4 and "degrade" not in later and "split" not in later
    whole = pl.pipeline_full(spark, config(points, f"file://{tmp_path}/other"))
    for name in ("degraded", "repaired", "recon_results", "pred_results"):
        assert rows(done[name]) == rows(whole[name])


@pytest.mark.parametrize("learner", ["linear", "boosting", "series_boosting"])
def test_stored_models_forecast_the_same(spark, points, tmp_path, learner):
    model, facts = fc.fit_learner(points, learner, 5, 3, 4, 2)
    save_model(model, f"file://{tmp_path}/model")
    again = load_model(spark, f"file://{tmp_path}/model", learner)
    a, b = (rows(fc.forecast_recursive(m, points, 4, 3)) for m in (model, again))
    assert len(a) == 12 and a == b and facts["final_train_loss"] >= 0


def test_replicated_and_guarded_user_forecasts(spark, points):
    rg.register_prediction_model("broken", lambda s, h: [float("nan")] * h if s.iloc[0] == 0 and s.iloc[1] == 1 else [s.mean()] * h, deterministic=False, kind="series")
    cfg = pl.RunConfig(points=points, n_test=5, techniques=("MCAR",), rates=(0.1,), models=("mean",), forecasters=("broken", "last_diff"), replicates=2)
    run = pl.pipeline_full(spark, cfg)
    preds = run["predictions"].where("source_type = 'original'")
    assert {(r.prediction_model, r.prediction_iteration) for r in preds.collect()} == {("broken", 1), ("broken", 2), ("last_diff", 1)}
    paths = {}
    for r in preds.orderBy("step").collect():
        paths.setdefault((r.series_id, r.prediction_model, r.prediction_iteration), []).append(r.predicted)
    assert paths["a", "broken", 1] == paths["a", "last_diff", 1] and paths["a", "broken", 2] == paths["a", "last_diff", 1]
    assert len(set(paths["c", "broken", 1])) == 1


def test_a_cell_is_not_gathered_to_be_found(make, capsys):
    points = make({"a": [1.0, 2.0], "b": [3.0]}).withColumn("model", F.lit(None).cast("string"))
    some = wanted(points, [{"series_id": "a", "model": None, "other": 1}])
    some.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r.value for r in some.collect()) == [1.0, 2.0]
