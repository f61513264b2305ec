import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendcast.operators import clean as cl, forecast as fc
from mendcast.plans import registry as rg

N = None


def paths(df):
    out = {}
    for r in df.select("series_id", "step", "predicted").orderBy("step").collect():
        out.setdefault(r[0], []).append(r[2])
    return out


@pytest.fixture(scope="module")
def data():
    r = random.Random(2)
    return {
        "long": [N if r.random() < 0.2 else round(10 + i / 5 + r.gauss(0, 2), 2) for i in range(120)],
        "four": [1.0, N, 2.0, 4.0, 3.0], "one": [N, 5.0, N], "empty": [N, N],
    }


def test_closed_forms(make, data):
    points = make(data)
    got = fc.forecast(points, list(fc.FORECASTERS), 3, block=8)
    per = {m: paths(got.where(F.col("prediction_model") == m)) for m in fc.FORECASTERS}
    y = [v for v in data["long"] if v is not None]
    d = np.diff(y)
    assert per["last_value"]["long"] == [y[-1]] * 3 and per["last_value"]["empty"] == [0.0] * 3
    assert per["drift10"]["long"] == pytest.approx([y[-1] + i * (y[-1] - y[-10]) / 9 for i in (1, 2, 3)])
    assert per["secant10"]["long"] == pytest.approx([y[-1] + i * (y[-1] - y[-10]) / 10 for i in (1, 2, 3)])
    assert per["last_diff"]["four"] == [2.0, 1.0, 0.0] and per["secant10"]["four"] == [2.0, 1.0, 0.0]
    w = np.exp(np.linspace(-1, 0, 20))[:-1]
    assert per["exp_weighted_drift"]["long"] == pytest.approx([y[-1] + i * np.average(d[-19:], weights=w) for i in (1, 2, 3)])
    level, trend = y[-20], 0.0
    for v in y[-20:]:
        level = 0.3 * v + 0.7 * (level + trend)
        trend = 0.3 * (level - (0.3 * v + 0.7 * level)) + 0.7 * trend
    assert per["double_exp20"]["long"] == pytest.approx([level + i * trend for i in (1, 2, 3)])
    level, trend = y[0], y[1] - y[0]
    for v in y[1:]:
        new = 0.3 * v + 0.7 * (level + trend)
        trend = 0.1 * (new - level) + 0.9 * trend
        level = new
    assert per["holt"]["long"] == pytest.approx([level + i * trend for i in (1, 2, 3)])
    phi = np.polyfit(d[:-1], d[1:], 1)[0]
    m = (d[1:].mean() - phi * d[:-1].mean()) / (1 - phi)
    walk, step, want = y[-1], d[-1], []
    for _ in range(3):
        step = m + phi * (step - m)
        walk += step
        want.append(walk)
    assert per["ari1"]["long"] == pytest.approx(want)
    assert per["one"] if "one" in per else True
    assert per["ari1"]["one"] == [5.0] * 3 and per["holt"]["one"] == [5.0] * 3
    assert {r.pos for r in got.where("series_id = 'long'").collect()} == {120, 121, 122}


@pytest.mark.parametrize("alpha,beta", [(0.3, 0.1), (0.9, 0.05), (0.5, 1.0), (0.05, 0.9)])
def test_smoothing_weights_equal_the_recursion(make, alpha, beta):
    r = random.Random(4)
    y = [r.uniform(0, 5) for _ in range(70)]
    level, trend = y[0], y[1] - y[0]
    for v in y[1:]:
        new = alpha * v + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
    got = paths(fc.forecast_holt(make({"s": y}), 2, alpha, beta, block=16))["s"]
    assert got == pytest.approx([level + trend, level + 2 * trend], rel=1e-8)


def test_horizon_per_series_and_trend(make, spark):
    points = make({"a": [2.0 * i for i in range(700)], "b": [5.0 - i for i in range(20)]})
    h = spark.createDataFrame([("a", 2), ("b", 1)], "series_id string, h int")
    got = paths(fc.forecast(points, ["trend"], h))
    assert got["a"] == pytest.approx([1400.0, 1402.0]) and got["b"] == pytest.approx([-15.0])
    bent = make({"s": [float(i) if i < 60 else 60.0 - 2 * (i - 60) for i in range(121)]})
    curve = paths(fc.forecast_trend(bent, 2, changepoints=1))["s"]
    assert curve == pytest.approx([-62.0, -64.0], abs=1e-3)
    sub = fc.even_subsample(points)
    want = set(np.linspace(0, 699, 500, dtype=int).tolist())
    assert {r.pos for r in sub.where("series_id = 'a'").collect()} == want
    assert sub.where("series_id = 'b'").count() == 20


def test_sources_guard_and_plugins(make):
    train = make({"s": [1.0, 2.0, 4.0]})
    rep = train.withColumns({"technique": F.lit("MCAR"), "rate_percent": F.lit(10), "iteration": F.lit(1), "model": F.lit("mean")})
    src = fc.forecast_sources(train, rep)
    rg.register_prediction_model("mean_of_all", lambda s, h: [s.mean()] * h, kind="series")
    out = fc.to_prediction_keys(fc.forecast(src, ["last_value", "mean_of_all"], 2))
    rows = {(r.source_type, r.reconstruction_model, r.prediction_model): r.predicted for r in out.where("step = 2").collect()}
    assert rows == {
        ("original", None, "last_value"): 4.0, ("reconstructed", "mean", "last_value"): 4.0,
        ("original", None, "mean_of_all"): 7 / 3, ("reconstructed", "mean", "mean_of_all"): 7 / 3,
    }
    with pytest.raises(KeyError):
        fc.forecast(src, ["nope"], 2)
    bad = fc.forecast_drift10(src, 2).withColumn(
        "predicted", F.when((F.col("source_type") == "original") & (F.col("step") == 2), F.lit(float("inf"))).otherwise(F.col("predicted")))
    fixed = fc.finite_guard_fallback(bad, fc.forecast_last_value(src, 2))
    got = {(r.source_type, r.step): r.predicted for r in fixed.collect()}
    assert got[("original", 1)] == 4.0 and got[("reconstructed", 1)] == 5.5


def test_lag_model(make):
    data = {"a": [float(i % 4) for i in range(60)], "b": [float((i + 1) % 4) for i in range(60)], "short": [7.0, 8.0]}
    points = make(data)
    f = fc.lag_features(points, 4, block=8)
    assert f.count() == 2 * 56
    row = f.where("series_id = 'a' AND pos = 9").first()
    assert (row.y, row.lag_1, row.lag_4) == (1.0, 0.0, 1.0)
    model = fc.train_global_lag_model(f, learner="linear")
    got = paths(fc.forecast_recursive(model, points, 10, 4, block=8))
    assert got["a"] == pytest.approx([float(i % 4) for i in range(60, 70)], abs=1e-6)
    assert got["short"] == [8.0] * 10
    parts = cl.train_val_split(make({"a": [1.0] * 20, "b": [1.0] * 9}))
    assert parts.where("part = 'val'").count() == 4


def test_sparse_changepoints_meet_the_optimality_conditions(make):
    r = random.Random(2)
    bent = [float(i) if i < 100 else 100.0 - 2 * (i - 100) + 0.2 * r.gauss(0, 1) for i in range(200)]
    noise = [3.0 + 0.1 * i + r.gauss(0, 2) for i in range(200)]
    n, k, penalty = 200, 9, 0.02
    t = np.arange(n) / (n - 1)
    basis = np.stack([np.ones(n), t, *[np.maximum(t - (i + 1) / (k + 1), 0) for i in range(k)]])
    xx = np.stack([basis @ basis.T / n + fc.RIDGE * np.eye(k + 2)] * 2)
    xy = np.stack([basis @ np.array(v) / n for v in (bent, noise)])
    beta = fc.sparse_coefficients(xx, xy, 2, penalty)
    slope = xy - np.einsum("nij,nj->ni", xx, beta)  # of the squared error
    assert np.abs(slope[:, :2]).max() < 1e-9
    on = beta[:, 2:] != 0
    assert np.abs(slope[:, 2:][on] - penalty * np.sign(beta[:, 2:][on])).max() < 1e-8
    assert (np.abs(slope[:, 2:][~on]) <= penalty + 1e-9).all()
    assert on[0].sum() <= 4 and on[1].sum() <= 2
    points = make({"bent": bent, "noise": noise})
    got = paths(fc.forecast_trend(points, 3, changepoints=k, penalty=penalty))
    future = (n - 1 + np.arange(1, 4)) / (n - 1)
    wide = np.stack([np.ones(3), future, *[np.maximum(future - (i + 1) / (k + 1), 0) for i in range(k)]])
    assert got["bent"] == pytest.approx((beta[0] @ wide).tolist()) and got["noise"] == pytest.approx((beta[1] @ wide).tolist())


def test_replicates_read_their_features_once(spark, make):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    points = make({"a": [float(i % 5) for i in range(40)]})
    features = fc.lag_features(points, 3).repartition(2).withColumn("y", counted("y"))
    models, _ = fc.fit_replicates(features, ["boosting"], 2, trees=2, depth=2)
    assert len(models) == 2 and seen.value == 37
    states = fc.histories(points, 4, 3)
    for (name, i), model in models.items():
        plain, shared = (fc.forecast_recursive(model, points, 4, 3, name=name, iteration=i, states=s) for s in (None, states))
        assert sorted(plain.collect()) == sorted(shared.collect()) and shared.count() == 4
