import math


import numpy as np
import pytest
from pyspark.sql import functions as F

from mendcast.functions import metrics as mt
from mendcast.operators import score as sc
from mendcast.plans import registry as rg


@pytest.fixture
def recon(spark):
    rows = [("s", i, t, p) for i, (t, p) in enumerate(zip([1.0, 2.0, 3.0], [1.1, 2.2, 2.8]))]
    return spark.createDataFrame(rows, "series_id string, pos bigint, t double, p double")


@pytest.fixture
def pred(spark):
    rows = [("s", "m", i, t, p) for i, (t, p) in enumerate(zip([10.0, 20.0, 30.0], [11.0, 19.0, 28.0]))]
    train = [("s", i, v) for i, v in enumerate([5.0, 8.0, 12.0, 15.0, 18.0])]
    return (
        spark.createDataFrame(rows, "series_id string, prediction_model string, step bigint, t double, p double"),
        spark.createDataFrame(train, "series_id string, pos bigint, value double"),
    )


def test_reconstruction_metrics(recon):
    r = sc.score_reconstruction(recon).first()
    assert r.mad == r.mae == pytest.approx(0.5 / 3)
    assert r.rmse == pytest.approx(math.sqrt(0.09 / 3)) and r.r2 == pytest.approx(1 - 0.09 / 2)
    assert r.max_diff == pytest.approx(0.2) and r.min_diff == pytest.approx(0.1) and r.n_missing == 3
    one = sc.score_reconstruction(recon, [" RMSE ", "rmse"])
    assert "rmse" in one.columns and "mad" not in one.columns
    with pytest.raises(KeyError):
        sc.score_reconstruction(recon, ["nope"])
    with pytest.raises(ValueError):
        sc.score_reconstruction(recon, ["mad"], primary="rmse")
    flat = recon.withColumn("t", F.lit(2.0))
    assert sc.score_reconstruction(flat).first().r2 is None


def test_prediction_metrics(pred):
    pairs, train = pred
    r = sc.score_prediction(pairs, train).first()
    assert r.mae == pytest.approx(4 / 3) and r.mape == pytest.approx((0.1 + 0.05 + 2 / 30) / 3 * 100)
    assert r.mase == pytest.approx((4 / 3) / (13 / 4)) and r.n_samples == 3
    assert sc.score_prediction(pairs).first().mase is None
    assert sc.pred_mase(pairs, train).first().mase == pytest.approx(r.mase)
    zero = pairs.withColumn("t", F.lit(0.0))
    assert sc.score_prediction(zero, train).first().mape is None


def test_loss(spark):
    df = spark.createDataFrame([(3.0,), (0.9,), (float("nan"),), (None,)], "v double")
    low = [r[0] for r in df.select(mt.optimization_loss("v", True)).collect()]
    high = [r[0] for r in df.select(mt.optimization_loss("v", False)).collect()]
    assert low == [3.0, 0.9, math.inf, math.inf] and high == [-3.0, -0.9, math.inf, math.inf]


def test_user_metrics(recon, pred):
    rg.register_reconstruction_metric("worst", "Worst", True, lambda t, p: abs(t - p).max(), kind="series")
    rg.register_reconstruction_metric("bias", "Bias", True, lambda t, p: F.avg(p - t), kind="frame")
    r = sc.score_reconstruction(recon.withColumn("p", F.when(F.col("pos") == 1, 2.5).otherwise(F.col("t")))).first()
    assert r.worst == 0.5 and r.bias == pytest.approx(0.5 / 3)
    for bad, err in (("mad", ValueError), ("n_missing", ValueError), ("worst", ValueError)):
        with pytest.raises(err):
            rg.register_reconstruction_metric(bad, "x", True, len)
    pairs, train = pred
    rg.register_prediction_metric("first", "First", True, lambda t, p, train: float(train[0]), needs_train=True, kind="series")
    assert sc.score_prediction(pairs, train, ["first", "mae"]).first().first == 5.0
    with pytest.raises(ValueError):
        rg.register_prediction_metric("n_samples", "x", True, len)


def test_pairs_and_alignment(spark, make):
    truth = make({"s": [1.0, 2.0, None, 4.0]})
    key = lambda df: df.withColumns({"technique": F.lit("X"), "rate_percent": F.lit(10), "iteration": F.lit(1)})
    degraded = key(make({"s": [1.0, None, None, None]}))
    repaired = key(make({"s": [1.0, 2.5, 9.0, None]})).withColumn("model", F.lit("m"))
    got = sc.scoring_pairs(truth, degraded, repaired).collect()
    assert [(r.pos, r.t, r.p) for r in got] == [(1, 2.0, 2.5)]
    ts = lambda df: df.withColumn("ts", F.timestamp_micros(F.col("pos").cast("long")))
    assert [(r.t, r.p) for r in sc.align_by_index(ts(truth), ts(degraded), ts(repaired)).collect()] == [(2.0, 2.5)]
    zipped = sc.align_positional(truth, make({"s": [7.0, 8.0]}), ["series_id"])
    assert sorted((r.a_value, r.b_value) for r in zipped.collect()) == [(1.0, 7.0), (2.0, 8.0)]
    none = repaired.withColumn("model", F.lit("other")).withColumn("value", F.lit(None).cast("double"))
    errors = sc.unscored(repaired.unionByName(none), sc.scoring_pairs(truth, degraded, repaired)).collect()
    assert [r.model for r in errors] == ["other"]


def test_profiles_meet_positions_in_blocks(make, values, spark):
    """One series with nine tenths of all rows: decoding in small blocks equals plain interpolation of the profile."""
    from mendcast.operators import encode as en

    series = {"hot": [float((i * 37) % 101) for i in range(900)], "a": [1.0, 5.0, 2.0], "one": [3.0], "b": [float(i % 9) for i in range(97)]}
    points = make(series)
    profile = {"hot": [0.0, 1.0, 0.25, 0.5, 0.75], "a": [0.5, 0.0, 1.0, 0.1, 0.9], "one": [0.5] * 5, "b": [0.2, 0.4, 0.6, 0.8, 1.0]}
    rows = [(k, i, j, v) for k, p in profile.items() for i, v in enumerate(p) for j in range(2)]
    matrix = spark.createDataFrame(rows, "series_id string, i int, j int, v double")
    for block in (1 << 16, 16):
        got = values(en.decode_row_mean(matrix, points, block=block))
        for name, v in series.items():
            at = np.linspace(0, 4, len(v)) if len(v) > 1 else np.zeros(1)
            want = np.interp(at, range(5), profile[name]) * (max(v) - min(v)) + min(v)
            assert got[name] == pytest.approx(want.tolist()), (name, block)
    wide = spark.createDataFrame([("hot", 0, j, float(j % 7)) for j in range(60)] + [("b", 0, 0, 2.0)], "series_id string, i int, j int, v double")
    got = values(en.decode_column_mean(wide, points.where("series_id IN ('hot', 'b')"), block=16))
    want = np.interp(np.linspace(0, 59, 900), range(60), [j % 7 / 6 for j in range(60)]) * 100
    assert got["hot"] == pytest.approx(want.tolist()) and got["b"] == [0.0] * 97
