"""User functions over blocks and mergeable metrics equal the same functions over whole series."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mendcast.operators import forecast as fc, score as sc
from mendcast.plans import blockwise as bw, registry as rg
from queries import runs


@pytest.fixture
def series():
    r = random.Random(7)
    data = {"long": [None if r.random() < 0.3 else r.uniform(0, 9) for _ in range(95)], "one": [4.0], "late": [None] * 20 + [1.0, None, 3.0]}
    data["edge"] = [float(i) for i in range(16)]
    return data


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_blocks_see_the_state_before_them(make, values, series, block):
    points = make(series)

    def change(pdf, place):
        return pdf["value"].where(pdf["value"].notna(), runs._last_seen(pdf["value"].to_numpy(float), place))

    got = values(bw.over_blocks(points, ["series_id"], runs.BlockMethod(runs._observed, runs._join_observed, None), change, block))
    for name, v in series.items():
        s = pd.Series(v, dtype=float)
        assert got[name] == pytest.approx(s.ffill().fillna(s.mean()).tolist()), name


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_masks_count_over_blocks(make, values, series, block):
    points = make(series).withColumn("value", F.lit(1.0)).withColumns({"rate": F.lit(0.3), "seed": F.lit(1)})

    def change(pdf, place):
        return runs._head_mask(pdf["value"].to_numpy(float).copy(), 0.3, 1, place)

    got = values(bw.over_blocks(points, ["series_id"], runs.HEAD, change, block).withColumn("value", F.nanvl("value", F.lit(None))))
    for name, v in series.items():
        assert [x is None for x in got[name]] == [i < int(len(v) * 0.3) for i in range(len(v))], name


def test_series_states_are_ordered_merges(make, series):
    method = bw.BlockMethod(runs._steps, runs._join_steps, None)
    rows = {r.series_id: r for r in bw.series_states(make(series), ["series_id"], method, 8).collect()}
    for name, v in series.items():
        seen = np.array([x for x in v if x is not None])
        assert rows[name].n == len(v)
        assert rows[name].state[:2] == pytest.approx([(np.diff(seen) ** 2).sum(), len(seen) - 1]), name


def test_merged_metrics_spread_one_configuration(spark, make):
    r = random.Random(3)
    rows = [("hot", "m", r.gauss(0, 1), r.gauss(0, 1)) for _ in range(3000)] + [("a", None, 1.0, 3.0), ("a", None, 2.0, 1.0), ("b", "m", 1.0, 1.0)]
    pairs = spark.createDataFrame(rows, "series_id string, reconstruction_model string, t double, p double").repartition(7)
    train = make({"hot": [float(i % 7) for i in range(100)], "a": [1.0, 3.0, 2.0], "b": [5.0]})
    got = {tuple(x)[:2]: (x.relative, x.too_low) for x in bw.merged_metrics(
        pairs, ["series_id", "reconstruction_model"], {"relative": runs.RELATIVE, "too_low": runs.TOO_LOW}, train, block=8).collect()}
    for key in {x[:2] for x in rows}:
        t, p = (np.array([x[i] for x in rows if x[:2] == key]) for i in (2, 3))
        steps = np.diff({"hot": [float(i % 7) for i in range(100)], "a": [1.0, 3.0, 2.0], "b": [5.0]}[key[0]])
        scale = (steps**2).mean() if len(steps) else None
        assert got[key][1] == pytest.approx((p < t).mean())
        assert got[key][0] == (pytest.approx(((t - p) ** 2).mean() / scale) if scale else None)


def test_registration_of_forms(make):
    with pytest.raises(TypeError):
        rg.register_missingness_technique("X", runs.HEAD)
    with pytest.raises(ValueError):
        rg.register_missingness_technique("X", lambda s: s, kind="block")
    with pytest.raises(ValueError):
        rg.register_reconstruction_metric("x", "X", True, runs.WORST, kind="sum")
    with pytest.raises(TypeError):
        rg.register_prediction_metric("x", "X", True, 3, kind="merge")
    rg.register_prediction_model("flat", runs.FLAT_MEAN, kind="block")
    out = fc.forecast(make({"s": [1.0, None, 3.0]}), ["flat", "last_value"], 2)
    assert {(r.prediction_model, r.step): r.predicted for r in out.collect()} == {
        ("flat", 1): 2.0, ("flat", 2): 2.0, ("last_value", 1): 3.0, ("last_value", 2): 3.0}
    rg.register_prediction_metric("too_low", "Too low", True, runs.TOO_LOW, kind="merge")
    pairs = out.withColumnRenamed("predicted", "p").withColumn("t", F.lit(2.5))
    scores = sc.score_prediction(pairs, None, ["too_low", "mae"]).collect()
    assert {r.prediction_model: r.too_low for r in scores} == {"flat": 1.0, "last_value": 0.0}


def test_a_task_call_covers_many_series(make, series, capsys):
    points = make(series).withColumn("technique", F.when(F.col("series_id") != "one", F.lit("T")))
    keys, method = ["series_id", "technique"], bw.BlockMethod(runs._observed, runs._join_observed, None)
    states = bw.series_states(points, keys, method, 8)
    changed = bw.over_blocks(points, keys, method, lambda part, place: part["value"].fillna(place.total[1]), 8)
    pairs = points.withColumns({"t": F.lit(1.0), "p": F.col("pos") + 1.0})
    scores = bw.merged_metrics(pairs, keys, {"worst": runs.WORST}, None)
    for df in (states, changed, scores):
        df.explain()
        assert "GroupsInPandas" not in capsys.readouterr().out  # one call for every series and block
    seen = {k: [x for x in v if x is not None] for k, v in series.items()}
    assert {r.series_id: (r.n, r.state[1]) for r in states.collect()} == {k: (len(v), len(seen[k])) for k, v in series.items()}
    assert {r.series_id: r.worst for r in scores.collect()} == {k: len(v) - 1.0 for k, v in series.items()}
    got = {(r.series_id, r.pos): (r.technique, r.value) for r in changed.collect()}
    assert got == {(k, i): (None if k == "one" else "T", len(seen[k]) if x is None else x) for k, v in series.items() for i, x in enumerate(v)}
