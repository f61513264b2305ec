"""Boosted trees per series, linear step weights, replicates and early stopping against plain single-series code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendcast.operators import boosting as bo, clean as cl, forecast as fc


def paths(df):
    out = {}
    for r in df.orderBy("series_id", "step").collect():
        out.setdefault(r.series_id, []).append(r.predicted)
    return out


def brute_boost(values, lag, trees, depth, lr, bins, reg, first_val=None, patience=10):
    """One series, one row and one node at a time; returns a function from lags (nearest first) to a prediction, and the losses."""
    known = [v for i, v in enumerate(values) if v is not None and (first_val is None or i < first_val)]
    known.sort()
    at = sorted({known[i * (len(known) - 1) // (bins - 1)] for i in range(bins)})
    cuts = [(a + b) / 2 for a, b in zip(at, at[1:])]
    rows = [(values[i - lag: i][::-1], values[i], first_val is not None and i >= first_val) for i in range(lag, len(values)) if None not in values[i - lag: i + 1]]
    train = [(x, y) for x, y, v in rows if not v]
    held = [(x, y) for x, y, v in rows if v]
    base = sum(y for _, y in train) / len(train)
    grown = []

    def tree_value(tree, x):
        while isinstance(tree, tuple):
            tree = tree[3] if x[tree[0]] > tree[1] else tree[2]
        return tree

    def score(x, n=None):
        return base + lr * sum(tree_value(t, x) for t in (grown if n is None else grown[:n]))

    error = sum((y - base) ** 2 for _, y in train)

    def leaf(r):
        return sum(v for _, v in r) / (len(r) + reg)

    def grow(r, d):
        if d == 0:
            return leaf(r)
        options = []
        for f in range(lag):
            for c in cuts:
                a, b = [p for p in r if p[0][f] <= c], [p for p in r if p[0][f] > c]
                if a and b:
                    options.append((sum(v for _, v in a) ** 2 / (len(a) + reg) + sum(v for _, v in b) ** 2 / (len(b) + reg), f, c, a, b))
        share = sum(v for _, v in r) ** 2 / (len(r) + reg)
        top = max((o[0] for o in options), default=-1.0)
        if not options or top - share <= 1e-20 * error + 1e-13 * share:
            return leaf(r)
        _, f, c, a, b = next(o for o in options if o[0] >= top - 1e-9 * abs(top))
        return f, c, grow(a, d - 1), grow(b, d - 1)

    losses = [sum((y - score(x)) ** 2 for x, y in held) / max(len(held), 1)]
    for _ in range(trees):
        tree = grow([(x, y - score(x)) for x, y in train], depth)
        if not isinstance(tree, tuple):
            break
        grown.append(tree)
        losses.append(sum((y - score(x)) ** 2 for x, y in held) / max(len(held), 1))
        if held and len(losses) - 1 - int(np.argmin(losses)) >= patience:
            break
    keep = int(np.argmin(losses)) if held else len(grown)
    return (lambda x: score(x, keep)), keep, losses[keep]


def brute_path(values, predict, lag, h):
    hist = [v for v in values if v is not None][-lag:]
    out = []
    for _ in range(h):
        out.append(predict(hist[-lag:][::-1]))
        hist.append(out[-1])
    return out


@pytest.fixture(scope="module")
def noisy():
    r = random.Random(3)
    data = {
        "wave": [round(10 * math.sin(i / 3), 1) + r.choice((0.0, 0.5)) for i in range(70)],
        "holes": [None if i in (11, 30, 31) else float((i * i) % 17) for i in range(60)],
        "pattern": [5.0, 1.0, 9.0, 2.0, 2.0, 7.0] * 9,
        "flat": [4.0] * 30,
        "short": [1.0, 2.0],
        "none": [None, None, None, None, None, None, None],
    }
    return data


PARAMS = dict(lag=4, trees=6, depth=3, lr=0.3, bins=16, reg=1.0)


@pytest.mark.parametrize("block", [1 << 16, 24])
def test_series_models_equal_one_series_code(make, noisy, block):
    points = make(noisy)
    model = bo.per_series_boosting(points, **PARAMS, block=block)
    assert model.count() == len(noisy)
    got = paths(fc.forecast_recursive(model, points, 5, PARAMS["lag"], block=16))
    for name, values in noisy.items():
        if name in ("short", "none"):
            assert got[name] == [2.0 if name == "short" else 0.0] * 5
        else:
            predict, keep, _ = brute_boost(values, **PARAMS)
            assert got[name] == pytest.approx(brute_path(values, predict, 4, 5), rel=1e-9), name
            assert {r.epochs_trained for r in model.where(F.col("series_id") == name).collect()} == {keep}


@pytest.mark.parametrize("block", [1 << 16, 32])
def test_validation_keeps_the_best_trees(make, noisy, block):
    split = cl.train_val_split(make({k: noisy[k] for k in ("wave", "pattern")}), 0.25)
    model = bo.per_series_boosting(split, **PARAMS, patience=3, block=block)
    rows = {r.series_id: r for r in model.collect()}
    for name in ("wave", "pattern"):
        values = noisy[name]
        _, keep, loss = brute_boost(values, **PARAMS, first_val=int(len(values) * 0.75), patience=3)
        assert rows[name].epochs_trained == keep and rows[name].best_val_loss == pytest.approx(loss, rel=1e-9)


def test_patterns_continue_exactly_per_series(make):
    r = random.Random(1)
    data = {str(k): [float(r.randint(0, 99)) for _ in range(2 + k)] * 12 for k in range(5)}
    got = paths(fc.forecast_recursive(bo.per_series_boosting(make(data), lr=0.3), make(data), 9))
    for k, values in data.items():
        assert got[k] == pytest.approx([values[i % (2 + int(k))] for i in range(9)], abs=1e-6)


def test_linear_step_weights_are_the_recursion():
    coefficients, intercept = [0.5, -0.2, 0.1], 2.0
    weights, constants = fc.linear_step_weights(coefficients, intercept, 11)
    hist = [1.0, -3.0, 4.0]
    want = list(hist)
    for _ in range(11):
        want.append(intercept + sum(c * v for c, v in zip(coefficients, want[::-1])))
    assert (weights @ np.array(hist) + constants).tolist() == pytest.approx(want[3:])


def test_tree_forecasts_equal_the_model(make, spark):
    data = {"a": [float(i % 5) for i in range(50)], "b": [float((3 * i) % 7) for i in range(50)], "s": [1.0]}
    points = make(data)
    features = fc.lag_features(points, 3, block=16)
    model = fc.train_global_lag_model(features, trees=5, depth=3)
    h = spark.createDataFrame([("a", 3), ("b", 7), ("s", 2)], "series_id string, h int")
    got = paths(fc.forecast_recursive(model, points, h, 3, block=16))
    assert {k: len(v) for k, v in got.items()} == {"a": 3, "b": 7, "s": 2} and got["s"] == [1.0, 1.0]
    for name in "ab":
        hist = data[name][-3:]
        for value in got[name]:
            row = spark.createDataFrame([(*hist[::-1],)], "lag_1 double, lag_2 double, lag_3 double")
            assert value == pytest.approx(model.transform(row).first().prediction)
            hist = [*hist[1:], value]


def test_replicates_and_early_stopping(make):
    r = random.Random(5)
    data = {"a": [r.gauss(0, 1) for _ in range(120)], "b": [r.gauss(3, 1) for _ in range(120)]}
    split = cl.train_val_split(make(data), 0.3)
    features = fc.lag_features(split, 3, block=64)
    assert {x.part for x in features.select("part").distinct().collect()} == {"train", "val"}
    models, metrics = fc.fit_replicates(features, ["boosting", "linear"], 2, 10, trees=30, depth=4, subsample=0.8)
    assert sorted(models) == [("boosting", 1), ("boosting", 2), ("linear", 1)]
    rows = {(m.model, m.iteration): m for m in metrics.collect()}
    assert rows["boosting", 1].seed == 11 and rows["boosting", 2].seed == 12
    assert rows["boosting", 1].epochs_trained < 30  # noise: more trees do not help
    assert rows["linear", 1].best_val_loss > 0 and rows["linear", 1].epochs_trained is None
    assert rows["boosting", 1].final_train_loss < rows["linear", 1].final_train_loss


def test_histograms_are_as_wide_as_the_bins_in_use(monkeypatch):
    widths, real = [], bo.best_splits
    monkeypatch.setattr(bo, "best_splits", lambda g, h, *rest: widths.append(h.shape[2]) or real(g, h, *rest))
    r = random.Random(4)
    y = np.array([r.choice([1.0, 5.0, 2.0]) for _ in range(80)])
    binned = np.array([[r.randrange(3) for _ in range(4)] for _ in range(80)], np.uint8)
    bo.boost(np.arange(80) % 2, binned, y, np.zeros(80, bool), 2, bo.Params(lag=4, trees=3, depth=3))
    assert widths and set(widths) == {3}


def test_paths_of_many_models_are_followed_together(monkeypatch):
    """Trees of different numbers and shapes, one without any, a short history, other horizons: equal to one model at a time."""
    import pyarrow as pa

    r, rows = np.random.default_rng(5), []
    for i in range(7):
        v = r.uniform(0, 9, 40 + i).round(2)
        y, x, place = bo.lag_rows(v, 0, 3)
        cuts = bo.cut_points(np.sort(v), 8)
        p = bo.Params(lag=3, trees=i, depth=2 + i % 2, bins=8) if i else bo.Params(lag=3, trees=1, depth=1, bins=8, reg=1e12)
        base, trees, n, val, train = bo.boost(np.zeros(len(y), int), np.searchsorted(cuts, x).astype(np.uint8), y, place >= 99, 1, p)
        row = bo.model_row(base[0], cuts, trees, 0, n[0], val[0], train[0], p)
        rows.append({**row, "_id": i, "hist": v[-3:] if i != 5 else v[:1], "h": 4 + i, "lag": 3, "depth": p.depth, "lr": p.lr})
    kinds = {**bo.model_types(), "_id": pa.int32(), "hist": pa.list_(pa.float64()), "h": pa.int32(), "lag": pa.int32(), "depth": pa.int32(), "lr": pa.float64()}
    batch = pa.RecordBatch.from_arrays([pa.array([row[c] for row in rows], t) for c, t in kinds.items()], list(kinds))
    want = [bo.Forest(row).path(row["hist"], row["h"]) if len(row["hist"]) == 3 else None for row in rows]

    class States:
        dtypes = [("_id", "int")]

        def mapInArrow(self, run, schema):  # noqa: N802
            return next(run([batch])).column("path").to_pylist()

    monkeypatch.setattr(bo, "Forest", None)
    for room in (bo.TOGETHER_NODES, 64):
        monkeypatch.setattr(bo, "TOGETHER_NODES", room)
        got = bo.forest_paths(States())
        assert [w is None for w in want] == [g is None for g in got]
        assert all(g == pytest.approx(w) for g, w in zip(got, want) if w is not None)
