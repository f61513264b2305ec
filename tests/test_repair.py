import random

import pytest

from mendcast.operators import repair as rp

N = None
FIX = [N, 1.0, N, N, 4.0, N]


def by_model(df):
    """{model: {series: values by position}} of one run."""
    out = {}
    for r in df.orderBy("pos").collect():
        out.setdefault(r.model, {}).setdefault(r.series_id, []).append(r.value)
    return out


def close(a, b):
    return all((x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9)) for x, y in zip(a, b))


def test_edges_of_each_method(make):
    """Who leaves leading and trailing gaps."""
    day = 86_400_000_000.0
    xs = [d * day for d in (1, 2, 3, 10, 12, 13)]
    got = {m: v["s"] for m, v in by_model(rp.reconstruct(make({"s": FIX}, xs), list(rp.METHODS))).items()}
    want = {
        "mean": [2.5, 1, 2.5, 2.5, 4, 2.5], "median": [2.5, 1, 2.5, 2.5, 4, 2.5], "mode": [1, 1, 1, 1, 4, 1],
        "knn": [2.5, 1, 2.5, 2.5, 4, 2.5],
        "ffill": [N, 1, 1, 1, 4, 4], "bfill": [1, 1, 4, 4, 4, N],
        "linear": [N, 1, 2, 3, 4, 4], "linear_both": [1, 1, 2, 3, 4, 4], "index": [N, 1, 1.3, 3.4, 4, 4],
        "nearest": [N, 1, 1, 4, 4, N],
        "pchip": [N, 1, 1.3, 3.4, 4, 4.3], "akima": [N, 1, 1.3, 3.4, 4, N],
        "quadratic": [N, 1, 1.3, 3.4, 4, N], "polynomial": [N, 1, 1.3, 3.4, 4, N], "cubic": [N, 1, 1.3, 3.4, 4, N],
        "krogh": [N, 1, 1.3, 3.4, 4, N],
        "knn_temporal": [2.5, 1, 2.5, 2.5, 4, 2.5],
        "ar1_smoother": FIX,  # under three observed
    }
    for m, w in want.items():
        assert close(got[m], w), (m, got[m])


def test_degenerate_series(make):
    data = {"empty": [N, N, N], "one": [N, 7.0, N], "none": [1.0, 2.0, 3.0]}
    out = by_model(rp.reconstruct(make(data), list(rp.METHODS)))
    for m, got in out.items():
        assert got["none"] == data["none"]
        assert got["one"][1] == 7.0
        assert got["empty"] == ([0.0] * 3 if m == "linear_both" else [N] * 3)
    assert out["pchip"]["one"] == [N, 7.0, 7.0] and out["nearest"]["one"] == [N, 7.0, N]


def test_straight_lines_are_reproduced(make):
    line = [2.0 + 3 * i for i in range(60)]
    r = random.Random(3)
    gaps = [N if 0 < i < 59 and r.random() < 0.5 else v for i, v in enumerate(line)]
    out = rp.reconstruct(make({"s": gaps}), ["linear", "index", "pchip", "akima", "quadratic", "cubic", "krogh", "spline"], block=8)
    for m, got in by_model(out).items():
        assert close(got["s"], line), m


def test_small_blocks_change_nothing(make):
    r = random.Random(5)
    data = {
        k: [N if r.random() < p else round(r.uniform(0, 9), 1) for _ in range(n)]
        for k, n, p in (("a", 90, 0.6), ("b", 31, 0.2), ("c", 64, 0.95))
    }
    points = make(data)
    whole, cut = (by_model(rp.reconstruct(points, list(rp.METHODS), block=b)) for b in (1 << 16, 8))
    for m in rp.METHODS:
        a, b = whole[m], cut[m]
        for k in data:
            assert close(a[k], b[k]), (m, k)
            assert all(v is None or v == w for v, w in zip(data[k], b[k])), m


def test_autoregressive_bridge_is_the_conditional_mean(make, values):
    import numpy as np

    r = random.Random(9)
    full = [0.0]
    for _ in range(79):
        full.append(0.7 * full[-1] + r.gauss(0, 1))
    gaps = [N if i in (10, 11, 12, 40, 79) else v for i, v in enumerate(full)]
    got = values(rp.impute_ar1_smoother(make({"s": gaps}), block=8))["s"]
    seen = np.array([v for v in gaps if v is not None])
    mu = seen.mean()
    pairs = np.array([(gaps[i - 1], gaps[i]) for i in range(1, 80) if gaps[i] is not None and gaps[i - 1] is not None])
    phi = np.polyfit(pairs[:, 0], pairs[:, 1], 1)[0]
    idx = [9, 13]
    cov = lambda a, b: np.array([[phi ** abs(i - j) for j in b] for i in a])
    want = mu + cov([10, 11, 12], idx) @ np.linalg.solve(cov(idx, idx), np.array([gaps[i] for i in idx]) - mu)
    assert close(got[10:13], list(want))
    assert got[79] == pytest.approx(mu + phi * (gaps[78] - mu))


def test_unknown_model(make):
    with pytest.raises(KeyError):
        rp.reconstruct(make({"s": FIX}), ["nope"])
