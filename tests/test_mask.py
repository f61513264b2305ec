import hashlib
import math

import pytest
from pyspark.sql import functions as F

from mendcast.functions.draws import uniform_draw
from mendcast.operators import grid as gr, mask

TWO52 = 2.0**52


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / TWO52


def expected(values, sid, technique, rate, seed):
    """Whole-series ranking by (weight zero last, -ln(u)/w, position)."""
    seen = sorted(v for v in values if v is not None)
    med = (seen[(len(seen) - 1) // 2] + seen[len(seen) // 2]) / 2 if seen else 0
    n = len(values)

    def weight(i, v):
        if technique == "MAR":
            return 0.0 if v is None else abs(v - med)
        if technique == "MNAR":
            return 0.1 + 0.9 * i / (n - 1) if n > 1 else 0.1
        return 1.0

    keys = []
    for i, v in enumerate(values):
        w = weight(i, v)
        e = -math.log(draw(sid, i, technique, round(rate * 100), 1, seed) + 0.5 / TWO52)
        keys.append((w <= 0, e / w if w > 0 else e, i))
    return {i for *_, i in sorted(keys)[: math.floor(n * rate)]}


def test_draw_fixture(spark):
    u = spark.range(1).select(uniform_draw(F.lit("a"), F.lit(1), F.lit(42))).first()[0]
    assert u == pytest.approx(0.3907325808887554, abs=1e-15)


def test_masks_equal_the_ranking_of_whole_series(make):
    data = {
        "hot": [((i * 37) % 101) / 7 for i in range(400)], "short": [1.0, 2.0, 9.0], "flat": [5.0] * 40,
        "gaps": [None if i % 3 == 0 else float(i) for i in range(30)], "one": [1.0],
    }
    points = make(data).repartition(5)
    grid = gr.experiment_grid(points, mask.TECHNIQUES, [0.0, 0.3, 1.0], 1, 42)
    got = {}
    for r in mask.degrade(points, grid, block=1).collect():  # buckets of a few rows
        got.setdefault((r.series_id, r.technique, r.rate_percent), {})[r.pos] = r.value
    assert len(got) == len(data) * 9
    for (sid, technique, percent), cell in got.items():
        hit = expected(data[sid], sid, technique, percent / 100, 42)
        assert cell == {i: None if i in hit else v for i, v in enumerate(data[sid])}, (sid, technique, percent)


def test_outlier_is_drawn_before_weightless_rows(make, values):
    got = values(mask.mask_mar(make({"s": [1.0, 1.0, 1.0, 1.0, 5.0]}), 0.4, 1))["s"]
    assert got[4] is None and got.count(None) == 2


def test_grid(spark, make):
    points = make({"a": [1.0] * 10, "b": [2.0] * 7})
    grid = gr.experiment_grid(points, ["MCAR", "MNAR"], [0.29, 0.57], 2, 42)
    assert grid.count() == 16
    assert {r[0] for r in grid.select("rate_percent").distinct().collect()} == {29, 57}
    with pytest.raises(ValueError):
        gr.experiment_grid(points, ["MCAR"], [1.2], 1, 42)
    out = mask.degrade(points, grid, keep_truth=True)
    report = mask.missing_report(out).collect()
    assert all(r.n_missing == math.floor(r.n_total * r.rate_percent / 100) for r in report) and len(report) == 16
    assert out.where("value IS NOT NULL AND value <> truth").count() == 0
    todo = gr.pending_tasks(grid, out.where("iteration = 1"), ["series_id", "technique", "rate_percent", "iteration"])
    assert {r[0] for r in todo.select("iteration").collect()} == {2}
    assert gr.model_fanout(grid, ["x", "y"]).count() == 32
    reps = gr.seed_replicates([("det", True), ("net", False)], 3, 42, spark).collect()
    assert sorted((r.model, r.seed) for r in reps) == [("det", 43), ("net", 43), ("net", 44), ("net", 45)]
