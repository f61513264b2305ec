import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from mendcast.functions.ttest import two_sided_p
from mendcast.operators import compare as cp, cost as co


def test_p_values(spark):
    known = [(2.100922, 18, 0.05), (12.7062047, 1, 0.05), (2.5758293, 10**9, 0.01), (1.9599640, 10**6, 0.05), (0.0, 5, 1.0),
             (4.302653, 2, 0.05), (2.776445, 4, 0.05), (3.182446, 3, 0.05), (6.0, 10**8, 1.973175e-9)]
    df = spark.createDataFrame([(t, n) for t, n, _ in known], "t double, n bigint")
    for (t, n, want), row in zip(known, df.select(two_sided_p(F.col("t"), F.col("n"))).collect()):
        assert row[0] == pytest.approx(want, rel=1e-4), (t, n)


def cosine_series(t, df):
    """The finite series for whole degrees of freedom: df / 2 terms."""
    theta = math.atan(abs(t) / math.sqrt(df))
    s, c, odd = math.sin(theta), math.cos(theta), df % 2 == 1
    if df == 1:
        return 1 - 2 * theta / math.pi
    total, term = 0.0, c if odd else 1.0
    for k in range((df - 3 if odd else df - 2) // 2 + 1):
        if k:
            term *= (2 * k / (2 * k + 1) if odd else (2 * k - 1) / (2 * k)) * c * c
        total += term
    return 1 - (2 / math.pi * (theta + s * total) if odd else s * total)


def test_p_equals_the_finite_series(spark):
    cells = [(t, n) for t in (1e-7, 0.01, 0.3, 0.9, 1.0, 1.2, 1.7, 2.4, 3.0, 4.5, 9.0, 60.0) for n in (1, 2, 3, 4, 5, 7, 10, 31, 200, 1001, 20_000, 20_001, 50_000)]
    df = spark.createDataFrame(cells, "t double, n bigint")
    for (t, n), row in zip(cells, df.select(two_sided_p(F.col("t"), F.col("n"))).collect()):
        assert row[0] == pytest.approx(cosine_series(t, n), abs=1e-12), (t, n)


def test_significance(spark):
    r = random.Random(1)
    rows = [("good", r.gauss(1, 0.1)) for _ in range(12)] + [("bad", r.gauss(2, 0.1)) for _ in range(12)] + [
        ("flat", 3.0), ("flat", 3.0), ("flat2", 3.0), ("flat2", 3.0), ("flat3", 4.0), ("flat3", 4.0), ("single", 1.0)]
    tests = cp.pairwise_ttest(spark.createDataFrame(rows, "model string, v double"), "v")
    got = {(x.model_a, x.model_b): x for x in cp.significance_codes(tests, True).collect()}
    models = {m for m, _ in rows}
    assert set(got) == {p for p in itertools.permutations(models, 2)}
    assert got[("good", "bad")].code == 2 and got[("bad", "good")].code == -2
    assert got[("single", "bad")].p == 1.0 and got[("single", "bad")].code == 0
    assert got[("flat", "flat2")].p is None and got[("flat", "flat2")].code == 0
    assert got[("flat", "flat3")].p == 0.0 and got[("flat", "flat3")].code == 2
    a = [v for m, v in rows if m == "good"]
    b = [v for m, v in rows if m == "bad"]
    var = lambda x: sum((v - sum(x) / len(x)) ** 2 for v in x) / (len(x) - 1)
    t = (sum(a) / 12 - sum(b) / 12) / math.sqrt((11 * var(a) + 11 * var(b)) / 22 * (2 / 12))
    assert got[("good", "bad")].t == pytest.approx(t)
    codes = cp.significance_codes(tests, True)
    for s in cp.significance_summary(codes).collect():
        assert s.better_p001 + s.better_p005 + s.no_difference + s.worse_p005 + s.worse_p001 == len(models) - 1
    wide = {x.model_a: x for x in cp.significance_matrix(codes).collect()}
    assert wide["good"]["bad"] == 2 and wide["good"]["good"] == 0


@pytest.mark.parametrize("lower", [True, False])
def test_pareto_is_plain_non_dominance(spark, lower):
    r = random.Random(3)
    rows = [(i, float(r.randint(0, 20)), float(r.randint(0, 20))) for i in range(300)]
    s = 1 if lower else -1
    want = {
        i for i, q, c in rows
        if not any(s * q2 <= s * q and c2 <= c and (s * q2 < s * q or c2 < c) for _, q2, c2 in rows)
    }
    got = co.pareto_front(spark.createDataFrame(rows, "id int, q double, c double"), "q", "c", lower)
    assert {x.id for x in got.collect()} == want


def test_leaderboards(spark):
    rows = [("reconstructed", m, d, f, v) for m, d, f, v in (
        ("a", "x", "f1", 1.0), ("a", "y", "f1", 3.0), ("b", "x", "f2", 0.0), ("b", "x", "f1", 0.0), ("c", "x", "f1", None))]
    rows.append(("original", None, "x", "f1", 9.0))
    df = spark.createDataFrame(rows, "source_type string, reconstruction_model string, dataset_name string, prediction_model string, mape double")
    board = cp.extended_leaderboard(df, "mape", True).collect()
    assert [(b["rank"], b.reconstruction_model) for b in board] == [(1, "b"), (2, "a"), (3, "c")]
    assert board[0].cv_percent is None and board[1].delta_best == 2.0 and board[1].n_datasets == 2
    best = cp.overview_best_model(df, "mape", True).first()
    assert best.best_model == "b" and best.n_models == 3 and best["mean"] == 1.0
    k = cp.best_worst_topk(df, "mape", True, 1, "reconstruction_model").collect()
    assert {(x.side, x.reconstruction_model) for x in k} == {("best", "b"), ("worst", "a")}
    one = spark.createDataFrame([("f", 1, 2.0)], "prediction_model string, prediction_iteration int, mape double")
    assert cp.iteration_series(one, "mape").count() == 0
    flags = spark.createDataFrame([("r", "a", 1.0), ("r", "b", 2.0), ("r", "c", None), ("s", "a", 5.0), ("s", "b", 5.0)], "row string, c string, value double")
    f = {(x.row, x.c): (x.best, x.worst) for x in cp.row_best_worst_flags(flags, True).collect()}
    assert f == {("r", "a"): (True, False), ("r", "b"): (False, True), ("r", "c"): (False, False), ("s", "a"): (True, False), ("s", "b"): (True, False)}


def test_efficiency_without_gpu_and_cores(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, None, 10.0), ("b", 3.0, 4.0, None, 30.0), ("c", 9.0, None, None, 5.0)],
                               "model string, time_seconds double, cpu_cores_used double, cpu_cores_total int, memory_mb double")
    got = {r.model: r.efficiency_score for r in co.efficiency_score_rows(df).collect()}
    assert got == pytest.approx({"a": 2.0, "b": 6.0})
    use = co.combined_usage(df, df.withColumnRenamed("model", "prediction_model"))
    assert use.count() == 4 and use.where("combined_score < 0.1").count() == 0
