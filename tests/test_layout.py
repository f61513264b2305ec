import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendcast import layout as ly
from mendcast.functions.percentiles import exact_mode, exact_percentiles

N = None


def series(seed, n, gap=0.5):
    r = random.Random(seed)
    return [None if r.random() < gap else round(r.uniform(-5, 5), 2) for _ in range(n)]


def test_positions_with_a_hot_key_and_equal_times(spark):
    rows = [("hot", 1, i) for i in range(700)] + [("b", i % 3, i) for i in range(200)] + [("c", 5, 0)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint").repartition(7)
    got = {(r.k, r.id): r.pos for r in ly.assign_positions(df, ["k"], ["t", "id"]).collect()}
    for key in ("hot", "b", "c"):
        order = sorted((t, i) for k, t, i in rows if k == key)
        assert [got[(key, i)] for _, i in order] == list(range(len(order)))


@pytest.mark.parametrize("k", [1, 3])
def test_knots_across_blocks(make, k):
    data = {"a": series(1, 60, 0.7), "b": series(2, 23, 0.3), "none": [N] * 9, "one": [N] * 8 + [1.0] + [N] * 8}
    got = ly.with_knots(make(data), k, block=4).collect()
    assert len(got) == sum(map(len, data.values()))
    for r in got:
        seen = [i for i, v in enumerate(data[r.series_id]) if v is not None]
        assert [e.pos for e in r.left] == [i for i in seen if i <= r.pos][-k:]
        assert [e.pos for e in r.right] == [i for i in seen if i >= r.pos][:k]
        assert all(e.value == data[r.series_id][e.pos] for e in [*r.left, *r.right])


def test_observed_rank_and_halo(make):
    data = {"a": series(3, 50), "b": series(4, 11)}
    for r in ly.with_observed_rank(make(data), block=4).collect():
        seen = [i for i, v in enumerate(data[r.series_id]) if v is not None]
        assert seen[r.rank] == r.pos and r.n_obs == len(seen)
    halo = ly.with_halo(make({"a": [float(i) for i in range(10)]}), 2, 1, block=4)
    blocks = {}
    for r in halo.collect():
        blocks.setdefault(r.block, []).append((r.pos, r.halo))
    assert sorted(p for p, h in blocks[1]) == [2, 3, 4, 5, 6, 7, 8]
    assert sorted(p for p, h in blocks[1] if not h) == [4, 5, 6, 7]


def test_facts_reach_every_row(make, monkeypatch):
    points = make({"hot": [1.0] * 400, "b": [2.0] * 9})
    facts = points.groupBy("series_id").agg(F.count("*").alias("_n"), F.max("pos").alias("_last"))
    assert ly.attach_by_block(points, facts, block=16).groupBy("series_id", "_n").count().collect() != []
    by_block = {r[0]: (r[1], r[2]) for r in ly.attach_by_block(points, facts, block=16).groupBy("series_id", "_n").count().collect()}
    assert by_block == {"hot": (400, 400), "b": (9, 9)}
    monkeypatch.setattr(ly, "ROWS_PER_SALT", 10)
    salted = ly.attach_salted(points, facts.drop("_last"), ["series_id"], "pos")
    assert {r[0]: (r[1], r[2]) for r in salted.groupBy("series_id", "_n").count().collect()} == by_block


@pytest.mark.parametrize("salt", [1 << 20, 20])
def test_percentiles_are_exact(spark, monkeypatch, salt):
    monkeypatch.setattr(ly, "ROWS_PER_SALT", salt)
    r = np.random.default_rng(7)
    groups = {
        "normal": r.normal(size=501), "heavy": np.exp(r.normal(scale=20, size=400)), "ties": np.r_[np.zeros(300), r.random(99)],
        "pair": np.array([1.0, 2.0]), "one": np.array([3.0]), "equal": np.full(50, 2.5), "huge": r.normal(size=3000).round(1),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("normal", None)], "k string, v double")
    probs = {"lo": 0.0, "q": 0.25, "m": 0.5, "t": 0.9, "hi": 1.0}
    for row in exact_percentiles(df, ["k"], "v", probs).collect():
        for name, p in probs.items():
            assert row[name] == pytest.approx(float(np.quantile(groups[row.k], p)), rel=1e-12, abs=1e-12), (row.k, name)
    everything = np.concatenate(list(groups.values()))
    assert exact_percentiles(df, [], "v", {"m": 0.5}).first()[0] == pytest.approx(float(np.median(everything)))


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("a", v) for v in (3.0, 3.0, 1.0, 1.0, 2.0)] + [("b", None), ("b", 4.0)], "k string, v double")
    assert dict(exact_mode(df, ["k"], "v").collect()) == {"a": 1.0, "b": 4.0}
    assert exact_mode(df, [], "v").first()[0] == 1.0


def test_stored_tables_use_the_named_folder(spark):
    folder = ly.scratch_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert folder == (named.rstrip("/") if named else spark.sparkContext.getCheckpointDir())
    stored = ly.materialise(spark.range(3))
    assert stored.count() == 3 and all(f"{folder}/mendcast/" in f for f in stored.inputFiles())
