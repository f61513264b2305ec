"""Registered queries against DuckDB on the smallest tables.

Runs a cross-section; set MENDCAST_ALL_QUERIES=1 for all of them.
"""

import math
import os

import pytest

import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = """impute_median interpolate_pchip interpolate_krogh reconstruct_models mask_mar degrade pending_tasks scoring_pairs
score_reconstruction score_prediction clean_series external_ingest_violations forecast_holt_seasonal forecast_ari1 extended_leaderboard
significance_summary tradeoff_ranking pareto_front_rows encode_gaf sweep_best parse_prediction_name read_series_csv
best_repair_leaderboard full_run_scores""".split()

queries.load_all()
NAMES = list(queries.ORACLE) if os.environ.get("MENDCAST_ALL_QUERIES") else SAMPLE
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def norm(v):
    v = v.item() if hasattr(v, "item") else v
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, v)
    return (2, float(v) + 0.0) if isinstance(v, (int, float)) else (3, str(v))


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(rel.fetchall(), rel.columns)


def test_every_query_has_a_name_of_its_own_and_plans():
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert len(queries.ORACLE) >= 180
