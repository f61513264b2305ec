"""Cleaning, splitting, filtering and ingest queries."""

from pyspark.sql import functions as F

from mendcast.operators import clean as cl
from mendcast.sources import series_io as io
from queries import query
from queries.fixtures import (
    COST, EV, EVH, LI, ORD, PRED, cost_rows, ev_hour, ev_user, li_day, ord_day, pred_results, rounded, rsql, table,
)

# ---- series from tables ----------------------------------------------------------------------------


@query("series_from_events", f"WITH {EV} SELECT series_id, pos, x, value FROM ev")
def series_from_events(spark, sf):
    return io.series_from_table(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value").select(
        "series_id", "pos", "x", "value")


@query("series_from_orders", rsql(f"WITH {ORD} SELECT series_id, pos, x, value FROM ord", "value", 4))
def series_from_orders(spark, sf):
    return rounded(ord_day(spark, sf).select("series_id", "pos", "x", "value"), 4)


@query("series_from_lineitem", rsql(f"WITH {LI} SELECT series_id, pos, x, value FROM li", "value", 8))
def series_from_lineitem(spark, sf):
    return rounded(li_day(spark, sf).select("series_id", "pos", "x", "value"), 8)


@query("hourly_calendar", rsql(f"WITH {EVH} SELECT series_id, pos, x, value FROM evh", "value"))
def hourly_calendar(spark, sf):
    return rounded(ev_hour(spark, sf).select("series_id", "pos", "x", "value"))


@query("discover_series", "SELECT DISTINCT event_type AS series_id FROM events WHERE event_type IN ('click', 'view', 'absent')")
def discover_series(spark, sf):
    ids = table(spark, sf, "events").select(F.col("event_type").alias("series_id"))
    return io.discover_series(ids, ["click", "view", "absent"])


# ---- cleaning: raw text rows with broken values, blank cells, equal minutes and three kinds of index ---

RAW = """raw AS (SELECT event_type AS series_id, event_id AS input_ord,
  CASE event_type WHEN 'click' THEN CAST(event_id // 2 AS VARCHAR) WHEN 'error' THEN 'e' || CAST(event_id // 3 AS VARCHAR)
    ELSE strftime(ts, '%Y-%m-%d %H:%M:00') END AS raw_index,
  CASE WHEN event_id % 7 = 0 THEN 'bad' WHEN event_id % 11 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS raw_value FROM events),
kind AS (SELECT series_id, CASE WHEN bool_and(try_cast(raw_index AS DOUBLE) IS NOT NULL) THEN 'numeric'
  WHEN bool_and(try_cast(raw_index AS TIMESTAMP) IS NOT NULL) THEN 'datetime' ELSE 'string' END AS axis FROM raw GROUP BY series_id),
typed AS (SELECT raw.*, kind.axis, try_cast(raw_value AS DOUBLE) AS v,
  CASE kind.axis WHEN 'numeric' THEN try_cast(raw_index AS DOUBLE)
    WHEN 'datetime' THEN CAST(epoch_us(try_cast(raw_index AS TIMESTAMP)) AS DOUBLE) END AS x
  FROM raw JOIN kind USING (series_id)),
uniq AS (SELECT * FROM typed WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, raw_index ORDER BY input_ord) = 1),
cleaned AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY x, raw_index, input_ord) - 1 AS pos, x, v AS value FROM uniq)"""


def _raw(spark, sf):
    e = table(spark, sf, "events")
    index = (
        F.when(F.col("event_type") == "click", F.expr("event_id div 2").cast("string"))
        .when(F.col("event_type") == "error", F.concat(F.lit("e"), F.expr("event_id div 3").cast("string")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:00"))
    )
    value = F.when(F.col("event_id") % 7 == 0, "bad").when(F.col("event_id") % 11 == 0, "").otherwise(F.col("value").cast("string"))
    return e.select(F.col("event_type").alias("series_id"), F.col("event_id").alias("input_ord"), index.alias("raw_index"), value.alias("raw_value"))


@query("clean_index", f"WITH {RAW} SELECT series_id, input_ord, axis, x FROM typed")
def clean_index(spark, sf):
    return cl.clean_index(_raw(spark, sf)).select("series_id", "input_ord", "axis", "x")


@query("coerce_numeric", f"WITH {RAW} SELECT input_ord, v AS value FROM typed")
def coerce_numeric(spark, sf):
    return _raw(spark, sf).select("input_ord", cl.coerce_numeric("raw_value").alias("value"))


@query("drop_all_missing_rows", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS a, CASE WHEN event_id % 3 = 0 THEN user_id END AS b "
                                "FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def drop_all_missing_rows(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("b"))
    return cl.drop_all_missing_rows(df, ["a", "b"])


@query("dedupe_index_keep_first", "SELECT event_type, user_id, event_id, value FROM events "
                                  "QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1")
def dedupe_index_keep_first(spark, sf):
    df = table(spark, sf, "events").select("event_type", "user_id", "event_id", "value")
    return cl.dedupe_index_keep_first(df, ["event_type", "user_id"], "event_id")


@query("sort_index", "SELECT event_type AS series_id, value AS x, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS pos FROM events")
def sort_index(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.col("value").alias("x"), "event_id")
    return cl.sort_index(df, order=["x", "event_id"])


@query("clean_series", f"WITH {RAW} SELECT series_id, pos, coalesce(x, CAST(pos AS DOUBLE)) AS x, value FROM cleaned")
def clean_series(spark, sf):
    return cl.clean_series(_raw(spark, sf))[0].select("series_id", "pos", "x", "value")


@query("clean_report", f"""WITH {RAW} SELECT t.series_id, count(*) AS rows_before, count(*) FILTER (v IS NULL) AS rows_all_missing,
  count(*) FILTER (v IS NOT NULL) - (SELECT count(*) FROM uniq u WHERE u.series_id = t.series_id) AS duplicates,
  (SELECT count(*) FROM uniq u WHERE u.series_id = t.series_id) AS rows_after FROM typed t GROUP BY t.series_id""")
def clean_report(spark, sf):
    return cl.clean_series(_raw(spark, sf))[1]


# ---- splits ----------------------------------------------------------------------------------------

SPLIT = """sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ev),
cut AS (SELECT *, CASE WHEN n > 60 THEN n - 60 WHEN greatest(1, n // 5) < n THEN n - greatest(1, n // 5) END AS c FROM sized),
split AS (SELECT series_id, pos, value, CASE WHEN pos >= c THEN 'test' WHEN c IS NOT NULL THEN 'train' END AS part,
  CASE WHEN pos >= c THEN pos - c + 1 END AS step FROM cut)"""


@query("temporal_split", f"WITH {EV}, {SPLIT} SELECT * FROM split")
def temporal_split(spark, sf):
    return cl.temporal_split(ev_user(spark, sf), 60).select("series_id", "pos", "value", "part", "step")


@query("split_report", rsql(f"""WITH {EV}, {SPLIT} SELECT series_id, count(*) AS n_total, count(*) FILTER (part = 'train') AS n_train,
  count(*) FILTER (part = 'test') AS n_test, count(*) FILTER (part = 'test') / CAST(count(*) AS DOUBLE) AS test_share,
  CASE WHEN count(*) FILTER (part = 'test') = 0 THEN 'too short' WHEN count(*) FILTER (part = 'test') < 60 THEN 'shortened' ELSE 'ok' END AS status FROM split GROUP BY series_id""", "test_share"))
def split_report(spark, sf):
    return rounded(cl.split_report(cl.temporal_split(ev_user(spark, sf), 60), 60))


@query("split_totals", f"""WITH {EV}, {SPLIT}, s AS (SELECT series_id, count(*) FILTER (part = 'train') AS a, count(*) FILTER (part = 'test') AS b FROM split GROUP BY ALL)
SELECT CASE WHEN b = 0 THEN 'too short' WHEN b < 60 THEN 'shortened' ELSE 'ok' END AS status, count(*) AS n_series,
  sum(a)::BIGINT AS n_train, sum(b)::BIGINT AS n_test FROM s GROUP BY ALL""")
def split_totals(spark, sf):
    return cl.split_totals(cl.split_report(cl.temporal_split(ev_user(spark, sf), 60), 60))


@query("train_val_split", f"""WITH {EVH}, o AS (SELECT series_id, pos, value, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS r,
  count(*) OVER (PARTITION BY series_id) AS n FROM evh WHERE value IS NOT NULL)
SELECT series_id, pos, CASE WHEN n > 10 AND floor(n * (1 - CAST(0.2 AS DOUBLE))) > 5 AND r >= floor(n * (1 - CAST(0.2 AS DOUBLE))) THEN 'val' ELSE 'train' END AS part FROM o""")
def train_val_split(spark, sf):
    return cl.train_val_split(ev_hour(spark, sf)).select("series_id", "pos", "part")


# ---- filters ---------------------------------------------------------------------------------------


@query("filter_configs", f"""WITH {PRED} SELECT n_samples, dataset_name, source_type, technique, rate_percent, mape FROM pred
  WHERE dataset_name IN ('O') AND (source_type = 'original' OR technique IN ('A', 'N')) AND (source_type = 'original' OR rate_percent IN (10, 20))
  AND mape IS NOT NULL""")
def filter_configs(spark, sf):
    out = cl.filter_configs(pred_results(spark, sf), ["O"], ["A", "N"], [10, 20], metric="mape")
    return out.select("n_samples", "dataset_name", "source_type", "technique", "rate_percent", "mape")


@query("local_filter", f"WITH {COST} SELECT model, technique, rate_percent, rmse FROM cost WHERE technique = 'R' AND rate_percent = 30")
def local_filter(spark, sf):
    return cl.local_filter(cost_rows(spark, sf), technique="R", rate_percent=30, model=None).select("model", "technique", "rate_percent", "rmse")


@query("search_any_column", "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(CAST(p_partkey AS VARCHAR)), '12') "
                            "OR contains(lower(p_name), '12') OR contains(lower(p_brand), '12') OR contains(lower(p_type), '12')")
def search_any_column(spark, sf):
    return cl.search_any_column(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "12")


@query("min_length_filter", f"WITH {EV} SELECT series_id, pos FROM ev QUALIFY count(value) OVER (PARTITION BY series_id) > 65")
def min_length_filter(spark, sf):
    return cl.min_length_filter(ev_user(spark, sf), 65).select("series_id", "pos")


@query("validate_complete", f"WITH {EVH} SELECT series_id, count(*) FILTER (value IS NULL) AS n_missing, count(*) AS n_total FROM evh "
                            "GROUP BY series_id HAVING count(*) FILTER (value IS NULL) > 0")
def validate_complete(spark, sf):
    return cl.validate_complete(ev_hour(spark, sf))


# ---- series with their own gaps --------------------------------------------------------------------

_MANIFEST = "id string, series string, n_test int, train string, test string, train_clean string, technique string, rate_percent int, iteration int"


def _manifest(spark, sf):
    """Entries over the stored series: an hourly one with gaps, a price series, and broken entries."""
    rows = [
        ("prices urgent", "p:1-URGENT", 30, None, None, None, None, None, None),
        ("pair", None, None, "h:click", "p:2-HIGH", None, "EXT", 5, 2),
        ("with clean", "p:3-MEDIUM", 50, None, None, "c:3-MEDIUM", None, None, None),
        ("gaps in test", "h:view", 400, None, None, None, None, None, None),
        ("two_token", "p:1-URGENT", 30, None, None, None, "A_B", None, None),
        ("too long", "p:1-URGENT", 1000000, None, None, None, None, None, None),
        ("nothing", None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, _MANIFEST)


def _external(spark, sf):
    p = ord_day(spark, sf)
    tag = lambda df, t: df.withColumn("series_id", F.concat(F.lit(t), "series_id"))
    medium = p.where(F.col("series_id") == "3-MEDIUM")
    last = medium.agg(F.max("pos")).scalar()
    points = tag(p, "p:").unionByName(tag(ev_hour(spark, sf), "h:")).unionByName(tag(medium.where(F.col("pos") <= last - 50), "c:"))
    return io.external_ingest(points, _manifest(spark, sf))


EXTERNAL = f"""{ORD}, {EVH}, urgent AS (SELECT *, count(*) OVER () AS n FROM ord WHERE series_id = '1-URGENT'),
medium AS (SELECT *, count(*) OVER () AS n FROM ord WHERE series_id = '3-MEDIUM')"""


@query("external_ingest", rsql(f"""WITH {EXTERNAL}
SELECT 'prices_urgent' AS series_id, 'EXTERNAL' AS technique, 0 AS rate_percent, 1 AS iteration, false AS has_clean_train, pos, value FROM urgent WHERE pos < n - 30
UNION ALL SELECT 'pair', 'EXT', 5, 2, false, pos, value FROM evh WHERE series_id = 'click'
UNION ALL SELECT 'with_clean', 'EXTERNAL', 0, 1, true, pos, value FROM medium WHERE pos < n - 50""", "value", 4))
def external_ingest(spark, sf):
    return rounded(_external(spark, sf)[0].select(
        "series_id", "technique", "rate_percent", "iteration", "has_clean_train", "pos", "value"), 4)


@query("external_ingest_test", rsql(f"""WITH {EXTERNAL} SELECT 'prices_urgent' AS series_id, pos - (n - 30) + 1 AS step, value FROM urgent WHERE pos >= n - 30
UNION ALL SELECT 'pair', pos + 1, value FROM ord WHERE series_id = '2-HIGH'
UNION ALL SELECT 'with_clean', pos - (n - 50) + 1, value FROM medium WHERE pos >= n - 50""", "value", 4))
def external_ingest_test(spark, sf):
    return rounded(_external(spark, sf)[1].select("series_id", "step", "value"), 4)


@query("external_ingest_violations", f"""WITH {EXTERNAL}, v AS (SELECT count(*) FILTER (value IS NULL AND pos >= m - 400) AS miss FROM
  (SELECT *, count(*) OVER () AS m FROM evh WHERE series_id = 'view'))
SELECT 'gaps_in_test' AS id, 'test has missing values' AS rule FROM v WHERE miss > 0
UNION ALL SELECT 'two_token', 'technique must be one token'
UNION ALL SELECT 'too_long', 'series not longer than n_test'
UNION ALL SELECT 'nothing', 'series, or train and test, required'
UNION ALL SELECT 'nothing', 'test is empty'""")
def external_ingest_violations(spark, sf):
    return _external(spark, sf)[3]
