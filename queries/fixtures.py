"""Series built from the given tables, in Spark and as SQL text, shared by the queries.

The Spark side stores each built table once per session and data folder in the shared folder, as a
user of the engine would; queries then read it like any other table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mendcast.layout import materialise
from mendcast.operators.grid import experiment_grid
from mendcast.operators.mask import degrade
from mendcast.sources.series_io import on_calendar, series_from_table

_STORED: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = materialise(build())
    return _STORED[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _nudge(dp: int) -> float:
    """Moves exact decimal ties (means of prices, midpoints) off the rounding edge, where the last bit would decide."""
    return 3.7e-3 * 10.0**-dp


def rounded(df: DataFrame, dp: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    return df.select(*[
        F.round(F.col(c) + F.lit(_nudge(dp)), dp).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def rsql(sql: str, cols: str, dp: int = 6) -> str:
    """The same in SQL; adding 0 turns a negative zero into zero."""
    replaced = ", ".join(
        f'round("{c}" + CAST({_nudge(dp)!r} AS DOUBLE), {dp}) + CAST(0 AS DOUBLE) AS "{c}"' for c in cols.split()
    )
    return f"SELECT * REPLACE ({replaced}) FROM ({sql})"


# ---- point tables ----------------------------------------------------------------------------------

def ev_user(spark, sf):
    """One series per user of the events table, irregular in time."""
    return stored(spark, sf, "ev_user", lambda: series_from_table(
        table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value"))


def ev_hour(spark, sf):
    """Hourly mean per event type on a full hour axis: natural gaps."""
    return stored(spark, sf, "ev_hour", lambda: on_calendar(series_from_table(
        table(spark, sf, "events"), ["event_type"], "ts", "value", agg="avg", bucket="hour"), "hour"))


def ord_day(spark, sf):
    """Daily mean order price per priority, days without orders absent."""
    return stored(spark, sf, "ord_day", lambda: series_from_table(
        table(spark, sf, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice", agg="avg", bucket="day"))


def li_day(spark, sf):
    """Daily revenue in thousands per return flag."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000
    return stored(spark, sf, "li_day", lambda: series_from_table(
        table(spark, sf, "lineitem"), ["l_returnflag"], "l_shipdate", revenue, agg="sum", bucket="day"))


EV = """ev AS (SELECT CAST(user_id AS VARCHAR) AS series_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  ts, CAST(epoch_us(ts) AS DOUBLE) AS x, value FROM events)"""

EVH = """evh_raw AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS h, avg(value) AS value
  FROM events GROUP BY ALL),
evh_span AS (SELECT series_id, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS ts FROM evh_raw GROUP BY series_id),
evh AS (SELECT s.series_id, row_number() OVER (PARTITION BY s.series_id ORDER BY s.ts) - 1 AS pos, s.ts,
  CAST(epoch_us(s.ts) AS DOUBLE) AS x, r.value
  FROM evh_span s LEFT JOIN evh_raw r ON r.series_id = s.series_id AND r.h = s.ts)"""

ORD = """ord_raw AS (SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts, avg(o_totalprice) AS value
  FROM orders GROUP BY ALL),
ord AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, CAST(ts AS TIMESTAMP) AS ts,
  CAST(epoch_us(CAST(ts AS TIMESTAMP)) AS DOUBLE) AS x, value FROM ord_raw)"""

LI = """li_raw AS (SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate) AS ts,
  sum(l_extendedprice * (1 - l_discount) / 1000) AS value FROM lineitem GROUP BY ALL),
li AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, CAST(ts AS TIMESTAMP) AS ts,
  CAST(epoch_us(CAST(ts AS TIMESTAMP)) AS DOUBLE) AS x, value FROM li_raw)"""


# ---- degraded tables -------------------------------------------------------------------------------

SEED = 42


def grid_for(points, techniques=("MCAR",), rates=(0.2,), iterations=1):
    return experiment_grid(points, techniques, rates, iterations, SEED)


def ev_deg(spark, sf):
    """User series with 20 % of the values missing at random, truth kept."""
    return stored(spark, sf, "ev_deg", lambda: degrade(ev_user(spark, sf), grid_for(ev_user(spark, sf)), keep_truth=True))


def ev_grid(spark, sf):
    """User series under three mechanisms and two rates."""
    return stored(spark, sf, "ev_grid", lambda: degrade(
        ev_user(spark, sf), grid_for(ev_user(spark, sf), ("MCAR", "MAR", "MNAR"), (0.1, 0.3)), keep_truth=True))


def masked_sql(source: str, name: str, techniques=("MCAR",), rates=(0.2,), iterations=(1,)) -> str:
    """CTEs that mask ``source``: ranks by (weight zero last, -ln(u)/w, position)."""
    cells = ", ".join(
        f"('{t}', {round(r * 100)}, CAST({r} AS DOUBLE), {i})" for t in techniques for r in rates for i in iterations
    )
    return f"""{name}_cells(technique, rate_percent, rate, iteration) AS (VALUES {cells}),
{name}_stat AS (SELECT series_id, median(value) AS med, count(*) AS n FROM {source} GROUP BY series_id),
{name}_w AS (SELECT s.*, c.*, t.n,
  -ln(CAST(('0x' || substr(md5(concat_ws(':', s.series_id, s.pos, c.technique, c.rate_percent, c.iteration, {SEED})), 1, 13)) AS UBIGINT)
      / CAST(4503599627370496 AS DOUBLE) + CAST(0.5 AS DOUBLE) / CAST(4503599627370496 AS DOUBLE)) AS e,
  CASE c.technique WHEN 'MAR' THEN coalesce(abs(s.value - t.med), CAST(0 AS DOUBLE))
    WHEN 'MNAR' THEN CASE WHEN t.n > 1 THEN CAST(0.1 AS DOUBLE) + CAST(0.9 AS DOUBLE) * s.pos / (t.n - 1) ELSE CAST(0.1 AS DOUBLE) END
    ELSE CAST(1 AS DOUBLE) END AS w
  FROM {source} s JOIN {name}_stat t ON t.series_id = s.series_id, {name}_cells c),
{name}_rank AS (SELECT *, row_number() OVER (PARTITION BY series_id, technique, rate_percent, iteration
  ORDER BY CASE WHEN w > 0 THEN 0 ELSE 1 END, e / CASE WHEN w > 0 THEN w ELSE 1 END, pos) AS rn FROM {name}_w),
{name} AS (SELECT series_id, technique, rate_percent, iteration, pos, ts, x,
  CASE WHEN rn <= floor(n * rate) THEN NULL ELSE value END AS value, value AS truth FROM {name}_rank)"""


DEG = f"{EV}, {masked_sql('ev', 'deg')}"
DEG_GRID = f"{EV}, {masked_sql('ev', 'deg', ('MCAR', 'MAR', 'MNAR'), (0.1, 0.3))}"
DEG_KEYS = "series_id, technique, rate_percent, iteration"


# ---- result tables ---------------------------------------------------------------------------------
# Result and resource rows derived from line items and parts: a stand-in with known distribution that
# grows with the data, so the comparison queries do not depend on a repair run before them.

def cost_rows(spark, sf):
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    joined = li.join(part.select("p_partkey", "p_brand", "p_size"), li.l_partkey == part.p_partkey)
    gpu = F.col("p_size") % 2 == 0
    return joined.select(
        F.col("l_linestatus").alias("dataset_name"), F.col("l_returnflag").alias("technique"),
        (F.col("l_linenumber") * 10).cast("int").alias("rate_percent"), F.col("l_linenumber").cast("int").alias("iteration"),
        F.col("p_brand").alias("model"), F.col("l_quantity").alias("time_seconds"), (F.col("l_tax") * 100).alias("cpu_cores_used"),
        F.when(F.col("l_linenumber") == 1, 4).otherwise(8).cast("int").alias("cpu_cores_total"),
        F.col("l_extendedprice").alias("memory_mb"), F.lit(64000.0).alias("memory_total_mb"),
        F.when(gpu, F.col("l_discount") * 100).alias("gpu_percent"),
        F.when(gpu, F.col("l_quantity") * 100).alias("gpu_memory_mb"), F.when(gpu, F.lit(8000.0)).alias("gpu_memory_total_mb"),
        F.col("l_discount").alias("quality"), F.col("l_discount").alias("mae"), F.col("l_tax").alias("rmse"),
        F.when(F.col("l_linenumber") < 7, 1 - F.col("l_discount")).alias("r2"),
    )


COST = """cost AS (SELECT l_linestatus AS dataset_name, l_returnflag AS technique, l_linenumber * 10 AS rate_percent,
  l_linenumber AS iteration, p_brand AS model, l_quantity AS time_seconds, l_tax * 100 AS cpu_cores_used,
  CASE WHEN l_linenumber = 1 THEN 4 ELSE 8 END AS cpu_cores_total, l_extendedprice AS memory_mb,
  CAST(64000 AS DOUBLE) AS memory_total_mb,
  CASE WHEN p_size % 2 = 0 THEN l_discount * 100 END AS gpu_percent,
  CASE WHEN p_size % 2 = 0 THEN l_quantity * 100 END AS gpu_memory_mb,
  CASE WHEN p_size % 2 = 0 THEN CAST(8000 AS DOUBLE) END AS gpu_memory_total_mb,
  l_discount AS quality, l_discount AS mae, l_tax AS rmse, CASE WHEN l_linenumber < 7 THEN 1 - l_discount END AS r2
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def pred_results(spark, sf):
    """Forecast results: line number 7 stands for original sources, whose repair key is missing."""
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    joined = li.join(part.select("p_partkey", "p_brand", "p_size"), li.l_partkey == part.p_partkey)
    fixed = F.col("l_linenumber") < 7
    return joined.select(
        F.col("l_linestatus").alias("dataset_name"),
        F.when(fixed, F.lit("reconstructed")).otherwise(F.lit("original")).alias("source_type"),
        F.when(fixed, F.col("l_returnflag")).alias("technique"),
        F.when(fixed, F.col("l_linenumber") * 10).cast("int").alias("rate_percent"),
        F.when(fixed, F.col("l_linenumber")).cast("int").alias("reconstruction_iteration"),
        F.when(fixed, F.col("p_brand")).alias("reconstruction_model"),
        F.concat(F.lit("fc_"), (F.col("p_size") % 5).cast("string")).alias("prediction_model"),
        (F.col("l_linenumber") % 3 + 1).cast("int").alias("prediction_iteration"),
        F.when(F.col("l_quantity") > 2, F.col("l_tax") * 100).alias("mape"), F.col("l_discount").alias("mae"),
        F.col("l_orderkey").alias("n_samples"), F.col("l_quantity").alias("time_seconds"),
        (F.col("l_tax") * 100).alias("cpu_cores_used"), F.col("l_extendedprice").alias("memory_mb"),
        F.when(F.col("p_size") % 2 == 0, F.col("l_discount") * 100).alias("gpu_percent"),
    )


PRED = """pred AS (SELECT l_linestatus AS dataset_name,
  CASE WHEN l_linenumber < 7 THEN 'reconstructed' ELSE 'original' END AS source_type,
  CASE WHEN l_linenumber < 7 THEN l_returnflag END AS technique,
  CASE WHEN l_linenumber < 7 THEN l_linenumber * 10 END AS rate_percent,
  CASE WHEN l_linenumber < 7 THEN l_linenumber END AS reconstruction_iteration,
  CASE WHEN l_linenumber < 7 THEN p_brand END AS reconstruction_model,
  'fc_' || CAST(p_size % 5 AS VARCHAR) AS prediction_model, l_linenumber % 3 + 1 AS prediction_iteration,
  CASE WHEN l_quantity > 2 THEN l_tax * 100 END AS mape, l_discount AS mae, l_orderkey AS n_samples,
  l_quantity AS time_seconds, l_tax * 100 AS cpu_cores_used, l_extendedprice AS memory_mb,
  CASE WHEN p_size % 2 = 0 THEN l_discount * 100 END AS gpu_percent
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def training_rows(spark, sf):
    """Training metrics per supplier order: model by part size class."""
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    joined = li.join(part.select("p_partkey", "p_size"), li.l_partkey == part.p_partkey)
    return joined.select(
        F.concat(F.lit("fc_"), (F.col("p_size") % 7).cast("string")).alias("model"), F.col("l_quantity").alias("time_seconds"),
        F.when(F.col("l_tax") > 0, F.col("l_tax") * 100).alias("cpu_cores_used"), F.col("l_extendedprice").alias("memory_mb"),
        F.when(F.col("p_size") % 3 == 0, F.col("l_discount") * 100).alias("gpu_percent"),
    )


TRAINING = """training AS (SELECT 'fc_' || CAST(p_size % 7 AS VARCHAR) AS model, l_quantity AS time_seconds,
  CASE WHEN l_tax > 0 THEN l_tax * 100 END AS cpu_cores_used, l_extendedprice AS memory_mb,
  CASE WHEN p_size % 3 = 0 THEN l_discount * 100 END AS gpu_percent
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
