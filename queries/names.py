"""File-name keys and file reading, on names and files derived from the tables."""

from pyspark.sql import functions as F

from mendcast.layout import scratch_dir
from mendcast.sources import names as nm, series_io as io
from queries import query
from queries.fixtures import table

MODELS = ("linear", "knn_temporal", "ar1_smoother")
FORECASTERS = ("xgboost", "holt_winters", "winters", "last_value", "tcn")

# {type with _}_{technique}_{rate}p_{iteration}_{model}, some names broken on purpose
NAMES = """names AS (SELECT p_partkey AS id,
  replace(p_type, ' ', '_') || '_' || ['MCAR', 'MAR', 'MNAR'][1 + p_partkey % 3] AS head,
  CASE WHEN p_partkey % 13 = 0 THEN 'x' ELSE '' END || CAST(p_size AS VARCHAR) || 'p_' || CAST(1 + p_partkey % 4 AS VARCHAR) AS rate,
  ['linear', 'knn_temporal', 'ar1_smoother'][1 + p_size % 3] AS model,
  ['xgboost', 'holt_winters', 'winters', 'last_value', 'tcn', 'unknown_one'][1 + p_partkey % 6] AS fc, p_type FROM part)"""


def _names(spark, sf):
    p = table(spark, sf, "part")
    pick = lambda options, i: F.get(F.array(*[F.lit(o) for o in options]), i)
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"), F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("_"), pick(("MCAR", "MAR", "MNAR"), k % 3)).alias("head"),
        F.concat(F.when(k % 13 == 0, "x").otherwise(""), F.col("p_size").cast("string"), F.lit("p_"), (1 + k % 4).cast("string")).alias("rate"),
        pick(MODELS, F.col("p_size") % 3).alias("model"),
        pick((*FORECASTERS, "unknown_one"), k % 6).alias("fc"), "p_type",
    )


@query("normalize_id", """SELECT p_partkey AS id, trim(regexp_replace(trim('__' || p_name || ' / ' || p_type || '!'), '[^a-zA-Z0-9_-]+', '_', 'g'), '_') AS clean FROM part""")
def normalize_id(spark, sf):
    p = table(spark, sf, "part")
    raw = F.concat(F.lit("__"), "p_name", F.lit(" / "), "p_type", F.lit("!"))
    return p.select(F.col("p_partkey").alias("id"), nm.normalize_id(raw).alias("clean"))


_DPAT = r"^(.+)_([^_]+)_(\d+)p_(\d+)$"


@query("parse_degraded_name", f"""WITH {NAMES}, d AS (SELECT id, head || '_' || rate AS s, regexp_matches(head || '_' || rate, '{_DPAT}') AS ok FROM names)
SELECT id, CASE WHEN ok THEN regexp_extract(s, '{_DPAT}', 1) END AS dataset, CASE WHEN ok THEN regexp_extract(s, '{_DPAT}', 2) END AS technique,
  CASE WHEN ok THEN CAST(regexp_extract(s, '{_DPAT}', 3) AS INTEGER) END AS rate_percent,
  CASE WHEN ok THEN CAST(regexp_extract(s, '{_DPAT}', 4) AS INTEGER) END AS iteration FROM d""")
def parse_degraded_name(spark, sf):
    n = _names(spark, sf).withColumn("file", F.concat("head", F.lit("_"), "rate", F.lit(".csv")))
    return n.select("id", nm.parse_degraded_name("file").alias("k")).select("id", "k.*")


@query("parse_reconstructed_name", f"""WITH {NAMES} SELECT id,
  CASE WHEN id % 13 <> 0 THEN replace(p_type, ' ', '_') END AS dataset_name,
  CASE WHEN id % 13 <> 0 THEN ['MCAR', 'MAR', 'MNAR'][1 + id % 3] END AS technique,
  CASE WHEN id % 13 <> 0 THEN CAST(split_part(rate, 'p', 1) AS INTEGER) END AS rate_percent,
  CASE WHEN id % 13 <> 0 THEN CAST(1 + id % 4 AS INTEGER) END AS iteration,
  CASE WHEN id % 13 <> 0 THEN model END AS model FROM names""")
def parse_reconstructed_name(spark, sf):
    n = _names(spark, sf).withColumn("file", F.concat_ws("_", "head", "rate", "model"))
    return n.select("id", nm.parse_reconstructed_name("file").alias("k")).select("id", "k.*")


@query("parse_prediction_name", f"""WITH {NAMES}, f AS (SELECT *, id % 5 = 0 AS orig, id % 13 <> 0 AS good FROM names)
SELECT id, CASE WHEN orig OR good THEN replace(p_type, ' ', '_') END AS dataset_name,
  CASE WHEN orig THEN 'original' WHEN good THEN 'reconstructed' END AS source_type,
  CASE WHEN NOT orig AND good THEN ['MCAR', 'MAR', 'MNAR'][1 + id % 3] END AS technique,
  CASE WHEN NOT orig AND good THEN CAST(split_part(rate, 'p', 1) AS INTEGER) END AS rate_percent,
  CASE WHEN NOT orig AND good THEN CAST(1 + id % 4 AS INTEGER) END AS reconstruction_iteration,
  CASE WHEN NOT orig AND good THEN model || CASE WHEN fc = 'unknown_one' THEN '_unknown' ELSE '' END END AS reconstruction_model,
  CASE WHEN orig THEN fc WHEN good THEN CASE WHEN fc = 'unknown_one' THEN 'one' ELSE fc END END AS prediction_model,
  CAST(CASE WHEN id % 2 = 0 THEN 1 + id % 3 ELSE 1 END AS INTEGER) AS prediction_iteration FROM f""")
def parse_prediction_name(spark, sf):
    n = _names(spark, sf)
    stem = F.when(
        F.col("id") % 5 == 0, F.concat_ws("_", F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("original"), "fc")
    ).otherwise(F.concat_ws("_", "head", "rate", "model", "fc"))
    tail = F.when(F.col("id") % 2 == 0, F.concat(F.lit("_iter"), (1 + F.col("id") % 3).cast("string"))).otherwise("")
    n = n.select("id", F.concat(stem, tail, F.lit(".csv")).alias("name"))
    return nm.parse_prediction_name(n, FORECASTERS).drop("name")


@query("build_key_name", f"""WITH {NAMES} SELECT id, replace(p_type, ' ', '_') || '_MCAR_' || CAST(id % 100 AS VARCHAR) || 'p_3_' || model AS name FROM names""")
def build_key_name(spark, sf):
    return _names(spark, sf).select("id", nm.build_key_name(
        F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("MCAR"), F.col("id") % 100, F.lit(3), "model").alias("name"))


@query("latest_snapshot", """WITH s AS (SELECT o_orderkey AS id, 'results_' || strftime(o_orderdate, '%Y%m%d') || '_120000.csv' AS file,
  strftime(o_orderdate, '%Y%m%d') || '_120000' AS run_ts FROM orders) SELECT * FROM s WHERE run_ts = (SELECT max(run_ts) FROM s)""")
def latest_snapshot(spark, sf):
    o = table(spark, sf, "orders")
    named = o.select(F.col("o_orderkey").alias("id"),
                     F.concat(F.lit("results_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_120000.csv")).alias("file"))
    return nm.latest_snapshot(named, "file")


# ---- files: events as one folder per event type, two of the types in semicolon/comma format ---------

_EU = ("error", "view")
_WRITTEN: dict = {}


def _csv_folder(spark, sf):
    """Writes the series files once per session into the shared folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        path = f"{scratch_dir(spark)}/mendcast/csv-{abs(hash(key))}-{spark.sparkContext.startTime}"
        e = table(spark, sf, "events")
        eu = F.col("event_type").isin(*_EU)
        rows = e.select(
            F.concat(F.when(eu, "eu_").otherwise("std_"), "event_type", F.lit("_EXTERNAL_0p_1")).alias("file"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
            F.when(F.col("event_id") % 9 == 4, F.lit(" ")).otherwise(F.col("value").cast("string")).alias("value"), eu.alias("eu"),
        )
        std = rows.where(~F.col("eu")).drop("eu")
        std.write.mode("append").partitionBy("file").option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(path)
        rows.where("eu").drop("eu").withColumn("value", F.replace("value", F.lit("."), F.lit(","))).write.mode(
            "append").partitionBy("file").option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


_FILES = "CASE WHEN event_type IN ('error', 'view') THEN 'eu_' ELSE 'std_' END || event_type || '_EXTERNAL_0p_1'"


@query("detect_csv_format", f"""SELECT DISTINCT {_FILES} AS series, CASE WHEN event_type IN ('error', 'view') THEN ';' ELSE ',' END AS sep,
  CASE WHEN event_type IN ('error', 'view') THEN ',' ELSE '.' END AS decimal FROM events""")
def detect_csv_format(spark, sf):
    """Votes of the files of a series (a file may start with a blank cell) combined to one format."""
    found = io.detect_csv_format(spark, _csv_folder(spark, sf))
    name = F.regexp_extract("file", r"file=([^/]*)/", 1)
    votes = found.groupBy(name.alias("series"), "sep", "decimal").agg(F.count("*").alias("n"))
    return votes.groupBy("series").agg(F.max_by("sep", "n").alias("sep"), F.max_by("decimal", "n").alias("decimal"))


@query("read_series_csv", f"""SELECT {_FILES} AS series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS raw_index,
  CASE WHEN event_id % 9 <> 4 THEN value END AS value FROM events""")
def read_series_csv(spark, sf):
    raw = io.read_series_csv(spark, _csv_folder(spark, sf), {"eu_": (";", ",")})
    return raw.select("series_id", "raw_index", F.expr("try_cast(trim(raw_value) AS DOUBLE)").alias("value"))


@query("read_degraded", """SELECT CASE WHEN event_type IN ('error', 'view') THEN 'eu_' ELSE 'std_' END || event_type AS series_id, 'EXTERNAL' AS technique, CAST(0 AS INTEGER) AS rate_percent,
  CAST(1 AS INTEGER) AS iteration, CAST(epoch_us(date_trunc('second', ts)) AS DOUBLE) AS x,
  CASE WHEN event_id % 9 <> 4 THEN value END AS value FROM events""")
def read_degraded(spark, sf):
    out = io.read_degraded(spark, _csv_folder(spark, sf), {"eu_": (";", ",")})
    return out.select("series_id", "technique", "rate_percent", "iteration", "x", "value")


@query("export_filtered_csv", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def export_filtered_csv(spark, sf):
    """Filtered orders written sorted and read back."""
    path = f"{scratch_dir(spark)}/mendcast/export-{spark.sparkContext.startTime}-{abs(hash(sf))}"
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") == "O")
    io.export_filtered_csv(o.select("o_orderkey", "o_totalprice"), path, ["o_totalprice", "o_orderkey"])
    return spark.read.option("header", True).schema("o_orderkey bigint, o_totalprice double").csv(path)


@query("write_points_skip_existing", """SELECT CAST(user_id AS VARCHAR) AS series_id, count(*) AS n FROM events GROUP BY ALL""")
def write_points_skip_existing(spark, sf):
    """Two writes of overlapping series into one table: the second adds only what is missing."""
    from queries.fixtures import ev_user

    path = f"{scratch_dir(spark)}/mendcast/points-{spark.sparkContext.startTime}-{abs(hash(sf))}"
    points = ev_user(spark, sf).select("series_id", "pos", "value")
    io.write_points(points.where(F.col("series_id") < "5"), path, overwrite=True)
    io.write_points(points, path)
    return spark.read.parquet(path).groupBy("series_id").agg(F.count("*").alias("n"))


@query("write_points_overwrite_cell", """SELECT CAST(user_id AS VARCHAR) AS series_id, technique, count(*) AS n FROM events, (VALUES ('A'), ('B')) t(technique)
WHERE technique = 'A' OR user_id % 2 = 0 OR event_id % 2 = 0 GROUP BY ALL""")
def write_points_overwrite_cell(spark, sf):
    """Half of each series is stored under two techniques; two overwrites replace all cells of one and some of the other."""
    from queries.fixtures import table

    path = f"{scratch_dir(spark)}/mendcast/cells-{spark.sparkContext.startTime}-{abs(hash(sf))}"
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("series_id"), "event_id", "value")
    both = e.withColumn("technique", F.explode(F.array(F.lit("A"), F.lit("B"))))
    io.write_points(both.where("event_id % 2 = 0"), path, overwrite=True)
    io.write_points(both.where("technique = 'A'"), path, overwrite=True)
    io.write_points(both.where("technique = 'B' AND series_id % 2 = 0"), path, overwrite=True)
    return spark.read.parquet(path).groupBy("series_id", "technique").agg(F.count("*").alias("n"))


@query("write_points_partial_cell", "SELECT CAST(user_id AS VARCHAR) AS series_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL")
def write_points_partial_cell(spark, sf):
    """A run that broke off left every third row; the next write completes those cells and doubles none."""
    from queries.fixtures import table

    path = f"{scratch_dir(spark)}/mendcast/partial-{spark.sparkContext.startTime}-{abs(hash(sf))}"
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("series_id"), "event_id", "value")
    io.write_points(e.where("event_id % 3 = 0"), path, overwrite=True)
    io.write_points(e, path)
    return spark.read.parquet(path).groupBy("series_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
