"""Scoring of repairs and forecasts."""

from pyspark.sql import functions as F

from mendcast.functions import metrics as mt
from mendcast.operators import clean as cl, forecast as fc, repair as rp, score as sc
from mendcast.operators.compare import run_summary as summary_of, summary_by
from queries import query
from queries.fixtures import COST, DEG, DEG_KEYS, EV, PRED, cost_rows, ev_deg, ev_user, pred_results, rounded, rsql, stored
from queries.repairing import REP, REP_MODELS

MK = f"{DEG_KEYS}, model"


def _repaired(spark, sf):
    return stored(spark, sf, "ev_repaired", lambda: rp.reconstruct(
        ev_deg(spark, sf).withColumn("masked", F.col("value").isNull()), REP_MODELS))


def _pairs(spark, sf):
    return sc.pairs_from_truth(_repaired(spark, sf))


PAIRS = REP + f", pairs AS (SELECT {MK}, pos, truth AS t, value AS p, abs(truth - value) AS e FROM rep WHERE masked AND truth IS NOT NULL AND value IS NOT NULL)"


@query("scoring_pairs", rsql(f"WITH {PAIRS} SELECT series_id, model, pos, t, p FROM pairs", "t p", 8))
def scoring_pairs(spark, sf):
    out = sc.scoring_pairs(ev_user(spark, sf), ev_deg(spark, sf), _repaired(spark, sf))
    return rounded(out.select("series_id", "model", "pos", "t", "p"), 8)


@query("pairs_without_join", rsql(f"WITH {PAIRS} SELECT series_id, model, pos, t, p FROM pairs", "t p", 8))
def pairs_without_join(spark, sf):
    return rounded(_pairs(spark, sf).select("series_id", "model", "pos", "t", "p"), 8)


@query("align_positional", f"""WITH {DEG} SELECT e.series_id, e.pos, e.value AS a_value, d.value AS b_value FROM ev e
  JOIN deg d ON d.series_id = e.series_id AND d.pos = e.pos""")
def align_positional(spark, sf):
    return sc.align_positional(ev_user(spark, sf), ev_deg(spark, sf), ["series_id"])


@query("align_by_index", rsql(f"WITH {PAIRS} SELECT series_id, model, pos AS n, t, p FROM pairs WHERE model = 'linear'", "t p", 8))
def align_by_index(spark, sf):
    """Aligned by time stamp; the position is looked up afterwards to compare with the positional pairs."""
    rep = _repaired(spark, sf).where(F.col("model") == "linear")
    out = sc.align_by_index(ev_user(spark, sf), ev_deg(spark, sf), rep)
    at = ev_user(spark, sf).select("series_id", "ts", F.col("pos").alias("n"))
    return rounded(out.join(at, ["series_id", "ts"]).select("series_id", "model", "n", "t", "p"), 8)


@query("unscored_configs", f"WITH {PAIRS} SELECT DISTINCT series_id, model, 'no missing position with both values' AS error FROM rep "
                           "WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.series_id = rep.series_id AND p.model = rep.model AND CAST(p.series_id AS INTEGER) % 3 <> 0)")
def unscored_configs(spark, sf):
    """The pairs of every third series are filed under another model."""
    renamed = F.when(F.col("series_id").cast("int") % 3 == 0, F.concat("model", F.lit(" v2"))).otherwise(F.col("model"))
    return sc.unscored(_repaired(spark, sf), _pairs(spark, sf).withColumn("model", renamed)).select("series_id", "model", "error")


_R2 = "CASE WHEN count(t) >= 2 AND var_pop(t) >= 1e-12 THEN 1 - sum((t - p) * (t - p)) / (count(t) * var_pop(t)) END"
_SM = "avg(2 * e / (abs(t) + abs(p) + CAST(1e-12 AS DOUBLE))) * 100"
_RECON = {"mad": "avg(e)", "mae": "avg(e)", "rmse": "sqrt(avg(e * e))", "r2": _R2, "smape": _SM}


def _recon(key, expr):
    @query(f"recon_{key}", rsql(f"WITH {PAIRS} SELECT {MK}, {expr} AS {key} FROM pairs GROUP BY ALL", key))
    def run(spark, sf):
        p = _pairs(spark, sf)
        col = mt.RECON_METRICS[key].expr(F.col("t"), F.col("p")).alias(key)
        return rounded(p.groupBy("series_id", "technique", "rate_percent", "iteration", "model").agg(col))


for _k, _e in _RECON.items():
    _recon(_k, _e)

_AUX = "max(e) AS max_diff, min(e) AS min_diff, stddev_pop(e) AS std_diff"


@query("recon_aux", rsql(f"WITH {PAIRS} SELECT model, {_AUX} FROM pairs GROUP BY ALL", "max_diff min_diff std_diff"))
def recon_aux(spark, sf):
    return rounded(_pairs(spark, sf).groupBy("model").agg(*mt.recon_aux(F.col("t"), F.col("p"))))


@query("score_reconstruction", rsql(f"""WITH {PAIRS}, tot AS (SELECT series_id, count(*) AS n_total FROM deg GROUP BY ALL)
SELECT {MK}, avg(e) AS mad, sqrt(avg(e * e)) AS rmse, {_R2} AS r2, {_AUX}, count(*) AS n_missing, any_value(n_total) AS n_total
FROM pairs JOIN tot USING (series_id) GROUP BY ALL""", "mad rmse r2 max_diff min_diff std_diff"))
def score_reconstruction(spark, sf):
    totals = ev_deg(spark, sf).groupBy("series_id").agg(F.count("*").alias("n_total"))
    return rounded(sc.score_reconstruction(_pairs(spark, sf), [" MAD", "rmse", "r2", "rmse"], "rmse", totals))


@query("optimization_loss", f"WITH {COST} SELECT model, iteration, count(*) AS n, min(CASE WHEN r2 IS NULL THEN 'Infinity'::DOUBLE ELSE -r2 END) AS loss FROM cost GROUP BY ALL")
def optimization_loss(spark, sf):
    c = cost_rows(spark, sf).withColumn("loss", mt.optimization_loss("r2", False))
    return c.groupBy("model", "iteration").agg(F.count("*").alias("n"), F.min("loss").alias("loss"))


def _summary(metric):
    return f"SELECT '{metric}' AS metric, avg({metric}) AS mean, median({metric}) AS median, min({metric}) AS min, max({metric}) AS max FROM cost"


@query("run_summary", rsql(f"WITH {COST} " + " UNION ALL ".join(_summary(m) for m in ("mae", "rmse", "r2")), "mean median min max"))
def run_summary(spark, sf):
    return rounded(summary_of(cost_rows(spark, sf), ["mae", "rmse", "r2"]))


@query("summary_by_source_type", rsql(f"WITH {PRED} SELECT source_type, avg(mape) AS mean, count(*) AS n FROM pred GROUP BY ALL", "mean"))
def summary_by_source_type(spark, sf):
    return rounded(summary_by(pred_results(spark, sf), "source_type", "mape"))


@query("summary_by_forecaster", rsql(f"WITH {PRED} SELECT prediction_model, avg(mape) AS mean, count(*) AS n FROM pred GROUP BY ALL", "mean"))
def summary_by_forecaster(spark, sf):
    return rounded(summary_by(pred_results(spark, sf), "prediction_model", "mape"))


# ---- forecasts against the held-out tail -----------------------------------------------------------

HORIZON = 12


def split_12(spark, sf):
    return stored(spark, sf, "ev_split12", lambda: cl.temporal_split(ev_user(spark, sf), HORIZON))


def train_12(spark, sf):
    return split_12(spark, sf).where(F.col("part") == "train").select("series_id", "pos", "ts", "x", "value")


def test_12(spark, sf):
    return split_12(spark, sf).where(F.col("part") == "test").select("series_id", "pos", "step", "value")


def _predictions(spark, sf):
    src = fc.forecast_sources(train_12(spark, sf), None)
    horizon = test_12(spark, sf).groupBy("series_id").agg(F.count("*").alias("h"))
    return stored(spark, sf, "ev_pred12", lambda: fc.to_prediction_keys(fc.forecast(src, ["last_value", "drift10"], horizon)))


def _pred_pairs(spark, sf):
    return sc.attach_truth(_predictions(spark, sf), test_12(spark, sf))[0]


# series shorter than the horizon give a fifth of their points
SPLIT12 = f"""s0 AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ev),
s1 AS (SELECT *, CASE WHEN n > {HORIZON} THEN n - {HORIZON} ELSE n - greatest(1, n // 5) END AS c FROM s0),
train AS (SELECT * FROM s1 WHERE pos < c), test AS (SELECT *, pos - c + 1 AS step FROM s1 WHERE pos >= c),
rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos DESC) AS b, count(*) OVER (PARTITION BY series_id) AS m FROM train),
st AS (SELECT series_id, max(value) FILTER (b = 1) AS last, max(value) FILTER (b = least(10, m)) AS back, least(10, max(m)) AS k FROM rk GROUP BY series_id),
pp AS (SELECT t.series_id, 'last_value' AS prediction_model, t.step, t.value AS t, s.last AS p FROM test t JOIN st s USING (series_id)
  UNION ALL SELECT t.series_id, 'drift10', t.step, t.value, s.last + t.step * (s.last - s.back) / (s.k - 1) FROM test t JOIN st s USING (series_id)),
pe AS (SELECT *, abs(t - p) AS e FROM pp)"""


@query("attach_truth", rsql(f"WITH {EV}, {SPLIT12} SELECT series_id, prediction_model, step, t, p FROM pp", "t p", 8))
def attach_truth(spark, sf):
    return rounded(_pred_pairs(spark, sf).select("series_id", "prediction_model", "step", "t", "p"), 8)


@query("attach_truth_errors", f"""WITH {EV} SELECT DISTINCT series_id, 'original' AS source_type, m AS prediction_model, 'no test series' AS error
  FROM ev, (VALUES ('last_value'), ('drift10')) v(m) WHERE series_id >= '3'""")
def attach_truth_errors(spark, sf):
    """The test parts of some series are filed under another name."""
    renamed = F.when(F.col("series_id") >= "3", F.concat(F.lit("test "), "series_id")).otherwise(F.col("series_id"))
    known = test_12(spark, sf).withColumn("series_id", renamed)
    return sc.attach_truth(_predictions(spark, sf), known)[1].select("series_id", "source_type", "prediction_model", "error")


_PMET = {
    "mae": "avg(e)", "rmse": "sqrt(avg(e * e))", "mape": "avg(CASE WHEN t <> 0 THEN e / abs(t) END) * 100", "smape": _SM,
}


def _pred(key, expr):
    @query(f"pred_{key}", rsql(f"WITH {EV}, {SPLIT12} SELECT series_id, prediction_model, {expr} AS {key} FROM pe GROUP BY ALL", key))
    def run(spark, sf):
        col = mt.PRED_METRICS[key].expr(F.col("t"), F.col("p")).alias(key)
        return rounded(_pred_pairs(spark, sf).groupBy("series_id", "prediction_model").agg(col))


for _k, _e in _PMET.items():
    _pred(_k, _e)

_SCALE = "sc AS (SELECT series_id, avg(d) AS scale FROM (SELECT series_id, abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY pos)) AS d FROM train) GROUP BY ALL)"
_MASE = "CASE WHEN any_value(scale) >= 1e-12 THEN avg(e) / any_value(scale) END"


@query("pred_mase", rsql(f"WITH {EV}, {SPLIT12}, {_SCALE} SELECT series_id, prediction_model, {_MASE} AS mase FROM pe JOIN sc USING (series_id) GROUP BY ALL", "mase"))
def pred_mase(spark, sf):
    # small blocks: first differences cross their edges
    return rounded(sc.pred_mase(_pred_pairs(spark, sf), train_12(spark, sf), block=16).select("series_id", "prediction_model", "mase"))


@query("pred_aux", rsql(f"""WITH {EV}, {SPLIT12} SELECT prediction_model, max(e) AS max_error, min(e) AS min_error,
  stddev_pop(e) AS std_error, count(e) AS n_samples FROM pe GROUP BY ALL""", "max_error min_error std_error"))
def pred_aux(spark, sf):
    return rounded(_pred_pairs(spark, sf).groupBy("prediction_model").agg(*mt.pred_aux(F.col("t"), F.col("p"))))


@query("score_prediction", rsql(f"""WITH {EV}, {SPLIT12}, {_SCALE} SELECT series_id, 'original' AS source_type, prediction_model,
  CAST(1 AS INTEGER) AS prediction_iteration, {_PMET['mape']} AS mape, {_SM} AS smape, {_MASE} AS mase, avg(e) AS mae, sqrt(avg(e * e)) AS rmse,
  max(e) AS max_error, min(e) AS min_error, stddev_pop(e) AS std_error, count(*) AS n_samples
  FROM pe JOIN sc USING (series_id) GROUP BY ALL""", "mape smape mase mae rmse max_error min_error std_error"))
def score_prediction(spark, sf):
    return rounded(sc.score_prediction(_pred_pairs(spark, sf), train_12(spark, sf)))


# ---- resources -------------------------------------------------------------------------------------

_CK = "dataset_name, technique, rate_percent, iteration, model"


def _recon_results(spark, sf):
    return cost_rows(spark, sf).groupBy("dataset_name", "technique", "rate_percent", "iteration", "model").agg(F.max("rmse").alias("rmse"))


@query("attach_perf_recon", f"""WITH {COST} SELECT {_CK}, max(rmse) AS rmse, CASE WHEN technique <> 'A' THEN max(time_seconds) END AS time_seconds,
  CASE WHEN technique <> 'A' THEN max(memory_mb) END AS memory_mb FROM cost GROUP BY {_CK}""")
def attach_perf_recon(spark, sf):
    """The resources of one technique are filed under another name."""
    renamed = F.when(F.col("technique") == "A", F.lit("A2")).otherwise(F.col("technique"))
    perf = cost_rows(spark, sf).withColumn("technique", renamed).groupBy(
        "dataset_name", "technique", "rate_percent", "iteration", "model"
    ).agg(F.max("time_seconds").alias("time_seconds"), F.max("memory_mb").alias("memory_mb"))
    return sc.attach_perf_recon(_recon_results(spark, sf), perf)


_PK = ("dataset_name, source_type, technique, rate_percent, reconstruction_iteration, reconstruction_model, prediction_model, prediction_iteration")


@query("attach_perf_pred", f"""WITH {PRED} SELECT {_PK}, max(mape) AS mape,
  CASE WHEN prediction_model <> 'fc_0' THEN max(time_seconds) END AS time_seconds FROM pred GROUP BY {_PK}""")
def attach_perf_pred(spark, sf):
    """Original rows have four missing key parts, which must match each other."""
    keys = _PK.split(", ")
    p = pred_results(spark, sf)
    renamed = F.when(F.col("prediction_model") == "fc_0", F.lit("fc_00")).otherwise(F.col("prediction_model"))
    perf = p.withColumn("prediction_model", renamed).groupBy(*keys).agg(F.max("time_seconds").alias("time_seconds"))
    perf = perf.withColumn("rate_percent", F.col("rate_percent").cast("double").cast("string"))
    return sc.attach_perf_pred(p.groupBy(*keys).agg(F.max("mape").alias("mape")), perf)
