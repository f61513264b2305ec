"""Whole runs and user-supplied methods."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mendcast.layout import new_table_path
from mendcast.operators import clean as cl, forecast as fc, mask, repair as rp, score as sc
from mendcast.plans import pipeline as pl, registry as rg
from mendcast.plans.blockwise import BlockMethod, MergedMetric
from queries import query
from queries.cleaning import _MANIFEST, EXTERNAL
from queries.fixtures import EV, ev_deg, ev_hour, ev_user, grid_for, masked_sql, ord_day, rounded, rsql
from queries.repairing import KNOTS, _line

TRAIN = f"""{EV}, s0 AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ev),
tr AS (SELECT series_id, pos, ts, x, value FROM s0 WHERE pos < CASE WHEN n > 12 THEN n - 12 ELSE n - greatest(1, n // 5) END),
te AS (SELECT series_id, value AS t, pos - CASE WHEN n > 12 THEN n - 12 ELSE n - greatest(1, n // 5) END + 1 AS step FROM s0
  WHERE pos >= CASE WHEN n > 12 THEN n - 12 ELSE n - greatest(1, n // 5) END),
{masked_sql('tr', 'deg')}, {KNOTS}"""
FILLS = {"mean": "avg(value) OVER (PARTITION BY series_id)", "ffill": "l1v", "linear": _line("pos")}
RUN = TRAIN + ", rep AS (" + " UNION ALL ".join(
    f"SELECT series_id, '{m}' AS model, pos, value IS NULL AS masked, truth, coalesce(value, {e}) AS value FROM kn" for m, e in FILLS.items()
) + "), res AS (SELECT series_id, model, sqrt(avg((truth - value) * (truth - value))) AS rmse, avg(abs(truth - value)) AS mae, count(*) AS n_missing " \
    "FROM rep WHERE masked AND value IS NOT NULL GROUP BY ALL)"


def _config(spark, sf, **kw):
    return pl.RunConfig(points=ev_user(spark, sf), n_test=12, techniques=("MCAR",), rates=(0.2,), models=("mean", "ffill", "linear"), **kw)


@query("best_repair_leaderboard", rsql(f"""WITH {RUN} SELECT model, avg(rmse) AS mean, stddev_samp(rmse) AS std, min(rmse) AS min, max(rmse) AS max FROM res GROUP BY ALL""", "mean std min max"))
def best_repair_leaderboard(spark, sf):
    """Flagship: which of mean, forward fill and line repairs event values best at 20 % missing?"""
    run = pl.pipeline_reconstruction(spark, _config(spark, sf))
    return rounded(pl.leaderboard(run["recon_results"]))


@query("reconstruction_run_scores", rsql(f"WITH {RUN} SELECT series_id, model, rmse, mae, n_missing FROM res", "rmse mae"))
def reconstruction_run_scores(spark, sf):
    out = pl.pipeline_reconstruction(spark, _config(spark, sf))["recon_results"]
    return rounded(out.select("series_id", "model", "rmse", "mae", "n_missing"))


@query("full_run_scores", rsql(f"""WITH {RUN}, src AS (SELECT 'original' AS source_type, CAST(NULL AS VARCHAR) AS reconstruction_model, series_id, pos, value FROM tr
  UNION ALL SELECT 'reconstructed', model, series_id, pos, value FROM rep),
q AS (SELECT source_type, reconstruction_model, series_id, max_by(value, pos) FILTER (value IS NOT NULL) AS y FROM src GROUP BY ALL)
SELECT source_type, reconstruction_model, series_id, 'last_value' AS prediction_model, avg(abs(t - y)) AS mae, count(*) AS n_samples FROM q JOIN te USING (series_id) GROUP BY ALL""", "mae"))
def full_run_scores(spark, sf):
    run = pl.pipeline_full(spark, _config(spark, sf, forecasters=("last_value",)))
    return rounded(run["pred_results"].select("source_type", "reconstruction_model", "series_id", "prediction_model", "mae", "n_samples"))


FULL = f"""{RUN}, src AS (SELECT 'original||' || series_id AS series_id, pos, value FROM tr
  UNION ALL SELECT 'reconstructed|' || model || '|' || series_id, pos, value FROM rep)"""
_KEYS = """split_part(series_id, '|', 1) AS source_type, nullif(split_part(series_id, '|', 2), '') AS reconstruction_model, split_part(series_id, '|', 3) AS series_id"""


def _full_sql() -> str:
    """A linear model on five lags over all sources, and the drift, scored against the held-out values."""
    from queries.forecasting import LAGS, _ols_sql, _roll_sql

    full = FULL.replace("ev AS (", "RECURSIVE ev AS (", 1)
    return rsql(f"""WITH {full}, {_ols_sql(LAGS, 'src')}, {_roll_sql(LAGS, 'src', '12')},
bk AS (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY pos DESC) AS b, least(10, count(*) OVER (PARTITION BY series_id)) AS k
  FROM src WHERE value IS NOT NULL),
dr AS (SELECT series_id, max(value) FILTER (b = 1) AS y, max(value) FILTER (b = k) AS y10, any_value(k) AS k FROM bk GROUP BY series_id),
pr AS (SELECT {_KEYS}, 'lag_model' AS prediction_model, step, predicted FROM roll WHERE step > 0
  UNION ALL SELECT {_KEYS}, 'drift10', CAST(i AS BIGINT), y + i * (y - y10) / (k - 1) FROM dr, range(1, 13) g(i)
  UNION ALL SELECT {_KEYS}, 'last_value', CAST(i AS BIGINT), y FROM dr, range(1, 13) g(i))
SELECT source_type, reconstruction_model, series_id, prediction_model, avg(abs(t - predicted)) AS mae, count(*) AS n_samples
FROM pr JOIN te USING (series_id, step) GROUP BY ALL""", "mae", 4)


@query("full_run_with_learner", _full_sql())
def full_run_with_learner(spark, sf):
    """All eight steps with a linear model trained over all series."""
    run = pl.pipeline_full(spark, _config(spark, sf, forecasters=("last_value", "drift10"), learner="linear", lags=5))
    return rounded(run["pred_results"].select("source_type", "reconstruction_model", "series_id", "prediction_model", "mae", "n_samples"), 4)


@query("resumed_run_scores", _full_sql())
def resumed_run_scores(spark, sf):
    """The same run in a stored folder: first with one repair and no learner, then going on with what is missing."""
    path = new_table_path(spark)
    part = _config(spark, sf, forecasters=("last_value",), store=path, lags=5)
    part.models = ("mean",)
    pl.pipeline_full(spark, part)
    run = pl.pipeline_full(spark, _config(spark, sf, forecasters=("last_value", "drift10"), learner="linear", lags=5, store=path))
    return rounded(run["pred_results"].select("source_type", "reconstruction_model", "series_id", "prediction_model", "mae", "n_samples"), 4)


_EXT = f"""{EXTERNAL}, click AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (ORDER BY pos) AS lp FROM evh WHERE series_id = 'click'),
src AS (SELECT 'urgent' AS series_id, m AS reconstruction_model, pos, value FROM urgent, (VALUES ('linear'), ('mean')) v(m) WHERE pos < n - 30
  UNION ALL SELECT 'pair', 'mean', pos, coalesce(value, avg(value) OVER ()) FROM click
  UNION ALL SELECT 'pair', 'linear', c.pos, coalesce(c.value, CASE WHEN r.pos IS NULL THEN l.value ELSE l.value + (r.value - l.value) / CAST(r.pos - l.pos AS DOUBLE) * (c.pos - l.pos) END)
    FROM click c LEFT JOIN click l ON l.pos = c.lp LEFT JOIN click r ON r.pos = (SELECT min(x.pos) FROM click x WHERE x.value IS NOT NULL AND x.pos > c.pos)),
te AS (SELECT 'urgent' AS series_id, pos - (n - 30) + 1 AS step, value AS t FROM urgent WHERE pos >= n - 30
  UNION ALL SELECT 'pair', pos + 1, value FROM ord WHERE series_id = '2-HIGH'),
bk AS (SELECT *, row_number() OVER w AS b, least(10, count(*) OVER (PARTITION BY series_id, reconstruction_model)) AS k FROM src WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY series_id, reconstruction_model ORDER BY pos DESC)),
st AS (SELECT series_id, reconstruction_model, max(value) FILTER (b = 1) AS y, max(value) FILTER (b = k) AS y10, any_value(k) AS k FROM bk GROUP BY ALL)"""


@query("external_run_scores", rsql(f"""WITH {_EXT} SELECT series_id, reconstruction_model, m AS prediction_model,
  avg(abs(t - CASE m WHEN 'drift10' THEN y + step * (y - y10) / (k - 1) ELSE y END)) AS mae, count(*) AS n_samples
FROM st JOIN te USING (series_id), (VALUES ('last_value'), ('drift10')) v(m) WHERE t IS NOT NULL GROUP BY ALL""", "mae", 3))
def external_run_scores(spark, sf):
    """Series with their own gaps: ingest, repair, forecast, score."""
    tag = lambda df, t: df.withColumn("series_id", F.concat(F.lit(t), "series_id"))
    points = tag(ord_day(spark, sf), "p:").unionByName(tag(ev_hour(spark, sf), "h:"))
    rows = [("urgent", "p:1-URGENT", 30, None, None, None, None, None, None), ("pair", None, None, "h:click", "p:2-HIGH", None, "EXT", 5, 2),
            ("bad", "h:view", 400, None, None, None, None, None, None)]
    manifest = spark.createDataFrame(rows, _MANIFEST)
    run = pl.pipeline_external(spark, manifest, pl.RunConfig(points=points, models=("linear", "mean"), forecasters=("last_value", "drift10")))
    return rounded(run["pred_results"].select("series_id", "reconstruction_model", "prediction_model", "mae", "n_samples"), 3)


# ---- user methods ----------------------------------------------------------------------------------

def _zero_fill(points):
    return points.withColumn("value", F.coalesce("value", F.lit(0.0)))


@query("plugin_repair_frame", rsql(f"WITH {EV}, {masked_sql('ev', 'deg')} SELECT series_id, pos, coalesce(value, 0) AS value FROM deg", "value"))
def plugin_repair_frame(spark, sf):
    rg.register_reconstruction_model("zero_fill", _zero_fill, overwrite=True, kind="frame")
    return rounded(rp.reconstruct(ev_deg(spark, sf), ["zero_fill"]).select("series_id", "pos", "value"))


@query("plugin_repair_series", rsql(f"WITH {EV}, {masked_sql('ev', 'deg')} SELECT series_id, pos, coalesce(value, 42) AS value FROM deg", "value"))
def plugin_repair_series(spark, sf):
    rg.register_reconstruction_model("constant_42", lambda s: s.fillna(42.0), overwrite=True, kind="block")
    return rounded(rp.reconstruct(ev_deg(spark, sf), ["constant_42"]).select("series_id", "pos", "value"))


def _near_mean(series):
    return series.fillna(series.rolling(5, center=True, min_periods=1).mean())


@query("plugin_repair_block", rsql(f"""WITH {EV}, {masked_sql('ev', 'deg')} SELECT series_id, pos,
  coalesce(value, avg(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS value FROM deg""", "value"))
def plugin_repair_block(spark, sf):
    rg.register_reconstruction_model("near_mean", _near_mean, overwrite=True, kind="block", halo=2)
    return rounded(rp.reconstruct(ev_deg(spark, sf), ["near_mean"]).select("series_id", "pos", "value"))


def _count(values):
    return [len(values)]


def _head_mask(values, rate, seed, place):
    """The first ``rate`` of the series, whichever blocks that covers."""
    values[: max(0, int(place.n * rate) - place.start)] = float("nan")
    return values


HEAD = BlockMethod(_count, lambda a, b: [a[0] + b[0]], _head_mask)


@query("plugin_mask_series", f"""WITH {EV}, c AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ev)
SELECT series_id, pos, CASE WHEN pos < floor(n * CAST(0.2 AS DOUBLE)) THEN NULL ELSE value END AS value FROM c""")
def plugin_mask_series(spark, sf):
    rg.register_missingness_technique("HEAD", HEAD, overwrite=True, kind="block")
    points = ev_user(spark, sf)
    return mask.degrade(points, grid_for(points, ("HEAD",))).select("series_id", "pos", "value")


def _observed(values):
    seen = values[~np.isnan(values)]
    return [seen.sum(), len(seen), seen[-1] if len(seen) else float("nan")]


def _join_observed(a, b):
    return [a[0] + b[0], a[1] + b[1], b[2] if b[1] else a[2]]


def _last_seen(values, place):
    """Forward fill across blocks; a head without a value takes the mean of the series."""
    filled = pd.Series(values).ffill().to_numpy()
    known = place.before[2] if place.before and place.before[1] else place.total[0] / place.total[1]
    return np.where(np.isnan(filled), known, filled)


@query("plugin_repair_state", rsql(f"""WITH {EV}, {masked_sql('ev', 'deg')} SELECT series_id, pos, coalesce(value,
  last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos), avg(value) OVER (PARTITION BY series_id)) AS value FROM deg""", "value"))
def plugin_repair_state(spark, sf):
    rg.register_reconstruction_model("last_seen", BlockMethod(_observed, _join_observed, _last_seen), overwrite=True, kind="block")
    return rounded(rp.reconstruct(ev_deg(spark, sf), ["last_seen"]).select("series_id", "pos", "value"))


WORST = MergedMetric(lambda t, p: [abs(t - p).max()], lambda a, b: [max(a[0], b[0])], lambda s, train: s[0])


@query("plugin_metric", rsql(f"""WITH {EV}, {masked_sql('ev', 'deg')}, {KNOTS} SELECT series_id, max(abs(truth - coalesce(value, {_line('pos')}))) AS worst,
  max(abs(truth - coalesce(value, {_line('pos')}))) AS worst_frame FROM kn WHERE value IS NULL AND {_line('pos')} IS NOT NULL GROUP BY ALL""", "worst worst_frame"))
def plugin_metric(spark, sf):
    rg.register_reconstruction_metric("worst", "Worst", True, WORST, overwrite=True, kind="merge")
    rg.register_reconstruction_metric("worst_frame", "Worst", True, lambda t, p: F.max(F.abs(t - p)), overwrite=True, kind="frame")
    rep = rp.reconstruct(ev_deg(spark, sf).withColumn("masked", F.col("value").isNull()), ["linear"])
    return rounded(sc.score_reconstruction(sc.pairs_from_truth(rep), ["worst", "worst_frame"]).select("series_id", "worst", "worst_frame"))


def _steps(values):
    """Sum and number of squared steps between neighbours, and the values at both ends."""
    seen = values[~np.isnan(values)]
    return [(np.diff(seen) ** 2).sum(), max(len(seen) - 1, 0), *((seen[0], seen[-1]) if len(seen) else (float("nan"),) * 2)]


def _join_steps(a, b):
    if a[2] != a[2]:
        return b
    if b[2] != b[2]:
        return a
    return [a[0] + b[0] + (b[2] - a[3]) ** 2, a[1] + b[1] + 1, a[2], b[3]]


#: Mean squared error over the mean squared step of the training series, and the share of forecasts that are too low.
RELATIVE = MergedMetric(
    lambda t, p: [((t - p) ** 2).sum(), len(t)], lambda a, b: [a[0] + b[0], a[1] + b[1]],
    lambda s, train: s[0] / s[1] / (train[0] / train[1]) if train and train[1] and train[0] else None, BlockMethod(_steps, _join_steps, None))
TOO_LOW = MergedMetric(lambda t, p: [(p < t).sum(), len(t)], lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda s, train: s[0] / s[1])


@query("plugin_prediction_metric", rsql(f"""WITH {EV}, s0 AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ev),
tr AS (SELECT series_id, pos, value FROM s0 WHERE pos < CASE WHEN n > 12 THEN n - 12 ELSE n - greatest(1, n // 5) END),
te AS (SELECT series_id, value AS t FROM s0 WHERE pos >= CASE WHEN n > 12 THEN n - 12 ELSE n - greatest(1, n // 5) END),
d AS (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS d FROM tr),
sc AS (SELECT series_id, avg(d * d) AS scale FROM d GROUP BY ALL), y AS (SELECT series_id, max_by(value, pos) AS y FROM tr GROUP BY ALL)
SELECT series_id, 'last_value' AS prediction_model, avg((t - y) * (t - y)) / any_value(scale) AS relative, avg(CASE WHEN y < t THEN 1.0::DOUBLE ELSE 0 END) AS too_low
FROM te JOIN y USING (series_id) JOIN sc USING (series_id) GROUP BY ALL""", "relative too_low"))
def plugin_prediction_metric(spark, sf):
    rg.register_prediction_metric("relative", "Relative MSE", True, RELATIVE, overwrite=True, kind="merge")
    rg.register_prediction_metric("too_low", "Too low", True, TOO_LOW, overwrite=True, kind="merge")
    split = cl.temporal_split(ev_user(spark, sf), 12)
    train, test = split.where("part = 'train'").drop("part", "step"), split.where("part = 'test'")
    preds = fc.forecast(train, ["last_value"], 12)
    pairs, _ = sc.attach_truth(preds, test)
    return rounded(sc.score_prediction(pairs, train, ["relative", "too_low"]).select("series_id", "prediction_model", "relative", "too_low"))


FLAT_MEAN = BlockMethod(_observed, _join_observed, lambda total, h: [total[0] / total[1]] * h)


@query("plugin_forecaster", rsql(f"""WITH {EV}, {masked_sql('ev', 'deg')}, a AS (SELECT series_id, avg(value) AS predicted FROM deg GROUP BY ALL)
SELECT series_id, CAST(i AS BIGINT) AS step, predicted FROM a, range(1, 4) g(i)""", "predicted"))
def plugin_forecaster(spark, sf):
    rg.register_prediction_model("flat_mean", FLAT_MEAN, overwrite=True, kind="block")
    return rounded(fc.forecast(ev_deg(spark, sf), ["flat_mean"], 3).select("series_id", "step", "predicted"))
