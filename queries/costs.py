"""Quality and cost queries."""

from pyspark.sql import functions as F

from mendcast.operators import cost as co, sweep as sw
from queries import query
from queries.fixtures import COST, DEG, DEG_KEYS, PRED, TRAINING, cost_rows, ev_deg, pred_results, rounded, rsql, training_rows
from queries.repairing import KNOTS, _line

T9 = "CAST(1e-9 AS DOUBLE)"
EFF = f"""{COST}, b AS (SELECT min(time_seconds) AS t0, max(time_seconds) AS t1, min(memory_mb) AS m0, max(memory_mb) AS m1 FROM cost),
md AS (SELECT cpu_cores_total AS cores FROM cost GROUP BY ALL ORDER BY count(*) DESC, cores LIMIT 1),
eff AS (SELECT cost.*, (time_seconds - t0) / (t1 - t0 + {T9}) AS time_norm, cpu_cores_used / cores AS cpu_norm,
  (memory_mb - m0) / (m1 - m0 + {T9}) AS mem_norm,
  CASE WHEN gpu_memory_mb IS NOT NULL AND gpu_memory_total_mb > 0 THEN gpu_memory_mb / gpu_memory_total_mb ELSE 0 END AS gpu_norm FROM cost, b, md),
es AS (SELECT *, time_norm + cpu_norm + mem_norm + gpu_norm AS efficiency_score FROM eff)"""


@query("efficiency_score_rows", rsql(f"WITH {EFF} SELECT model, time_seconds, memory_mb, cpu_norm, gpu_norm, efficiency_score FROM es",
                                     "time_seconds memory_mb cpu_norm gpu_norm efficiency_score"))
def efficiency_score_rows(spark, sf):
    return rounded(co.efficiency_score_rows(cost_rows(spark, sf)).select(
        "model", "time_seconds", "memory_mb", "cpu_norm", "gpu_norm", "efficiency_score"))


@query("efficiency_by_model", rsql(f"WITH {EFF} SELECT model, avg(efficiency_score) AS efficiency_score FROM es GROUP BY ALL", "efficiency_score"))
def efficiency_by_model(spark, sf):
    return rounded(co.efficiency_by_model(cost_rows(spark, sf)))


CM = """cm AS (SELECT model, avg(quality) AS quality, avg(time_seconds) AS time_seconds, avg(cpu_cores_used) AS cpu_cores_used, max(cpu_cores_total) AS cpu_cores_total,
  avg(memory_mb) AS memory_mb, avg(gpu_memory_mb) AS gpu_memory_mb, max(gpu_memory_total_mb) AS gpu_memory_total_mb FROM cost GROUP BY model)"""


@query("quality_x_cost_join", rsql(f"""WITH {COST}, {PRED}, {CM}, q AS (SELECT reconstruction_model AS model, avg(mape) AS q FROM pred WHERE reconstruction_model IS NOT NULL GROUP BY ALL)
SELECT model, q.q AS quality, time_seconds, cpu_cores_used, memory_mb FROM cm JOIN q USING (model)""", "quality time_seconds cpu_cores_used memory_mb", 4))
def quality_x_cost_join(spark, sf):
    return rounded(co.quality_x_cost_join(pred_results(spark, sf), cost_rows(spark, sf), "mape").select(
        "model", "quality", "time_seconds", "cpu_cores_used", "memory_mb"), 4)


@query("cost_restricted_to_quality_datasets", f"WITH {COST} SELECT dataset_name, model, count(*) AS n FROM cost WHERE dataset_name = 'O' GROUP BY ALL")
def cost_restricted_to_quality_datasets(spark, sf):
    quality = pred_results(spark, sf).where(F.col("dataset_name") == "O")
    return co.cost_restricted_to_quality_datasets(cost_rows(spark, sf), quality).groupBy("dataset_name", "model").agg(F.count("*").alias("n"))


@query("models_without_cost", f"WITH {PRED} SELECT DISTINCT reconstruction_model AS model FROM pred WHERE reconstruction_model >= 'Brand#4'")
def models_without_cost(spark, sf):
    """The costs of some models are filed under another name."""
    renamed = F.when(F.col("model") >= "Brand#4", F.concat("model", F.lit(" v2"))).otherwise(F.col("model"))
    return co.models_without_cost(pred_results(spark, sf), cost_rows(spark, sf).withColumn("model", renamed))


TRADE = f"""{COST}, {CM}, md AS (SELECT cpu_cores_total AS cores FROM cm GROUP BY ALL ORDER BY count(*) DESC, cores LIMIT 1),
b AS (SELECT min(time_seconds) AS t0, max(time_seconds) AS t1, min(memory_mb) AS m0, max(memory_mb) AS m1, min(quality) AS q0, max(quality) AS q1 FROM cm),
e AS (SELECT cm.*, q0, q1, (time_seconds - t0) / (t1 - t0 + {T9}) + cpu_cores_used / cores + (memory_mb - m0) / (m1 - m0 + {T9})
  + CASE WHEN gpu_memory_mb IS NOT NULL AND gpu_memory_total_mb > 0 THEN gpu_memory_mb / gpu_memory_total_mb ELSE 0 END AS efficiency_score FROM cm, b, md),
n AS (SELECT *, (quality - q0) / (q1 - q0 + {T9}) AS quality_norm,
  (efficiency_score - min(efficiency_score) OVER ()) / (max(efficiency_score) OVER () - min(efficiency_score) OVER () + {T9}) AS efficiency_norm FROM e),
tr AS (SELECT *, CAST(0.5 AS DOUBLE) * quality_norm + CAST(0.5 AS DOUBLE) * efficiency_norm AS combined_score FROM n)"""
_TCOLS = "quality efficiency_score quality_norm efficiency_norm combined_score time_seconds cpu_cores_used memory_mb"


@query("tradeoff_ranking", rsql(f"WITH {TRADE} SELECT CAST(row_number() OVER (ORDER BY combined_score, model) AS INTEGER) AS rank, model, {', '.join(_TCOLS.split())} FROM tr", _TCOLS, 5))
def tradeoff_ranking(spark, sf):
    return rounded(co.tradeoff_ranking(cost_rows(spark, sf), None, True), 5)


@query("tradeoff_ranking_forecasts", rsql(f"""WITH {TRADE}, {PRED}, q AS (SELECT reconstruction_model AS model, avg(mape) AS q FROM pred WHERE reconstruction_model IS NOT NULL GROUP BY ALL),
w AS (SELECT tr.model, q.q AS quality, efficiency_score, efficiency_norm, (q.q - min(q.q) OVER ()) / (max(q.q) OVER () - min(q.q) OVER () + {T9}) AS quality_norm FROM tr JOIN q USING (model))
SELECT model, quality, efficiency_score, CAST(0.7 AS DOUBLE) * quality_norm + CAST(0.3 AS DOUBLE) * efficiency_norm AS combined_score FROM w""", "quality efficiency_score combined_score"))
def tradeoff_ranking_forecasts(spark, sf):
    quality = pred_results(spark, sf).withColumnRenamed("reconstruction_model", "model")
    out = co.tradeoff_ranking(quality, cost_rows(spark, sf), True, 0.7, 0.3, "mape")
    return rounded(out.select("model", "quality", "efficiency_score", "combined_score"))


@query("pareto_front", rsql(f"""WITH {TRADE} SELECT model, quality, efficiency_score FROM tr a WHERE NOT EXISTS (SELECT 1 FROM tr b
  WHERE b.quality <= a.quality AND b.efficiency_score <= a.efficiency_score AND (b.quality < a.quality OR b.efficiency_score < a.efficiency_score))""", "quality efficiency_score"))
def pareto_front(spark, sf):
    ranked = co.tradeoff_ranking(cost_rows(spark, sf), None, True).select("model", "quality", "efficiency_score")
    return rounded(co.pareto_front(ranked, "quality", "efficiency_score", True))


@query("pareto_front_rows", """SELECT o_orderkey, o_totalprice, age FROM (SELECT o_orderkey, o_totalprice, datediff('day', o_orderdate, TIMESTAMP '2002-01-01') AS age,
  max(o_totalprice) OVER (ORDER BY datediff('day', o_orderdate, TIMESTAMP '2002-01-01') RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  max(o_totalprice) OVER (PARTITION BY datediff('day', o_orderdate, TIMESTAMP '2002-01-01')) AS same FROM orders)
  WHERE o_totalprice = same AND (before IS NULL OR o_totalprice > before)""")
def pareto_front_rows(spark, sf):
    """Front over all single orders: high price, recent date."""
    from queries.fixtures import table

    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")).alias("age"))
    return co.pareto_front(o, "o_totalprice", "age", lower=False)


@query("compute_mix", rsql(f"""WITH {COST}, m AS (SELECT model, avg(time_seconds) AS time_seconds, avg(memory_mb) AS memory_mb, avg(cpu_cores_used) AS cpu_cores_used,
  coalesce(avg(gpu_memory_mb) / avg(gpu_memory_total_mb), 0) * 4 AS gpu_normalized FROM cost GROUP BY ALL)
SELECT *, cpu_cores_used + gpu_normalized AS combined_compute, CASE WHEN gpu_normalized > 0 THEN 'CPU+GPU' ELSE 'CPU only' END AS compute_type FROM m""",
                           "time_seconds memory_mb cpu_cores_used gpu_normalized combined_compute", 4))
def compute_mix(spark, sf):
    return rounded(co.compute_mix(cost_rows(spark, sf)), 4)


@query("cpu_gpu_melt", rsql(f"""WITH {COST}, m AS (SELECT model, avg(cpu_cores_used) AS c, coalesce(avg(gpu_percent), 0) AS g FROM cost GROUP BY ALL)
SELECT model, 'CPU Cores' AS resource_type, c AS usage, c + g / 100 * 4 AS combined FROM m UNION ALL SELECT model, 'GPU Utilization (%)', g, c + g / 100 * 4 FROM m""", "usage combined"))
def cpu_gpu_melt(spark, sf):
    return rounded(co.cpu_gpu_melt(cost_rows(spark, sf)))


@query("time_summary", rsql(f"WITH {COST} SELECT sum(time_seconds) AS total, avg(time_seconds) AS mean, min(time_seconds) AS min, max(time_seconds) AS max FROM cost", "total mean min max"))
def time_summary(spark, sf):
    return rounded(co.time_summary(cost_rows(spark, sf)))


for _name, _fn, _key in (("time_by_model", co.time_by_model, "model"), ("time_by_technique", co.time_by_technique, "technique"), ("time_by_rate", co.time_by_rate, "rate_percent")):
    def _make(fn):
        return lambda spark, sf: rounded(fn(cost_rows(spark, sf)))

    query(_name, rsql(f"""WITH {COST} SELECT {_key}, avg(time_seconds) AS mean, stddev_samp(time_seconds) AS std, min(time_seconds) AS min,
  max(time_seconds) AS max, count(*) AS count FROM cost GROUP BY ALL""", "mean std min max"))(_make(_fn))


@query("time_distribution", rsql(f"""WITH {COST} SELECT model, quantile_cont(memory_mb, 0) AS q0, quantile_cont(memory_mb, 0.25) AS q25, quantile_cont(memory_mb, 0.5) AS q50,
  quantile_cont(memory_mb, 0.75) AS q75, quantile_cont(memory_mb, 1) AS q100 FROM cost GROUP BY ALL""", "q0 q25 q50 q75 q100"))
def time_distribution(spark, sf):
    return rounded(co.time_distribution(cost_rows(spark, sf).withColumn("time_seconds", F.col("memory_mb"))))


@query("resource_by_model", rsql(f"""WITH {COST} SELECT model, avg(cpu_cores_used) AS cpu_mean, stddev_samp(cpu_cores_used) AS cpu_std, max(cpu_cores_used) AS cpu_max,
  avg(memory_mb) AS memory_mean, stddev_samp(memory_mb) AS memory_std, max(memory_mb) AS memory_max FROM cost GROUP BY ALL""",
                                 "cpu_mean cpu_std cpu_max memory_mean memory_std memory_max", 4))
def resource_by_model(spark, sf):
    return rounded(co.resource_by_model(cost_rows(spark, sf)), 4)


@query("resource_overall", rsql(f"""WITH {COST} SELECT avg(cpu_cores_used) AS cpu_mean, avg(memory_mb) AS memory_mean,
  (SELECT cpu_cores_total FROM cost GROUP BY ALL ORDER BY count(*) DESC, 1 LIMIT 1) AS cores_total FROM cost""", "cpu_mean memory_mean", 4))
def resource_overall(spark, sf):
    return rounded(co.resource_overall(cost_rows(spark, sf)), 4)


_TS = "avg(time_seconds) AS mean, stddev_samp(time_seconds) AS std, sum(time_seconds) AS total"


@query("training_time", rsql(f"WITH {TRAINING} SELECT model, {_TS} FROM training GROUP BY ALL", "mean std total"))
def training_time(spark, sf):
    return rounded(co.training_time(training_rows(spark, sf)))


@query("prediction_time", rsql(f"WITH {PRED} SELECT prediction_model AS model, {_TS} FROM pred GROUP BY ALL", "mean std total"))
def prediction_time(spark, sf):
    return rounded(co.prediction_time(pred_results(spark, sf)))


_TOT = f"""{TRAINING}, {PRED}, a AS (SELECT model, sum(time_seconds) AS t FROM training GROUP BY ALL),
b AS (SELECT prediction_model AS model, sum(time_seconds) AS p FROM pred GROUP BY ALL)"""


@query("total_time_outer_join", rsql(f"WITH {_TOT} SELECT coalesce(a.model, b.model) AS model, coalesce(t, 0) AS training_time, coalesce(p, 0) AS prediction_time "
                                     "FROM a FULL JOIN b ON a.model = b.model", "training_time prediction_time"))
def total_time_outer_join(spark, sf):
    a = training_rows(spark, sf).groupBy("model").agg(F.sum("time_seconds").alias("training_time"))
    b = pred_results(spark, sf).groupBy(F.col("prediction_model").alias("model")).agg(F.sum("time_seconds").alias("prediction_time"))
    return rounded(co.total_time_outer_join(a, b))


@query("total_time", rsql(f"WITH {_TOT} SELECT coalesce(a.model, b.model) AS model, coalesce(t, 0) AS training_time, coalesce(p, 0) AS prediction_time, "
                          "coalesce(t, 0) + coalesce(p, 0) AS total_time FROM a FULL JOIN b ON a.model = b.model", "training_time prediction_time total_time"))
def total_time(spark, sf):
    return rounded(co.total_time(training_rows(spark, sf), pred_results(spark, sf)))


@query("training_resources", rsql(f"""WITH {TRAINING} SELECT model, avg(cpu_cores_used) AS cpu_cores_used, avg(memory_mb) AS memory_mb, avg(gpu_percent) AS gpu_percent
  FROM training WHERE cpu_cores_used IS NOT NULL GROUP BY ALL""", "cpu_cores_used memory_mb gpu_percent", 4))
def training_resources(spark, sf):
    return rounded(co.training_resources(training_rows(spark, sf)), 4)


@query("prediction_resources", rsql(f"""WITH {PRED} SELECT prediction_model AS model, avg(cpu_cores_used) AS cpu_cores_used, avg(memory_mb) AS memory_mb,
  avg(gpu_percent) AS gpu_percent FROM pred GROUP BY ALL""", "cpu_cores_used memory_mb gpu_percent", 4))
def prediction_resources(spark, sf):
    return rounded(co.prediction_resources(pred_results(spark, sf)), 4)


@query("combined_usage", rsql(f"""WITH {TRAINING}, {PRED}, u AS (SELECT model, 'Training' AS phase, cpu_cores_used AS cpu_cores, coalesce(gpu_percent, 0) AS gpu_percent
  FROM training WHERE cpu_cores_used IS NOT NULL UNION ALL SELECT prediction_model, 'Prediction', avg(cpu_cores_used), coalesce(avg(gpu_percent), 0) FROM pred GROUP BY ALL)
SELECT *, greatest(cpu_cores + gpu_percent / 10, CAST(0.1 AS DOUBLE)) AS combined_score FROM u""", "cpu_cores gpu_percent combined_score"))
def combined_usage(spark, sf):
    return rounded(co.combined_usage(training_rows(spark, sf), pred_results(spark, sf)))


# ---- parameter sweep -------------------------------------------------------------------------------

_KL = ("list_sort(list_filter([{'d': pos - l3p, 'p': l3p, 'v': l3v}, {'d': pos - l2p, 'p': l2p, 'v': l2v}, {'d': pos - l1p, 'p': l1p, 'v': l1v}, "
       "{'d': r1p - pos, 'p': r1p, 'v': r1v}, {'d': r2p - pos, 'p': r2p, 'v': r2v}, {'d': r3p - pos, 'p': r3p, 'v': r3v}], lambda k: k.v IS NOT NULL))")
SWEEP = f"""{DEG}, {KNOTS}, nn AS (SELECT *, {_KL} AS near FROM kn WHERE value IS NULL AND truth IS NOT NULL),
tr AS (SELECT {DEG_KEYS}, truth AS t, CAST(k AS INTEGER) AS param, list_avg(list_transform(near[:k], lambda e: e.v)) AS p FROM nn, range(1, 4) g(k)),
sc AS (SELECT {DEG_KEYS}, param, avg(abs(t - p)) AS mad, sqrt(avg((t - p) * (t - p))) AS rmse, count(*) AS n_missing FROM tr WHERE p IS NOT NULL GROUP BY ALL)"""


@query("sweep_scores", rsql(f"WITH {SWEEP} SELECT series_id, param, mad, rmse, n_missing FROM sc", "mad rmse"))
def sweep_scores(spark, sf):
    out = sw.sweep_scores(ev_deg(spark, sf), [1, 2, 3], "knn_temporal", ["mad", "rmse"])
    return rounded(out.select("series_id", "param", "mad", "rmse", "n_missing"))


@query("sweep_best", rsql(f"""WITH {SWEEP}, a AS (SELECT param, avg(rmse) AS objective, count(rmse) AS n_cases FROM sc GROUP BY ALL)
SELECT 'knn_temporal' AS model, param, objective, objective AS metric_value, n_cases, (SELECT count(*) FROM a) AS n_tried FROM a ORDER BY objective, param LIMIT 1""",
                          "objective metric_value"))
def sweep_best(spark, sf):
    scores = sw.sweep_scores(ev_deg(spark, sf), [1, 2, 3], "knn_temporal", ["mad", "rmse"])
    return rounded(sw.sweep_best(scores, "rmse", True))


def _parabola(h: int) -> str:
    """The rolling fit with ``h`` rows on each side, as sums over the observed rows of a self join."""
    return f"""SELECT k.series_id, k.pos, {h} AS param, any_value(k.truth) AS t, count(*) FILTER (o.value IS NOT NULL) AS m, any_value(k.line) AS line,
  list({{'u': CAST(o.pos - k.pos AS DOUBLE), 'v': o.value}}) FILTER (o.value IS NOT NULL) AS ks
FROM kl k JOIN deg o ON o.series_id = k.series_id AND abs(o.pos - k.pos) <= {h} WHERE k.value IS NULL GROUP BY k.series_id, k.pos"""


_SUMS = ", ".join([f"list_sum(list_transform(us, lambda k: pow(k.u, {i}))) AS s{i}" for i in range(5)]
                  + [f"list_sum(list_transform(us, lambda k: k.v * pow(k.u, {i}))) AS t{i}" for i in range(3)])
_FIT = """coalesce(CASE WHEN m >= 3 THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2))
  / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))
  WHEN m = 2 THEN (t0 * s2 - s1 * t1) / (s0 * s2 - s1 * s1) WHEN m = 1 THEN t0 END, line)"""


@query("sweep_windows", rsql(f"""WITH {DEG}, {KNOTS}, kl AS (SELECT *, {_line('pos')} AS line FROM kn), w AS ({' UNION ALL '.join(_parabola(h) for h in (2, 4, 8))}),
u AS (SELECT *, list_max(list_transform(ks, lambda k: abs(k.u))) AS sc FROM w), n AS (SELECT *, list_transform(ks, lambda k: {{'u': k.u / sc, 'v': k.v}}) AS us FROM u),
f AS (SELECT *, {_SUMS} FROM n), p AS (SELECT series_id, param, t, {_FIT} AS p FROM f)
SELECT series_id, param, sqrt(avg((t - p) * (t - p))) AS rmse, count(*) AS n_missing FROM p WHERE p IS NOT NULL GROUP BY ALL""", "rmse", 5))
def sweep_windows(spark, sf):
    scores = sw.sweep_scores(ev_deg(spark, sf), [2, 4, 8], "spline", ["rmse"])
    return rounded(scores.select("series_id", "param", "rmse", "n_missing"), 5)
