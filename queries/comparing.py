"""Comparison queries on the result stand-ins (cost rows, forecast results)."""

from pyspark.sql import functions as F

from mendcast.operators import compare as cp
from queries import query
from queries.fixtures import COST, PRED, cost_rows, pred_results, rounded, rsql, table

SPREAD = "avg({m}) AS mean, stddev_samp({m}) AS std, min({m}) AS min, max({m}) AS max"
RECON = "source_type = 'reconstructed'"


def _spread(m):
    return SPREAD.format(m=m)


@query("overview", rsql(f"WITH {COST} SELECT count(*) AS n, avg(r2) AS mean, median(r2) AS median, max(r2) AS best, min(r2) AS worst FROM cost", "mean median best worst"))
def overview(spark, sf):
    return rounded(cp.overview(cost_rows(spark, sf), "r2", False))


@query("overview_best_model", rsql(f"""WITH {PRED}, g AS (SELECT reconstruction_model AS m, avg(mape) AS a, sum(mape) AS s, count(mape) AS c, count(*) AS n
  FROM pred WHERE {RECON} GROUP BY ALL) SELECT count(*) AS n_models, sum(s) / sum(c) AS mean, (SELECT m FROM g ORDER BY a, m LIMIT 1) AS best_model,
  min(a) AS best, CAST(sum(n) AS BIGINT) AS n FROM g""", "mean best"))
def overview_best_model(spark, sf):
    return rounded(cp.overview_best_model(pred_results(spark, sf), "mape", True))


def _stats(name, fn, key, source, where="true", metric="rmse"):
    cte = COST if source == "cost" else PRED

    @query(name, rsql(f"WITH {cte} SELECT {key}, {_spread(metric)} FROM {source} WHERE {where} GROUP BY ALL", "mean std min max"))
    def run(spark, sf):
        return rounded(fn((cost_rows if source == "cost" else pred_results)(spark, sf)))


_stats("stats_by_model", lambda r: cp.stats_by_model(r, "rmse", True, technique="R", rate=20), "model", "cost", "technique = 'R' AND rate_percent = 20")
_stats("stats_by_technique", lambda r: cp.stats_by_technique(r, "rmse", True, model="Brand#11"), "technique", "cost", "model = 'Brand#11'")
_stats("stats_by_rate", lambda r: cp.stats_by_rate(r, "rmse", technique="N"), "rate_percent", "cost", "technique = 'N'")
_stats("stats_by_recon_model", lambda r: cp.stats_by_model(r, "mape", True, key="reconstruction_model"), "reconstruction_model", "pred", RECON, "mape")
_stats("stats_pred_by_technique", lambda r: cp.stats_by_technique(r, "mape", True), "technique", "pred", RECON, "mape")
_stats("stats_pred_by_rate", lambda r: cp.stats_by_rate(r, "mape"), "rate_percent", "pred", RECON, "mape")


@query("stats_by_dataset", rsql(f"WITH {COST} SELECT dataset_name, avg(rmse) AS mean, stddev_samp(rmse) AS std FROM cost GROUP BY ALL", "mean std"))
def stats_by_dataset(spark, sf):
    return rounded(cp.stats_by_dataset(cost_rows(spark, sf), "rmse", True))


@query("stats_by_recon_dataset", rsql(f"WITH {PRED} SELECT reconstruction_model, dataset_name, avg(mape) AS mean, stddev_samp(mape) AS std FROM pred WHERE {RECON} GROUP BY ALL", "mean std"))
def stats_by_recon_dataset(spark, sf):
    return rounded(cp.stats_by_dataset(pred_results(spark, sf), "mape", True, ["reconstruction_model"]))


@query("stats_recon_by_technique", rsql(f"WITH {PRED} SELECT reconstruction_model, technique, avg(mape) AS mean FROM pred WHERE {RECON} GROUP BY ALL", "mean"))
def stats_recon_by_technique(spark, sf):
    return rounded(cp.stats_recon_by_technique(pred_results(spark, sf), "mape"))


@query("stats_recon_by_rate", rsql(f"WITH {PRED} SELECT reconstruction_model, rate_percent, avg(mape) AS mean FROM pred WHERE {RECON} AND technique = 'A' GROUP BY ALL", "mean"))
def stats_recon_by_rate(spark, sf):
    return rounded(cp.stats_recon_by_rate(pred_results(spark, sf), "mape", "A"))


@query("extended_leaderboard", rsql(f"""WITH {PRED}, g AS (SELECT reconstruction_model, {_spread('mape')}, median(mape) AS median, count(mape) AS n_predictions,
  count(DISTINCT dataset_name) AS n_datasets, count(DISTINCT prediction_model) AS n_pred_models FROM pred WHERE {RECON} GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY mean, reconstruction_model) AS INTEGER) AS rank, reconstruction_model, mean, median, std,
  std / nullif(mean, 0) * 100 AS cv_percent, min, max, mean - min(mean) OVER () AS delta_best, n_predictions, n_datasets, n_pred_models FROM g""",
    "mean median std min max").replace("SELECT * REPLACE (", "SELECT * REPLACE (round(cv_percent, 2) AS cv_percent, round(delta_best, 4) + CAST(0 AS DOUBLE) AS delta_best, "))
def extended_leaderboard(spark, sf):
    out = cp.extended_leaderboard(pred_results(spark, sf), "mape", True)
    return rounded(out.withColumn("cv_percent", F.col("cv_percent").cast("decimal(20,2)")).withColumn(
        "delta_best", F.col("delta_best").cast("decimal(20,4)"))).withColumn(
        "cv_percent", F.col("cv_percent").cast("double")).withColumn("delta_best", F.col("delta_best").cast("double"))


@query("summary_per_recon_model", rsql(f"WITH {PRED} SELECT reconstruction_model, {_spread('mape')}, median(mape) AS median, count(mape) AS n FROM pred WHERE {RECON} GROUP BY ALL",
                                       "mean std median min max", 4))
def summary_per_recon_model(spark, sf):
    return rounded(cp.summary_per_recon_model(pred_results(spark, sf), "mape", True, 9), 4)


@query("model_statistics", rsql(f"""WITH {COST} SELECT model, {_spread('r2')}, median(r2) AS median, count(r2) AS count,
  stddev_samp(r2) / sqrt(count(r2)) AS se FROM cost GROUP BY ALL""", "mean std median min max se"))
def model_statistics(spark, sf):
    return rounded(cp.model_statistics(cost_rows(spark, sf), "r2", False))


@query("forecaster_statistics", rsql(f"""WITH {PRED} SELECT prediction_model, {_spread('mape')}, median(mape) AS median, count(mape) AS count,
  stddev_samp(mape) / sqrt(count(mape)) AS se FROM pred GROUP BY ALL""", "mean std median min max se"))
def forecaster_statistics(spark, sf):
    return rounded(cp.model_statistics(pred_results(spark, sf), "mape", True, "prediction_model"))


# ---- pivots ----------------------------------------------------------------------------------------

TECH = ("A", "N", "R")
RATES = (10, 20, 30, 40, 50, 60)
_TCOLS = ", ".join(f"avg({{m}}) FILTER (technique = '{t}') AS \"{t}\"" for t in TECH)
_RCOLS = ", ".join(f"avg(mape) FILTER (rate_percent = {r}) AS \"{r}\"" for r in RATES)


@query("pivot_model_technique", rsql(f"WITH {COST} SELECT model, {_TCOLS.format(m='rmse')} FROM cost GROUP BY ALL", "A N R"))
def pivot_model_technique(spark, sf):
    return rounded(cp.pivot_model_technique(cost_rows(spark, sf), "rmse", sort_by="R", values=TECH))


@query("pivot_recon_technique", rsql(f"WITH {PRED}, w AS (SELECT reconstruction_model, {_TCOLS.format(m='mape')} FROM pred WHERE {RECON} GROUP BY ALL) "
                                     "SELECT *, list_avg([\"A\", \"N\", \"R\"]) AS row_mean FROM w", "A N R row_mean"))
def pivot_recon_technique(spark, sf):
    return rounded(cp.pivot_recon_technique(pred_results(spark, sf), "mape", values=TECH))


@query("pivot_recon_rate", rsql(f"WITH {PRED}, w AS (SELECT reconstruction_model, {_RCOLS} FROM pred WHERE {RECON} AND technique = 'A' GROUP BY ALL) "
                                f"SELECT *, list_avg([{', '.join(chr(34) + str(r) + chr(34) for r in RATES)}]) AS row_mean FROM w",
                                " ".join(map(str, RATES)) + " row_mean"))
def pivot_recon_rate(spark, sf):
    return rounded(cp.pivot_recon_rate(pred_results(spark, sf), "mape", "A", values=RATES))


_BR = tuple(f"Brand#{i}" for i in range(1, 26))


@query("pivot_pred_recon", rsql(f"WITH {PRED} SELECT prediction_model, " + ", ".join(
    f"avg(mape) FILTER (reconstruction_model = '{b}') AS \"{b}\"" for b in _BR) + f" FROM pred WHERE {RECON} GROUP BY ALL", " ".join(_BR)))
def pivot_pred_recon(spark, sf):
    return rounded(cp.pivot_pred_recon(pred_results(spark, sf), "mape", sort_by="Brand#11", values=_BR))


@query("pivot_pred_recon_count", f"WITH {PRED} SELECT prediction_model, " + ", ".join(
    f"nullif(count(mape) FILTER (reconstruction_model = '{b}'), 0) AS \"{b}\"" for b in _BR) + f" FROM pred WHERE {RECON} GROUP BY ALL")
def pivot_pred_recon_count(spark, sf):
    return cp.pivot_pred_recon(pred_results(spark, sf), "mape", "count", values=_BR)


@query("row_best_worst_flags", rsql(f"""WITH {COST}, l AS (SELECT technique AS row, model, avg(rmse) AS value FROM cost GROUP BY ALL),
  e AS (SELECT *, min(value) OVER (PARTITION BY row) AS lo, max(value) OVER (PARTITION BY row) AS hi FROM l)
SELECT row, model, value, abs(value - lo) <= 1e-6 OR lo = hi AS best, abs(value - hi) <= 1e-6 AND lo <> hi AS worst FROM e""", "value"))
def row_best_worst_flags(spark, sf):
    long = cost_rows(spark, sf).groupBy(F.col("technique").alias("row"), "model").agg(F.avg("rmse").alias("value"))
    return rounded(cp.row_best_worst_flags(long, True))


@query("best_worst_topk", rsql(f"""WITH {PRED}, g AS (SELECT reconstruction_model, avg(mape) AS mean FROM pred WHERE {RECON} GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (ORDER BY mean, reconstruction_model) AS r, count(*) OVER () AS n FROM g)
SELECT 'best' AS side, CAST(r AS INTEGER) AS place, reconstruction_model, mean FROM r
UNION ALL SELECT 'worst', CAST(n - r + 1 AS INTEGER), reconstruction_model, mean FROM r""", "mean"))
def best_worst_topk(spark, sf):
    return rounded(cp.best_worst_topk(pred_results(spark, sf), "mape", True, key="reconstruction_model"))


@query("iteration_series", rsql(f"WITH {PRED} SELECT prediction_model, prediction_iteration, avg(mape) AS mean FROM pred GROUP BY ALL", "mean"))
def iteration_series(spark, sf):
    return rounded(cp.iteration_series(pred_results(spark, sf), "mape"))


@query("iteration_variance", rsql(f"WITH {PRED} SELECT prediction_model, {_spread('mape')}, round(stddev_samp(mape) / nullif(avg(mape), 0) * 100, 2) AS cv FROM pred GROUP BY ALL", "mean std min max"))
def iteration_variance(spark, sf):
    out = cp.iteration_variance(pred_results(spark, sf), "mape").withColumn("cv", F.col("cv").cast("decimal(20,2)"))
    return rounded(out).withColumn("cv", F.col("cv").cast("double"))


@query("prediction_rows", f"""WITH {PRED} SELECT dataset_name AS dataset, technique, rate_percent AS rate, reconstruction_model AS recon_model,
  prediction_model AS pred_model, prediction_iteration AS pred_iter, mape, n_samples FROM pred WHERE mape IS NOT NULL
  ORDER BY reconstruction_model NULLS LAST, prediction_model, dataset_name, technique NULLS LAST, rate_percent NULLS LAST, prediction_iteration, mape, n_samples""")
def prediction_rows(spark, sf):
    return cp.prediction_rows(pred_results(spark, sf), "mape")


@query("raw_browser", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE contains(CAST(s_suppkey AS VARCHAR), '7') OR contains(lower(s_name), '7') "
                      "OR contains(CAST(s_nationkey AS VARCHAR), '7') OR contains(CAST(s_acctbal AS VARCHAR), '7')")
def raw_browser(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return cp.raw_browser(df, "7", "s_acctbal", asc=False)


@query("distinct_filter_values", f"""WITH {PRED} SELECT DISTINCT 'technique' AS dim, technique AS value FROM pred WHERE technique IS NOT NULL
UNION ALL SELECT DISTINCT 'rate_percent', CAST(rate_percent AS VARCHAR) FROM pred WHERE rate_percent IS NOT NULL
UNION ALL SELECT DISTINCT 'prediction_model', prediction_model FROM pred""")
def distinct_filter_values(spark, sf):
    return cp.distinct_filter_values(pred_results(spark, sf), ["technique", "rate_percent", "prediction_model"])


# ---- significance ----------------------------------------------------------------------------------

# quantities per brand differ just enough for all codes to occur; R2 is replaced by a brand-shifted value
SHIFTED = f"{COST}, sh AS (SELECT model, time_seconds + CAST(substr(model, 7, 1) AS INTEGER) * CAST(0.4 AS DOUBLE) AS v FROM cost)"
def _ttest_sql(rows: str) -> str:
    """Pooled t-tests of ``sh`` (model, v), p by the finite cosine series."""
    return f"""{rows}, g AS (SELECT model, count(v) AS n, avg(v) AS mean, var_samp(v) AS var FROM sh GROUP BY ALL),
pr AS (SELECT a.model AS model_a, b.model AS model_b, a.mean AS mean_a, b.mean AS mean_b, a.n + b.n - 2 AS df,
  (a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2) * (CAST(1 AS DOUBLE) / a.n + CAST(1 AS DOUBLE) / b.n)) AS t
  FROM g a, g b WHERE a.model <> b.model),
th AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM pr),
pv AS (SELECT *, greatest(0, 1 - CASE WHEN df % 2 = 0 THEN sin(th) * list_sum(list_transform(range(0, df // 2),
    lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + 2 * k * ln(cos(th)))))
  ELSE 2 / pi() * (th + sin(th) * list_sum(list_transform(range(0, (df - 1) // 2),
    lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + 0.5 * ln(pi()) - ln(2) + (2 * k + 1) * ln(cos(th)))))) END) AS p FROM th),
cd AS (SELECT *, CAST(CASE WHEN p < 0.01 THEN 2 WHEN p < 0.05 THEN 1 ELSE 0 END * CASE WHEN mean_a < mean_b THEN 1 ELSE -1 END AS INTEGER) AS code FROM pv)"""


TTEST = _ttest_sql(SHIFTED)


def _tests(spark, sf):
    c = cost_rows(spark, sf).select("model", (F.col("time_seconds") + F.substring("model", 7, 1).cast("int") * 0.4).alias("v"))
    return cp.pairwise_ttest(c, "v")


def _codes(spark, sf):
    return cp.significance_codes(_tests(spark, sf), True)


@query("model_pairs", rsql(f"WITH {TTEST} SELECT model_a, model_b, mean_a, mean_b FROM pr", "mean_a mean_b"))
def model_pairs(spark, sf):
    c = cost_rows(spark, sf).select("model", (F.col("time_seconds") + F.substring("model", 7, 1).cast("int") * 0.4).alias("v"))
    return rounded(cp.model_pairs(c.groupBy("model").agg(F.avg("v").alias("mean"))))


@query("pairwise_ttest", rsql(f"WITH {TTEST} SELECT model_a, model_b, t, p FROM pv", "t p"))
def pairwise_ttest(spark, sf):
    return rounded(_tests(spark, sf).select("model_a", "model_b", "t", "p"))


# three groups with some ten thousand values each
WIDE = "sh AS (SELECT l_returnflag AS model, l_quantity + CASE l_returnflag WHEN 'A' THEN CAST(0.3 AS DOUBLE) ELSE 0 END AS v FROM lineitem)"


@query("pairwise_ttest_many_values", rsql(f"WITH {_ttest_sql(WIDE)} SELECT model_a, model_b, t, p FROM pv", "t p"))
def pairwise_ttest_many_values(spark, sf):
    v = F.col("l_quantity") + F.when(F.col("l_returnflag") == "A", 0.3).otherwise(0)
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), v.alias("v"))
    return rounded(cp.pairwise_ttest(rows, "v").select("model_a", "model_b", "t", "p"))


@query("significance_codes", f"WITH {TTEST} SELECT model_a, model_b, code FROM cd")
def significance_codes(spark, sf):
    return _codes(spark, sf).select("model_a", "model_b", "code")


_MX = _BR


@query("significance_matrix", f"WITH {TTEST} SELECT model_a, " + ", ".join(
    f"coalesce(max(code) FILTER (model_b = '{b}'), 0) AS \"{b}\"" for b in _MX) + " FROM cd GROUP BY model_a")
def significance_matrix(spark, sf):
    return cp.significance_matrix(_codes(spark, sf), "code", _MX)


@query("significance_summary", f"""WITH {TTEST} SELECT model_a AS model, count(*) FILTER (code = 2) AS better_p001, count(*) FILTER (code = 1) AS better_p005,
  count(*) FILTER (code = 0) AS no_difference, count(*) FILTER (code = -1) AS worse_p005, count(*) FILTER (code = -2) AS worse_p001 FROM cd GROUP BY ALL""")
def significance_summary(spark, sf):
    return cp.significance_summary(_codes(spark, sf))


@query("significance_text", f"""WITH {TTEST} SELECT model_a, model_b, CASE code WHEN 2 THEN '+2 (p<0.01)' WHEN 1 THEN '+1 (p<0.05)' WHEN 0 THEN '0'
  WHEN -1 THEN '-1 (p<0.05)' ELSE '-2 (p<0.01)' END AS label FROM cd""")
def significance_text(spark, sf):
    return _codes(spark, sf).select("model_a", "model_b", cp.significance_text("code").alias("label"))
