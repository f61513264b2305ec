"""Parameter sweeps over repair methods: all parameter sets of a method in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from mendcast.functions import curves
from mendcast.functions.metrics import RECON_METRICS, choose_metrics, metric_columns, optimization_loss, recon_aux
from mendcast.layout import BLOCK, config_keys, with_knots
from mendcast.operators.repair import _rolling_rows

PARAMETER = {"knn_temporal": "k", "spline": "half_window"}


def sweep_scores(
    degraded: DataFrame, params: Sequence[int], model: str, metrics: Sequence[str] = (), axis: str = "pos",
    block: int = BLOCK,
) -> DataFrame:
    """Metric rows for every parameter value and configuration of ``degraded`` (with ``truth``).

    The neighbourhood for the largest value is prepared once; smaller values read a part of it. Points a
    value cannot fill, and configurations without a valid pair, are skipped.
    """
    keys = config_keys(degraded)
    values = sorted({int(p) for p in params})
    if model not in PARAMETER or not values or values[0] < 1:
        raise ValueError(f"sweepable: {PARAMETER}, positive values")
    slim = degraded.select(*keys, "pos", "x", "value", "truth")
    if model == "knn_temporal":
        rows = with_knots(slim, values[-1], block)
        fills = {v: curves.knn_temporal(v) for v in values}
    else:
        rows = with_knots(_rolling_rows(slim, values[-1], block), 1, block).withColumnRenamed("_near", "_all")
        fills = None
    rows = rows.where(F.col("value").isNull() & F.col("truth").isNotNull())
    if fills is not None:
        fan = F.array(*[F.struct(F.lit(v).alias("param"), f.alias("p")) for v, f in fills.items()])
        tried = rows.withColumn("_f", F.explode(fan)).select(*keys, "truth", "_f.param", "_f.p")
    else:
        tried = (
            rows.withColumn("param", F.explode(F.array(*[F.lit(v) for v in values])))
            .withColumn("_near", F.filter("_all", lambda k: F.abs(k["pos"] - F.col("pos")) <= F.col("param")))
            .withColumn("p", F.coalesce(curves.local_quadratic(axis), curves.linear(axis)))
            .select(*keys, "truth", "param", "p")
        )
    t, p = F.col("truth"), F.col("p")
    wanted = choose_metrics(metrics, RECON_METRICS)
    valid = tried.where(p.isNotNull() & ~F.isnan(p))
    return valid.groupBy(*keys, "param").agg(
        *metric_columns(wanted, RECON_METRICS, t, p), *recon_aux(t, p), F.count("*").alias("n_missing")
    ).withColumn("model", F.lit(model))


def sweep_best(scores: DataFrame, metric: str, lower: bool) -> DataFrame:
    """Per model the parameter of the smallest mean finite loss (smaller parameter on ties)."""
    loss = optimization_loss(metric, lower)
    finite = F.when(F.abs(loss) < F.lit(float("inf")), loss)
    means = scores.groupBy("model", "param").agg(
        F.coalesce(F.avg(finite), F.lit(float("inf"))).alias("objective"), F.count(finite).alias("n_cases")
    )
    best = means.groupBy("model").agg(
        F.min(F.struct("objective", "param", "n_cases")).alias("_b"), F.count("*").alias("n_tried")
    )
    return best.select(
        "model", "_b.param", "_b.objective",
        (F.col("_b.objective") if lower else -F.col("_b.objective")).alias("metric_value"), "_b.n_cases", "n_tried",
    )
