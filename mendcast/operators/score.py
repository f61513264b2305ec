"""Scoring of repairs and forecasts as one grouped aggregate per request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from mendcast.functions.metrics import PRED_METRICS, RECON_METRICS, choose_metrics, metric_columns, pred_aux, recon_aux
from mendcast.layout import BLOCK, config_keys, with_observed_rank, with_halo

PREDICTION_KEYS = (
    "series_id", "source_type", "technique", "rate_percent", "reconstruction_iteration",
    "reconstruction_model", "prediction_model", "prediction_iteration",
)


def align_positional(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zips two series by position; the inner join truncates to the shorter one."""
    left = a.select(*keys, "pos", F.col("value").alias("a_value"))
    right = b.select(*keys, "pos", F.col("value").alias("b_value"))
    return left.join(right, [*keys, "pos"])


def align_by_index(truth: DataFrame, degraded: DataFrame, repaired: DataFrame) -> DataFrame:
    """Rows whose time stamp occurs in all three; missing in degraded, present in the other two."""
    rk, dk = config_keys(repaired), config_keys(degraded)
    t = truth.select("series_id", "ts", F.col("value").alias("t"))
    d = degraded.where(F.col("value").isNull()).select(*dk, "ts")
    r = repaired.select(*rk, "ts", F.col("value").alias("p"))
    return (
        r.where(F.col("p").isNotNull()).join(d, [*dk, "ts"])
        .join(t.where(F.col("t").isNotNull()), ["series_id", "ts"])
        .select(*rk, "ts", "t", "p")
    )


def scoring_pairs(truth: DataFrame, degraded: DataFrame, repaired: DataFrame) -> DataFrame:
    """Pairs (t, p) at the positions missing in ``degraded`` where truth and repair are both present.

    All joins carry the position in their key, so a long series is spread evenly.
    """
    rk, dk = config_keys(repaired), config_keys(degraded)
    t = truth.where(F.col("value").isNotNull()).select("series_id", "pos", F.col("value").alias("t"))
    d = degraded.where(F.col("value").isNull()).select(*dk, "pos")
    r = repaired.where(F.col("value").isNotNull()).select(*rk, "pos", F.col("value").alias("p"))
    return d.join(t, ["series_id", "pos"]).join(r, [*dk, "pos"]).select(*rk, "pos", "t", "p")


def pairs_from_truth(repaired: DataFrame) -> DataFrame:
    """Same pairs without any join, for points that carry ``truth`` and the pre-repair ``masked`` flag."""
    rk = config_keys(repaired)
    return repaired.where(
        F.col("masked") & F.col("truth").isNotNull() & F.col("value").isNotNull()
    ).select(*rk, "pos", F.col("truth").alias("t"), F.col("value").alias("p"))


def unscored(repaired: DataFrame, pairs: DataFrame) -> DataFrame:
    """Configurations without a single valid pair, as error rows."""
    rk = config_keys(repaired)
    return (
        repaired.select(*rk).distinct().join(pairs.select(*rk).distinct(), rk, "left_anti")
        .withColumn("error", F.lit("no missing position with both values"))
    )


def score_reconstruction(
    pairs: DataFrame, keys: Sequence[str] = (), primary: str | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """Metrics per configuration. ``totals`` (keys, n_total) adds the series length."""
    from mendcast.plans.registry import add_custom_metrics

    by = config_keys(pairs)
    wanted = choose_metrics(keys, RECON_METRICS, primary)
    t, p = F.col("t"), F.col("p")
    out = pairs.groupBy(*by).agg(
        *metric_columns(wanted, RECON_METRICS, t, p), *recon_aux(t, p), F.count("*").alias("n_missing")
    )
    out = add_custom_metrics(out, pairs, by, [RECON_METRICS[k] for k in wanted])
    if totals is not None:
        shared = config_keys(totals)
        out = out.join(totals.select(*shared, "n_total"), shared, "left")
    return out


def mase_scale(train: DataFrame, block: int = BLOCK) -> DataFrame:
    """Mean absolute first difference of the observed training values per series."""
    keys = config_keys(train)
    ranked = with_observed_rank(train.select(*keys, "pos", "value"), block)
    w = W.partitionBy(*keys, "block").orderBy("rank")
    step = F.col("value") - F.lag("value").over(w)
    return (
        with_halo(ranked, 1, 0, block, by="rank").withColumn("_d", F.abs(step)).where(~F.col("halo"))
        .groupBy(*keys).agg(F.avg("_d").alias("scale"))
    )


def pred_mase(pairs: DataFrame, train: DataFrame | None, block: int = BLOCK) -> DataFrame:
    """MAE over the training scale; missing without train or with a scale under 1e-12."""
    by = prediction_keys(pairs)
    mae = pairs.groupBy(*by).agg(F.avg(F.abs(F.col("t") - F.col("p"))).alias("_mae"))
    if train is None:
        return mae.select(*by, F.lit(None).cast("double").alias("mase"))
    scale = mase_scale(train, block)
    return mae.join(scale, config_keys(train), "left").select(
        *by, F.when(F.col("scale") >= 1e-12, F.col("_mae") / F.col("scale")).alias("mase")
    )


def prediction_keys(df: DataFrame) -> list[str]:
    return [c for c in PREDICTION_KEYS if c in df.columns]


def score_prediction(
    pairs: DataFrame, train: DataFrame | None = None, keys: Sequence[str] = (), block: int = BLOCK
) -> DataFrame:
    """Forecast metrics per configuration; only MASE needs the training series."""
    from mendcast.plans.registry import add_custom_metrics

    by = prediction_keys(pairs)
    wanted = choose_metrics(keys, PRED_METRICS)
    t, p = F.col("t"), F.col("p")
    valid = pairs.where(t.isNotNull() & p.isNotNull())
    out = valid.groupBy(*by).agg(
        *metric_columns(wanted, PRED_METRICS, t, p), *pred_aux(t, p), F.avg(F.abs(t - p)).alias("_mae")
    )
    if "mase" in wanted:
        if train is None:
            out = out.withColumn("mase", F.lit(None).cast("double"))
        else:
            out = (
                out.join(mase_scale(train, block), config_keys(train), "left")
                .withColumn("mase", F.when(F.col("scale") >= 1e-12, F.col("_mae") / F.col("scale")))
                .drop("scale")
            )
    return add_custom_metrics(out.drop("_mae"), valid, by, [PRED_METRICS[k] for k in wanted], train)


def attach_truth(
    preds: DataFrame, test: DataFrame, train: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Predictions with their test value (same series and step) and error rows for unknown series."""
    truth = test.select("series_id", "step", F.col("value").alias("t"))
    pairs = preds.withColumnRenamed("predicted", "p").join(truth, ["series_id", "step"])
    known = test.select("series_id").distinct()
    by = prediction_keys(preds)
    errors = (
        preds.select(*by).distinct().join(known, "series_id", "left_anti")
        .withColumn("error", F.lit("no test series"))
    )
    if train is not None:
        has = train.select("series_id").distinct().withColumn("has_train", F.lit(True))
        pairs = pairs.join(has, "series_id", "left").fillna(False, ["has_train"])
    return pairs, errors


def attach_perf_recon(results: DataFrame, perf: DataFrame) -> DataFrame:
    """Resource columns by the five-part repair key; absent stays missing."""
    keys = ["dataset_name", "technique", "rate_percent", "iteration", "model"]
    return results.join(perf, keys, "left")


def attach_perf_pred(results: DataFrame, perf: DataFrame) -> DataFrame:
    """Resource columns by the eight-part forecast key; missing parts match missing parts."""
    keys = [
        "dataset_name", "source_type", "technique", "rate_percent", "reconstruction_iteration",
        "reconstruction_model", "prediction_model", "prediction_iteration",
    ]
    ints = ["rate_percent", "reconstruction_iteration", "prediction_iteration"]

    def tidy(df):
        for c in ints:
            df = df.withColumn(c, F.expr(f"try_cast(try_cast(`{c}` AS DOUBLE) AS INT)"))
        return df.withColumn("prediction_iteration", F.coalesce("prediction_iteration", F.lit(1)))

    left, right = tidy(results).alias("l"), tidy(perf).alias("r")
    same = None
    for k in keys:
        one = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        same = one if same is None else same & one
    extra = [c for c in perf.columns if c not in keys]
    return left.join(right, same, "left").select("l.*", *[F.col(f"r.{c}") for c in extra])
