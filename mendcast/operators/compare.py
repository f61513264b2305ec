"""Comparison of methods: leaderboards, pivots, iteration spread and significance tests.

Result tables have one row per configuration and may be large and unevenly spread over models, so
everything starts with a partial aggregate. Rankings and pairings run on the aggregated tables, whose
size is the number of methods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mendcast.functions.percentiles import exact_median
from mendcast.functions.ttest import two_sided_p


def _reconstructed(df: DataFrame) -> DataFrame:
    return df.where(F.col("source_type") == "reconstructed") if "source_type" in df.columns else df


def _direction(col: str, lower: bool) -> Column:
    return F.asc_nulls_last(col) if lower else F.desc_nulls_last(col)


def _spread(metric: str, *, median: bool = False) -> list[Column]:
    m = F.col(metric)
    return [
        F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"), F.min(m).alias("min"), F.max(m).alias("max"),
    ]


def _with_median(stats: DataFrame, df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    return stats.join(exact_median(df, keys, metric), keys, "left") if keys else stats


def _best(c: Column, lower: bool) -> Column:
    return F.min(c) if lower else F.max(c)


# ---- overviews -------------------------------------------------------------------------------------

def overview(results: DataFrame, metric: str, lower: bool) -> DataFrame:
    """Record count, mean, exact median, best and worst by direction (one row)."""
    m = F.col(metric)
    base = results.agg(
        F.count("*").alias("n"), F.avg(m).alias("mean"), _best(m, lower).alias("best"), _best(m, not lower).alias("worst")
    )
    median = exact_median(results, [], metric).scalar()
    return base.withColumn("median", median)


def overview_best_model(pred_results: DataFrame, metric: str, lower: bool) -> DataFrame:
    """Number of repair models, overall mean, and the model with the best mean (first name on ties)."""
    df = _reconstructed(pred_results).where(F.col("reconstruction_model").isNotNull())
    by = df.groupBy("reconstruction_model").agg(
        F.avg(metric).alias("mean"), F.sum(metric).alias("_s"), F.count(metric).alias("_c"), F.count("*").alias("_n")
    )
    sign = F.col("mean") if lower else -F.col("mean")
    return by.agg(
        F.count("*").alias("n_models"),
        (F.sum("_s") / F.sum("_c")).alias("mean"),
        F.min_by("reconstruction_model", F.when(F.col("mean").isNotNull(), F.struct(sign, "reconstruction_model")))
        .alias("best_model"),
        _best(F.col("mean"), lower).alias("best"),
        F.sum("_n").alias("n"),
    )


def run_summary(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """mean / median / min / max per metric over all runs, one row per metric."""
    long = results.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
        .alias("_e")
    ).select("_e.*").where(F.col("v").isNotNull())
    stats = long.groupBy("metric").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    return stats.join(exact_median(long, ["metric"], "v"), "metric").select("metric", "mean", "median", "min", "max")


def summary_by(results: DataFrame, key: str, primary: str) -> DataFrame:
    """Mean of the primary metric and row count per source type or forecaster."""
    return results.groupBy(key).agg(F.avg(primary).alias("mean"), F.count("*").alias("n"))


def distinct_filter_values(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Distinct non-missing values of each dimension in one pass: ``dim, value``."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    return (
        df.select(F.explode(pairs).alias("_p")).select("_p.*").where(F.col("value").isNotNull())
        .distinct().orderBy("dim", "value")
    )


# ---- statistics per method -------------------------------------------------------------------------

def _stats(df, keys, metric, order):
    return df.dropna(subset=keys).groupBy(*keys).agg(*_spread(metric)).orderBy(*order)


def stats_by_model(results, metric, lower, technique=None, rate=None, key="model") -> DataFrame:
    from mendcast.operators.clean import local_filter

    df = local_filter(_reconstructed(results), technique=technique, rate_percent=rate)
    return _stats(df, [key], metric, [_direction("mean", lower), key])


def stats_by_technique(results, metric, lower, model=None, rate=None, key="model") -> DataFrame:
    from mendcast.operators.clean import local_filter

    df = local_filter(_reconstructed(results), **{key: model, "rate_percent": rate})
    return _stats(df, ["technique"], metric, [_direction("mean", lower), "technique"])


def stats_by_rate(results, metric, model=None, technique=None, key="model") -> DataFrame:
    from mendcast.operators.clean import local_filter

    df = local_filter(_reconstructed(results), **{key: model, "technique": technique})
    return _stats(df, ["rate_percent"], metric, ["rate_percent"])


def stats_by_dataset(results, metric, lower, extra: Sequence[str] = ()) -> DataFrame:
    """Mean and deviation by dataset, or by repair model and dataset with ``extra``."""
    keys = [*extra, "dataset_name"]
    return results.dropna(subset=keys).groupBy(*keys).agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std")
    ).orderBy(_direction("mean", lower), *keys)


def stats_recon_by_technique(r, metric) -> DataFrame:
    return _reconstructed(r).dropna(subset=["reconstruction_model", "technique"]).groupBy(
        "reconstruction_model", "technique"
    ).agg(F.avg(metric).alias("mean"))


def stats_recon_by_rate(r, metric, technique=None) -> DataFrame:
    from mendcast.operators.clean import local_filter

    return local_filter(_reconstructed(r), technique=technique).dropna(
        subset=["reconstruction_model", "rate_percent"]
    ).groupBy("reconstruction_model", "rate_percent").agg(F.avg(metric).alias("mean"))


def extended_leaderboard(pred_results: DataFrame, metric: str, lower: bool) -> DataFrame:
    """Spread, counts, CV%, rank and distance to the best mean per repair model."""
    df = _reconstructed(pred_results).where(F.col("reconstruction_model").isNotNull())
    key = ["reconstruction_model"]
    stats = df.groupBy(*key).agg(
        *_spread(metric), F.count(metric).alias("n_predictions"),
        F.countDistinct("dataset_name").alias("n_datasets"),
        F.countDistinct("prediction_model").alias("n_pred_models"),
    )
    stats = _with_median(stats, df, key, metric)
    # one row per model from here on
    best = F.min("mean").over(W.partitionBy()) if lower else F.max("mean").over(W.partitionBy())
    order = W.orderBy(_direction("mean", lower), "reconstruction_model")
    gap = F.col("mean") - best if lower else best - F.col("mean")
    return stats.select(
        F.row_number().over(order).alias("rank"), "reconstruction_model", "mean", "median", "std",
        F.round(F.col("std") / F.nullif("mean", F.lit(0.0)) * 100, 2).alias("cv_percent"), "min", "max",
        F.round(gap, 4).alias("delta_best"), "n_predictions", "n_datasets", "n_pred_models",
    ).orderBy("rank")


def summary_per_recon_model(pred_results: DataFrame, metric: str, lower: bool, decimals: int = 4) -> DataFrame:
    df = _reconstructed(pred_results).where(F.col("reconstruction_model").isNotNull())
    key = ["reconstruction_model"]
    stats = _with_median(df.groupBy(*key).agg(*_spread(metric), F.count(metric).alias("n")), df, key, metric)
    return stats.orderBy(_direction("mean", lower), *key).select(
        *key, *[F.round(c, decimals).alias(c) for c in ("mean", "std", "median", "min", "max")], "n"
    )


def model_statistics(results: DataFrame, metric: str, lower: bool, key: str = "model") -> DataFrame:
    """Spread with median, count and standard error per model."""
    df = results.where(F.col(key).isNotNull())
    stats = _with_median(df.groupBy(key).agg(*_spread(metric), F.count(metric).alias("count")), df, [key], metric)
    return stats.select(
        key, "mean", "std", "median", "min", "max", "count", (F.col("std") / F.sqrt("count")).alias("se")
    ).orderBy(_direction("mean", lower), key)


# ---- pivots ----------------------------------------------------------------------------------------

def _pivot(df: DataFrame, row: str, column: str, values: Sequence, metric: str, agg: str = "avg") -> DataFrame:
    """Wide form of the aggregated table; its columns are ``values`` or else all that the small aggregated table has."""
    long = df.dropna(subset=[row, column]).groupBy(row, column).agg(getattr(F, agg)(metric).alias("_v"))
    names = list(values) or [r[0] for r in long.select(column).distinct().orderBy(column).collect()]
    return long.groupBy(row).pivot(column, names).agg(F.first("_v", ignorenulls=True))


def pivot_model_technique(
    results, metric, sort_by=None, lower=True, row="model", values: Sequence = ()
) -> DataFrame:
    wide = _pivot(_reconstructed(results), row, "technique", values, metric)
    return wide.orderBy(_direction(sort_by, lower), row) if sort_by in wide.columns else wide.orderBy(row)


def _by_row_mean(wide: DataFrame, row: str, lower: bool) -> DataFrame:
    cells = F.array_compact(F.array(*[F.col(f"`{c}`") for c in wide.columns if c != row]))
    mean = F.aggregate(cells, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(cells), F.lit(0))
    return wide.withColumn("row_mean", mean).orderBy(_direction("row_mean", lower), row)


def pivot_recon_technique(r, metric, lower=True, values: Sequence = ()) -> DataFrame:
    wide = _pivot(_reconstructed(r), "reconstruction_model", "technique", values, metric)
    return _by_row_mean(wide, "reconstruction_model", lower)


def pivot_recon_rate(r, metric, technique=None, lower=True, values: Sequence = ()) -> DataFrame:
    from mendcast.operators.clean import local_filter

    df = local_filter(_reconstructed(r), technique=technique)
    return _by_row_mean(_pivot(df, "reconstruction_model", "rate_percent", values, metric), "reconstruction_model", lower)


def pivot_pred_recon(pred_results, metric, agg="avg", sort_by=None, lower=True, values: Sequence = ()) -> DataFrame:
    """Forecaster x repair model, mean or count."""
    wide = _pivot(_reconstructed(pred_results), "prediction_model", "reconstruction_model", values, metric, agg)
    if sort_by in wide.columns:
        return wide.orderBy(_direction(sort_by, lower), "prediction_model")
    return wide.orderBy("prediction_model")


def row_best_worst_flags(pivot_long: DataFrame, lower: bool, tol: float = 1e-6, row="row", value="value") -> DataFrame:
    """Per row of a matrix in long form: ``best`` / ``worst`` within ``tol``; an all-equal row is best only."""
    ends = pivot_long.groupBy(row).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    good, bad = ("_lo", "_hi") if lower else ("_hi", "_lo")
    flat = F.col("_lo") == F.col("_hi")
    near = lambda c: F.abs(F.col(value) - F.col(c)) <= tol
    return (
        pivot_long.join(ends, row)
        .withColumn("best", F.coalesce(near(good) | flat, F.lit(False)) & F.col(value).isNotNull())
        .withColumn("worst", F.coalesce(near(bad) & ~flat, F.lit(False)) & F.col(value).isNotNull())
        .drop("_lo", "_hi")
    )


def best_worst_topk(results: DataFrame, metric: str, lower: bool, k: int | None = None, key="model") -> DataFrame:
    """Every model with its place from both ends of the sorted means; ``k`` keeps the first places of either end."""
    means = _reconstructed(results).dropna(subset=[key]).groupBy(key).agg(F.avg(metric).alias("mean")).where(
        F.col("mean").isNotNull()
    )
    order = W.orderBy(_direction("mean", lower), key)  # one row per model
    n = F.count("*").over(W.partitionBy())
    ranked = means.withColumn("_r", F.row_number().over(order)).withColumn("_n", n)
    sides = F.array(
        F.struct(F.lit("best").alias("side"), F.col("_r").alias("place")),
        F.struct(F.lit("worst").alias("side"), (F.col("_n") - F.col("_r") + 1).cast("int").alias("place")),
    )
    placed = ranked.select(key, "mean", F.explode(sides).alias("_s")).select("_s.side", "_s.place", key, "mean")
    return placed if k is None else placed.where(F.col("place") <= k)


# ---- iterations and row views ----------------------------------------------------------------------

def iteration_series(pred_results: DataFrame, metric: str) -> DataFrame:
    """Mean by forecaster and iteration; empty when only one iteration exists."""
    df = pred_results.dropna(subset=["prediction_model", "prediction_iteration"])
    means = df.groupBy("prediction_model", "prediction_iteration").agg(F.avg(metric).alias("mean"))
    spread = df.agg((F.max("prediction_iteration") > F.min("prediction_iteration")).alias("many")).scalar()
    return means.where(spread)


def iteration_variance(pred_results: DataFrame, metric: str) -> DataFrame:
    df = pred_results.dropna(subset=["prediction_model"])
    return df.groupBy("prediction_model").agg(*_spread(metric)).withColumn(
        "cv", F.round(F.col("std") / F.nullif("mean", F.lit(0.0)) * 100, 2)
    ).orderBy(F.desc_nulls_last("cv"), "prediction_model")


def prediction_rows(pred_results: DataFrame, metric: str, n: int | None = None) -> DataFrame:
    """Forecast rows in the fixed key order; ``n`` gives a page of the first rows."""
    cols = ["dataset_name", "technique", "rate_percent", "reconstruction_model", "prediction_model", "prediction_iteration"]
    order = ["reconstruction_model", "prediction_model", "dataset_name", "technique", "rate_percent", "prediction_iteration", metric]
    extra = ["n_samples"] if "n_samples" in pred_results.columns else []
    rows = (
        pred_results.where(F.col(metric).isNotNull()).select(*cols, metric, *extra)
        .orderBy(*[F.asc_nulls_last(c) for c in order], *[F.asc_nulls_last(c) for c in extra])
    )
    return (
        (rows if n is None else rows.limit(n))
        .withColumnRenamed("dataset_name", "dataset")
        .withColumnRenamed("rate_percent", "rate").withColumnRenamed("reconstruction_model", "recon_model")
        .withColumnRenamed("prediction_model", "pred_model").withColumnRenamed("prediction_iteration", "pred_iter")
    )


def raw_browser(df: DataFrame, term: str = "", sort: str | None = None, asc: bool = True) -> DataFrame:
    from mendcast.operators.clean import search_any_column

    out = search_any_column(df, term) if term else df
    return out if sort is None else out.orderBy(F.asc_nulls_last(sort) if asc else F.desc_nulls_last(sort))


# ---- significance ----------------------------------------------------------------------------------

def model_pairs(stats: DataFrame, key: str = "model") -> DataFrame:
    """All ordered pairs of different models, from the table with one row per model.

    That table is packed into a single short array which every row unfolds; the registry of methods
    bounds its length, the number of results does not matter.
    """
    cols = [c for c in stats.columns if c != key]
    others = stats.agg(F.collect_list(F.struct(F.col(key).alias("model_b"), *[F.col(c).alias(f"{c}_b") for c in cols])))
    left = stats.select(F.col(key).alias("model_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    return (
        left.withColumn("_all", others.scalar()).withColumn("_o", F.explode("_all"))
        .select(*left.columns, "_o.*").where(F.col("model_a") != F.col("model_b"))
    )


def pairwise_ttest(results: DataFrame, metric: str, key: str = "model") -> DataFrame:
    """Pooled-variance t-test of every ordered pair: ``model_a, model_b, t, p`` with both means.

    Under two values on a side gives p = 1 and no t. Without any variance equal means have no p,
    different means p = 0.
    """
    stats = results.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.var_samp(metric).alias("var")
    )
    na, nb = F.col("n_a"), F.col("n_b")
    df = na + nb - 2
    pooled = ((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b")) / df
    gap = F.col("mean_a") - F.col("mean_b")
    se = F.sqrt(pooled * (1 / na + 1 / nb))
    enough = (na >= 2) & (nb >= 2)
    pairs = model_pairs(stats, key).withColumn("_df", F.when(enough, df)).withColumn(
        "t", F.when(enough & (se > 0), gap / se)
    )
    p = (
        F.when(~enough, F.lit(1.0))
        .when(F.col("t").isNotNull(), two_sided_p(F.col("t"), F.col("_df")))
        .when(gap != 0, F.lit(0.0))
    )
    return pairs.select("model_a", "model_b", "mean_a", "mean_b", "t", p.alias("p"))


def significance_codes(ttests: DataFrame, lower: bool, a01: float = 0.01, a05: float = 0.05) -> DataFrame:
    """2 / 1 when ``model_a`` is significantly better, -1 / -2 when worse, else 0."""
    better = F.col("mean_a") < F.col("mean_b") if lower else F.col("mean_a") > F.col("mean_b")
    size = F.when(F.col("p") < a01, 2).when(F.col("p") < a05, 1).otherwise(0)
    return ttests.withColumn("code", F.when(better, size).otherwise(-size).cast("int"))


def significance_matrix(codes: DataFrame, value: str = "code", models: Sequence[str] = ()) -> DataFrame:
    """Wide form of the codes or p-values; the diagonal is 0 (code) or 1 (p)."""
    fill = 0 if value == "code" else 1.0
    long = codes.select("model_a", "model_b", F.col(value).alias("_v"))
    diagonal = codes.select("model_a").distinct().select("model_a", F.col("model_a").alias("model_b"), F.lit(fill).alias("_v"))
    both = long.unionByName(diagonal)
    return both.groupBy("model_a").pivot("model_b", list(models) or None).agg(F.first("_v")).orderBy("model_a")


def significance_summary(codes: DataFrame) -> DataFrame:
    """Counts of each outcome per model over the other models."""
    names = {2: "better_p001", 1: "better_p005", 0: "no_difference", -1: "worse_p005", -2: "worse_p001"}
    return codes.groupBy(F.col("model_a").alias("model")).agg(
        *[F.count_if(F.col("code") == c).alias(n) for c, n in names.items()]
    ).orderBy(F.desc("better_p001"), "model")


def significance_text(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    # fixed values: display texts
    texts = {2: "+2 (p<0.01)", 1: "+1 (p<0.05)", 0: "0", -1: "-1 (p<0.05)", -2: "-2 (p<0.01)"}
    out = F.lit("?")
    for code, text in texts.items():
        out = F.when(c == code, F.lit(text)).otherwise(out)
    return out
