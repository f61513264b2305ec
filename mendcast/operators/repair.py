"""Gap repair: every method is a column over the row, its nearest observed knots and series statistics.

All wanted methods share one preparation (one shuffle of the points by key and block) and fan
out in a single projection, so twenty methods cost little more than one. Observed values never change.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mendcast.functions import curves as c
from mendcast.functions.percentiles import exact_median, exact_mode
from mendcast.layout import BLOCK, attach_by_block, config_keys, with_halo, with_knots


@dataclass(frozen=True)
class Settings:
    axis: str = "x"          # abscissa of the curve methods: "x" or "pos"
    k: int = 3               # neighbours of knn_temporal
    half_window: int = 5     # rows on each side of the rolling fit


@dataclass(frozen=True)
class Method:
    value: Callable[[Settings], Column]
    knots: Callable[[Settings], int] = lambda s: 0
    stats: frozenset[str] = field(default_factory=frozenset)
    rolling: bool = False


def _m(value, knots=0, stats=(), rolling=False):
    return Method(value, knots if callable(knots) else lambda s: knots, frozenset(stats), rolling)


METHODS: dict[str, Method] = {
    "mean": _m(lambda s: F.col("_mean"), stats=["mean"]),
    "median": _m(lambda s: F.col("_median"), stats=["median"]),
    "mode": _m(lambda s: F.coalesce("_mode", "_mean"), stats=["mode", "mean"]),
    "ffill": _m(lambda s: c.ffill(), 1),
    "bfill": _m(lambda s: c.bfill(), 1),
    "linear": _m(lambda s: c.linear("pos"), 1),
    "linear_both": _m(lambda s: c.linear_both(), 1),
    "index": _m(lambda s: c.linear(s.axis), 1),
    "nearest": _m(lambda s: c.nearest(s.axis), 1),
    "pchip": _m(lambda s: c.pchip(s.axis), 3),
    "akima": _m(lambda s: c.akima(s.axis), 3),
    "quadratic": _m(lambda s: c.lagrange(s.axis, 2, 3), 3),
    "polynomial": _m(lambda s: c.lagrange(s.axis, 2, 3), 3),
    "cubic": _m(lambda s: c.lagrange(s.axis, 2, 4), 3),
    "krogh": _m(lambda s: c.lagrange(s.axis, 3, 6), 3),
    "spline": _m(lambda s: F.coalesce(c.local_quadratic(s.axis), c.linear(s.axis)), 1, rolling=True),
    "knn": _m(lambda s: F.col("_mean"), stats=["mean"]),
    "knn_temporal": _m(lambda s: c.knn_temporal(s.k), lambda s: s.k),
    "ar1_smoother": _m(
        lambda s: F.when(F.col("_n_obs") >= 3, c.ar1_bridge(F.col("_mean"), F.coalesce("_phi", F.lit(0.0)))),
        1, stats=["mean", "ar1"],
    ),
}

#: Names for one formula: with a single feature column the nearest rows of a missing one are all rows.
SAME_AS = {"polynomial": "quadratic", "knn": "mean"}

PHI_LIMIT = 0.99


def ar1_fit(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Lag-1 regression slope over adjacent observed pairs, clamped inside the stationary range."""
    keys = config_keys(points)
    w = W.partitionBy(*keys, "block").orderBy("pos")
    pairs = (
        with_halo(points.select(*keys, "pos", "value"), 1, 0, block)
        .withColumn("_prev", F.lag("value").over(w))
        .where(~F.col("halo"))
    )
    # a block's first row sees its halo copy; without a previous row lag() is missing and the pair is skipped
    phi = F.regr_slope("value", "_prev")
    return pairs.groupBy(*keys).agg(
        F.greatest(F.least(F.when(~F.isnan(phi), phi), F.lit(PHI_LIMIT)), F.lit(-PHI_LIMIT)).alias("_phi"),
        F.count("value").alias("_n_obs"),
    )


def _series_stats(points: DataFrame, wanted: set[str], block: int) -> DataFrame | None:
    keys = config_keys(points)
    if not wanted:
        return None
    parts = [points.groupBy(*keys).agg(F.avg("value").alias("_mean"), F.max("pos").alias("_last"))]
    if "median" in wanted:
        parts.append(exact_median(points, keys, "value", "_median"))
    if "mode" in wanted:
        parts.append(exact_mode(points, keys, "value", "_mode"))
    if "ar1" in wanted:
        parts.append(ar1_fit(points, block))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "left")
    return out


def _rolling_rows(points: DataFrame, half: int, block: int) -> DataFrame:
    """Observed rows within ``half`` positions of each row; the frame is at most 2*half+1 rows long."""
    keys = config_keys(points)
    w = W.partitionBy(*keys, "block").orderBy("pos").rowsBetween(-half, half)
    point = F.struct("pos", F.col("x").cast("double").alias("x"), "value")
    near = F.collect_list(F.when(F.col("value").isNotNull(), point)).over(w)
    return with_halo(points, half, half, block).withColumn("_near", near).where(~F.col("halo")).drop("halo")


def merge_keep_observed(observed: Column | str, filled: Column | str) -> Column:
    """Observed where present, else the repaired value."""
    return F.coalesce(observed, filled)


def _prepared(points: DataFrame, methods: Sequence[Method], settings: Settings, block: int) -> DataFrame:
    rows = points
    if any(m.rolling for m in methods):
        rows = _rolling_rows(rows, settings.half_window, block)
    knots = max(m.knots(settings) for m in methods)
    if knots:
        rows = with_knots(rows, knots, block)
    elif "block" in rows.columns:
        rows = rows.drop("block")
    stats = _series_stats(points, set().union(*[m.stats for m in methods]), block)
    return rows if stats is None else attach_by_block(rows, stats, block=block)


def reconstruct_gaps(
    degraded: DataFrame, models: Sequence[str], settings: Settings = Settings(), block: int = BLOCK
) -> DataFrame:
    """Only the missing points, once per model: what repairs add. Observed points stay in ``degraded``, see ``with_observed``."""
    from mendcast.plans.registry import custom_models, run_custom_model

    own = custom_models()
    unknown = [m for m in models if m not in METHODS and m not in own]
    if unknown:
        raise KeyError(f"unknown reconstruction models: {unknown}")
    names = [m for m in models if m in METHODS and m not in own]
    rest = [col for col in degraded.columns if col != "value"]
    out = None
    if names:
        methods = [METHODS[m] for m in names]
        # methods that are the same formula share its column
        formula = {n: SAME_AS.get(n, n) for n in names}
        staged = [METHODS[n].value(settings).cast("double").alias(f"_as_{n}") for n in dict.fromkeys(formula.values())]
        fills = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_as_{formula[n]}").alias("value")) for n in names])
        out = (
            _prepared(degraded, methods, settings, block).where(F.col("value").isNull())
            .select(*rest, *staged).withColumn("_fill", F.explode(fills))
            .select(*rest, "_fill.model", "_fill.value")
        )
    for name in [m for m in models if m in own]:
        done = run_custom_model(name, degraded.withColumn("_gap", F.col("value").isNull())).where("_gap").drop("_gap")
        out = done if out is None else out.unionByName(done)
    return out


def with_observed(gaps: DataFrame, degraded: DataFrame, models: Sequence[str]) -> DataFrame:
    """Repaired series: the observed points of ``degraded`` once per model, united with the repaired ones. Nothing is shuffled."""
    seen = degraded.where(F.col("value").isNotNull()).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return gaps.unionByName(seen.select(*gaps.columns))


def reconstruct(
    degraded: DataFrame, models: Sequence[str], settings: Settings = Settings(), block: int = BLOCK
) -> DataFrame:
    """Repairs every configuration with every model: one row per point and model."""
    return with_observed(reconstruct_gaps(degraded, models, settings, block), degraded, models)


def _single(points: DataFrame, model: str, settings: Settings = Settings(), block: int = BLOCK) -> DataFrame:
    method = METHODS[model]
    fill = merge_keep_observed("value", method.value(settings).cast("double"))
    return _prepared(points, [method], settings, block).select(
        *[fill.alias("value") if col == "value" else F.col(col) for col in points.columns]
    )


def impute_mean(points, block=BLOCK):
    return _single(points, "mean", block=block)


def impute_median(points, block=BLOCK):
    return _single(points, "median", block=block)


def impute_mode(points, block=BLOCK):
    return _single(points, "mode", block=block)


def impute_ffill(points, block=BLOCK):
    return _single(points, "ffill", block=block)


def impute_bfill(points, block=BLOCK):
    return _single(points, "bfill", block=block)


def interpolate_linear(points, block=BLOCK):
    return _single(points, "linear", block=block)


def interpolate_linear_both(points, block=BLOCK):
    return _single(points, "linear_both", block=block)


def interpolate_index(points, axis="x", block=BLOCK):
    return _single(points, "index", Settings(axis), block)


def interpolate_nearest(points, axis="x", block=BLOCK):
    return _single(points, "nearest", Settings(axis), block)


def interpolate_pchip(points, axis="x", block=BLOCK):
    return _single(points, "pchip", Settings(axis), block)


def interpolate_akima(points, axis="x", block=BLOCK):
    return _single(points, "akima", Settings(axis), block)


def interpolate_quadratic(points, axis="x", block=BLOCK):
    return _single(points, "quadratic", Settings(axis), block)


def interpolate_polynomial(points, axis="x", order=2, block=BLOCK):
    """Order 2 and 3 are the local quadratic and cubic."""
    return _single(points, {2: "quadratic", 3: "cubic"}[order], Settings(axis), block)


def interpolate_cubic(points, axis="x", block=BLOCK):
    return _single(points, "cubic", Settings(axis), block)


def interpolate_krogh(points, axis="x", knots=6, block=BLOCK):
    if knots != 6:
        raise ValueError("three knots per side are carried")
    return _single(points, "krogh", Settings(axis), block)


def interpolate_spline(points, axis="x", h=5, order=2, block=BLOCK):
    if order != 2:
        raise ValueError("the rolling fit is quadratic")
    return _single(points, "spline", Settings(axis, half_window=h), block)


def impute_knn(points, block=BLOCK):
    """One feature column gives no distance for a missing row, so the column mean."""
    return impute_mean(points, block)


def impute_knn_temporal(points, k=3, block=BLOCK):
    return _single(points, "knn_temporal", Settings(k=k), block)


def impute_ar1_smoother(points, block=BLOCK):
    return _single(points, "ar1_smoother", block=block)


def unfilled_report(repaired: DataFrame) -> DataFrame:
    """Points a method left missing, per configuration."""
    return repaired.groupBy(*config_keys(repaired)).agg(
        F.count_if(F.col("value").isNull()).alias("n_unfilled"), F.count("*").alias("n_total")
    )
