"""Forecasts of the held-out tail from original and repaired series.

A closed-form forecaster needs one short state row per source (last values, trend sums, smoothing
sums). States come from partial aggregates; steps and models are expanded from the state row.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mendcast.layout import BLOCK, add_block, attach_by_block, config_keys, materialise, with_halo, with_observed_rank

SOURCE_COLUMNS = ("source_type", "series_id", "technique", "rate_percent", "iteration", "model")
TAIL = 20
PHI_LIMIT = 0.99


def forecast_sources(train: DataFrame, repaired: DataFrame | None) -> DataFrame:
    """Original training series and all repaired series as forecast sources.

    ``source_id`` joins all key parts (missing ones as ``-``) into one key that is never missing.
    """
    slim = ["pos", "x", "value"]
    out = train.select("series_id", *slim).withColumn("source_type", F.lit("original"))
    if repaired is not None:
        keys = [c for c in SOURCE_COLUMNS if c in repaired.columns and c != "source_type"]
        other = repaired.select(*keys, *slim).withColumn("source_type", F.lit("reconstructed"))
        out = out.unionByName(other, allowMissingColumns=True)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in SOURCE_COLUMNS if c in out.columns]
    return out.withColumn("source_id", F.concat_ws("|", *parts))


def clean_train_allowlist(points: DataFrame, ingest: DataFrame) -> DataFrame:
    """Points of series whose ingest entry has a clean training series."""
    allowed = ingest.where(F.col("has_clean_train")).select("series_id").distinct()
    ends = points.groupBy("series_id").agg(F.max("pos").alias("_last")).join(allowed, "series_id")
    return attach_by_block(points, ends, ["series_id"])


def _attributes(points: DataFrame) -> list[str]:
    keys = config_keys(points)
    return [c for c in SOURCE_COLUMNS if c in points.columns and c not in keys]


def observed_tail(points: DataFrame, m: int = TAIL, block: int = BLOCK) -> DataFrame:
    """Last ``m`` observed values per source, oldest first, as ``tail``; all sources are kept.

    Block counts tell which blocks can hold the last ``m`` values; only their rows are shuffled.
    """
    keys = config_keys(points)
    by = [*keys, "block"]
    rows = add_block(points.select(*keys, "pos", "value"), block)
    later = W.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    needed = (
        rows.groupBy(*by).agg(F.count("value").alias("_n"))
        .withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0)))
        .where((F.col("_later") < m) & (F.col("_n") > 0)).select(*by)
    )
    near = rows.where(F.col("value").isNotNull()).join(needed, by, "left_semi")
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("pos"))) <= m
    tails = (
        near.withColumn("_keep", last).where("_keep").groupBy(*keys)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("tail"))
    )
    facts = points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("value").alias("n_obs"), F.max("pos").alias("last_pos"),
        *[F.max(a).alias(a) for a in _attributes(points)],
    )
    return facts.join(tails, keys, "left").withColumn(
        "tail", F.coalesce("tail", F.array().cast("array<double>"))
    )


def difference_stats(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Lag-1 regression of first differences over the observed values: ``_phi``, ``_mean_d``."""
    keys = config_keys(points)
    w = W.partitionBy(*keys, "block").orderBy("rank")
    ranked = with_observed_rank(points.select(*keys, "pos", "value"), block).drop("n_obs")
    steps = (
        with_halo(ranked, 2, 0, block, by="rank")
        .withColumn("_d", F.col("value") - F.lag("value").over(w))
        .withColumn("_e", F.lag("value").over(w) - F.lag("value", 2).over(w))
        .where(~F.col("halo"))
    )
    slope = F.regr_slope("_d", "_e")
    phi = F.greatest(F.least(F.when(~F.isnan(slope), slope), F.lit(PHI_LIMIT)), F.lit(-PHI_LIMIT))
    return (
        steps.groupBy(*keys)
        .agg(phi.alias("_phi"), F.regr_avgy("_d", "_e").alias("_ay"), F.regr_avgx("_d", "_e").alias("_ax"))
        .withColumn("_mean_d", (F.col("_ay") - F.col("_phi") * F.col("_ax")) / (1 - F.col("_phi")))
        .drop("_ay", "_ax")
    )


def even_subsample(points: DataFrame, max_points: int = 500) -> DataFrame:
    """Rows at int(linspace(0, n-1, max_points)); shorter series stay whole. A map-side test per row."""
    keys = config_keys(points)
    n = points.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("pos").alias("_last"))
    step = (F.col("_n") - 1) / F.lit(float(max_points - 1))
    guess = F.ceil(F.col("pos") / step)

    def at(i):
        inside = (i >= 0) & (i <= max_points - 1)
        place = F.when(i == max_points - 1, F.col("_n") - 1).otherwise(F.floor(i * step))
        return inside & (place == F.col("pos"))

    hit = at(guess - 1) | at(guess) | at(guess + 1)
    return attach_by_block(points, n).where((F.col("_n") <= max_points) | hit).drop("_n")


def trend_stats(points: DataFrame) -> DataFrame:
    """Least-squares line over the positions of all points: one partial aggregate."""
    keys = config_keys(points)
    t = F.col("pos").cast("double")
    return points.groupBy(*keys).agg(
        F.regr_slope("value", t).alias("_slope"), F.regr_intercept("value", t).alias("_level0")
    )


def _power_term(m: Column, alpha: float, beta: float) -> Column:
    """``p_m`` with ``A^m = p_m A - (1-alpha) p_(m-1) I`` for the transition matrix A of Holt smoothing."""
    trace, det = 2 - alpha - alpha * beta, 1 - alpha
    disc = trace * trace - 4 * det
    if abs(disc) < 1e-14:
        return m * F.pow(F.lit(trace / 2), m - 1)
    if disc > 0:
        root = math.sqrt(disc)
        a, b = (trace + root) / 2, (trace - root) / 2
        return (F.pow(F.lit(a), m) - F.pow(F.lit(b), m)) / F.lit(root)
    r = math.sqrt(det)
    theta = math.acos(trace / (2 * r))
    return F.pow(F.lit(r), m - 1) * F.sin(m * F.lit(theta)) / F.lit(math.sin(theta))


def holt_stats(points: DataFrame, alpha: float, beta: float, season: int | None = None, block: int = BLOCK) -> DataFrame:
    """Final level and trend of additive-trend smoothing over the whole observed series.

    The recursion is linear, so its end state is a weighted sum of the values with closed-form
    weights of their distance from the end: a plain aggregate instead of a walk through the series.
    Start: level = first value, trend = first difference. With ``season`` the mean per
    phase is taken off first and kept as ``_season``.
    """
    if not (0 < alpha < 1 and 0 < beta <= 1):
        raise ValueError("alpha in (0,1) and beta in (0,1] required")
    keys = config_keys(points)
    rows = with_observed_rank(points.select(*keys, "pos", "value"), block)
    y = F.col("value")
    if season:
        phase = rows.groupBy(*keys, F.expr(f"rank % {int(season)}").alias("_p")).agg(
            F.avg("value").alias("_a"), F.count("*").alias("_c"), F.sum("value").alias("_s")
        )
        offsets = (
            phase.groupBy(*keys)
            .agg((F.sum("_s") / F.sum("_c")).alias("_mean"), F.sum("_c").alias("_k"),
                 F.map_from_entries(F.collect_list(F.struct("_p", "_a"))).alias("_a"))
            .withColumn("_season", F.transform_values("_a", lambda k, v: v - F.col("_mean")))
            .select(*keys, "_season", (F.col("_k") - 1).alias("_last"))
        )
        rows = attach_by_block(rows, offsets, by="rank", block=block)
        y = y - F.element_at("_season", F.expr(f"rank % {int(season)}"))
    det = 1 - alpha
    m = (F.col("n_obs") - 1 - F.col("rank")).cast("double")
    p_m, p_l = _power_term(m, alpha, beta), _power_term(m - 1, alpha, beta)
    driven = F.col("rank") >= 1
    sums = rows.withColumn("_y", y).groupBy(*keys).agg(
        F.max("n_obs").alias("_k"),
        F.sum(F.when(driven, F.col("_y") * p_m).otherwise(0.0)).alias("_s1"),
        F.sum(F.when(driven, F.col("_y") * p_l).otherwise(0.0)).alias("_s0"),
        F.max(F.when(F.col("rank") == 0, F.col("_y"))).alias("_y0"),
        F.max(F.when(F.col("rank") == 1, F.col("_y"))).alias("_y1"),
        *([F.any_value("_season").alias("_season")] if season else []),
    )
    g = (F.lit(alpha), F.lit(alpha * beta))

    def transition(v):
        return ((1 - alpha) * v[0] + (1 - alpha) * v[1], -alpha * beta * v[0] + (1 - alpha * beta) * v[1])

    ag = transition(g)
    start = (F.col("_y0"), F.coalesce(F.col("_y1") - F.col("_y0"), F.lit(0.0)))
    a_start = transition(start)
    steps = (F.col("_k") - 1).cast("double")
    q1, q0 = _power_term(steps, alpha, beta), _power_term(steps - 1, alpha, beta)
    out = [
        q1 * a_start[i] - det * q0 * start[i] + F.col("_s1") * ag[i] - det * F.col("_s0") * g[i] for i in (0, 1)
    ]
    return sums.select(
        *keys, out[0].alias("_level"), out[1].alias("_trend"), F.col("_k").alias("_holt_n"),
        *(["_season"] if season else []),
    )


# ---- closed-form forecasters: columns over a state row and the step -------------------------------

def _last() -> Column:
    return F.get("tail", F.size("tail") - 1)


def _back(i) -> Column:
    """i-th value from the end (1 = last)."""
    return F.get("tail", F.size("tail") - i)


def _last_value(step):
    return F.coalesce(_last(), F.lit(0.0))


def _last_diff(step):
    return F.when(F.size("tail") >= 2, _last() + step * (_last() - _back(2))).otherwise(_last_value(step))


def _drift(m):
    def value(step):
        k = F.least(F.size("tail"), F.lit(m))
        return F.when(k >= 2, _last() + step * (_last() - _back(k)) / (k - 1)).otherwise(_last_value(step))

    return value


def _secant(m):
    def value(step):
        k = F.least(F.size("tail"), F.lit(m))
        return F.when(k >= 5, _last() + step * (_last() - _back(k)) / k).otherwise(_last_diff(step))

    return value


def _recent(m):
    return F.slice("tail", F.greatest(F.size("tail") - m + 1, F.lit(1)), m)


def _exp_weighted(m):
    def value(step):
        recent = _recent(m)
        k = F.size(recent)
        diffs = F.transform(
            F.sequence(F.lit(1), k - 1),
            lambda i: F.struct(
                (F.get(recent, i) - F.get(recent, i - 1)).alias("d"),
                F.exp(-1.0 + (i - 1) / (k - 1)).alias("w"),
            ),
        )
        total = F.aggregate(diffs, F.lit(0.0), lambda a, s: a + s["w"])
        weighted = F.aggregate(diffs, F.lit(0.0), lambda a, s: a + s["w"] * s["d"])
        return F.when(F.size("tail") >= 5, _last() + step * weighted / total).otherwise(_last_diff(step))

    return value


def _double_exp(m, alpha):
    def value(step):
        recent = _recent(m)

        def advance(s, v):
            level = alpha * v + (1 - alpha) * (s["level"] + s["trend"])
            trend = alpha * (level - (alpha * v + (1 - alpha) * level)) + (1 - alpha) * s["trend"]
            return F.struct(level.alias("level"), trend.alias("trend"))

        start = F.struct(F.get(recent, F.lit(0)).alias("level"), F.lit(0.0).alias("trend"))
        end = F.aggregate(recent, start, advance)
        return F.when(F.size("tail") >= 5, end["level"] + step * end["trend"]).otherwise(_last_diff(step))

    return value


def _holt(step):
    base = F.col("_level") + step * F.col("_trend")
    return F.when(F.col("_holt_n") >= 2, base).otherwise(_last_value(step))


def _ari1(step):
    d = _last() - _back(2)
    phi, mean = F.col("_phi"), F.col("_mean_d")
    moved = _last() + step * mean + (d - mean) * phi * (1 - F.pow(phi, step)) / (1 - phi)
    return F.when(F.col("n_obs") >= 5, moved)


def _trend(step):
    return F.col("_level0") + F.col("_slope") * (F.col("last_pos") + step)


@dataclass(frozen=True)
class Forecaster:
    value: Callable[[Column], Column]
    needs: frozenset = frozenset()


FORECASTERS: dict[str, Forecaster] = {
    "last_value": Forecaster(_last_value),
    "drift10": Forecaster(_drift(10)),
    "last_diff": Forecaster(_last_diff),
    "secant10": Forecaster(_secant(10)),
    "exp_weighted_drift": Forecaster(_exp_weighted(20)),
    "double_exp20": Forecaster(_double_exp(20, 0.3)),
    "holt": Forecaster(_holt, frozenset({"holt"})),
    # a source too short for the regression falls back along the ladder
    "ari1": Forecaster(lambda s: _guarded(_ari1(s), _exp_weighted(20)(s), _last_diff(s)), frozenset({"diff"})),
    "trend": Forecaster(lambda s: _guarded(_trend(s), _last_diff(s)), frozenset({"trend"})),
}


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _guarded(*ladder: Column) -> Column:
    return F.coalesce(*[F.when(_finite(c), c) for c in ladder])


def _with_steps(states: DataFrame, h: int | DataFrame) -> DataFrame:
    if isinstance(h, DataFrame):
        return states.join(h.select("series_id", "h"), "series_id").withColumn(
            "step", F.explode(F.sequence(F.lit(1).cast("long"), F.col("h").cast("long")))
        ).drop("h")
    return states.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(int(h)).cast("long"))))


def _states(points, needs, alpha, beta, season, block, tail):
    keys = config_keys(points)
    out = observed_tail(points, tail, block)
    if "holt" in needs:
        out = out.join(holt_stats(points, alpha, beta, season, block), keys, "left")
    if "diff" in needs:
        out = out.join(difference_stats(points, block), keys, "left")
    if "trend" in needs:
        out = out.join(trend_stats(points), keys, "left")
    return out


def _predict(
    points, chosen: dict[str, Forecaster], h, alpha=0.3, beta=0.1, season=None, block=BLOCK, tail=TAIL
) -> DataFrame:
    keys, attrs = config_keys(points), _attributes(points)
    needs = set().union(*[f.needs for f in chosen.values()])
    states = _with_steps(_states(points, needs, alpha, beta, season, block, tail), h)
    step = F.col("step").cast("double")
    fan = F.array(*[
        F.struct(F.lit(n).alias("prediction_model"), f.value(step).cast("double").alias("predicted"))
        for n, f in chosen.items()
    ])
    return states.withColumn("_f", F.explode(fan)).select(
        *keys, *attrs, "_f.prediction_model", F.lit(1).alias("prediction_iteration"),
        "step", (F.col("last_pos") + F.col("step")).alias("pos"), "_f.predicted",
    )


def _one(points, name, value, h, needs=(), **kw):
    return _predict(points, {name: Forecaster(value, frozenset(needs))}, h, **kw)


def forecast_last_value(points, h, block=BLOCK):
    return _one(points, "last_value", _last_value, h, block=block)


def forecast_drift10(points, h, m=10, block=BLOCK):
    return _one(points, "drift10", _drift(m), h, block=block, tail=max(TAIL, m))


def forecast_last_diff(points, h, block=BLOCK):
    return _one(points, "last_diff", _last_diff, h, block=block)


def forecast_secant10(points, h, m=10, block=BLOCK):
    return _one(points, "secant10", _secant(m), h, block=block, tail=max(TAIL, m))


def forecast_exp_weighted_drift(points, h, m=20, block=BLOCK):
    return _one(points, "exp_weighted_drift", _exp_weighted(m), h, block=block, tail=max(TAIL, m))


def forecast_double_exp20(points, h, alpha=0.3, m=20, block=BLOCK):
    return _one(points, "double_exp20", _double_exp(m, alpha), h, block=block, tail=max(TAIL, m))


def forecast_holt(points, h, alpha=0.3, beta=0.1, season=None, block=BLOCK):
    value = _holt
    if season:
        def value(step):
            place = F.expr(f"(_holt_n + step - 1) % {int(season)}")
            return _holt(step) + F.coalesce(F.element_at("_season", place), F.lit(0.0))
    return _one(points, "holt", value, h, ["holt"], alpha=alpha, beta=beta, season=season, block=block)


def forecast_ari1(points, h, block=BLOCK):
    return _predict(points, {"ari1": FORECASTERS["ari1"]}, h, block=block)


def forecast_trend(points, h, changepoints=0, block=BLOCK, penalty=0.0):
    """Line through all points; with ``changepoints`` its slope may change at even places.

    ``penalty`` is the price of a change of slope: 0 fits all of them, a larger one keeps only those that pay (an L1 penalty
    on the changes, in units of the mean squared error).
    """
    if not changepoints:
        return _predict(points, {"trend": FORECASTERS["trend"]}, h, block=block)
    return _piecewise_trend(points, h, changepoints, block, penalty)


SWEEPS, SETTLED = 10_000, 1e-13


def sparse_coefficients(xx: np.ndarray, xy: np.ndarray, free: int, penalty: float) -> np.ndarray:
    """Least squares with ``penalty`` times the sizes of all coefficients but the first ``free``, from moment matrices of many sources.

    Coordinate descent: the free coefficients are solved together, every other one in turn by a soft threshold, for all sources at once.
    """
    n, k = xy.shape
    beta = np.zeros((n, k))
    live = np.arange(n)
    for _ in range(SWEEPS):
        a, b, old = xx[live], xy[live], beta[live].copy()
        new = old.copy()
        rest = b[:, :free] - np.einsum("nij,nj->ni", a[:, :free, free:], new[:, free:])
        new[:, :free] = np.linalg.solve(a[:, :free, :free], rest[..., None])[..., 0]
        for j in range(free, k):
            pull = b[:, j] - np.einsum("nj,nj->n", a[:, j], new) + a[:, j, j] * new[:, j]
            new[:, j] = np.sign(pull) * np.maximum(np.abs(pull) - penalty, 0.0) / a[:, j, j]
        beta[live] = new
        live = live[np.abs(new - old).max(axis=1) > SETTLED * (1 + np.abs(new).max(axis=1))]
        if not len(live):
            break
    return beta


RIDGE = 1e-9


def _piecewise_trend(points: DataFrame, h, changepoints: int, block: int, penalty: float) -> DataFrame:
    """Moments are means per source from one aggregate; small systems are solved for all sources of a batch together."""
    keys, attrs = config_keys(points), _attributes(points)
    facts = observed_tail(points, TAIL, block)
    seen = points.select(*keys, "pos", "value").where(F.col("value").isNotNull())
    # time is scaled to the length of the source; knots lie evenly inside it
    rows = attach_by_block(seen, facts.select(*keys, "last_pos", F.col("last_pos").alias("_last")), keys).withColumn(
        "_t", F.col("pos") / F.greatest(F.col("last_pos"), F.lit(1))
    )
    places = [(i + 1) / (changepoints + 1) for i in range(changepoints)]
    basis = [F.lit(1.0), F.col("_t"), *[F.greatest(F.col("_t") - p, F.lit(0.0)) for p in places]]
    k = len(basis)
    moments = rows.groupBy(*keys).agg(
        F.array(*[F.avg(basis[i] * basis[j]) for i in range(k) for j in range(k)]).alias("_xx"),
        F.array(*[F.avg(b * F.col("value")) for b in basis]).alias("_xy"),
    )

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        a = np.stack(xx.to_numpy()).reshape(-1, k, k) + RIDGE * np.eye(k)
        b = np.stack(xy.to_numpy())
        out = sparse_coefficients(a, b, 2, penalty) if penalty > 0 else np.linalg.solve(a, b[..., None])[..., 0]
        return pd.Series(list(out))

    states = _with_steps(
        facts.join(moments.select(*keys, solve("_xx", "_xy").alias("_coef")), keys, "left"), h
    ).withColumn("_t", (F.col("last_pos") + F.col("step")) / F.greatest(F.col("last_pos"), F.lit(1)))
    value = F.lit(0.0)
    for i, b in enumerate(basis):
        value = value + F.get("_coef", F.lit(i)) * b
    return states.select(
        *keys, *attrs, F.lit("trend").alias("prediction_model"), F.lit(1).alias("prediction_iteration"), "step",
        (F.col("last_pos") + F.col("step")).alias("pos"), _guarded(value, _last_value(None)).alias("predicted"),
    )


def zscore(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Standardised points and the statistics (mean, sample deviation; 0 only centres)."""
    keys = config_keys(points)
    stats = points.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("_s"), F.max("pos").alias("_last")
    ).withColumn("scale", F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))).drop("_s")
    scaled = attach_by_block(points, stats).withColumn("value", (F.col("value") - F.col("mean")) / F.col("scale"))
    return scaled.drop("mean", "scale"), stats.drop("_last")


def unzscore(preds: DataFrame, stats: DataFrame) -> DataFrame:
    keys = config_keys(stats)
    return preds.join(stats, keys).withColumn(
        "predicted", F.col("predicted") * F.col("scale") + F.col("mean")
    ).drop("mean", "scale")


def finite_guard_fallback(preds: DataFrame, *ladder: DataFrame) -> DataFrame:
    """A source with any non-finite step takes the whole forecast of the next rung that is finite."""
    keys = [*config_keys(preds), "step"]
    by = config_keys(preds)
    out = preds
    for i, rung in enumerate(ladder):
        ok = out.groupBy(*by).agg(F.bool_and(_finite(F.col("predicted"))).alias("_ok"))
        other = rung.select(*keys, F.col("predicted").alias("_other"))
        out = (
            out.join(ok, by).join(other, keys, "left")
            .withColumn("predicted", F.when(F.col("_ok"), F.col("predicted")).otherwise(F.col("_other")))
            .drop("_ok", "_other")
        )
    return out


def forecast(sources: DataFrame, models: Sequence[str], h: int | DataFrame, block: int = BLOCK) -> DataFrame:
    """All sources with all forecasters: one state preparation, then an expansion by model and step."""
    from mendcast.plans.registry import custom_forecasters, run_custom_forecaster

    own = custom_forecasters()
    unknown = [m for m in models if m not in FORECASTERS and m not in own]
    if unknown:
        raise KeyError(f"unknown forecasters: {unknown}")
    native = {m: FORECASTERS[m] for m in models if m in FORECASTERS and m not in own}
    out = _predict(sources, native, h, block=block) if native else None
    keys, attrs = config_keys(sources), _attributes(sources)
    for name in [m for m in models if m in own]:
        steps = h if isinstance(h, DataFrame) else sources.select("series_id").distinct().withColumn("h", F.lit(h))
        raw = run_custom_forecaster(name, sources, steps, list(dict.fromkeys([*keys, "series_id"])))
        facts = sources.groupBy(*keys).agg(
            F.max("pos").alias("_p"), *[F.max(a).alias(a) for a in attrs]
        )
        done = raw.drop(*[a for a in attrs if a in raw.columns]).join(facts, keys).select(
            *keys, *attrs, F.lit(name).alias("prediction_model"), F.lit(1).alias("prediction_iteration"),
            F.col("step").cast("long").alias("step"), (F.col("_p") + F.col("step")).alias("pos"), "predicted",
        )
        # a user's forecast that is not finite at some step falls back as a whole
        done = finite_guard_fallback(done, forecast_last_diff(sources, h, block), forecast_last_value(sources, h, block))
        out = done if out is None else out.unionByName(done)
    return out


def to_prediction_keys(preds: DataFrame) -> DataFrame:
    """Renames the source columns to those of the result table."""
    names = {"iteration": "reconstruction_iteration", "model": "reconstruction_model"}
    out = preds.drop("source_id")
    for old, new in names.items():
        if old in out.columns:
            out = out.withColumnRenamed(old, new)
    return out


# ---- learners on lag features ----------------------------------------------------------------------

def lag_features(points: DataFrame, lag: int = 10, block: int = BLOCK) -> DataFrame:
    """``y, lag_1..lag_L`` for rows with a complete history; frames never leave their block. ``part`` of a row is kept."""
    keys, attrs = config_keys(points), [*_attributes(points), *(["part"] if "part" in points.columns else [])]
    w = W.partitionBy(*keys, "block").orderBy("pos")
    rows = with_halo(points.select(*keys, *attrs, "pos", "value"), lag, 0, block)
    for i in range(1, lag + 1):
        rows = rows.withColumn(f"lag_{i}", F.lag("value", i).over(w))
    names = [f"lag_{i}" for i in range(1, lag + 1)]
    return (
        rows.where(~F.col("halo") & (F.col("pos") >= lag)).dropna(subset=["value", *names])
        .select(*keys, *attrs, "pos", F.col("value").alias("y"), *names)
    )


def _lag_names(features: DataFrame) -> list[str]:
    return sorted((c for c in features.columns if c.startswith("lag_")), key=lambda c: int(c[4:]))


#: Learners and whether a seed changes nothing about them: one model over all series, or one for each.
LEARNERS = {"boosting": False, "linear": True, "series_boosting": True}


def train_global_lag_model(
    features: DataFrame, trees: int = 100, depth: int = 6, lr: float = 0.1, seed: int = 42, learner: str = "boosting",
    subsample: float = 1.0, tolerance: float = 0.01,
):
    """One model over all series on lag features: boosted trees, or a linear model as the fast variant.

    With a column ``part`` only rows that are not ``val`` are fitted, and boosting stops when the loss of the ``val`` rows no longer
    falls by more than ``tolerance`` of itself.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    if learner not in ("boosting", "linear"):
        raise KeyError(f"unknown learner {learner!r}")
    assemble = VectorAssembler(inputCols=_lag_names(features), outputCol="features")
    is_val = F.coalesce(F.col("part") == "val", F.lit(False)) if "part" in features.columns else F.lit(False)
    if learner == "linear":
        est = LinearRegression(featuresCol="features", labelCol="y", predictionCol="prediction", solver="normal")
        return Pipeline(stages=[assemble, est]).fit(features.where(~is_val))
    features = features.withColumn("is_val", is_val)
    stop = {} if features.where("is_val").isEmpty() else {"validationIndicatorCol": "is_val", "validationTol": tolerance}
    est = GBTRegressor(featuresCol="features", labelCol="y", predictionCol="prediction", maxIter=trees, maxDepth=depth, stepSize=lr,
                       seed=seed, subsamplingRate=subsample, **stop)
    return Pipeline(stages=[assemble, est]).fit(features)


def training_metrics(model, features: DataFrame) -> dict:
    """Trees kept (none for the linear learner) and mean squared errors of the fitted and of the validation rows."""
    if isinstance(model, DataFrame):  # one model per series: means over the series
        return model.agg(
            F.round(F.avg("epochs_trained")).cast("int").alias("epochs_trained"), F.avg("final_train_loss").alias("final_train_loss"),
            F.avg("best_val_loss").alias("best_val_loss")).first().asDict()
    is_val = F.coalesce(F.col("part") == "val", F.lit(False)) if "part" in features.columns else F.lit(False)
    error = F.pow(F.col("prediction") - F.col("y"), 2)
    scored = model.transform(features.withColumn("_val", is_val)).agg(
        F.avg(F.when(~F.col("_val"), error)).alias("final_train_loss"), F.avg(F.when(F.col("_val"), error)).alias("best_val_loss"))
    last = model.stages[-1]
    return {"epochs_trained": getattr(last, "getNumTrees", None), **scored.first().asDict()}


def fit_learner(points: DataFrame, name: str, seed: int, lag: int, trees: int, depth: int, block: int = BLOCK, features: DataFrame | None = None, **kw):
    """A model of one learner on the sources of ``points`` and its training metrics."""
    from mendcast.operators.boosting import per_series_boosting

    if name == "series_boosting":
        model = per_series_boosting(points, lag, trees, depth, block=block)
        return model, training_metrics(model, points)
    features = lag_features(points, lag, block) if features is None else features
    model = train_global_lag_model(features, trees, depth, seed=seed, learner=name, **kw)
    return model, training_metrics(model, features)


def fit_replicates(
    features: DataFrame, learners: Sequence[str], n: int = 1, base_seed: int = 42, **kw
) -> tuple[dict[tuple[str, int], object], DataFrame]:
    """Models by (learner, iteration) and the table of their training: seeds base+1..base+n, a deterministic learner once.

    The features are stored once: every fit reads them several times.
    """
    models, rows, features = {}, [], materialise(features)
    for name, iteration, seed in replicate_plan(learners, n, base_seed):
        start = time.time()
        models[name, iteration] = model = train_global_lag_model(features, seed=seed, learner=name, **kw)
        rows.append({"model": name, "iteration": iteration, "seed": seed, "time_seconds": time.time() - start, **training_metrics(model, features)})
    return models, metrics_table(features.sparkSession, rows)


def metrics_table(spark, rows: list[dict]) -> DataFrame:
    """One row per trained model: learners times replicates."""
    kinds = ("string", "int", "long", "int", "double", "double", "double")
    return spark.createDataFrame(
        [tuple(r[c] for c in METRIC_COLUMNS) for r in rows], ", ".join(f"{c} {t}" for c, t in zip(METRIC_COLUMNS, kinds)))


METRIC_COLUMNS = ("model", "iteration", "seed", "epochs_trained", "best_val_loss", "final_train_loss", "time_seconds")


def replicate_plan(learners: Sequence[str], n: int, base_seed: int) -> list[tuple[str, int, int]]:
    """The plan of ``grid.seed_replicates``: one row per model that is trained."""
    from mendcast.operators.grid import seed_replicates

    plan = seed_replicates([(name, LEARNERS[name]) for name in learners], n, base_seed).collect()  # learners x replicates
    return sorted((r["model"], r["iteration"], r["seed"]) for r in plan)


def histories(points: DataFrame, h: int | DataFrame, lag: int = 10, block: int = BLOCK) -> DataFrame:
    """Stored: what ``forecast_recursive`` needs of the sources, for several models with the same lags and horizons."""
    return materialise(_histories(points, h, lag, block))


def _histories(points: DataFrame, h: int | DataFrame, lag: int, block: int) -> DataFrame:
    """One row per source: ``hist`` (its last ``lag`` values, oldest first), ``h``, and ``_flat`` for sources that are too short."""
    state = observed_tail(points, lag, block).select(
        *config_keys(points), *_attributes(points), "last_pos", F.col("tail").alias("hist"), F.coalesce(_last(), F.lit(0.0)).alias("_flat"))
    if isinstance(h, DataFrame):
        return state.join(h.select("series_id", F.col("h").cast("int").alias("h")), "series_id")
    return state.withColumn("h", F.lit(int(h)))


def linear_step_weights(coefficients, intercept: float, h: int) -> tuple[np.ndarray, np.ndarray]:
    """``(weights, constants)`` of steps 1..h on the last values, oldest first: first rows of the powers of the companion matrix.

    A history (v, 1) moves by ``[[coefficients, intercept], [shift]]``; powers of two are squared, so h steps take log2(h) products of
    row blocks.
    """
    lag = len(coefficients)
    step = np.zeros((lag + 1, lag + 1))  # acts on (oldest .. newest, 1)
    step[np.arange(lag - 1), np.arange(1, lag)] = 1.0
    step[lag - 1, :lag], step[lag - 1, lag] = np.asarray(coefficients, float)[::-1], intercept
    step[lag, lag] = 1.0
    rows, power = step[lag - 1: lag], step
    while len(rows) < h:
        rows = np.concatenate((rows, rows @ power))
        power = power @ power
    return rows[:h, :lag], rows[:h, lag]


def _linear_paths(states: DataFrame, model) -> DataFrame:
    """Forecasts of a linear model: one product of histories and step weights per batch."""
    import pyarrow as pa

    coefficients, intercept = model.stages[-1].coefficients.toArray(), float(model.stages[-1].intercept)

    def run(batches):
        weights = constants = None
        for batch in batches:
            wanted = batch.column("h").to_numpy()
            most = int(wanted.max()) if len(wanted) else 0
            if weights is None or len(weights) < most:
                weights, constants = linear_step_weights(coefficients, intercept, max(most, 1))
            paths = [
                (weights[:n] @ np.array(hist, float) + constants[:n]).tolist() if len(hist) == len(coefficients) else None
                for hist, n in zip(batch.column("hist").to_pylist(), wanted)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(paths, pa.list_(pa.float64()))], ["_id", "path"])

    return states.mapInArrow(run, f"_id {dict(states.dtypes)['_id']}, path array<double>")


def _tree_model(model, lag: int) -> dict:
    """The trees of a fitted ensemble as one row like those of ``per_series_boosting``: its nodes are read, (trees x 2^depth) of them."""
    last = model.stages[-1]
    row = {"lag": lag, "base": 0.0, "lr": 1.0, "depth": 0, "cuts": [], **{c: [] for c in ("tree", "node", "feature", "cut", "value")}}

    def walk(tree, node, at, weight, depth):
        inner = node.subtreeDepth() > 0
        row["depth"] = max(row["depth"], depth)
        for name, v in (("tree", tree), ("node", at), ("feature", node.split().featureIndex() if inner else -1), ("cut", len(row["cuts"]) if inner else 0),
                        ("value", weight * node.prediction())):
            row[name].append(v)
        if inner:
            row["cuts"].append(node.split().threshold())
            walk(tree, node.leftChild(), 2 * at + 1, weight, depth + 1)
            walk(tree, node.rightChild(), 2 * at + 2, weight, depth + 1)

    for i, (tree, weight) in enumerate(zip(last._java_obj.trees(), last.treeWeights)):
        walk(i, tree.rootNode(), 0, weight, 0)
    return row


def _tree_paths(states: DataFrame, row: dict) -> DataFrame:
    """Forecasts of one ensemble for all sources; a source that has all its steps leaves the batch."""
    import pyarrow as pa

    from mendcast.operators.boosting import Forest

    def run(batches):
        forest = Forest(row)
        for batch in batches:
            hist, wanted = batch.column("hist").to_pylist(), batch.column("h").to_numpy()
            full = [i for i, v in enumerate(hist) if len(v) == row["lag"]]
            full.sort(key=lambda i: -wanted[i])
            lags = np.array([hist[i][::-1] for i in full], float).reshape(len(full), row["lag"])
            paths = [None] * len(hist)
            for i in full:
                paths[i] = []
            live, step = len(full), 0
            while live:
                values = forest.predict_all(lags[:live])
                for i, v in zip(full[:live], values.tolist()):
                    paths[i].append(v)
                lags[:live] = np.concatenate((values[:, None], lags[:live, :-1]), axis=1)
                step += 1
                while live and wanted[full[live - 1]] <= step:
                    live -= 1
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(paths, pa.list_(pa.float64()))], ["_id", "path"])

    return states.mapInArrow(run, f"_id {dict(states.dtypes)['_id']}, path array<double>")


def forecast_recursive(
    model, points: DataFrame, h: int | DataFrame, lag: int = 10, block: int = BLOCK, name: str = "lag_model", iteration: int = 1,
    states: DataFrame | None = None,
) -> DataFrame:
    """Each predicted step enters the history of the next; one row per source and step, in one pass over the sources.

    ``model`` is a fitted pipeline of ``train_global_lag_model`` or the table of ``per_series_boosting``. A history shorter than ``lag``
    repeats its last value (0 without any). ``states`` are the ``histories`` of the same arguments, if they are there already.
    """
    from mendcast.operators.boosting import forest_paths

    keys, attrs = config_keys(points), _attributes(points)
    state = histories(points, h, lag, block) if states is None else states  # a row per source, read twice
    rows = state.select(F.struct(*keys).alias("_id"), "hist", "h")
    if isinstance(model, DataFrame):
        known = model.select(F.struct(*keys).alias("_id"), *[c for c in model.columns if c not in keys])
        paths = forest_paths(rows.join(known, "_id"))
    elif hasattr(model.stages[-1], "coefficients"):
        paths = _linear_paths(rows, model)
    else:
        paths = _tree_paths(rows, _tree_model(model, lag))
    flat = F.array_repeat("_flat", F.col("h"))
    out = state.withColumn("_id", F.struct(*keys)).join(paths, "_id", "left").withColumn("path", F.coalesce("path", flat))
    return out.select(*keys, *attrs, "last_pos", F.posexplode("path").alias("_i", "predicted")).select(
        *keys, *attrs, F.lit(name).alias("prediction_model"), F.lit(iteration).alias("prediction_iteration"),
        (F.col("_i") + 1).cast("long").alias("step"), (F.col("last_pos") + F.col("_i") + 1).alias("pos"), "predicted",
    )
