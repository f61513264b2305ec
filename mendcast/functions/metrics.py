"""Error metrics as aggregate columns, with their direction and display facts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

EPS = 1e-12  # fixed value: guards denominators

RECON_RESERVED = ("max_diff", "min_diff", "std_diff", "n_missing", "n_total")
PRED_RESERVED = ("max_error", "min_error", "std_error", "n_samples")


@dataclass(frozen=True)
class Metric:
    key: str
    label: str
    lower_is_better: bool
    expr: Callable[[Column, Column], Column] | None = None
    value_is_percent: bool = False
    needs_train: bool = False
    compute: Callable | None = None
    merged: object | None = None  # a MergedMetric


def _error(t, p):
    return F.abs(t - p)


def recon_mad(t, p):
    return F.avg(_error(t, p))


def recon_mae(t, p):
    return F.avg(_error(t, p))


def recon_rmse(t, p):
    return F.sqrt(F.avg((t - p) * (t - p)))


def recon_r2(t, p):
    sst = F.count(t) * F.var_pop(t)
    return F.when(
        (F.count(t) >= 2) & (F.var_pop(t) >= EPS), 1 - F.sum((t - p) * (t - p)) / F.nullif(sst, F.lit(0.0))
    )


def recon_smape(t, p):
    return F.avg(2 * _error(t, p) / (F.abs(t) + F.abs(p) + F.lit(EPS))) * 100


def recon_aux(t, p) -> list[Column]:
    e = _error(t, p)
    return [F.max(e).alias("max_diff"), F.min(e).alias("min_diff"), F.stddev_pop(e).alias("std_diff")]


def pred_mae(t, p):
    return recon_mae(t, p)


def pred_rmse(t, p):
    return recon_rmse(t, p)


def pred_mape(t, p):
    return F.avg(F.when(t != 0, _error(t, p) / F.abs(t))) * 100


def pred_smape(t, p):
    return recon_smape(t, p)


def pred_aux(t, p) -> list[Column]:
    e = _error(t, p)
    return [
        F.max(e).alias("max_error"), F.min(e).alias("min_error"), F.stddev_pop(e).alias("std_error"),
        F.count(e).alias("n_samples"),
    ]


RECON_METRICS: dict[str, Metric] = {
    m.key: m
    for m in (
        Metric("mad", "MAD", True, recon_mad),
        Metric("mae", "MAE", True, recon_mae),
        Metric("rmse", "RMSE", True, recon_rmse),
        Metric("r2", "R²", False, recon_r2),
        Metric("smape", "sMAPE", True, recon_smape, value_is_percent=True),
    )
}
PRED_METRICS: dict[str, Metric] = {
    m.key: m
    for m in (
        Metric("mape", "MAPE", True, pred_mape, value_is_percent=True),
        Metric("smape", "sMAPE", True, pred_smape, value_is_percent=True),
        Metric("mase", "MASE", True, None, needs_train=True),
        Metric("mae", "MAE", True, pred_mae),
        Metric("rmse", "RMSE", True, pred_rmse),
    )
}


def choose_metrics(keys: Iterable[str], known: dict[str, Metric], primary: str | None = None) -> list[str]:
    """Trimmed, lower-cased, de-duplicated keys; none means all; unknown keys and a missing primary are errors."""
    wanted = list(dict.fromkeys(k.strip().lower() for k in keys if k.strip())) or list(known)
    unknown = [k for k in wanted if k not in known]
    if unknown:
        raise KeyError(f"unknown metrics {unknown}; known: {sorted(known)}")
    if primary is not None and primary not in wanted:
        raise ValueError(f"primary metric {primary!r} is not among {wanted}")
    return wanted


def optimization_loss(col: Column | str, lower: bool) -> Column:
    """Smaller is better: missing becomes +inf, a higher-is-better metric is negated."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull() | F.isnan(c), F.lit(float("inf"))).otherwise(c if lower else -c)


def metric_columns(keys: Sequence[str], known: dict[str, Metric], t: Column, p: Column) -> list[Column]:
    out = []
    for k in keys:
        m = known[k]
        if m.expr is not None:
            out.append(m.expr(t, p).alias(k))
    return out
