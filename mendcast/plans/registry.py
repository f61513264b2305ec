"""User methods: masks, repairs, forecasters and metrics next to the built-in ones.

Contracts:

* ``kind="frame"`` (default) - a DataFrame transform, or for metrics a function that builds an aggregate Column, which Spark
  merges from partial results. Runs like a built-in.
* ``kind="block"`` - functions over blocks of a series, which spreads long series: a ``BlockMethod`` whose blocks receive the state of the
  blocks before them, or for repairs also a pandas function over a block and ``halo`` rows on either side of it.
* ``kind="merge"`` - for metrics: a ``MergedMetric`` of states that tasks update and Spark merges.
* ``kind="series"`` - a pandas function over one whole series (for metrics: a configuration). One task then holds it by definition; this
  form is there for methods that exist as such functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mendcast.functions.metrics import PRED_METRICS, PRED_RESERVED, RECON_METRICS, RECON_RESERVED, Metric
from mendcast.layout import BLOCK, attach_by_block, config_keys, with_halo
from mendcast.plans.blockwise import BlockMethod, MergedMetric, change_groups, merged_metrics, nullable, over_blocks, packed_rows, series_states


@dataclass(frozen=True)
class Plugin:
    fn: Callable
    kind: str = "frame"
    halo: int = 0
    gpu: bool = False
    deterministic: bool = True


_TECHNIQUES: dict[str, Plugin] = {}
_MODELS: dict[str, Plugin] = {}
_FORECASTERS: dict[str, Plugin] = {}
_BUILTIN_METRICS = (frozenset(RECON_METRICS), frozenset(PRED_METRICS))


def _register(table: dict, name: str, plugin: Plugin, overwrite: bool) -> None:
    if not isinstance(name, str) or not name.strip():
        raise ValueError("name must be a non-empty string")
    kinds = ("series", "frame", "block")
    if plugin.kind not in kinds:
        raise ValueError(f"kind must be one of {kinds}")
    in_blocks = isinstance(plugin.fn, BlockMethod)
    if in_blocks and plugin.kind != "block":
        raise TypeError("a BlockMethod goes with kind='block'")
    if not in_blocks and not callable(plugin.fn):
        raise TypeError("a callable is required")
    if not in_blocks and plugin.kind == "block" and table is not _MODELS:
        raise ValueError("kind='block' needs a BlockMethod")
    if name in table and not overwrite:
        raise ValueError(f"{name!r} is already registered")
    table[name] = plugin


def register_missingness_technique(name, fn, overwrite=False, kind="frame"):
    """``(series, rate, seed) -> series``, ``(points, cells) -> degraded with truth`` or a ``BlockMethod``."""
    _register(_TECHNIQUES, name, Plugin(fn, kind), overwrite)


def register_reconstruction_model(name, fn, overwrite=False, kind="frame", halo=0):
    """``(points) -> points``, a ``BlockMethod``, or ``(series) -> series`` over blocks with a halo or whole series.

    Takes precedence over a built-in of that name.
    """
    _register(_MODELS, name, Plugin(fn, kind, halo), overwrite)


def register_prediction_model(name, fn, gpu=False, deterministic=True, overwrite=False, kind="frame"):
    """``(train, horizon) -> values``, ``(points, horizons) -> predictions`` or a ``BlockMethod``."""
    _register(_FORECASTERS, name, Plugin(fn, kind, gpu=gpu, deterministic=deterministic), overwrite)


def _register_metric(table, builtin, reserved, metric: Metric, overwrite):
    key = metric.key.strip().lower()
    if not key:
        raise ValueError("metric key must be non-empty")
    if key in reserved:
        raise ValueError(f"{key!r} is reserved")
    if key in builtin:
        raise ValueError(f"built-in metric {key!r} cannot be overridden")
    if key in table and not overwrite:
        raise ValueError(f"{key!r} is already registered")
    if not isinstance(metric.merged, MergedMetric) and not callable(metric.compute or metric.expr):
        raise TypeError("a callable or a MergedMetric is required")
    table[key] = metric


def _forms(compute, kind: str) -> dict:
    names = {"frame": "expr", "series": "compute", "merge": "merged"}
    if kind not in names:
        raise ValueError(f"kind must be one of {tuple(names)}")
    return {names[kind]: compute}


def register_reconstruction_metric(key, label, lower_is_better, compute, overwrite=False, kind="frame"):
    """``(y_true, y_pred) -> float`` over arrays, over Columns with ``kind="frame"``, or a ``MergedMetric`` with ``kind="merge"``."""
    metric = Metric(key.strip().lower(), label, lower_is_better, **_forms(compute, kind))
    _register_metric(RECON_METRICS, _BUILTIN_METRICS[0], RECON_RESERVED, metric, overwrite)


def register_prediction_metric(
    key, label, lower_is_better, compute, needs_train=False, value_is_percent=False, overwrite=False, kind="frame"
):
    """``(y_true, y_pred[, train]) -> float`` over arrays, over Columns with ``kind="frame"``, or a ``MergedMetric`` with ``kind="merge"``."""
    needs_train = needs_train or (isinstance(compute, MergedMetric) and compute.train is not None)
    metric = Metric(key.strip().lower(), label, lower_is_better, value_is_percent=value_is_percent, needs_train=needs_train, **_forms(compute, kind))
    _register_metric(PRED_METRICS, _BUILTIN_METRICS[1], PRED_RESERVED, metric, overwrite)


def reset_plugins() -> None:
    """Forgets everything the user registered."""
    for table in (_TECHNIQUES, _MODELS, _FORECASTERS):
        table.clear()
    for table, builtin in zip((RECON_METRICS, PRED_METRICS), _BUILTIN_METRICS):
        for key in [k for k in table if k not in builtin]:
            del table[key]


def custom_techniques() -> list[str]:
    return list(_TECHNIQUES)


def custom_models() -> list[str]:
    return list(_MODELS)


def custom_forecasters() -> dict[str, Plugin]:
    return dict(_FORECASTERS)


def run_custom_technique(name: str, points: DataFrame, cells: DataFrame) -> DataFrame:
    plugin = _TECHNIQUES[name]
    if plugin.kind == "frame":
        return plugin.fn(points, cells)
    fn = plugin.fn
    keys = ["series_id", "technique", "rate_percent", "iteration"]
    ends = points.groupBy("series_id").agg(F.max("pos").alias("_last"))
    rows = attach_by_block(points, cells.join(ends, "series_id"), ["series_id"]).withColumn("truth", F.col("value"))
    out = rows.drop("rate", "seed")
    kept = out.columns
    columns = [*keys, *[c for c in points.columns if c not in ("series_id", "value")], "value", "truth"]
    if plugin.kind == "block":
        def change(pdf: pd.DataFrame, place):
            return fn.apply(pdf["value"].to_numpy(float), float(pdf["rate"].iloc[0]), int(pdf["seed"].iloc[0]), place)

        return over_blocks(rows, keys, fn, change).withColumn("value", F.nanvl("value", F.lit(None))).select(*columns)

    def mask(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        pdf["value"] = fn(pdf["value"].copy(), float(pdf["rate"].iloc[0]), int(pdf["seed"].iloc[0])).to_numpy()
        return pdf[kept]

    return rows.groupBy(*keys).applyInPandas(mask, nullable(out)).select(*columns)


def run_custom_model(name: str, degraded: DataFrame) -> DataFrame:
    plugin = _MODELS[name]
    rest = [c for c in degraded.columns if c != "value"]
    if plugin.kind == "frame":
        return plugin.fn(degraded).withColumn("model", F.lit(name)).select(*rest, "model", "value")
    fn = plugin.fn
    keys = config_keys(degraded)
    if isinstance(fn, BlockMethod):
        def change(pdf: pd.DataFrame, place):
            filled = fn.apply(pdf["value"].to_numpy(float), place)
            return pdf["value"].where(pdf["value"].notna(), filled)

        done = over_blocks(degraded, keys, fn, change)
        return done.withColumn("model", F.lit(name)).select(*rest, "model", "value")

    def repair(part: pd.DataFrame, *_):
        return part["value"].where(part["value"].notna(), pd.Series(fn(part["value"].copy())).to_numpy())

    if plugin.kind == "block":
        cut = with_halo(degraded, plugin.halo, plugin.halo, BLOCK)
        names = [*degraded.columns, "halo"]
        packed = packed_rows(cut, [*keys, "block"], names)
        done = change_groups(packed, nullable(cut.select(*names)), repair).where(~F.col("halo")).drop("halo")
    else:
        packed = packed_rows(degraded, keys, degraded.columns)
        done = change_groups(packed, nullable(degraded), repair)
    return done.withColumn("model", F.lit(name)).select(*rest, "model", "value")


def run_custom_forecaster(name: str, points: DataFrame, horizons: DataFrame, keys: list[str]) -> DataFrame:
    """``horizons`` holds ``h`` per series; result: keys, step, predicted."""
    plugin = _FORECASTERS[name]
    if plugin.kind == "frame":
        return plugin.fn(points, horizons)
    fn = plugin.fn
    if plugin.kind == "block":
        states = series_states(points, keys, fn).join(horizons, "series_id")

        def expand(frames):
            for pdf in frames:
                paths = [[float(v) for v in fn.apply(list(s), int(h))] for s, h in zip(pdf["state"], pdf["h"])]
                yield pdf[keys].assign(path=paths)

        kinds = dict(points.dtypes)
        paths = states.mapInPandas(expand, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", path array<double>")
        return paths.select(*keys, F.posexplode("path").alias("_i", "predicted")).select(
            *keys, (F.col("_i") + 1).cast("long").alias("step"), "predicted")
    ends = points.groupBy(*keys).agg(F.max("pos").alias("_last")).join(horizons, "series_id")
    rows = attach_by_block(points.select(*keys, "pos", "value"), ends, keys)
    schema = ", ".join(f"`{k}` {dict(points.dtypes)[k]}" for k in keys) + ", step bigint, predicted double"

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        h = int(pdf["h"].iloc[0])
        values = pd.Series(fn(pdf["value"].dropna().reset_index(drop=True), h)).to_numpy()
        out = pd.DataFrame({"step": range(1, h + 1), "predicted": values})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "step", "predicted"]]

    return rows.groupBy(*keys).applyInPandas(predict, schema)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which missing key parts match missing key parts."""
    l, r = left.alias("l"), right.alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return l.join(r, same, how).select("l.*", *extra)


def add_custom_metrics(
    out: DataFrame, pairs: DataFrame, by: list[str], metrics: list[Metric], train: DataFrame | None = None
) -> DataFrame:
    """Columns of user metrics: merged from states, or by one grouped pandas function for all array functions."""
    merged = {m.key: m.merged for m in metrics if m.merged is not None}
    if merged:
        out = null_safe_join(out, merged_metrics(pairs, by, merged, train), by)
    own = [m for m in metrics if m.compute is not None]
    if not own:
        return out
    types = dict(pairs.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in by) + "".join(f", `{m.key}` double" for m in own)
    fns = {m.key: (m.compute, m.needs_train) for m in own}
    names = [m.key for m in own]

    def score(pdf: pd.DataFrame, history) -> dict:
        t, p = pdf["t"].to_numpy(), pdf["p"].to_numpy()
        row = {k: pdf[k].iloc[0] for k in by}
        for key, (fn, needs) in fns.items():
            row[key] = float(fn(t, p, train=history)) if needs else float(fn(t, p))
        return row

    slim = pairs.select(*by, "t", "p")
    if train is not None and any(m.needs_train for m in own):
        history = train.select("series_id", "pos", "value")

        def both(pdf: pd.DataFrame, hist: pd.DataFrame) -> pd.DataFrame:
            past = hist.sort_values("pos")["value"].dropna().to_numpy()
            rows = [score(g, past) for _, g in pdf.groupby(by, dropna=False)] if len(pdf) else []
            return pd.DataFrame(rows, columns=[*by, *names])

        extra = slim.groupBy("series_id").cogroup(history.groupBy("series_id")).applyInPandas(both, schema)
    else:
        extra = slim.groupBy(*by).applyInPandas(lambda pdf: pd.DataFrame([score(pdf, None)])[[*by, *names]], schema)
    return null_safe_join(out, extra, by)
