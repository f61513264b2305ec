"""Whole runs composed from the operators.

Steps are DataFrames, but some start jobs while they are built: ordinals, cut-offs and percentiles are stored tables, and so
is the degraded table, which masks every point once however many repairs read it. ``layout.scratch_run`` removes them.

With ``RunConfig.store`` the tables and models of a run stay in that folder: every grid cell is written once and recorded when it is
complete, cells on record are read, so a run that was stopped goes on where it was (see ``plans.store``).
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from mendcast.layout import BLOCK, materialise
from mendcast.operators import clean, forecast as fc, score
from mendcast.operators.grid import experiment_grid
from mendcast.operators.mask import degrade, missing_report
from mendcast.operators.repair import reconstruct
from mendcast.plans.registry import custom_forecasters
from mendcast.plans.store import RunStore, load_model, save_model, wanted
from mendcast.sources.series_io import external_ingest, read_series_csv


@dataclass
class RunConfig:
    raw: DataFrame | None = None              # raw rows for cleaning
    glob: str | None = None                   # or CSV files
    points: DataFrame | None = None           # or points that are clean already
    n_test: int = 30
    techniques: tuple = ("MCAR", "MAR", "MNAR")
    rates: tuple = (0.1, 0.2)
    iterations: int = 1
    seed: int = 42
    models: tuple = ("mean", "ffill", "linear")
    forecasters: tuple = ("last_value", "drift10")
    recon_metrics: tuple = ()
    pred_metrics: tuple = ()
    learner: str | None = None                # "boosting" or "linear" trains a model over all series, "series_boosting" one for each
    learners: tuple = ()                      # several of them
    replicates: int = 1                       # models of a learner that depends on its seed
    val_frac: float | None = None             # share of each source held out to stop boosting early
    trees: int = 100
    depth: int = 6
    lags: int = 10
    block: int = BLOCK
    require_train_missing: bool = False
    store: str | None = None                  # shared folder that keeps the run
    commit_every: int | None = None           # grid cells between two commits; all of a step if not given
    training_metrics: bool = False            # also return the table of the training

    def all_learners(self) -> list[str]:
        return list(dict.fromkeys([*([self.learner] if self.learner else []), *self.learners]))

    def identity(self) -> dict:
        """What must be the same for a stored run to go on. The input rows are the caller's business."""
        left_out = {"raw", "points", "store", "commit_every", "training_metrics", "techniques", "rates", "iterations", "models", "forecasters",
                    "learner", "learners", "replicates"}  # inputs, and what only adds cells
        return {k: v for k, v in self.__dict__.items() if k not in left_out}


class StepFailed(ValueError):
    """A step found nothing to work on or broke down; ``completed`` lists the steps before it."""

    def __init__(self, step: str, message: str, completed: list[str]):
        super().__init__(f"{step}: {message}")
        self.step, self.completed = step, completed


@contextmanager
def _step(name: str, completed: list[str]):
    """Failures inside become ``StepFailed``; wrong arguments stay what they are."""
    try:
        yield
    except (ValueError, KeyError, TypeError):
        raise
    except Exception as e:
        raise StepFailed(name, str(e).split("\n")[0][:500], list(completed)) from e
    completed.append(name)


def _must_have(rows: DataFrame, step: str, completed: list[str]) -> None:
    if rows.isEmpty():
        raise StepFailed(step, "no rows", list(completed))


def _store(spark: SparkSession, cfg: RunConfig) -> RunStore | None:
    return RunStore(spark, cfg.store, cfg.identity(), cfg.commit_every) if cfg.store else None


def _cells(store: RunStore | None, step: str, cells: list[dict], build: Callable[[list[dict]], DataFrame]) -> DataFrame:
    """Rows of all cells: computed and kept for this run, or from the store, which computes only what it lacks."""
    return materialise(build(cells)) if store is None else store.run(step, cells, build)


def _clean(spark, cfg):
    if cfg.points is not None:
        return cfg.points, None
    raw = cfg.raw if cfg.raw is not None else read_series_csv(spark, cfg.glob)
    return clean.clean_series(raw)


CELL = ("technique", "rate_percent", "iteration")


def _grid_cells(cfg) -> list[dict]:
    return [
        {"technique": t, "rate_percent": int(round(r * 100)), "iteration": i + 1}
        for t in cfg.techniques for r in cfg.rates for i in range(cfg.iterations)
    ]


def _degraded(train, cfg, store) -> DataFrame:
    def build(cells):
        grid = experiment_grid(train, cfg.techniques, cfg.rates, cfg.iterations, cfg.seed)
        masked = degrade(train, wanted(grid, cells), keep_truth=True, block=cfg.block)
        return masked.withColumn("masked", F.col("value").isNull())

    return _cells(store, "degrade", _grid_cells(cfg), build)  # read by every repair and by the scores


def _repaired(degraded, cfg, store) -> DataFrame:
    """All repairs; cells that lack the same models are repaired together."""
    def build(cells):
        out, lacking = None, {}
        for c in cells:
            lacking.setdefault(tuple(c[k] for k in CELL), []).append(c["model"])
        groups = {}
        for cell, models in lacking.items():
            groups.setdefault(tuple(models), []).append(dict(zip(CELL, cell)))
        for models, same in groups.items():
            part = reconstruct(wanted(degraded, same), models, block=cfg.block)
            out = part if out is None else out.unionByName(part)
        return out

    if store is None:
        return reconstruct(degraded, cfg.models, block=cfg.block)
    return store.run("reconstruct", [{**c, "model": m} for c in _grid_cells(cfg) for m in cfg.models], build)


def _recon_scores(degraded, repaired, cfg) -> DataFrame:
    pairs = score.pairs_from_truth(repaired)
    return score.score_reconstruction(
        pairs, cfg.recon_metrics, totals=missing_report(degraded).drop("n_missing", "missing_share")
    )


def _parts(split):
    columns = [c for c in ("series_id", "pos", "ts", "x", "value") if c in split.columns]
    train = split.where(F.col("part") == "train").select(*columns)
    test = split.where(F.col("part") == "test").select(*columns, "step")
    return train, test


def _prepared(spark, cfg, store, completed) -> tuple[dict, DataFrame, DataFrame]:
    """clean and split; with a store the split is kept."""
    with _step("clean", completed):
        points, report = _clean(spark, cfg)
        _must_have(points, "clean", completed)
    with _step("split", completed):
        split = clean.temporal_split(points, cfg.n_test)
        if store is not None:
            split = store.run("split", [{"points": "all"}], lambda cells: split)
        train, test = _parts(split)
        _must_have(test, "split", completed)
    out = {"points": points, "split": split, "test": test}
    return out if report is None else {"clean_report": report, **out}, train, test


def _reconstruction(spark, cfg, store, completed) -> tuple[dict, DataFrame, DataFrame]:
    out, train, test = _prepared(spark, cfg, store, completed)
    with _step("degrade", completed):
        out["degraded"] = _degraded(train, cfg, store)
        _must_have(out["degraded"], "degrade", completed)
    with _step("reconstruct", completed):
        out["repaired"] = _repaired(out["degraded"], cfg, store)
    with _step("score", completed):
        out["recon_results"] = _recon_scores(out["degraded"], out["repaired"], cfg)
        if store is not None:
            cells, rows = [{**c, "model": m} for c in _grid_cells(cfg) for m in cfg.models], out["recon_results"]
            out["recon_results"] = store.run("recon_scores", cells, lambda some: wanted(rows, some))
    return out, train, test


def pipeline_reconstruction(spark: SparkSession, cfg: RunConfig) -> dict[str, DataFrame]:
    """clean, split, degrade, reconstruct, score."""
    return _reconstruction(spark, cfg, _store(spark, cfg), [])[0]


def _source_cells(cfg, repaired_cells: list[dict]) -> list[dict]:
    """The forecast sources: the original series and every repair."""
    none = dict.fromkeys((*CELL, "model"))
    return [{"source_type": "original", **none}, *[{"source_type": "reconstructed", **none, **c} for c in repaired_cells]]


def _digest(source_cells: list[dict]) -> str:
    """Names a set of sources; a model belongs to the sources that it was trained on."""
    return hashlib.sha1(json.dumps(sorted(map(str, source_cells))).encode()).hexdigest()[:16]


def _trained(sources, source_cells, cfg, store) -> tuple[dict, DataFrame | None]:
    """Models by (learner, iteration), fitted or read, and the table of their training."""
    plan = fc.replicate_plan(cfg.all_learners(), cfg.replicates, cfg.seed)
    if not plan:
        return {}, None
    spark, trained_on = sources.sparkSession, _digest(source_cells)
    points = clean.train_val_split(sources, cfg.val_frac) if cfg.val_frac else sources
    cells = [{"model": name, "iteration": iteration, "trained_on": trained_on} for name, iteration, _ in plan]
    left = {(c["model"], c["iteration"]) for c in (store.pending("train", cells) if store is not None else cells)}
    features, models, rows = None, {}, []
    for name, iteration, seed in plan:
        if (name, iteration) not in left:
            continue
        if features is None and name != "series_boosting":
            features = materialise(fc.lag_features(points, cfg.lags, cfg.block))  # read by every fit
        start = time.time()
        model, facts = fc.fit_learner(points, name, seed, cfg.lags, cfg.trees, cfg.depth, cfg.block, features)
        rows.append({"model": name, "iteration": iteration, "seed": seed, "time_seconds": time.time() - start, **facts})
        models[name, iteration] = model
        if store is not None:
            path = store.new_path("models")
            save_model(model, path)
            store.commit("train", [{"model": name, "iteration": iteration, "trained_on": trained_on}], fc.metrics_table(spark, rows[-1:]).withColumns(
                {"model_path": F.lit(path), "trained_on": F.lit(trained_on)}))
    if store is None:
        return models, fc.metrics_table(spark, rows)
    metrics = wanted(store.read("train"), cells)
    for r in metrics.collect():  # a row per model
        models[r.model, r.iteration] = load_model(spark, r.model_path, r.model)
    return models, metrics


def _predicted(sources, source_cells, horizon, models, cfg, store) -> DataFrame:
    """Forecasts of all closed forms and all trained models for all sources; sources that lack the same forecasts share a pass."""
    named = {("lag_model" if name == cfg.learner else f"{name}_lag_model", i): m for (name, i), m in models.items()}
    trained_on = _digest(source_cells)

    def forecasts(some, own):
        parts = []
        for i in sorted({i for m, i in own if (m, i) not in named}):
            plain = [m for m, j in own if j == i and (m, j) not in named]
            parts.append(fc.forecast(some, plain, horizon, cfg.block).withColumns({"prediction_iteration": F.lit(i), "trained_on": F.lit("")}))
        trained = [k for k in own if k in named]
        states = fc.histories(some, horizon, cfg.lags, cfg.block) if trained else None
        for name, i in trained:
            part = fc.forecast_recursive(named[name, i], some, horizon, cfg.lags, cfg.block, name=name, iteration=i, states=states)
            parts.append(part.withColumn("trained_on", F.lit(trained_on)))
        return parts

    def build(cells):
        lacking, groups, parts = {}, {}, []
        for c in cells:
            lacking.setdefault(tuple(c[k] for k in source_cells[0]), []).append((c["prediction_model"], c["prediction_iteration"]))
        for source, own in lacking.items():
            groups.setdefault(tuple(own), []).append(dict(zip(source_cells[0], source)))
        for own, some in groups.items():
            parts += forecasts(sources if len(some) == len(source_cells) else wanted(sources, some), own)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    user = custom_forecasters()
    times = {m: cfg.replicates if m in user and not user[m].deterministic else 1 for m in cfg.forecasters}
    keys = [(m, i, "") for m, n in times.items() for i in range(1, n + 1)] + [(m, i, trained_on) for m, i in named]
    cells = [{**s, "prediction_model": m, "prediction_iteration": i, "trained_on": t} for s in source_cells for m, i, t in keys]
    return (build(cells) if store is None else store.run("predict", cells, build)).drop("trained_on")


def _forecast_and_score(sources, source_cells, train, test, cfg, store, completed):
    horizon = test.groupBy("series_id").agg(F.count("*").alias("h"))
    out = {}
    with _step("train", completed):
        models, metrics = _trained(sources, source_cells, cfg, store)
        if metrics is not None and cfg.training_metrics:
            out["training_metrics"] = metrics
    with _step("predict", completed):
        preds = fc.to_prediction_keys(_predicted(sources, source_cells, horizon, models, cfg, store))
    with _step("score predictions", completed):
        pairs, errors = score.attach_truth(preds, test)
        results = score.score_prediction(pairs, train, cfg.pred_metrics, cfg.block)
        if store is not None:
            results = materialise(results)
            _must_have(results, "score predictions", completed)
    out.update(predictions=preds, pred_results=results, pred_errors=errors)
    return out


def pipeline_full(spark: SparkSession, cfg: RunConfig) -> dict[str, DataFrame]:
    """clean, split, degrade, reconstruct, score, train, predict, score.

    The steps are lazy, so what can fail is checked where it shows: bad arguments at once, an empty
    input before anything is trained on it.
    """
    store, completed = _store(spark, cfg), []
    out, train, test = _reconstruction(spark, cfg, store, completed)
    with _step("sources", completed):
        if store is None:
            out["repaired"] = materialise(out["repaired"])  # a result of its own and the source of the forecasts
        # read twice below (training history and forecast sources), so cut the plan here
        sources = materialise(fc.forecast_sources(train, out["repaired"]))
        _must_have(sources, "sources", completed)
    source_cells = _source_cells(cfg, [{**c, "model": m} for c in _grid_cells(cfg) for m in cfg.models])
    out.update(_forecast_and_score(sources, source_cells, train, test, cfg, store, completed))
    return out


def pipeline_external(spark: SparkSession, manifest: DataFrame, cfg: RunConfig) -> dict[str, DataFrame]:
    """ingest, reconstruct, train, predict, score; neither masking nor repair scores."""
    store, completed = _store(spark, cfg), []
    with _step("clean", completed):
        points, _ = _clean(spark, cfg)
        _must_have(points, "clean", completed)
    with _step("ingest", completed):
        degraded, test, train, violations = external_ingest(points, manifest, cfg.require_train_missing)
        degraded = materialise(degraded)
        _must_have(degraded, "ingest", completed)
    with _step("reconstruct", completed):
        repaired = reconstruct(degraded, cfg.models, block=cfg.block)
        if store is not None:
            repaired = store.run("reconstruct", [{"model": m} for m in cfg.models], lambda cells: reconstruct(
                degraded, [c["model"] for c in cells], block=cfg.block))
        allowed = fc.clean_train_allowlist(train, degraded.select("series_id", "has_clean_train").distinct())
        sources = materialise(fc.forecast_sources(allowed, repaired))
        _must_have(sources, "reconstruct", completed)
    out = {"degraded": degraded, "test": test, "violations": violations, "repaired": repaired}
    keys = [k for k in CELL if k in repaired.columns]
    known = [r.asDict() for r in degraded.select(*keys).distinct().collect()] if keys else [{}]  # kinds of degradation named by the manifest
    source_cells = _source_cells(cfg, [{**c, "model": m} for c in known for m in cfg.models])
    out.update(_forecast_and_score(sources, source_cells, train, test, cfg, store, completed))
    return out


def leaderboard(recon_results: DataFrame, metric: str = "rmse", lower: bool = True) -> DataFrame:
    """Which repair works best: statistics per model over all scored configurations."""
    from mendcast.operators.compare import stats_by_model

    return stats_by_model(recon_results, metric, lower)
