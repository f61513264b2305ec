"""A folder that keeps the tables and models of a run, so that a run that was stopped goes on and a finished one is only read.

A step writes the rows of some grid cells into a folder of its own for every attempt. Only when that is complete, the manifest
gets one record per cell with the folder. Cells without a record are pending: what a lost run left half written is never read.
Records are rows of small Parquet files, so the manifest needs no more than a file system and appends do not touch earlier ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from mendcast.operators.grid import pending_tasks

RECORD = "step string, cell string, path string"


class RunStore:
    """``path`` must lie in a folder that the driver and all executors share. ``identity`` tells runs of different settings apart."""

    def __init__(self, spark: SparkSession, path: str, identity: dict | None = None, commit_every: int | None = None):
        self.spark, self.path, self.commit_every = spark, path.rstrip("/"), commit_every
        self._paths: list[str] = []
        text = json.dumps(identity or {}, sort_keys=True, default=str)
        known = [r.cell for r in self.records().where("step = '_run'").collect()]  # one row
        if not known:
            self._record("_run", [text], self.path)
        elif known != [text]:
            raise ValueError(f"{path} holds a run with other settings: {known[0]}")

    @property
    def manifest(self) -> str:
        return f"{self.path}/manifest"

    def records(self) -> DataFrame:
        """``step, cell, path`` of everything that is complete."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.manifest)
        exists = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(RECORD).parquet(self.manifest) if exists else self.spark.createDataFrame([], RECORD)

    def _record(self, step: str, cells: Sequence[str], path: str) -> None:
        self.spark.createDataFrame([(step, c, path) for c in cells], RECORD).coalesce(1).write.mode("append").parquet(self.manifest)

    def pending(self, step: str, cells: Sequence[dict]) -> list[dict]:
        """Cells of the grid that no finished attempt holds, in the order given."""
        if not cells:
            return []
        grid = self.spark.createDataFrame([(i, _text(c)) for i, c in enumerate(cells)], "at int, cell string")
        left = pending_tasks(grid, self.records().where(F.col("step") == step), ["cell"])
        return [cells[r.at] for r in left.orderBy("at").collect()]  # grid cells, not rows

    def run(self, step: str, cells: Sequence[dict], build: Callable[[list[dict]], DataFrame]) -> DataFrame:
        """Rows of all cells: ``build`` gets the pending ones, at most ``commit_every`` at a time."""
        todo = self.pending(step, cells)
        size = self.commit_every or max(len(todo), 1)
        for i in range(0, len(todo), size):
            self.commit(step, todo[i: i + size], build(todo[i: i + size]))
        return wanted(self.read(step), cells)

    def commit(self, step: str, cells: Sequence[dict], rows: DataFrame) -> None:
        path = self.new_path(step)
        rows.write.parquet(path)
        self._record(step, [_text(c) for c in cells], path)

    def new_path(self, step: str) -> str:
        return f"{self.path}/{step}/{uuid.uuid4().hex}"

    def read(self, step: str) -> DataFrame:
        paths = [r.path for r in self.records().where(F.col("step") == step).select("path").distinct().orderBy("path").collect()]
        if not paths:
            raise ValueError(f"nothing is stored for step {step!r}")
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)


def wanted(rows: DataFrame, cells: Sequence[dict]) -> DataFrame:
    """Rows of the given cells, by the keys that are columns (missing matches missing); the cells are a short list.

    It is broadcast: a cell holds a share of all rows, so a shuffle by these keys would gather that share in one task.
    """
    keys = [k for k in cells[0] if k in rows.columns] if cells else []
    if not keys:
        return rows
    kinds = dict(rows.dtypes)
    grid = rows.sparkSession.createDataFrame(
        list(dict.fromkeys(tuple(c[k] for k in keys) for c in cells)), ", ".join(f"`_{k}` {kinds[k]}" for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(F.broadcast(grid), same, "left_semi")


def _text(cell: dict) -> str:
    return json.dumps(cell, sort_keys=True)


def save_model(model, path: str) -> None:
    """A fitted pipeline, or the table of ``per_series_boosting``."""
    (model.write.parquet(path) if isinstance(model, DataFrame) else model.write().save(path))


def load_model(spark: SparkSession, path: str, learner: str):
    from pyspark.ml import PipelineModel

    return spark.read.parquet(path) if learner == "series_boosting" else PipelineModel.load(path)
