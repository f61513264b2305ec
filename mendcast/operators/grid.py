"""Experiment grid: which series is degraded, repaired and forecast how."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def _options(values: Sequence, kind: str):
    return F.explode(F.array(*[F.lit(v).cast(kind) for v in values]))


def experiment_grid(
    series: DataFrame, techniques: Sequence[str], rates: Sequence[float], iterations: int | Sequence[int], seed: int
) -> DataFrame:
    """series x technique x rate x iteration as a table; a narrow expansion of the series list.

    Every draw hashes all key parts, so the seed is one number and cells never share a random stream.
    """
    for r in rates:
        if not 0.0 <= r <= 1.0:
            raise ValueError(f"rate {r} outside [0, 1]")
    steps = range(1, iterations + 1) if isinstance(iterations, int) else iterations
    return (
        series.select("series_id").distinct()
        .withColumn("technique", _options(techniques, "string"))
        .withColumn("rate", _options(rates, "double"))
        .withColumn("rate_percent", F.round(F.col("rate") * 100).cast("int"))
        .withColumn("iteration", _options(list(steps), "int"))
        .withColumn("seed", F.lit(seed).cast("long"))
    )


def pending_tasks(grid: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid cells without a result yet."""
    return grid.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def model_fanout(grid: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every cell once per model."""
    return grid.withColumn("model", _options(models, "string"))


def seed_replicates(models: Sequence[tuple[str, bool]], n: int, base_seed: int, spark=None) -> DataFrame:
    """Deterministic models once, the others ``n`` times with seeds base+1..base+n."""
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.active()
    rows = spark.createDataFrame(
        [(m, bool(d)) for m, d in models], "model string, deterministic boolean"
    )
    return replicate_models(rows, n, base_seed)


def replicate_models(models: DataFrame, n: int, base_seed: int) -> DataFrame:
    """Same for a table ``model, deterministic``."""
    last = F.when(F.col("deterministic"), F.lit(1)).otherwise(F.lit(int(n)))
    return models.withColumn("iteration", F.explode(F.sequence(F.lit(1), last))).withColumn(
        "seed", F.lit(base_seed) + F.col("iteration")
    )
