"""Injection of missing values: weighted sampling without replacement inside every series.

Each row gets the exponential key ``-ln(u)/w`` (Efraimidis and Spirakis); the ``floor(n*rate)`` smallest
keys of a series are masked. Instead of ranking whole series, the cut-off key is found first:

1. rows are counted in buckets of ``ln(key)``. That logarithm has density at most 1/e per unit for any
   weights, so buckets as wide as the wanted share of rows hold fewer rows than that share;
2. only the bucket in which the count reaches the quota is ranked;
3. a narrow pass compares every row with its cell's cut-off.

The points x cells product is therefore generated on the fly and never shuffled. The cells of a series
travel as one short array (its length is the number of grid cells).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mendcast.functions.draws import exponential_draw
from mendcast.functions.percentiles import exact_median
from mendcast.layout import BLOCK, attach_by_block, materialise
from mendcast.operators.grid import experiment_grid

TECHNIQUES = ("MCAR", "MAR", "MNAR")
CELL = ("technique", "rate_percent", "iteration")
BLOCKS_PER_BUCKET = 16  # a million rows per bucket keep both the bucket table and the ranked bucket small


def _weight(technique: Column) -> Column:
    away = F.coalesce(F.abs(F.col("value") - F.col("_median")), F.lit(0.0))
    ramp = F.when(F.col("_n") > 1, 0.1 + 0.9 * F.col("pos") / (F.col("_n") - 1)).otherwise(F.lit(0.1))
    return F.when(technique == "MAR", away).when(technique == "MNAR", ramp).otherwise(F.lit(1.0))


def _keyed(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points x cells with the order of masking: ``late`` (weight 0 goes last), ``key``, ``pos``."""
    rows = (
        attach_by_block(points, cells, ["series_id"])
        .withColumn("_cell", F.explode("_cells"))
        .select("*", "_cell.*").drop("_cells", "_cell")
    )
    w = _weight(F.col("technique"))
    e = exponential_draw("series_id", "pos", *CELL, "seed")
    return (
        rows.withColumn("_w", w)
        .withColumn("late", (F.col("_w") <= 0).cast("int"))
        .withColumn("key", e / F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.lit(1.0)))
        .drop("_w")
    )


def _with_cells(series: DataFrame, cells: DataFrame) -> DataFrame:
    packed = cells.groupBy("series_id").agg(
        F.collect_list(F.struct(*[c for c in cells.columns if c != "series_id"])).alias("_cells")
    )
    return series.join(packed, "series_id")


def degrade(points: DataFrame, grid: DataFrame, keep_truth: bool = False, block: int = BLOCK) -> DataFrame:
    """Masks the points once per cell of ``grid``; other columns stay as they are.

    ``keep_truth`` adds the untouched value as ``truth`` so that scoring needs no join afterwards.
    Techniques registered by the user are applied to their own cells and unioned.
    """
    from mendcast.plans.registry import custom_techniques, run_custom_technique

    own = custom_techniques()
    native = grid.where(~F.col("technique").isin(*own)) if own else grid
    masked = _degrade_native(points, native, block)
    for name in own:
        cells = grid.where(F.col("technique") == name)
        masked = masked.unionByName(run_custom_technique(name, points, cells))
    return masked if keep_truth else masked.drop("truth")


def _degrade_native(points: DataFrame, grid: DataFrame, block: int) -> DataFrame:
    ids = ["series_id", *CELL]
    # one row per series and one per cell: stored, since three passes read them
    series = points.groupBy("series_id").agg(F.count("*").alias("_n"), F.max("pos").alias("_last"))
    if grid.where(F.col("technique") == "MAR").isEmpty():
        series = series.withColumn("_median", F.lit(None).cast("double"))
    else:
        series = series.join(exact_median(points, ["series_id"], "value", "_median"), "series_id", "left")
    series = materialise(series)
    cells = grid.join(series, "series_id").select(
        *ids, "seed", F.floor(F.col("_n") * F.col("rate")).alias("quota")
    )
    slim = points.select("series_id", "pos", "value")

    bucket = F.floor(F.ln("key") * F.ceil(F.col("_n") / (block * BLOCKS_PER_BUCKET)))
    keyed = _keyed(slim, _with_cells(series, cells.where("quota > 0"))).withColumn("bucket", bucket)
    order = W.partitionBy(*ids).orderBy("late", "bucket")
    reach = (
        keyed.groupBy(*ids, "late", "bucket")
        .agg(F.count("*").alias("_c"), F.max("quota").alias("quota"), F.max("seed").alias("seed"))
        .withColumn("_end", F.sum("_c").over(order))
        .where((F.col("_end") >= F.col("quota")) & (F.col("_end") - F.col("_c") < F.col("quota")))
        .select(*ids, "seed", F.col("late").alias("at_late"), F.col("bucket").alias("at_bucket"),
                (F.col("quota") - F.col("_end") + F.col("_c")).alias("nth"))
    )
    edge = (
        _keyed(slim, _with_cells(series, reach)).withColumn("bucket", bucket)
        .where((F.col("late") == F.col("at_late")) & (F.col("bucket") == F.col("at_bucket")))
        .select(*ids, "late", "key", "pos", "nth")
    )
    cutoff = materialise(
        edge.withColumn("_rn", F.row_number().over(W.partitionBy(*ids).orderBy("key", "pos")))
        .where(F.col("_rn") == F.col("nth"))
        .select(*ids, F.col("late").alias("cut_late"), F.col("key").alias("cut_key"), F.col("pos").alias("cut_pos"))
    )
    final = cells.join(cutoff, ids, "left")
    extra = [c for c in points.columns if c not in ("series_id", "value")]
    late, key, at = F.col("late"), F.col("key"), F.col("pos")
    within = (late < F.col("cut_late")) | (
        (late == F.col("cut_late"))
        & ((key < F.col("cut_key")) | ((key == F.col("cut_key")) & (at <= F.col("cut_pos"))))
    )
    hit = F.coalesce(within, F.lit(False))
    return _keyed(points, _with_cells(series, final)).select(
        *ids, *extra,
        F.when(~hit, F.col("value")).alias("value"),
        F.col("value").alias("truth"),
    )


def _single(points: DataFrame, technique: str, rate: float, seed: int, block: int) -> DataFrame:
    return degrade(points, experiment_grid(points, [technique], [rate], 1, seed), block=block)


def mask_mcar(points: DataFrame, rate: float, seed: int, block: int = BLOCK) -> DataFrame:
    """Missing completely at random: equal weights."""
    return _single(points, "MCAR", rate, seed, block)


def mask_mar(points: DataFrame, rate: float, seed: int, block: int = BLOCK) -> DataFrame:
    """Weights are distances to the series median; rows of weight 0 are drawn last."""
    return _single(points, "MAR", rate, seed, block)


def mask_mnar(points: DataFrame, rate: float, seed: int, block: int = BLOCK) -> DataFrame:
    """Weights grow linearly from 0.1 at the start to 1.0 at the end of the series."""
    return _single(points, "MNAR", rate, seed, block)


def missing_report(degraded: DataFrame) -> DataFrame:
    """Missing count and share per configuration."""
    from mendcast.layout import config_keys

    return degraded.groupBy(*config_keys(degraded)).agg(
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.count("*").alias("n_total"),
    ).withColumn("missing_share", F.col("n_missing") / F.col("n_total"))
