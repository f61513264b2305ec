"""Series as square matrices: long tables ``keys, i, j, v`` of a fixed size.

A series is first resampled to ``size`` values. Only those travel further, as one array of fixed length
per series, so matrix cells are expanded from a short row and never from a join of the points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from mendcast.layout import BLOCK, attach_by_block, attach_salted, config_keys, materialise


def _with_length(points: DataFrame, keys: list[str]) -> DataFrame:
    sizes = points.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("pos").alias("_last"))
    return attach_by_block(points, sizes, keys)


def resample_linear(points: DataFrame, size: int = 512) -> DataFrame:
    """Linear resample of the position axis to ``size`` values (``i`` 0..size-1).

    Every row adds its share to the targets it brackets: a narrow expansion and a partial aggregate.
    Rows between two targets contribute nothing and are dropped before the shuffle.
    """
    keys = config_keys(points)
    rows = _with_length(points.select(*keys, "pos", "value"), keys)
    scale = (F.col("_n") - 1) / F.lit(float(size - 1))
    # with a single value all targets sit on it
    low = F.greatest(F.when(scale > 0, F.floor((F.col("pos") - 1) / scale) - 1).otherwise(F.lit(0)), F.lit(0))
    high = F.least(F.when(scale > 0, F.ceil((F.col("pos") + 1) / scale) + 1).otherwise(F.lit(size - 1)), F.lit(size - 1))
    at = F.col("i") * F.col("_s")
    base = F.least(F.floor(at), F.greatest(F.col("_n") - 2, F.lit(0)))
    frac = at - base
    share = F.when(F.col("pos") == base, 1 - frac).when(F.col("pos") == base + 1, frac)
    return (
        rows.withColumn("_s", scale)
        .withColumn("i", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
        .withColumn("_w", share).where(F.col("_w").isNotNull())
        .groupBy(*keys, "i").agg(
            F.when(F.count_if(F.col("value").isNull() & (F.col("_w") > 0)) == 0, F.sum(F.col("value") * F.col("_w")))
            .alias("value")
        )
    )


def _vectors(points: DataFrame, size: int) -> DataFrame:
    """Resampled values of a series as one array of length ``size``."""
    keys = config_keys(points)
    entries = F.sort_array(F.collect_list(F.struct("i", "value")))
    return resample_linear(points, size).groupBy(*keys).agg(
        F.transform(entries, lambda e: e["value"]).alias("vec")
    ).withColumn("_lo", F.array_min("vec")).withColumn("_hi", F.array_max("vec"))


def _cells(vectors: DataFrame, keys: list[str], value, extra=()) -> DataFrame:
    """All (i, j) cells; ``value(a, b)`` of the two vector entries."""
    left = vectors.select("*", F.posexplode("vec").alias("i", "_a"))
    both = left.select(*keys, "i", "_a", *extra, F.posexplode("vec").alias("j", "_b"))
    return both.select(*keys, "i", "j", value(F.col("_a"), F.col("_b")).cast("double").alias("v"))


def _scaled(vectors: DataFrame, low: float, high: float) -> DataFrame:
    span = F.col("_hi") - F.col("_lo")

    def one(v: Column) -> Column:
        return F.when(span > 0, (v - F.col("_lo")) / span * (high - low) + low).otherwise(F.lit(0.0))

    return vectors.withColumn("vec", F.transform("vec", lambda v: F.greatest(F.least(one(v), F.lit(high)), F.lit(low))))


def encode_gaf(points: DataFrame, size: int = 512) -> DataFrame:
    """cos(phi_i + phi_j) of the values scaled to [-1, 1]; a constant series counts as 0."""
    keys = config_keys(points)
    root = lambda a: F.sqrt(F.greatest(1 - a * a, F.lit(0.0)))
    return _cells(_scaled(_vectors(points, size), -1.0, 1.0), keys, lambda a, b: a * b - root(a) * root(b))


def encode_mtf(points: DataFrame, size: int = 512, n_bins: int = 8) -> DataFrame:
    """1 where both values fall in the same of ``n_bins`` equal-width bins."""
    keys = config_keys(points)
    span = F.col("_hi") - F.col("_lo")
    vectors = _vectors(points, size).withColumn(
        "vec",
        F.transform("vec", lambda v: F.when(
            span > 0, F.least(F.floor((v - F.col("_lo")) / span * n_bins), F.lit(n_bins - 1)).cast("double")
        ).otherwise(F.lit(0.0))),
    )
    return _cells(vectors, keys, lambda a, b: (a == b).cast("int"))


def encode_rp(points: DataFrame, size: int = 512, epsilon: float | None = None) -> DataFrame:
    """1 where min-max scaled values are nearer than ``epsilon`` (default a tenth of their deviation)."""
    keys = config_keys(points)
    vectors = _scaled(_vectors(points, size), 0.0, 1.0)
    n = F.size("vec")
    mean = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v) / n
    deviation = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m"))) / n)
    vectors = vectors.withColumn("_m", mean).withColumn(
        "_eps", F.lit(float(epsilon)) if epsilon is not None else 0.1 * deviation
    )
    return _cells(vectors, keys, lambda a, b: (F.abs(a - b) < F.col("_eps")).cast("int"), extra=["_eps"])


def encode_spectrogram(points: DataFrame, nperseg: int | None = None) -> DataFrame:
    """Power in dB per window ``j`` and frequency ``i``: Hann window, mean removed, hop 7/8 of a window.

    Default window length min(256, n//4). Only full windows count; a row belongs to at most two, each
    window is gathered as an array of its fixed length.
    """
    keys = config_keys(points)
    rows = _with_length(points.select(*keys, "pos", "value"), keys)
    length = F.lit(nperseg) if nperseg else F.least(F.lit(256), F.floor(F.col("_n") / 4)).cast("int")
    rows = rows.withColumn("_m", length).where(F.col("_m") >= 2).withColumn(
        "_hop", F.col("_m") - F.floor(F.col("_m") / 8).cast("int")
    )
    first = F.greatest(F.floor((F.col("pos") - F.col("_m")) / F.col("_hop")) + 1, F.lit(0))
    last = F.floor(F.col("pos") / F.col("_hop"))
    windows = (
        rows.withColumn("j", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        .withColumn("_k", F.col("pos") - F.col("j") * F.col("_hop"))
        .where((F.col("_k") < F.col("_m")) & (F.col("j") * F.col("_hop") + F.col("_m") <= F.col("_n")))
        .groupBy(*keys, "j")
        .agg(F.max("_m").alias("_m"), F.sort_array(F.collect_list(F.struct("_k", "value"))).alias("_w"))
        .where(F.size("_w") == F.col("_m"))
    )
    mean = F.aggregate("_w", F.lit(0.0), lambda a, e: a + e["value"]) / F.col("_m")
    hann = lambda k: 0.5 - 0.5 * F.cos(2 * math.pi * k / F.col("_m"))
    windows = windows.withColumn("_mean", mean).withColumn(
        "_t", F.transform("_w", lambda e: F.struct(e["_k"].alias("k"), ((e["value"] - F.col("_mean")) * hann(e["_k"])).alias("y")))
    ).withColumn("_e", F.aggregate("_w", F.lit(0.0), lambda a, e: a + hann(e["_k"]) * hann(e["_k"])))
    freq = windows.withColumn("i", F.explode(F.expr("sequence(0, _m div 2)")))
    angle = lambda k: 2 * math.pi * F.pmod(k * F.col("i"), F.col("_m")) / F.col("_m")
    re = F.aggregate("_t", F.lit(0.0), lambda a, e: a + e["y"] * F.cos(angle(e["k"])))
    im = F.aggregate("_t", F.lit(0.0), lambda a, e: a + e["y"] * F.sin(angle(e["k"])))
    sides = F.when((F.col("i") == 0) | (2 * F.col("i") == F.col("_m")), F.lit(1.0)).otherwise(F.lit(2.0))
    power = (re * re + im * im) * sides / F.col("_e")
    return freq.select(*keys, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (10 * F.log10(power + F.lit(1e-10))).alias("v"))


def encode_mask(degraded: DataFrame, size: int = 512, time_axis_only: bool = False) -> DataFrame:
    """1 in the stripes ``int(pos*size/n)`` of missing rows, on both axes (only ``j`` for spectrograms)."""
    keys = config_keys(degraded)
    rows = _with_length(degraded.select(*keys, "pos", "value"), keys)
    stripe = F.floor(F.col("pos") * size / F.col("_n")).cast("int")
    stripes = (
        rows.groupBy(*keys, stripe.alias("s")).agg(F.bool_or(F.col("value").isNull()).alias("_miss"))
        .groupBy(*keys).agg(F.collect_set(F.when(F.col("_miss"), F.col("s"))).alias("_set"))
    )
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    cells = stripes.withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis))
    hit = F.array_contains("_set", F.col("j"))
    if not time_axis_only:
        hit = hit | F.array_contains("_set", F.col("i"))
    return cells.select(*keys, "i", "j", hit.cast("double").alias("v"))


def scale_to_uint8(matrix: DataFrame) -> DataFrame:
    """Min-max to 0..255, truncated; a constant matrix becomes 0.

    The level is rounded to six digits before it is truncated, so a value next to a whole number does not depend on its last bit.
    """
    keys = config_keys(matrix)
    ends = materialise(matrix.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count("*").alias("_n")))
    span = F.col("_hi") - F.col("_lo")
    level = F.round((F.col("v") - F.col("_lo")) / span * 255, 6)
    spread = matrix.withColumn("_cell", F.struct("i", "j"))
    return attach_salted(spread, ends, keys, "_cell").select(
        *keys, "i", "j", F.when(span > 0, F.floor(level)).otherwise(F.lit(0)).cast("int").alias("v")
    )


def _stretch(profile: DataFrame, points: DataFrame, low: float, high: float, block: int = BLOCK) -> DataFrame:
    """Profile values (``i``, ``v``) stretched over the positions and mapped from [low, high] to the observed range.

    Every block of positions gets the range of profile entries that it lies between as a short array, so points and entries meet on
    (series, block) and neither a profile nor a series is gathered anywhere.
    """
    keys = config_keys(points)
    facts = points.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.max("pos").alias("_last")
    ).join(profile.groupBy(*keys).agg((F.max("i") + 1).cast("long").alias("_size")), keys)
    # entry i bounds the positions between those that lie at i - 1 and i + 1
    wide = (F.col("_n") - 1) / F.greatest(F.col("_size") - 1, F.lit(1))
    from_block = F.floor(F.greatest((F.col("i") - 1) * wide - 1, F.lit(0.0)) / block)
    to_block = F.floor(F.least((F.col("i") + 1) * wide + 1, F.col("_last").cast("double")) / block)
    sized = facts.select(*keys, "_n", "_size", F.col("_last").alias("_until"), (F.col("_size") - 1).alias("_last"))
    entries = attach_by_block(profile.withColumn("i", F.col("i").cast("long")), sized, keys, by="i", block=block).withColumn("_last", F.col("_until"))
    ranges = (
        entries.withColumn("_b", F.explode(F.sequence(from_block.cast("long"), F.greatest(to_block, from_block).cast("long"))))
        .groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_near"))
        .select(*keys, "_b", F.get("_near", F.lit(0))["i"].alias("_first"), F.transform("_near", lambda e: e["v"]).alias("_near"))
    )
    at = F.when(F.col("_n") > 1, F.col("pos") * (F.col("_size") - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    k = (F.floor("_at") - F.col("_first")).cast("int")
    a = F.get("_near", k)
    value = a + (F.coalesce(F.get("_near", k + 1), a) - a) * (F.col("_at") - F.floor("_at"))
    span = F.col("_hi") - F.col("_lo")
    mapped = F.when(span > 0, (value - low) / (high - low) * span + F.col("_lo")).otherwise(F.col("_lo"))
    placed = attach_by_block(points, facts, keys, block=block).withColumn("_at", at).withColumn("_b", F.expr(f"pos div {int(block)}"))
    return placed.join(ranges, [*keys, "_b"]).select(
        *[mapped.alias("value") if c == "value" else F.col(c) for c in points.columns]
    )


def decode_diagonal(matrix: DataFrame, points: DataFrame, cosine: bool = False, block: int = BLOCK) -> DataFrame:
    """Diagonal as profile: ``cosine=True`` for GAF matrices (cos of the diagonal, range [-1, 1])."""
    keys = config_keys(matrix)
    diagonal = matrix.where(F.col("i") == F.col("j")).select(
        *keys, "i", (F.cos("v") if cosine else F.col("v")).alias("v")
    )
    return _stretch(diagonal, points, -1.0 if cosine else 0.0, 1.0, block)


def decode_row_mean(matrix: DataFrame, points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Row means as profile (recurrence matrices)."""
    keys = config_keys(matrix)
    return _stretch(matrix.groupBy(*keys, "i").agg(F.avg("v").alias("v")), points, 0.0, 1.0, block)


def decode_column_mean(matrix: DataFrame, points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Column means, min-max normalised, as profile (spectrograms)."""
    keys = config_keys(matrix)
    columns = matrix.groupBy(*keys, F.col("j").cast("long").alias("i")).agg(F.avg("v").alias("v"))
    ends = columns.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.max("i").alias("_last"))
    span = F.col("_hi") - F.col("_lo")
    unit = attach_by_block(columns, ends, keys, by="i").select(
        *keys, "i", F.when(span > 0, (F.col("v") - F.col("_lo")) / span).otherwise(F.lit(0.0)).alias("v")
    )
    return _stretch(unit, points, 0.0, 1.0, block)
