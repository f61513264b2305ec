"""Keys encoded in file names: parsing, building and picking the newest run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _stem(col) -> Column:
    return F.regexp_replace(_c(col), r"\.csv$", "")


def normalize_id(col) -> Column:
    """Runs outside ``[a-zA-Z0-9_-]`` become ``_``; nothing left is an error."""
    clean = F.btrim(F.regexp_replace(F.trim(_c(col)), "[^a-zA-Z0-9_-]+", "_"), F.lit("_"))
    return F.when(clean == "", F.raise_error(F.lit("empty identifier"))).otherwise(clean)


def parse_degraded_name(col) -> Column:
    """``{dataset}_{technique}_{rate}p_{iteration}``, read from the right; no match gives missing."""
    pattern = r"^(.+)_([^_]+)_(\d+)p_(\d+)$"
    s = _stem(col)
    ok = s.rlike(pattern)
    part = lambda i: F.when(ok, F.regexp_extract(s, pattern, i))
    return F.struct(
        part(1).alias("dataset"), part(2).alias("technique"),
        part(3).cast("int").alias("rate_percent"), part(4).cast("int").alias("iteration"),
    )


def _first_rate(parts: Column) -> Column:
    """1-based place of the first ``NNp`` token, 0 if none."""
    return F.array_position(F.transform(parts, lambda t: t.rlike(r"^\d+p$")), True)


def _joined(parts: Column, start, length) -> Column:
    return F.array_join(F.slice(parts, start, F.greatest(length, F.lit(0))), "_")


def parse_reconstructed_name(col) -> Column:
    """``{dataset}_{technique}_{rate}p_{iteration}_{model}``; dataset and model may hold underscores."""
    parts = F.split(_stem(col), "_")
    at = _first_rate(parts)
    size = F.size(parts)
    step = F.get(parts, at).try_cast("int")
    ok = (size >= 5) & (at >= 2) & (at + 2 <= size) & step.isNotNull()
    return F.struct(
        F.when(ok, _joined(parts, F.lit(1), at - 2)).alias("dataset_name"),
        F.when(ok, F.get(parts, at - 2)).alias("technique"),
        F.when(ok, F.regexp_extract(F.get(parts, at - 1), r"^(\d+)p$", 1).try_cast("int")).alias("rate_percent"),
        F.when(ok, step).alias("iteration"),
        F.when(ok, _joined(parts, F.when(ok, at + 2).otherwise(F.lit(1)), size - at - 1)).alias("model"),
    )


def parse_prediction_name(df: DataFrame, names: Sequence[str], column: str = "name") -> DataFrame:
    """Adds the eight key columns of a forecast name; ``names`` are the known forecasters.

    An ``_iterN`` suffix is the forecast iteration (default 1). Names with ``_original_`` hold no repair
    part; in the others the longest known forecaster at the end splits repair from forecaster, the
    last token if none is known.
    """
    stem = _stem(column)
    tail = F.regexp_extract(stem, r"_iter(\d+)$", 1)
    body = F.regexp_replace(stem, r"_iter\d+$", "")
    parts = F.split(body, "_")
    original = F.contains(body, F.lit("_original_"))
    at_o = F.array_position(parts, "original")
    at = _first_rate(parts)
    size = F.size(parts)
    ok = ~original & (at >= 3) & (at < size)
    rest = _joined(parts, F.when(ok, at + 2).otherwise(F.lit(1)), size - at - 1)
    known = F.lit(None).cast("string")
    for n in sorted(names):
        hit = (rest == n) | F.endswith(rest, F.lit(f"_{n}"))
        known = F.when(hit & (F.lit(len(n)) > F.coalesce(F.length(known), F.lit(0))), F.lit(n)).otherwise(known)
    last = F.element_at(F.split(rest, "_"), -1)
    forecaster = F.coalesce(known, last)
    repair = F.substring(rest, F.lit(1), F.greatest(F.length(rest) - F.length(forecaster) - 1, F.lit(0)))
    number = lambda c: c.try_cast("int")
    return df.select(
        "*",
        F.when(original, _joined(parts, F.lit(1), at_o - 1)).when(ok, _joined(parts, F.lit(1), at - 2))
        .alias("dataset_name"),
        F.when(original, F.lit("original")).when(ok, F.lit("reconstructed")).alias("source_type"),
        F.when(ok, F.get(parts, at - 2)).alias("technique"),
        F.when(ok, number(F.regexp_extract(F.get(parts, at - 1), r"^(\d+)p$", 1))).alias("rate_percent"),
        F.when(ok, number(F.get(parts, at))).alias("reconstruction_iteration"),
        F.when(ok, repair).alias("reconstruction_model"),
        F.when(original, _joined(parts, at_o + 1, size - at_o)).when(ok, forecaster).alias("prediction_model"),
        F.coalesce(number(F.nullif(tail, F.lit(""))), F.lit(1)).alias("prediction_iteration"),
    )


def build_key_name(dataset, technique, rate_percent, iteration, *rest) -> Column:
    """``dataset_technique_{rate}p_iteration[_...]``, the inverse of the parsers."""
    return F.concat_ws(
        "_", _c(dataset), _c(technique), F.concat(_c(rate_percent).cast("string"), F.lit("p")),
        _c(iteration).cast("string"), *[_c(r) for r in rest],
    )


def latest_snapshot(df: DataFrame, name_col: str) -> DataFrame:
    """Rows of the newest run by the ``YYYYMMDD_HHMMSS`` in the name; the maximum is a one-row subquery."""
    stamp = F.nullif(F.regexp_extract(F.col(name_col), r"(\d{8}_\d{6})", 1), F.lit(""))
    newest = df.select(F.max(stamp).alias("run_ts")).scalar()
    return df.withColumn("run_ts", stamp).where(F.col("run_ts") == newest)
