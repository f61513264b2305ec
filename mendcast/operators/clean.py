"""Cleaning, splitting and filtering of point tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mendcast.layout import assign_positions, attach_by_block, attach_salted, config_keys, materialise


def coerce_numeric(col: Column | str) -> Column:
    """Invalid text and NaN become missing."""
    c = F.col(col) if isinstance(col, str) else col
    number = c.cast("string").try_cast("double")
    return F.when(~F.isnan(number), number)


def clean_index(df: DataFrame, index: str = "raw_index", key: str = "series_id") -> DataFrame:
    """Axis per series: numeric if every entry is a number, else time if every entry is one, else text.

    Adds ``axis`` (numeric / datetime / string), ``ts`` and ``x``. Numbers are read as numbers, not as
    nanoseconds since the epoch.
    """
    text = F.trim(F.col(index).cast("string"))
    rows = df.withColumn("_num", coerce_numeric(text)).withColumn("_time", F.try_to_timestamp(text))
    kinds = materialise(rows.groupBy(key).agg(
        F.when(F.bool_and(F.col("_num").isNotNull()), F.lit("numeric"))
        .when(F.bool_and(F.col("_time").isNotNull()), F.lit("datetime"))
        .otherwise(F.lit("string")).alias("axis"),
        F.count("*").alias("_n"),
    ))
    tagged = rows.withColumn("_id", F.monotonically_increasing_id())
    return (
        attach_salted(tagged, kinds, [key], "_id")
        .withColumn("ts", F.when(F.col("axis") == "datetime", F.col("_time")))
        .withColumn(
            "x",
            F.when(F.col("axis") == "numeric", F.col("_num"))
            .when(F.col("axis") == "datetime", F.unix_micros("_time").cast("double")),
        )
        .drop("_num", "_time", "_id", "_n")
    )


def drop_all_missing_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(cols))


def dedupe_index_keep_first(df: DataFrame, keys: Sequence[str], ord: str) -> DataFrame:
    """First row in input order per key; only the winning ordinals are aggregated, not the rows."""
    first = df.groupBy(*keys).agg(F.min(ord).alias(ord))
    return df.join(first, [*keys, ord], "left_semi")


def sort_index(df: DataFrame, keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("x",)) -> DataFrame:
    """Ascending order, realised as the ordinal ``pos``."""
    return assign_positions(df, list(keys), list(order))


def clean_series(raw: DataFrame, values: Sequence[str] = ("raw_value",)) -> tuple[DataFrame, DataFrame]:
    """``series_id, input_ord, raw_index, <values>`` to ``points`` and a report per series.

    A row goes only if all its value columns are missing; of equal indexes the first in input order stays.
    """
    values = list(values)
    missing = [c for c in ("raw_index", *values) if c not in raw.columns]
    if missing or not values:
        raise ValueError(f"an index and at least one value column are needed, missing: {missing}")
    typed = clean_index(raw)
    for v in values:
        typed = typed.withColumn(v, coerce_numeric(v))
    kept = drop_all_missing_rows(typed, values).withColumn(
        "_index", F.coalesce(F.col("x").cast("string"), F.col("raw_index").cast("string"))
    )
    unique = dedupe_index_keep_first(kept, ["series_id", "_index"], "input_ord")
    # text axes have no x and are sorted by their text
    placed = assign_positions(unique, ["series_id"], ["x", "_index", "input_ord"])
    points = placed.select(
        "series_id", "pos", "ts", F.coalesce("x", F.col("pos").cast("double")).alias("x"),
        F.col(values[0]).alias("value"), *values[1:],
    )
    before = typed.groupBy("series_id").agg(
        F.count("*").alias("rows_before"),
        F.count_if(F.coalesce(*values).isNull()).alias("rows_all_missing"),
    )
    after = points.groupBy("series_id").agg(F.count("*").alias("rows_after"))
    report = before.join(after, "series_id", "left").select(
        "series_id", "rows_before", "rows_all_missing",
        (F.col("rows_before") - F.col("rows_all_missing") - F.coalesce("rows_after", F.lit(0))).alias("duplicates"),
        F.coalesce("rows_after", F.lit(0)).alias("rows_after"),
    )
    return points, report


def temporal_split(points: DataFrame, n_test: int) -> DataFrame:
    """Last ``n_test`` points are ``test``; series that are not longer than ``n_test`` give a fifth, at least one point
    (``split_report`` calls them shortened).

    A series of one point cannot be split and gets no part. ``step`` numbers the test rows from 1.
    """
    if n_test <= 0:
        raise ValueError("n_test must be positive")
    keys = config_keys(points)
    n = F.col("_n")
    take = F.when(n > n_test, F.lit(n_test)).otherwise(F.greatest(F.lit(1), F.floor(n / 5)))
    sizes = points.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("pos").alias("_last")).withColumn(
        "_cut", F.when(take < n, n - take)
    )
    part = F.when(F.col("pos") >= F.col("_cut"), F.lit("test")).when(F.col("_cut").isNotNull(), F.lit("train"))
    return (
        attach_by_block(points, sizes)
        .withColumn("part", part)
        .withColumn("step", F.when(F.col("part") == "test", F.col("pos") - F.col("_cut") + 1))
        .drop("_n", "_cut")
    )


def train_val_split(points: DataFrame, frac: float = 0.2) -> DataFrame:
    """First ``1-frac`` of each observed series train, the rest validation.

    Needs more than 10 points, more than 5 for training and one for validation, else all is training.
    """
    from mendcast.layout import with_observed_rank

    cut = F.floor(F.col("n_obs") * (1 - frac))
    split = (F.col("n_obs") > 10) & (cut > 5) & (F.col("n_obs") - cut > 0)
    return with_observed_rank(points).withColumn(
        "part", F.when(split & (F.col("rank") >= cut), F.lit("val")).otherwise(F.lit("train"))
    ).drop("rank", "n_obs")


def split_report(split_points: DataFrame, n_test: int) -> DataFrame:
    """Sizes, test share and status per series: ``shortened`` if fewer than the ``n_test`` points asked for could be held out."""
    return split_points.groupBy("series_id").agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col("part") == "train").alias("n_train"),
        F.count_if(F.col("part") == "test").alias("n_test"),
    ).withColumn("test_share", F.col("n_test") / F.col("n_total")).withColumn(
        "status", F.when(F.col("n_test") == 0, "too short").when(F.col("n_test") < n_test, "shortened").otherwise("ok")
    )


def split_totals(report: DataFrame) -> DataFrame:
    """Series and point counts per status."""
    return report.groupBy("status").agg(
        F.count("*").alias("n_series"), F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test")
    )


def filter_configs(
    df: DataFrame, dataset: Sequence = (), technique: Sequence = (), rate: Sequence = (), iteration: Sequence = (),
    metric: str | None = None,
) -> DataFrame:
    """AND of ``IN`` lists, an empty list does not filter.

    With a ``source_type`` column technique and rate apply to reconstructed rows only; ``metric``
    drops the rows without it.
    """
    name = "dataset_name" if "dataset_name" in df.columns else "series_id"
    original = F.col("source_type") == "original" if "source_type" in df.columns else F.lit(False)
    for column, values, spared in (
        (name, dataset, False), ("technique", technique, True), ("rate_percent", rate, True),
        ("iteration", iteration, False),
    ):
        if values:
            inside = F.col(column).isin(*values)
            df = df.where(original | inside if spared else inside)
    return df if metric is None else df.where(F.col(metric).isNotNull())


def local_filter(df: DataFrame, **equals) -> DataFrame:
    """Single equalities; an argument left at ``None`` does not filter, 0 does."""
    for column, value in equals.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def search_any_column(df: DataFrame, term: str) -> DataFrame:
    """Rows with the literal term in any column, ignoring case."""
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(term.lower())), F.lit(False))
    return df.where(hit)


def min_length_filter(points: DataFrame, n: int = 10, strict: bool = True) -> DataFrame:
    """Series with more than (or at least) ``n`` observed points."""
    keys = config_keys(points)
    sizes = points.groupBy(*keys).agg(F.count("value").alias("_n"), F.max("pos").alias("_last"))
    ok = sizes.where(F.col("_n") > n if strict else F.col("_n") >= n).drop("_n")
    return attach_by_block(points, ok)


def validate_complete(points: DataFrame) -> DataFrame:
    """Series with missing values, as violations."""
    return points.groupBy("series_id").agg(
        F.count_if(F.col("value").isNull()).alias("n_missing"), F.count("*").alias("n_total")
    ).where(F.col("n_missing") > 0)
