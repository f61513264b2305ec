"""Reading series from files and tables, the external-gaps manifest, and writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mendcast.layout import assign_positions, attach_by_block, epoch_micros, materialise
from mendcast.operators.clean import coerce_numeric
from mendcast.sources.names import normalize_id, parse_degraded_name

# fixed values: candidate formats in the order they are tried
CSV_FORMATS = ((",", "."), (";", ","), (";", "."), (",", ","))
DEFAULT_FORMAT = (",", ".")


def _number(text: Column, decimal: str) -> Column:
    t = F.trim(text)
    if decimal == ",":
        t = F.when(~F.contains(t, F.lit(".")), F.regexp_replace(t, ",", "."))
    return F.nullif(t, F.lit("")).try_cast("double")


def detect_csv_format(spark: SparkSession, path: str) -> DataFrame:
    """Separator and decimal mark per file, judged on the header and the first data row.

    The first candidate with two columns and a number after the index wins, else comma and dot.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"), "value",
    ).where(F.col("_at") == 0)
    head = lines.groupBy("file").agg(F.min("_id").alias("_id"), F.min_by("value", "_id").alias("header"))
    row = head.select("file", (F.col("_id") + 1).alias("_id"), "header").join(lines, ["file", "_id"], "left")
    rank = F.lit(len(CSV_FORMATS))
    for i, (sep, dec) in reversed(list(enumerate(CSV_FORMATS))):
        cells = F.split("value", sep)
        wide = F.size(F.split("header", sep)) >= 2
        number = F.exists(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))),
                          lambda c: _number(c, dec).isNotNull())
        rank = F.when(F.coalesce(wide & number, F.lit(False)), F.lit(i)).otherwise(rank)
    options = F.array(*[F.struct(F.lit(s).alias("sep"), F.lit(d).alias("decimal"))
                        for s, d in (*CSV_FORMATS, DEFAULT_FORMAT)])
    return row.withColumn("_f", F.get(options, rank)).select("file", "_f.sep", "_f.decimal")


def _series_name() -> Column:
    """File stem; for files inside a folder written by Spark the folder's name (value of ``key=value``)."""
    path = F.regexp_replace(F.col("_metadata.file_path"), r"/part-[^/]*$", "")
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"^[^=]*=|\.csv$", "")


def read_series_csv(
    spark: SparkSession, glob: str, fmt_by_pattern: Mapping[str, tuple[str, str]] | None = None,
    default: tuple[str, str] = DEFAULT_FORMAT,
) -> DataFrame:
    """Raw rows ``series_id, input_ord, raw_index, raw_value`` of many two-column files.

    The format is chosen by the first pattern contained in the path. Paths are file metadata, so each
    read opens only its own files. ``input_ord`` orders the lines of a file across its splits.
    """
    plans, taken = [], F.lit(False)
    name = F.col("_metadata.file_path")
    for pattern, (sep, dec) in [*(fmt_by_pattern or {}).items(), (None, default)]:
        mine = ~taken if pattern is None else F.contains(name, F.lit(pattern)) & ~taken
        raw = (
            spark.read.option("header", True).option("sep", sep).option("nullValue", "")
            .option("recursiveFileLookup", True)
            .schema("raw_index string, raw_value string").csv(glob).where(mine)
        )
        value = F.col("raw_value") if dec == "." else F.regexp_replace("raw_value", ",", ".")
        row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        plans.append(
            raw.select(
                _series_name().alias("series_id"),
                (F.col("_metadata.file_block_start").cast("decimal(38,0)") * F.lit(1 << 33).cast("decimal(12,0)")
                 + row_in_task).cast("decimal(38,0)").alias("input_ord"),
                "raw_index", value.alias("raw_value"),
            )
        )
        if pattern is not None:
            taken = taken | F.contains(name, F.lit(pattern))
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    return out


def typed_degraded(raw: DataFrame) -> DataFrame:
    """Degraded rows from ``series_id`` (the file stem), ``raw_index`` and ``raw_value`` text.

    Blank cells are missing; the key columns come from the name.
    """
    key = parse_degraded_name("series_id")
    text = F.nullif(F.trim("raw_value"), F.lit(""))
    time = F.try_to_timestamp(F.trim("raw_index"))
    number = coerce_numeric("raw_index")
    return (
        raw.withColumn("_k", key)
        .select(
            F.coalesce("_k.dataset", "series_id").alias("series_id"), "_k.technique", "_k.rate_percent",
            "_k.iteration", *[c for c in ("input_ord", "pos") if c in raw.columns],
            F.when(number.isNull(), time).alias("ts"),
            F.coalesce(number, F.unix_micros(time).cast("double")).alias("x"),
            coerce_numeric(text).alias("value"),
        )
    )


def read_degraded(
    spark: SparkSession, glob: str, fmt_by_pattern: Mapping[str, tuple[str, str]] | None = None,
    default: tuple[str, str] = DEFAULT_FORMAT,
) -> DataFrame:
    """Degraded points from ``{dataset}_{technique}_{rate}p_{iteration}.csv`` files; formats as in ``read_series_csv``."""
    rows = typed_degraded(read_series_csv(spark, glob, fmt_by_pattern, default))
    return assign_positions(rows, ["series_id", "technique", "rate_percent", "iteration"], ["input_ord"]).drop(
        "input_ord"
    )


def discover_series(df: DataFrame, selected: Sequence[str] = ()) -> DataFrame:
    """Selected series, or all."""
    ids = df.select("series_id").distinct()
    return ids.where(F.col("series_id").isin(*selected)) if selected else ids


def series_from_table(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] | str, value: str | Column,
    agg: str | None = None, bucket: str | None = None,
) -> DataFrame:
    """Points from any table: one series per key, ordered by a time column and tie breakers.

    ``bucket`` truncates the time ("hour", "day") and ``agg`` ("avg", "sum", ...) combines the rows of a
    bucket; both are partial aggregates before anything is shuffled.
    """
    order = [order] if isinstance(order, str) else list(order)
    measure = F.col(value) if isinstance(value, str) else value
    sid = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    time = order[0]
    rows = df.select(sid.alias("series_id"), *order, measure.cast("double").alias("value"))
    if bucket:
        kind = dict(df.dtypes)[time]
        rows = rows.withColumn(time, F.date_trunc(bucket, time).cast(kind))
    if agg:
        rows = rows.groupBy("series_id", time).agg(getattr(F, agg)("value").alias("value"))
        order = [time]
    placed = assign_positions(rows, ["series_id"], order)
    value_col = F.when(~F.isnan("value"), F.col("value"))
    return placed.select(
        "series_id", "pos", F.col(time).alias("ts"), epoch_micros(placed, time).alias("x"), value_col.alias("value")
    )


# fixed values: microseconds of a calendar step
CALENDAR = {"hour": 3_600_000_000, "day": 86_400_000_000}


def on_calendar(points: DataFrame, step: str) -> DataFrame:
    """Completes each series to a gapless hour or day axis; new rows have no value.

    Positions follow from the calendar by arithmetic. The axis is generated day by day, so no array
    grows with the length of a series.
    """
    width = CALENDAR[step]
    per_day = CALENDAR["day"] // width
    kind = dict(points.dtypes)["ts"]
    slot = F.floor(F.col("x") / width).cast("long")
    ends = points.groupBy("series_id").agg(F.min(slot).alias("_a"), F.max(slot).alias("_b"))
    spine = (
        ends.withColumn("_day", F.explode(F.expr(f"sequence(_a div {per_day}, _b div {per_day})")))
        .withColumn("_slot", F.explode(F.sequence(F.col("_day") * per_day, F.col("_day") * per_day + per_day - 1)))
        .where((F.col("_slot") >= F.col("_a")) & (F.col("_slot") <= F.col("_b")))
        .select("series_id", "_slot", (F.col("_slot") - F.col("_a")).alias("pos"))
    )
    seen = points.select("series_id", slot.alias("_slot"), "value")
    micros = F.col("_slot") * width
    ts = (
        F.expr(f"timestampadd(MICROSECOND, _slot * {width}L, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
        if kind == "timestamp_ntz" else F.timestamp_micros(micros)
    )
    return spine.join(seen, ["series_id", "_slot"], "left").select(
        "series_id", "pos", ts.alias("ts"), micros.cast("double").alias("x"), "value"
    )


def external_ingest(
    points: DataFrame, manifest: DataFrame, require_train_missing: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Series that come with their own gaps: ``(degraded, test, train, violations)``.

    ``manifest`` has one row per entry: ``id``, ``series`` + ``n_test`` (last n rows are the test) or ``train`` +
    ``test`` (ids of two series), optional ``train_clean``, ``technique`` (EXTERNAL), ``rate_percent`` (0) and
    ``iteration`` (1). Entries breaking a rule are listed in ``violations`` and kept out of the rest.
    """
    m = manifest.select(
        normalize_id("id").alias("id"), "series", "n_test", "train", "test", "train_clean",
        F.trim(F.coalesce("technique", F.lit("EXTERNAL"))).alias("technique"),
        F.coalesce("rate_percent", F.lit(0)).alias("rate_percent"),
        F.coalesce("iteration", F.lit(1)).alias("iteration"),
    )
    src = points.select(F.col("series_id").alias("source"), "pos", "ts", "x", "value")
    whole = m.where(F.col("series").isNotNull())
    sizes = materialise(src.groupBy("source").agg(F.count("*").alias("_n"), F.max("pos").alias("_last")))
    cuts = whole.join(sizes.drop("_last").withColumnRenamed("source", "series"), "series", "left").withColumn(
        "_cut", F.coalesce("_n", F.lit(0)) - F.col("n_test")
    )

    def take(entries, ref, *extra):
        """Points of the referenced sources; the join key holds the block, so long sources stay spread."""
        named = entries.where(F.col(ref).isNotNull()).select(F.col(ref).alias("source"), "id", *extra)
        return attach_by_block(src, named.join(sizes.drop("_n"), "source"), ["source"])

    split = take(cuts, "series", "_cut")
    pairs = m.where(F.col("series").isNull())

    body = ["id", "pos", "ts", "x", "value"]
    train_rows = split.where(F.col("pos") < F.col("_cut")).select(*body).unionByName(take(pairs, "train").select(*body))
    test_rows = (
        split.where(F.col("pos") >= F.col("_cut"))
        .withColumn("pos", F.col("pos") - F.greatest("_cut", F.lit(0))).select(*body)
        .unionByName(take(pairs, "test").select(*body))
    )
    clean_rows = take(m, "train_clean").select(*body)

    def facts(df, tag):
        return df.groupBy("id").agg(
            F.count("*").alias(f"{tag}_rows"), F.count_if(F.col("value").isNull()).alias(f"{tag}_missing"),
            F.max("pos").alias(f"{tag}_last"),
        )

    checks = m.join(cuts.select("id", F.col("_n")), "id", "left")
    for df, tag in ((train_rows, "train"), (test_rows, "test"), (clean_rows, "clean")):
        checks = checks.join(facts(df, tag), "id", "left")
    checks = checks.fillna(
        0, [f"{t}_{w}" for t in ("train", "test", "clean") for w in ("rows", "missing")]
    )
    # one row per entry, read by all four results
    checks = materialise(checks)
    has_clean = F.col("train_clean").isNotNull()
    rules = {
        "technique must be one token": (F.col("technique") == "") | F.contains("technique", F.lit("_")),
        "series, or train and test, required": F.col("series").isNull()
        & (F.col("train").isNull() | F.col("test").isNull()),
        "n_test must be positive": F.col("series").isNotNull() & (F.coalesce("n_test", F.lit(0)) <= 0),
        "series not longer than n_test": F.col("series").isNotNull()
        & (F.coalesce("_n", F.lit(0)) <= F.coalesce("n_test", F.lit(0))),
        "test is empty": F.col("test_rows") == 0,
        "test has missing values": F.col("test_missing") > 0,
        "train has no missing values": F.lit(require_train_missing) & (F.col("train_missing") == 0),
        "clean train has missing values": has_clean & (F.col("clean_missing") > 0),
        "clean train differs in length": has_clean & (F.col("clean_rows") != F.col("train_rows")),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]))
    violations = checks.select("id", F.explode(broken).alias("rule"))
    good = checks.where(F.size(broken) == 0).withColumn("has_clean_train", has_clean)

    def kept(rows, tag, *extra):
        return attach_by_block(rows, good.select("id", *extra, F.col(f"{tag}_last").alias("_last")), ["id"])

    degraded = kept(train_rows, "train", "technique", "rate_percent", "iteration", "has_clean_train").select(
        F.col("id").alias("series_id"), "technique", "rate_percent", "iteration", "has_clean_train",
        "pos", "ts", "x", "value",
    )
    test = kept(test_rows, "test").select(
        F.col("id").alias("series_id"), "pos", (F.col("pos") + 1).alias("step"), "ts", "x", "value"
    )
    train = kept(clean_rows, "clean").select(
        F.col("id").alias("series_id"), "pos", "ts", "x", "value"
    )
    return degraded, test, train, violations


def write_points(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "parquet") -> None:
    """Writes points cell by cell; a cell is one series under one configuration.

    Without ``overwrite`` cells that the table holds with as many rows as ``df`` are finished and skipped; a cell with another
    number of rows was left half-written and is replaced. With ``overwrite`` every cell of ``df`` is replaced. Other cells stay:
    the partitions touched are merged in a stored table first and then swapped in.
    """
    spark = df.sparkSession
    parts = [c for c in ("technique", "rate_percent", "model") if c in df.columns]
    keys = [c for c in ("series_id", "technique", "rate_percent", "iteration", "model") if c in df.columns]

    def save(rows, mode):
        writer = rows.write.mode(mode).partitionBy(*parts) if parts else rows.write.mode(mode)
        writer = writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" and parts else writer
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)

    def among(rows, cells, columns, how):
        return rows.join(cells, [rows[c].eqNullSafe(cells[c]) for c in columns], how)

    old = _existing(spark, path, df, fmt)
    if old is None:
        return save(df, "append")
    new_cells = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    old_cells = old.groupBy(*keys).agg(F.count("*").alias("_n"))
    done = new_cells.limit(0) if overwrite else old_cells
    todo = materialise(among(new_cells, done, [*keys, "_n"], "left_anti").select(*keys))
    rows = among(df, todo, keys, "left_semi")
    if among(old_cells, todo, keys, "left_semi").isEmpty():
        return save(rows, "append")
    touched = todo.select(*parts).distinct()
    rest = among(old, todo, keys, "left_anti")
    rest = among(rest, touched, parts, "left_semi") if parts else rest
    save(materialise(rows.unionByName(rest)), "overwrite")


write_results = write_points


def _existing(spark: SparkSession, path: str, like: DataFrame, fmt: str) -> DataFrame | None:
    """The stored table, or None if there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        reader = spark.read.schema(like.schema)
        return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def export_filtered_csv(df: DataFrame, path: str, sort: Sequence[str]) -> None:
    """Filtered rows as CSV in global sort order (range partitioned, one file per range)."""
    df.orderBy(*sort).write.mode("overwrite").option("header", True).csv(path)
