"""Physical layout of point tables: ordinals, blocks and neighbour look-ups.

A point table holds one row per observation: ``series_id, pos, ts, x, value`` plus,
after masking and repair, the configuration columns of ``KEY_COLUMNS``.

One series may hold a large share of all rows, so no operator here ever sorts or
collects a whole series in one task. A series is cut into blocks of ``block``
consecutive positions; windows run inside ``(keys, block)`` and what has to cross a
block edge travels in a summary table with one short row per block.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

KEY_COLUMNS = ("series_id", "technique", "rate_percent", "iteration", "model")
BLOCK = 1 << 16


def config_keys(df: DataFrame) -> list[str]:
    """Key columns of a point table; forecast sources carry one combined key without missing parts."""
    if "source_id" in df.columns:
        return ["source_id"]
    return [c for c in KEY_COLUMNS if c in df.columns]


def scratch_dir(spark: SparkSession) -> str:
    """Folder for stored tables that the driver and all executors share.

    A cluster must name it. Only a session that runs inside one process (``local`` or ``local[n]``) gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("stored tables need a shared folder: set spark.checkpoint.dir or call setCheckpointDir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mendcast-"))
    return sc.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, cutting the lineage.

    Unlike a cached or locally checkpointed frame the table survives the loss of executors, and
    later reads keep column pruning and filter pushdown.
    """
    path = new_table_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_RUNS: list[list[str]] = []


def new_table_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder, deleted with the runs that are open now."""
    path = f"{scratch_dir(spark)}/mendcast/{uuid.uuid4().hex}"
    for tables in _RUNS:
        tables.append(path)
    return path


def delete_stored(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def noted_tables():
    """The paths of the tables stored inside the block, for a caller that deletes them later."""
    tables: list[str] = []
    _RUNS.append(tables)
    try:
        yield tables
    finally:
        _RUNS[:] = [open_run for open_run in _RUNS if open_run is not tables]


@contextmanager
def scratch_run(spark: SparkSession):
    """Deletes the tables stored inside the block when it ends. Results must be written before that."""
    tables: list[str] = []
    _RUNS.append(tables)
    try:
        yield tables
    finally:
        _RUNS[:] = [open_run for open_run in _RUNS if open_run is not tables]
        for path in tables:
            delete_stored(spark, path)


def epoch_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since the epoch as DOUBLE, independent of the session time zone for naive timestamps."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(
            f"CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`) AS DOUBLE)"
        )
    return F.unix_micros(F.col(column).cast("timestamp")).cast("double")


def assign_positions(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Ordinal 0..n-1 of every row within its ``keys`` group, ordered by ``order`` (must be unique per group).

    A range-partitioned global sort spreads a hot group over many tasks. Row ids of the sorted
    partitions then become ordinals by adding the row counts of the group's earlier partitions: that
    table has one row per (group, partition), so no window ever sees the points themselves.
    The sorted rows are written once because the sampled range bounds must be the same for both uses.
    """
    tagged = materialise(
        df.orderBy(*keys, *order).withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_row", 33))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_part")
        .agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
        .select(*keys, "_part", "_shift")
    )
    return (
        tagged.join(offsets, [*keys, "_part"])
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .select(*df.columns, name)
    )


def add_block(points: DataFrame, block: int = BLOCK, by: str = "pos") -> DataFrame:
    return points.withColumn("block", F.expr(f"`{by}` div {int(block)}"))


def with_halo(points: DataFrame, before: int, after: int, block: int = BLOCK, by: str = "pos") -> DataFrame:
    """Blocks that also hold copies (``halo``) of the ``before``/``after`` rows next to their edges.

    Fixed-length frames (lags, rolling fits) inside ``(keys, block)`` then equal the same frames
    over the whole series. Only rows near an edge are copied.
    """
    if max(before, after) > block:
        raise ValueError("halo wider than a block")
    offset = F.expr(f"`{by}` % {int(block)}")
    own = F.expr(f"`{by}` div {int(block)}")
    homes = F.array_compact(
        F.array(
            own,
            F.when((offset >= block - before) if before else F.lit(False), own + 1),
            F.when(((offset < after) & (own > 0)) if after else F.lit(False), own - 1),
        )
    )
    return (
        points.withColumn("block", F.explode(homes))
        .withColumn("halo", F.col("block") != own)
    )


def attach_by_block(
    rows: DataFrame, facts: DataFrame, keys: list[str] | None = None, by: str = "pos", block: int = BLOCK
) -> DataFrame:
    """Joins one row of ``facts`` per series to its points without gathering the series.

    A fact row is repeated once per block of its series (``_last`` = largest ``by``), so the join key holds the
    block and a long series is spread over as many tasks as it has blocks. Series without facts drop out.
    """
    keys = keys or config_keys(rows)
    spread = facts.withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_last div {int(block)}").cast("long")))
    ).drop("_last")
    return rows.withColumn("_b", F.expr(f"`{by}` div {int(block)}")).join(spread, [*keys, "_b"]).drop("_b")


HOT_GROUPS = 1000
ROWS_PER_SALT = 1 << 20


def attach_salted(
    rows: DataFrame, facts: DataFrame, keys: list[str], spread_by: str, per_salt: int = ROWS_PER_SALT, hint: str | None = None,
) -> DataFrame:
    """Same for rows without a position: ``facts`` (a stored table) has the group size ``_n``, hot groups are salted.

    Hot means more than a thousandth of the rows of ``facts``, so there are never more than ``HOT_GROUPS`` of them and
    only their keys are broadcast. Each gets one salt per ``per_salt`` rows; other groups keep salt 0. ``hint`` names the
    join of the others, where Spark's choice should not change with the size.
    """
    share = facts.agg((F.sum("_n") / HOT_GROUPS).alias("s")).scalar()
    salts = F.ceil(F.col("_n") / per_salt)
    sized = facts.withColumn(
        "_salts", F.when((F.col("_n") > share) & (F.col("_n") > per_salt), salts).otherwise(F.lit(1))
    )
    hot = F.broadcast(sized.where(F.col("_salts") > 1).select(*keys, F.col("_salts").alias("_k")))
    salted = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    salted = salted.hint(hint) if hint else salted
    return (
        rows.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.coalesce("_k", F.lit(1).cast("long"))))
        .join(salted, [*keys, "_salt"]).drop("_salt", "_k")
    )


def knot() -> Column:
    return F.struct("pos", F.col("x").cast("double").alias("x"), "value")


def _last_k(arr: Column, k: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - (k - 1), F.lit(1)), k)


def _edges(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """First and last ``k`` observed knots of every block as short arrays ``head`` and ``tail``."""
    seen_pos = F.when(F.col("value").isNotNull(), F.col("pos"))
    if k == 1:
        sides = rows.groupBy(*by).agg(
            F.min(seen_pos).alias("p0"), F.min_by("x", seen_pos).alias("x0"), F.min_by("value", seen_pos).alias("v0"),
            F.max(seen_pos).alias("p1"), F.max_by("x", seen_pos).alias("x1"), F.max_by("value", seen_pos).alias("v1"),
        )

        def one(i):
            s = F.struct(F.col(f"p{i}").alias("pos"), F.col(f"x{i}").cast("double").alias("x"),
                         F.col(f"v{i}").alias("value"))
            return F.array_compact(F.array(F.when(F.col(f"p{i}").isNotNull(), s)))

        return sides.select(*by, one(0).alias("head"), one(1).alias("tail"))
    w = W.partitionBy(*by).orderBy("pos")
    seen = F.col("value").isNotNull()
    ranked = rows.withColumn("_from_start", F.count("value").over(w)).withColumn(
        "_total", F.count("value").over(W.partitionBy(*by))
    )
    near = seen & ((F.col("_from_start") <= k) | (F.col("_from_start") > F.col("_total") - k))
    knots = F.sort_array(F.collect_list(F.when(near, knot())))
    return (
        ranked.groupBy(*by).agg(knots.alias("_knots"))
        .select(*by, F.slice("_knots", 1, k).alias("head"), _last_k(F.col("_knots"), k).alias("tail"))
    )


def _carry(edges: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per block: the last ``k`` knots before it and the first ``k`` after it, skipping empty blocks."""
    filled = F.size("tail") > 0
    if k > 1:
        w = W.partitionBy(*keys, "_filled").orderBy("block")
        none = F.slice("tail", 1, 0)
        tails = [F.coalesce(F.lag("tail", d).over(w), none) for d in range(k - 1, 0, -1)]
        heads = [F.coalesce(F.lead("head", d).over(w), none) for d in range(1, k)]
        edges = (
            edges.withColumn("_filled", filled)
            .withColumn("_t", _last_k(F.concat(*tails, F.col("tail")), k))
            .withColumn("_h", F.slice(F.concat(F.col("head"), *heads), 1, k))
        )
    else:
        edges = edges.withColumn("_t", F.col("tail")).withColumn("_h", F.col("head"))
    ahead = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    return edges.select(
        *keys, "block",
        F.last(F.when(filled, F.col("_t")), ignorenulls=True).over(ahead).alias("_before"),
        F.last(F.when(filled, F.col("_h")), ignorenulls=True).over(behind).alias("_after"),
    )


def with_knots(points: DataFrame, k: int = 1, block: int = BLOCK) -> DataFrame:
    """Adds ``left`` and ``right``: up to ``k`` nearest observed knots on each side, in position order.

    An observed row counts as its own nearest neighbour on both sides. Points, summaries and windows share
    the partitioning by key and block.
    """
    keys = config_keys(points)
    by = [*keys, "block"]
    rows = points if "block" in points.columns else add_block(points, block)
    carry = _carry(_edges(rows, by, k), keys, k)
    asc = W.partitionBy(*by).orderBy("pos")
    desc = W.partitionBy(*by).orderBy(F.desc("pos"))
    seen = F.col("value").isNotNull()
    if k == 1:
        rows = rows.withColumn("_l", F.when(seen, F.array(knot()))).withColumn("_r", F.col("_l"))
    else:
        w = W.partitionBy(*by, "_seen").orderBy("pos")
        rows = rows.withColumn("_seen", seen).withColumn("_k", knot())
        lags = [F.lag("_k", d).over(w) for d in range(k - 1, 0, -1)]
        leads = [F.lead("_k", d).over(w) for d in range(1, k)]
        rows = rows.withColumn(
            "_l", F.when(seen, F.array_compact(F.array(*lags, F.col("_k"))))
        ).withColumn("_r", F.when(seen, F.array_compact(F.array(F.col("_k"), *leads))))
    inner_l = F.last("_l", ignorenulls=True).over(asc)
    inner_r = F.last("_r", ignorenulls=True).over(desc)
    none = F.slice(F.array(knot()), 1, 0)
    return (
        rows.withColumn("_il", inner_l)
        .withColumn("_ir", inner_r)
        .join(carry, by)
        .withColumn("left", _last_k(F.concat(F.coalesce("_before", none), F.coalesce("_il", none)), k))
        .withColumn("right", F.slice(F.concat(F.coalesce("_ir", none), F.coalesce("_after", none)), 1, k))
        .drop("block", "_before", "_after", "_il", "_ir", "_l", "_r", "_seen", "_k")
    )


def with_neighbours(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """As-of look-up: nearest observed point at or before (``prev``) and at or after (``next``) each row."""
    return (
        with_knots(points, 1, block)
        .withColumn("prev", F.get("left", F.lit(0)))
        .withColumn("next", F.get("right", F.lit(0)))
        .drop("left", "right")
    )


def with_observed_rank(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Observed rows only, with ``rank`` (0-based among observed) and ``n_obs`` of their series."""
    keys = config_keys(points)
    by = [*keys, "block"]
    seen = add_block(points.where(F.col("value").isNotNull()), block)
    w = W.partitionBy(*keys).orderBy("block")
    counts = (
        seen.groupBy(*by).agg(F.count("*").alias("_n"))
        .select(
            *by,
            F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_shift"),
            F.sum("_n").over(W.partitionBy(*keys)).alias("n_obs"),
        )
    )
    inner = F.row_number().over(W.partitionBy(*by).orderBy("pos")) - 1
    return (
        seen.withColumn("_in", inner)
        .join(counts, by)
        .withColumn("rank", F.col("_in") + F.col("_shift"))
        .drop("block", "_in", "_shift")
    )
