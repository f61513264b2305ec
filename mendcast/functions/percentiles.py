"""Exact percentiles per group without gathering a group in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from mendcast.layout import attach_salted, materialise

SKETCH = 100_000


def _stored(facts: DataFrame) -> DataFrame:
    """One row per group, read several times below: stored, so that each pass over the rows runs once."""
    return materialise(facts)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles, exact, one column per entry of ``probs``.

    ``percentile``/``median`` keep a map of all distinct values of a group in one buffer. Here a
    sketch only proposes cut points around each wanted rank; exact counts between the cuts tell which
    narrow interval holds the rank, and only that interval (about 4e-5 of a group) is
    ranked. A poor sketch would cost time, never correctness.
    """
    marker = keys or ["_all"]
    rows = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    if not keys:
        rows = rows.withColumn("_all", F.lit(1))
    rows = rows.select(*marker, "_v")
    steps = (2.0 / SKETCH, 1e-3, 3e-2)
    wanted = sorted({min(1.0, max(0.0, p + s * d)) for p in probs.values() for d in steps for s in (-1, 1)})
    cuts = _stored(rows.groupBy(*marker).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", wanted, SKETCH).alias("_cuts"),
    ))
    # the row id, not the value, spreads a hot group: one value may fill most of it
    tagged = rows.withColumn("_id", F.monotonically_increasing_id())
    by = [*marker, "_bucket"]

    def bucketed(facts: DataFrame) -> DataFrame:
        if keys:
            both = attach_salted(tagged, facts, marker, "_id")
        else:
            one = facts.select(F.struct(*[c for c in facts.columns if c != "_all"]).alias("_f")).scalar()
            both = rows.withColumn("_f", one).select("*", "_f.*")
        return both.withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))

    before = W.partitionBy(*marker).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    ranks = {}
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        ranks[name] = (F.floor(at), F.ceil(at), at - F.floor(at))
    hit = F.lit(False)
    for low, high, _ in ranks.values():
        for k in (low, high):
            hit = hit | ((F.col("_below") <= k) & (k < F.col("_below") + F.col("_c")))
    kept = (
        bucketed(cuts).groupBy(*by).agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
        .withColumn("_below", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .where(hit)
        .groupBy(*marker).agg(F.map_from_entries(F.collect_list(F.struct("_bucket", "_below"))).alias("_kept"))
    )
    ends = (
        bucketed(_stored(cuts.join(kept, marker)))
        .withColumn("_below", F.element_at("_kept", F.col("_bucket"))).where(F.col("_below").isNotNull())
        .groupBy(*by, "_v").agg(F.count("*").alias("_c"), F.max("_below").alias("_below"), F.max("_n").alias("_n"))
        .withColumn("_end", F.col("_below") + F.sum("_c").over(W.partitionBy(*by).orderBy("_v")))
    )
    aggs = []
    for name, (low, high, _) in ranks.items():
        aggs.append(F.min(F.when(F.col("_end") > low, F.col("_v"))).alias(f"_{name}_a"))
        aggs.append(F.min(F.when(F.col("_end") > high, F.col("_v"))).alias(f"_{name}_b"))
    picked = ends.groupBy(*marker).agg(F.max("_n").alias("_n"), *aggs)
    return picked.select(
        *keys,
        *[
            (F.col(f"_{n}_a") + (F.col(f"_{n}_b") - F.col(f"_{n}_a")) * frac).alias(n)
            for n, (_, _, frac) in ranks.items()
        ],
    )


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return exact_percentiles(df, keys, value, {name: 0.5})


def exact_mode(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent number per group, the smallest of ties; counts are combined before any row is compared."""
    marker = keys or ["_all"]
    rows = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value))
    if not keys:
        rows = rows.withColumn("_all", F.lit(1))
    counts = rows.groupBy(*marker, "_v").agg(F.count("*").alias("_c"))
    top = F.max(F.struct("_c", (-F.col("_v")).alias("_m")))
    return counts.groupBy(*marker).agg(top.alias("_t")).select(*keys, (-F.col("_t._m")).alias(name))
