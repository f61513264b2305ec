"""Sources mixed to target weights by temperature, realised as budgeted block permutations.

A source with share p of all tokens gets the weight p^t / sum(p^t). Entropy and repetition both fall as t grows from 0
(all sources alike) to 1 (as found); bisection finds the smallest t whose weights neither exceed the target entropy nor
repeat a source more often than allowed. Each step of the search evaluates a grid of exponents in one aggregation over the
table of sources, so six steps fix t to 1e-10.

A source's token budget is its weight times the whole budget. Its documents are dealt into blocks by a hash; in every
epoch another hash orders the blocks and the documents inside each. Whole epochs take every document, the last one
the documents that begin before the rest of the budget ends. Order and running sums need windows inside blocks and one over a
row per block, so a source with a third of all rows is spread over its blocks.

Defined results: a null source is a source of its own; documents without words weigh nothing, and if no document has words
nothing is taken; repeated rows are rows of their own; an empty table gives an empty result; further columns are kept
by ``mix_documents`` and ignored by ``mix_plan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mendcast.layout import materialise
from mendcast.llm.common import numbered, one_spaced, text_or_empty

GRID, ROUNDS = 64, 6
BLOCK_DOCS = 4096


def word_count(text_col: str = "text") -> Column:
    spaced = F.trim(one_spaced(text_or_empty(text_col)))
    return (F.length(spaced) - F.length(F.replace(spaced, F.lit(" "))) + (spaced != "").cast("int")).cast("long")


def source_totals(rows: DataFrame) -> DataFrame:
    """Stored table with one row per source: tokens ``_total``, documents ``_docs`` and share ``_p``."""
    totals = materialise(rows.groupBy("_source").agg(F.sum("_tokens").alias("_total"), F.count("*").alias("_docs")))
    whole = totals.agg(F.sum("_total")).scalar()
    return totals.withColumn("_all", whole).withColumn("_p", F.when(whole > 0, F.col("_total") / whole).otherwise(F.lit(0.0)))


def mix_curve(totals: DataFrame, low: float, high: float) -> list:
    """Entropy and largest repetition of the mix at evenly spaced exponents from ``low`` to ``high``."""
    t = F.lit(low) + F.col("_i") * F.lit((high - low) / GRID)
    power, log_p = F.exp(t * F.log("_p")), F.log("_p")
    return (
        totals.where(F.col("_p") > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
        .groupBy("_i")
        .agg(F.sum(power).alias("z"), F.sum(power * log_p).alias("s"), F.max(power / F.col("_p")).alias("r"), F.count("*").alias("n"))
        .select(t.alias("t"), (F.log("z") - t * F.col("s") / F.col("z")).alias("entropy"), (F.col("r") / F.col("z")).alias("repeats"), "n")
        .orderBy("t").collect()
    )


def find_exponent(totals: DataFrame, evenness: float | None, max_repeats: float | None, budget_share: float) -> float:
    """Smallest exponent in [0, 1] whose mix is no more even than asked and repeats no source too often, to six decimals."""
    low, high = 0.0, 1.0

    def too_flat(row) -> bool:
        even = evenness is not None and row["entropy"] > evenness * math.log(row["n"])
        return even or (max_repeats is not None and row["repeats"] * budget_share > max_repeats)

    for _ in range(ROUNDS):
        curve = mix_curve(totals, low, high)
        flat = [i for i, row in enumerate(curve) if too_flat(row)]
        if not flat:
            return round(low, 6)
        if flat[-1] == len(curve) - 1:
            return round(high, 6)
        low, high = curve[flat[-1]]["t"], curve[flat[-1] + 1]["t"]
    return round(high, 6)


def _draw(*parts: Column) -> Column:
    return F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))


def _plan(rows: DataFrame, evenness: float | None, max_repeats: float | None, budget_share: float, seed: int) -> DataFrame:
    """``rows`` (``_row``, ``_id``, ``_source``, ``_tokens``), once per epoch in which they are taken."""
    totals = source_totals(rows)
    t = find_exponent(totals, evenness, max_repeats, budget_share)
    power = F.when(F.col("_p") > 0, F.exp(F.lit(t) * F.log("_p"))).otherwise(F.lit(0.0))
    z = totals.agg(F.sum(power)).scalar()
    budgets = totals.withColumn("weight", F.when(z > 0, power / z).otherwise(F.lit(0.0))).select(
        F.col("_source").alias("_s"), "weight", "_total",
        F.round(F.col("weight") * F.lit(float(budget_share)) * F.col("_all")).cast("long").alias("_budget"),
        F.ceil(F.col("_docs") / BLOCK_DOCS).alias("_blocks"),
    ).where(F.col("_budget") > 0).select(
        "*", F.expr("_budget div _total").alias("_whole"), F.expr("_budget % _total").alias("_rest")
    )
    dealt = (
        rows.join(budgets, rows["_source"].eqNullSafe(F.col("_s"))).drop("_s")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole") - (F.col("_rest") == 0).cast("long"))))
        .withColumn("block", F.pmod(F.conv(F.substring(_draw(F.lit(seed), F.col("_id")), 1, 8), 16, 10).cast("long"), F.col("_blocks")))
        .withColumn("_order", _draw(F.lit(seed), F.col("epoch"), F.col("_id")))
    )
    source = F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.lit("null"))
    dealt = dealt.withColumn("_source_key", source)
    by_block = ["_source_key", "epoch", "block"]
    inside = W.partitionBy(*by_block).orderBy("_order", "_id", "_row").rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy("_source_key", "epoch").orderBy("_block_order", "block").rowsBetween(W.unboundedPreceding, -1)
    before = (
        dealt.groupBy(*by_block).agg(F.sum("_tokens").alias("_in_block"))
        .withColumn("_block_order", _draw(F.lit(seed), F.col("_source_key"), F.col("epoch"), F.col("block")))
        .select(*by_block, F.coalesce(F.sum("_in_block").over(across), F.lit(0)).alias("_before"))
    )
    placed = (
        dealt.withColumn("_inside", F.coalesce(F.sum("_tokens").over(inside), F.lit(0)))
        .join(before, by_block)
        .withColumn("_start", F.col("_before") + F.col("_inside"))
    )
    return placed.where((F.col("epoch") < F.col("_whole")) | (F.col("_start") < F.col("_rest"))).withColumn(
        "mix_at", F.round((F.col("epoch") * F.col("_total") + F.col("_start")) / F.col("_budget"), 9)
    )


def _narrow(docs: DataFrame, id_col: str, source_col: str, text_col: str, row) -> DataFrame:
    return docs.select(
        row.alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text_col).alias("_tokens")
    )


def mix_plan(
    docs: DataFrame, evenness: float | None = 0.95, max_repeats: float | None = 4.0, budget_share: float = 1.0, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The mixture as rows (id, source, ``n_tokens``, ``weight``, ``epoch``, ``block``, ``mix_at``).

    ``evenness`` is the target entropy as a share of the entropy of equal weights; reading in the order of ``mix_at``
    draws from all sources in proportion to their weights at any point.
    """
    rows = materialise(_narrow(docs, id_col, source_col, text_col, F.monotonically_increasing_id()))
    return _plan(rows, evenness, max_repeats, budget_share, seed).select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_tokens").alias("n_tokens"),
        F.round("weight", 9).alias("weight"), "epoch", "block", "mix_at",
    )


def mix_documents(
    docs: DataFrame, evenness: float | None = 0.95, max_repeats: float | None = 4.0, budget_share: float = 1.0, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The documents themselves, all columns, once per epoch that takes them. The stage form of ``mix_plan``."""
    stored = numbered(docs)
    view = stored.select("_row", *[F.col(f"_doc.{c}").alias(c) for c in dict.fromkeys((id_col, source_col, text_col))])
    plan = _plan(_narrow(view, id_col, source_col, text_col, F.col("_row")), evenness, max_repeats, budget_share, seed)
    return stored.join(plan.select("_row"), "_row").select("_doc.*")
