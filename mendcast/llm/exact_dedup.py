"""Exact duplicates through an extendible-hash index that lies in shared files.

The index has one entry per 64-bit text hash. Its directory starts with one bucket; a bucket with more entries than
``capacity`` is split on the next hash bit, which doubles the part of the directory above it, until every bucket fits.
All depths are counted in one aggregation over a histogram, so the splits need no pass over the texts. Owners are ranges
of buckets; they write their entries as Parquet into the shared folder. Entries that several rows share form chains:
only their rows are read again, and compared byte by byte in their bucket by grouping on the text itself. Partial aggregation
does that before the shuffle, so a text that makes up a third of all rows reaches its owner as one row per task.

Defined results: ids may be of any ordered type; a null text counts as empty, null ids sort last, of repeated rows with the same id and text exactly
one is kept, an empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from mendcast.layout import attach_salted, materialise
from mendcast.llm.common import one_spaced, text_or_empty

#: Rows of a hot hash that one task compares.
ROWS_PER_SALT = 1024


def finest_depth(n_entries: int, capacity: int) -> int:
    """Depth of the histogram: 64 cells for each bucket that uniform hashes would need."""
    return max(1, min(40, math.ceil(math.log2(max(n_entries, 1) / capacity)) + 6))


def bucket_directory(groups: DataFrame, finest: int, capacity: int) -> DataFrame:
    """(cell, local_depth, bucket): cells are hash prefixes at the finest counted depth, buckets are their directory leaves."""
    cells = groups.groupBy(F.shiftrightunsigned("_h", 64 - finest).alias("cell")).agg(F.count("*").alias("_n"))
    levels = (
        cells.withColumn("local_depth", F.explode(F.sequence(F.lit(0), F.lit(finest))))
        .withColumn("bucket", F.expr(f"shiftrightunsigned(cell, {finest} - local_depth)"))
    )
    counted = levels.groupBy("local_depth", "bucket").agg(F.sum("_n").alias("_n"))
    fits = (F.col("_n") <= capacity) | (F.col("local_depth") == finest)
    leaf = levels.drop("_n").join(counted.where(fits), ["local_depth", "bucket"]).groupBy("cell").agg(
        F.min("local_depth").alias("local_depth")
    )
    first_cell = F.expr(f"shiftleft(shiftrightunsigned(cell, {finest} - local_depth), {finest} - local_depth)")
    return leaf.select("cell", "local_depth", first_cell.alias("bucket"))


def build_index(entries: DataFrame, capacity: int) -> DataFrame:
    """The stored index: one row per hash (``_h``, rows ``_n``) with its bucket, written by owners of bucket ranges."""
    groups = materialise(entries.groupBy("_h").agg(F.count("*").alias("_n")))
    finest = finest_depth(groups.count(), capacity)
    directory = bucket_directory(groups, finest, capacity)
    placed = groups.withColumn("cell", F.shiftrightunsigned("_h", 64 - finest)).join(directory, "cell")
    return materialise(
        placed.select("bucket", "local_depth", "_h", "_n").repartitionByRange("bucket", "_h")
        .sortWithinPartitions("bucket", "_h")
    )


def chains(docs: DataFrame, index: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts that occur more than once: (``_h``, ``text_sha256``, ``keep_id``, ``group_size``, ``bucket``).

    The index tells which hashes several rows share; only those rows are looked at again. They meet in their bucket, where the
    texts themselves are compared, so a collision of hashes gives chains of their own. The shared hashes grow with the table, so
    they are never broadcast; the rows of a hot hash, whose number the index holds, are salted. Equal texts are added up before
    they reach their owner.
    """
    shared = index.where(F.col("_n") > 1).select("_h", "bucket", "_n")
    rows = docs.select(F.col(id_col).alias("_id"), one_spaced(text_or_empty(text_col)).alias("_text"))
    numbered = rows.withColumns({"_h": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    return (
        attach_salted(numbered, shared, ["_h"], "_row", ROWS_PER_SALT, "shuffle_hash")
        .groupBy("bucket", "_h", "_text").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") > 1)
        .select("bucket", "_h", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    text = one_spaced(text_or_empty(text_col))
    entries = materialise(
        docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
        .select("_id", F.xxhash64("_text").alias("_h"), F.sha2("_text", 256).alias("text_sha256"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    heads = chains(docs, build_index(entries, capacity), id_col, text_col)
    first = (
        entries.groupBy("_h", "text_sha256")
        .agg(F.min_by("_row", F.struct(F.col("_id").isNull(), F.col("_id"))).alias("_first"), F.count("*").alias("_k"))
        .where(F.col("_k") > 1).drop("_k")
    )
    facts = materialise(heads.join(first, ["_h", "text_sha256"]))  # stored, so that the next join can split a frequent text
    joined = entries.join(facts, ["_h", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("_row") == F.col("_first"))).alias("kept"),
        "text_sha256",
    )


def keep_first_of_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later copies, all columns kept. The stage form of ``exact_dedup``."""
    kept = (
        exact_dedup(docs, id_col, text_col).where("kept")
        .select(F.col(id_col).alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")).distinct()
    )
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs[id_col].alias("_its_id"),
        F.sha2(one_spaced(F.coalesce(docs[text_col], F.lit(""))), 256).alias("_its_sha"),
    )
    same = [F.col("_its_id").eqNullSafe(F.col("_kept_id")), F.col("_its_sha") == F.col("_kept_sha")]
    return keyed.join(kept, same, "left_semi").dropDuplicates(["_its_id", "_its_sha"]).select("_doc.*")
