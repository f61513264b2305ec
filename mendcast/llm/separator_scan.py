"""Token counts of documents in flat token files that have no index, found by scanning for the separator id.

Files are cut into blocks of equal size whatever lies in them. A task compares a whole block with the separator id at once and
returns one row per separator and one summary row per block. A prefix scan over the summaries of a file (one row per
block) gives the number of documents before each block and the place of the last separator before it, which completes the
documents that cross block edges, however many blocks they cross.

Defined results: two separators in a row hold an empty document; ids after the last separator form a document that is not
``terminated``; an empty file has none. In ``write_tokens`` null texts are empty, rows of an empty table write no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from mendcast.layout import materialise, scratch_dir
from mendcast.llm.common import map_batches, shared_files
from mendcast.llm.tokens import END_OF_TEXT, WordwiseTokens

WIDTH = 2
BLOCK_TOKENS = 1 << 22
FILE_BYTES = 1 << 28


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every text, each followed by the separator, into flat files; returns (id, ``file``, ``ordinal``).

    Each attempt of a task writes files of its own names, so only files named in the stored result count.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def writer():
        files, root = shared_files(folder)
        tokens = WordwiseTokens(vocabulary, plain=True)
        end = np.array([END_OF_TEXT], "<u2").tobytes()

        def work(batch) -> dict:
            name, size, ordinal, out, found = "", FILE_BYTES, 0, None, []
            for text in batch.column("_text"):
                if size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, size, ordinal = f"tokens-{uuid.uuid4().hex}.u16", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                data = tokens.encode(text.as_py()).tobytes() + end
                out.write(data)
                size += len(data)
                found.append((name, ordinal))
                ordinal += 1
            if out is not None:
                out.close()
            return {"file": [f for f, _ in found], "ordinal": [o for _, o in found]}

        return work

    shared_files(folder)[0].create_dir(shared_files(folder)[1], recursive=True)
    return materialise(map_batches(rows, writer, {"file": "string", "ordinal": "long"})).withColumnRenamed("_id", id_col)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(``file``, ``bytes``) of a folder, listed by Spark without reading contents."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.u16").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def scan_blocks(files: DataFrame, folder: str, separator: int, block_tokens: int) -> DataFrame:
    """One row per separator (``place`` = its index in the file) and a summary (null ``place``) per block."""
    blocks = files.where(F.col("bytes") >= WIDTH).select(
        "file", F.expr(f"bytes div {WIDTH}").alias("tokens")
    ).withColumn("block", F.explode(F.expr(f"sequence(0L, (tokens - 1) div {block_tokens})")))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = shared_files(folder)
        for batch in batches:
            for name, total, block in zip(batch["file"], batch["tokens"], batch["block"]):
                first = block * block_tokens
                with store.open_input_file(f"{root}/{name}") as f:
                    ids = np.frombuffer(f.read_at(int(min(block_tokens, total - first)) * WIDTH, int(first) * WIDTH), "<u2")
                at = np.flatnonzero(ids == separator) + first
                yield pd.DataFrame({
                    "file": name, "block": block, "tokens": total,
                    "place": pd.array([*at, None], "Int64"), "nth": np.arange(len(at) + 1), "found": len(at),
                })

    # a number is given because these few rows do not show how much each has to read
    return blocks.repartition(max(1, blocks.count())).mapInPandas(scan, "file string, block long, tokens long, place long, nth long, found long")


def separator_scan(files: DataFrame, folder: str, separator: int = END_OF_TEXT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(``file``, ``ordinal``, ``start``, ``n_tokens``, ``terminated``) of every document in the files."""
    hits = materialise(scan_blocks(files, folder, separator, block_tokens))
    inside = W.partitionBy("file", "block").orderBy("nth")
    marks = hits.where(F.col("place").isNotNull()).withColumn("_prev", F.lag("place").over(inside))
    last = marks.groupBy("file", "block").agg(F.max("place").alias("_last"))
    ahead = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    summary = (
        hits.where(F.col("place").isNull()).select("file", "block", "tokens", "found").join(last, ["file", "block"], "left")
        .withColumn("_before", F.coalesce(F.sum("found").over(ahead), F.lit(0)))
        .withColumn("_carried", F.coalesce(F.max("_last").over(ahead), F.lit(-1)))
    )
    closed = marks.join(summary.select("file", "block", "_before", "_carried"), ["file", "block"]).select(
        "file", (F.col("_before") + F.col("nth")).alias("ordinal"), (F.coalesce("_prev", "_carried") + 1).alias("start"),
        F.col("place").alias("_end"), F.lit(True).alias("terminated"),
    )
    open_end = (
        summary.groupBy("file").agg(
            F.sum("found").alias("ordinal"), (F.coalesce(F.max("_last"), F.lit(-1)) + 1).alias("start"), F.max("tokens").alias("_end")
        ).where(F.col("start") < F.col("_end")).withColumn("terminated", F.lit(False))
    )
    return closed.unionByName(open_end).select(
        "file", "ordinal", "start", (F.col("_end") - F.col("start")).alias("n_tokens"), "terminated"
    )


def document_token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_tokens``) of every document: written to flat files, then counted by the scan."""
    folder = f"{scratch_dir(docs.sparkSession)}/mendcast/tokens-{uuid.uuid4().hex}"
    placed = write_tokens(docs, folder, vocabulary, id_col, text_col)
    named = placed.select("file").distinct()
    files = list_files(docs.sparkSession, folder).join(named, "file", "left_semi")
    counted = separator_scan(files, folder)
    return placed.join(counted, ["file", "ordinal"]).select(id_col, "n_tokens")
