"""The corpus pipeline: quality rules, exact copies, near copies, source mixture, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns the packed pieces. The output of
a stage is written and read again before the next one starts, which is when the tables that the stage stored for itself are deleted
(not if the next one is given the unwritten output, which still reads them).

Defined results: a null or empty text fails the base rule, so ``quality`` drops it; of equal and of near equal texts the row with the
smallest id stays, repeated rows count as copies; ``mix`` repeats documents per epoch and leaves some out, as the weights
ask, so ``pack`` sees repeated ids and packs every one; an empty table passes through all stages; further columns are kept by all
stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mendcast.layout import delete_stored, new_table_path, noted_tables
from mendcast.llm.common import table, vocabulary
from mendcast.llm.exact_dedup import keep_first_of_equal
from mendcast.llm.fertility import keep_fertile
from mendcast.llm.jaccard_join import keep_class_representatives
from mendcast.llm.mixing import mix_documents
from mendcast.llm.packing import pack_by_retrieval


_LEFT: list[str] = []


def stage(work: Callable) -> Callable:
    """Deletes what the stage before stored for itself if ``docs`` no longer reads it, and notes what this one stores."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _LEFT else []
        if files and not any(path.rsplit("/", 1)[1] in file for path in _LEFT for file in files):
            while _LEFT:
                delete_stored(spark, _LEFT.pop())
        with noted_tables() as tables:
            out = work(spark, docs, sf_dir)
        _LEFT.extend(tables)
        return out

    run_stage.__name__ = work.__name__
    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_fertile(docs, vocabulary("piece_bpe_32k.model"))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_of_equal(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_class_representatives(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_by_retrieval(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near duplicates", near), ("source mixture", mix), ("packing", pack)]

#: The vocabulary, the Jaccard classes and the packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, work in STAGES[:-1]:
        path, kept = new_table_path(spark), work(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            delete_stored(spark, before)  # the stage after it is written
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
