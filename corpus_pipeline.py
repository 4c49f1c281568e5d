"""The corpus pipeline: quality rules, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``, and further columns as they came.

Defined results: a null text is an empty one, which the quality rules reject. Rows that agree in id and text are one document, of which the exact stage leaves one row;
rows that share an id but not a text are one document to the near stage, which leaves the one with the smallest text. Rows without an id are kept apart
by the near stage. Of equal texts the row with the largest id stays, of near copies that with the smallest. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazardry.llm import exact, near, packing, quality
from hazardry.llm.common import materialise, remove, scratch, shared_path, table
from hazardry.session import ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the standard policy of the rule ledger."""
    ship_package(spark)
    return quality.keep_documents(docs, quality.STANDARD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship_package(spark)
    return exact.keep_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return near.keep_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in the sequences."""
    import public_tokenizers

    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("packing", packing_stage)]

#: Alignment and tokenisation are beyond SQL; tests/llm checks the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. What a stage has written for itself, and its input, goes once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), name, path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
