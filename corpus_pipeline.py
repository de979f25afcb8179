"""The corpus pipeline: quality filter, near-duplicate removal, repeat removal, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``, whatever these are called.

null text: as empty, and kept, one row of each group of equal texts as for any other. A null doc_id stays null, and is no row of
``labels``. Repeated rows: one stays. Very long texts are read whole by every stage. No labelled rows to learn from: the
first stage rejects nothing. Empty ``documents``: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftloom.llm.bloom_lm import fold
from shiftloom.llm.common import read_table, write_shared
from shiftloom.llm.histogram_packing import pack_documents
from shiftloom.llm.near_copies import without_near_copies
from shiftloom.llm.quality_qda import accepted
from shiftloom.llm.repeat_index import without_repeats

#: Bytes of the shortest repeat that goes: less than fifty words take in the languages of the corpus.
REPEAT_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labelled rows among ``docs``."""
    return accepted(docs, read_table(spark, sf_dir, "labels"), fold(0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that occur more than once."""
    return without_repeats(docs, REPEAT_BYTES)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", repeats), ("best-fit packing", packing)]

#: No stage can be expressed in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_shared(docs, f"stage-{k + 1}")
    return docs
