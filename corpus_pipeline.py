"""A training-data pipeline over `documents`: reject, de-duplicate, cut, decontaminate and pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads
again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.decontaminate import uncontaminated
from loomspan.llm.near_dedup import one_of_each_group
from loomspan.llm.packing import pack
from loomspan.llm.quality import fit, with_scores
from loomspan.llm.substring_dedup import cut_repeated_windows
from loomspan.session import discard, scratch, table

QUALITY_THRESHOLD = 0.3
SIMILARITY_PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject. Labelled rows decide its weights, never a document's fate.

    Every row is judged by its text alone: null and empty texts have the bias as their score, repeated and null doc_ids are rows like others.
    """
    scored = with_scores(docs, fit(docs, table(spark, sf_dir, "labels")), "quality score of this stage")
    return scored.where(scored["quality score of this stage"] >= QUALITY_THRESHOLD).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of every group of near duplicates; documents linked with nothing stay.

    A null doc_id is a document of its own; of rows that repeat both doc_id and text one stays.
    """
    return one_of_each_group(docs, SIMILARITY_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that also start elsewhere. Rows that repeat a doc_id are texts of their own; null ids stay."""
    return cut_repeated_windows(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item, whatever their doc_id; null and empty texts stay."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens. Repeated and null doc_ids are documents of their own; a null or empty text is its end token."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", keep_uncontaminated),
    ("packing", pack_sequences),
]

#: The classifier, the joins on signatures and the packing can't be written in SQL; tests/llm/test_plain_versions.py holds run() against plain stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table is deleted when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
