"""A corpus pipeline: toxicity, near copies, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of ``docs``. Its result is
written as Parquet and read again as the next stage's ``docs``; a table is deleted once the next one is written.

Defined cases for all stages: rows with nulls in any column, empty texts and very long ones are read like others; all columns besides doc_id, text and
n_chars are kept as they are, whatever they are called; an empty table gives an empty table. What a stage does with repeats and ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontamination import drop_contaminated
from tessera.llm.packing import pack_documents
from tessera.llm.privacy import sanitise
from tessera.llm.queries import table, vocabulary
from tessera.llm.scratch import forget, materialise
from tessera.llm.simhash import drop_near_duplicates
from tessera.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models take for toxic go; the labels are those of ``sf_dir``.

    Null and empty texts score as a text without words; repeated rows go or stay alike; without labels of both classes the share of toxic ones decides.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id, nulls last, then the smallest hash of its text.

    Texts without words, null ones included, are one group; rows with equal ids and texts are one document.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least four fifths of a benchmark item go.

    Null and empty items match nothing; null and empty texts stay; repeated rows go or stay alike.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced.

    A null text stays null; repeated rows change alike; of spans that overlap the one that starts first is replaced; n_chars is counted again where a text changed.
    """
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in windows of at most 2048 ids.

    Null and empty texts are one piece with the end id; repeated rows are separate documents.
    """
    return pack_documents(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]

#: Fingerprints, language models and tokens aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
