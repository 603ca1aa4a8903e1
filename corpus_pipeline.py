"""A training-data pipeline over documents: language ID, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last
return the columns of documents. Stages cannot be expressed together in SQL (a trained model decides the
first), so ORACLE_SQL is None and tests hold run() against a brute-force version. Columns of any name beside doc_id and text pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import langid, ngramjoin, packing, pii
from webloom.llm.common import table
from webloom.operators.storage import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letters, or unlike all learnt languages."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked documents, the one with the smallest doc_id."""
    return ngramjoin.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a kind's name in place of each span of personal data; keeps every document."""
    return pii.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' pieces into sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
