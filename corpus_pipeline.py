"""A corpus pipeline: language identification, near duplicates, contamination, personal data, mixing.

Each stage works on all documents that the one before it kept and returns the columns of documents,
but for the last, which adds the number of the copy. Stages are written to the shared folder in
between, so a lost executor costs no more than the stage at hand.

Defined results: null and empty texts and texts without letters have no language and go at the first
stage; a null source or doc_id is a value of its own; repeated rows are kept or go together, but for the
copies that the last stage adds; an empty table gives an empty result; texts of any length are whole;
extra columns, whatever their names, come through unchanged, all but one named `copy`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphlens.llm import decontam, language_id, mixing, near_dup, pii
from graphlens.llm.common import materialize, read_table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those that are undetermined or doubtful go."""
    return language_id.reject(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group."""
    return near_dup.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each copy with its number."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identified),
    ("MinHash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("PII", redacted),
    ("mixing sources to target weights", mixed),
]

#: Language identification learns a model, which SQL cannot express; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
