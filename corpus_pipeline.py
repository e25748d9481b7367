"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

Every stage works on all rows that the one before kept; all but the last return the columns that
they were given, extra ones too. A stage's files are deleted once the next one's are written.

Edge cases: a document without text, or of white space alone, fails the quality rules (no words);
null ids, languages and sources are values like any other; documents with one id and text are rows
of their own until the near-dedup stage, which keeps one of each group of near copies, the one
with the least id, and of rows that share it the one with the least hash of the text; columns named
like the operators' own (row, id, key, limits) pass through; an empty table gives no rows of any
stage. Without labels the classifier rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayloom.llm import packing, quality_classifier, quality_rules, simhash
from wayloom.llm.common import discarded, stored, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, accepts."""
    return quality_classifier.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.filter_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents that are left, and its place in a sequence."""
    return packing.packed(docs)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("simhash", near_dedup), ("packing", pack)]

#: A trained classifier decides in the second stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if read is not None:
            discarded(read)
        docs = read = out
    return docs
