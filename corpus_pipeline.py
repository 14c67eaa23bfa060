"""Cleaning of a document table for training, stage by stage.

Every stage works on all that its predecessor kept; its result is written as Parquet and read again
as the documents of the next. All but the last return the columns of ``documents``.

Defined results of the stages: rows with a null id pass toxicity, decontamination and secrets by
their text like any other, and near_duplicates as they are; null and empty texts pass all stages but
have no sequences; a text of any length is read whole; repeated rows fare alike in toxicity,
decontamination and secrets, and near_duplicates keeps one of them; of equally near copies the
least id stays; null labels and null test items count for nothing; without labels of both kinds
nothing is toxic; an empty table stays empty; further columns are kept as they are, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import without_contained
from tessera.llm.near_dup import without_near_duplicates
from tessera.llm.packing import packed
from tessera.llm.secrets import redacted
from tessera.llm.tables import table, written
from tessera.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of the labelled ones rejects go; all others stay as they are."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return without_contained(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with a mask in place of each secret and ``n_chars`` of the new text."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as sequences of power-of-two length."""
    return packed(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]
#: The classifier, the tree join, the tiling, the random field and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` of ``sf_dir`` on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
