"""Documents to training sequences: five stages, each reading what its predecessor wrote.

Empty tables pass through all stages as empty tables. Texts of any length are read whole. Stages keep all columns
of documents, whatever further ones there are and whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parallaxis.llm import exact_dedup, jaccard_join, language_id, packing, secret_scan
from parallaxis.llm._common import documents, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the corpus' own labels teach.

    Null and empty text, and text without letters, goes; so does text unlike every learned language. Null lang
    teaches nothing. Repeated rows are judged alike. Without any labelled row nothing goes.
    """
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal text, white space aside: the smallest id, null ids last.

    Null text counts as empty. Of rows that repeat an id with an equal text, one stays.
    """
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8 or more: the smallest id.

    Documents without words stay. Rows with a null id link nothing and stay.
    """
    return jaccard_join.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, repeated rows and null text too; its secrets are cut out of the text."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences. Null text counts as empty: its one piece is the end id."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("secrets", secrets), ("packing", pack)]

#: Rank-order profiles, byte-pair encoding and window packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
