"""Cleaning pipeline over `documents`: toxicity, line de-duplication, near-duplicates, packing.

Each stage's result is written and read again as the next one's `docs`; all but the last return
the columns of documents (n_chars is what the table says, not counted anew).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import line_dedup, packing, simhash, toxicity
from plumbline.llm.common import materialize, scratch, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its site's boilerplate lines."""
    return line_dedup.drop_lines(docs, scratch(spark), counter=None)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one row with the smallest id;
    documents without words or without an id are no duplicates of anything and stay.  Rows that repeat an id are
    taken one by one: an equal or similar text goes, another text stays."""
    return simhash.without_similar(docs, scratch(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(docs, scratch(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: A fitted model and a tokenizer take part, which SQL can't express; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), folder, name)
    return docs
