"""The registered queries of this folder and their SQL twins (DuckDB), where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, chat, line_dedup, packing, resharding, simhash, spm_trie, topk, toxicity, url_filter
from plumbline.llm.common import scratch, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(table(spark, sf_dir, "documents"), scratch(spark))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(chat.ADDED, "conv_id long, turn long, role string, text string")
    return chat.digests(conversations.unionByName(added), scratch(spark))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_trie.round_trip(table(spark, sf_dir, "documents"))


def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.digests(table(spark, sf_dir, "documents"), scratch(spark))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where(F.col("vec_id") % 100 == 0), scratch(spark))


def op8_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 20 == 0), scratch(spark))


def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), scratch(spark))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_lines(table(spark, sf_dir, "documents"), scratch(spark))
    return cleaned.select("doc_id", "source", "text", "dropped_lines")


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_chat_formatting, op3_sentencepiece, op4_resharding, op5_url_rules, op6_toxicity,
    op7_exact_top_k, op8_multiprobe_neighbours, op9_simhash_near_duplicates, op10_line_dedup,
)}

ORACLE_SQL = {"op2_chat_formatting": chat.SQL, "op5_url_rules": url_filter.SQL, "op7_exact_top_k": topk.SQL, "op10_line_dedup": line_dedup.SQL}
