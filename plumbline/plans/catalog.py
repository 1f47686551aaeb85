"""All queries of the library, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import band_queries, group_queries, model_queries, panel_queries, prob_queries, rule_queries, source_queries, tail_queries, walk_queries  # noqa: F401  they register their queries
from plumbline.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["w1_w2_daily_coverage"](spark, sf_dir)
