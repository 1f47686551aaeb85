"""Scratch tables in the shared folder, table access and worker set-up."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.settle import remove, shared

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def scratch(spark: SparkSession) -> str:
    """A new shared folder, see settle.shared()."""
    return shared(spark)


def materialize(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table into a scratch folder and read it back: cuts the lineage, and a lost
    executor costs no more than the tasks it was running."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables of a scratch folder that nothing reads any more."""
    for name in names:
        remove(spark, f"{folder}/{name}")


#: Heavy keys that spread_join() takes by a broadcast at most, and rows of a key from which it counts as heavy at least.
HEAVY_KEYS, HEAVY_ROWS = 4_096, 256


def spread_join(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of `many` (of `total` rows) with `one`, which has one row a key: no task gets more than a small share of a key.

    Keys with over total / HEAVY_KEYS rows, of which there are at most HEAVY_KEYS, meet their row where the rows are; the
    others are shuffled."""
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_"))
    heavy = counts.where(F.col("n_") > max(HEAVY_ROWS, total // HEAVY_KEYS)).select(key)
    few = F.broadcast(one.join(F.broadcast(heavy), key, "left_semi"))  # HEAVY_KEYS rows at most, both
    return many.join(few, key).unionByName(many.join(F.broadcast(heavy), key, "left_anti").join(one, key))
