"""Global order without a single task: range partitions, sums within them and a prefix over partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.settle import settle


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over all rows before each row in a total order.

    Only one row a partition meets in one place.  The range partitions are settled before they are used twice: their
    borders come from a sample, so a second computation could cut elsewhere."""
    parts = df.withColumn("v_", value).repartitionByRange(*[F.col(c) for c in order]).withColumn("part_", F.spark_partition_id())
    within = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = settle(parts.withColumn("in_", F.coalesce(F.sum("v_").over(within), F.lit(0))))
    sums = held.groupBy("part_").agg(F.sum("v_").alias("s_"))
    before = sums.select("part_", (F.sum("s_").over(Window.orderBy("part_")) - F.col("s_")).alias("before_"))
    return held.join(before, "part_").withColumn(name, F.col("in_") + F.col("before_")).drop("v_", "part_", "in_", "before_")


def rank0(df: DataFrame, order: list[str], name: str = "rank0") -> DataFrame:
    """0-based rank in a total order."""
    return running(df, order, F.lit(1).cast("long"), name)


def quantile(df: DataFrame, value: str, qs: dict[str, float], *by: str) -> DataFrame:
    """by and, by name, the exact quantiles of a column, interpolated as `percentile` does it; missing values are left out.

    `percentile` gathers all different values of a group in one task.  Here equal values are counted and the counts ranked, so
    that a task holds one range of values."""
    counts = df.select(*by, F.col(value).cast("double").alias("x_")).where("x_ IS NOT NULL").groupBy(*by, "x_").agg(F.count(F.lit(1)).alias("n_"))
    ranked = running(counts, [*by, "x_"], F.col("n_"), "below_")
    groups = ranked.groupBy(*[F.col(c).alias(f"{c}_of_") for c in by]).agg((F.sum("n_") - 1).alias("last_"), F.min("below_").alias("first_"))
    each = ranked.join(groups, [F.col(c).eqNullSafe(F.col(f"{c}_of_")) for c in by]) if by else ranked.crossJoin(F.broadcast(groups))  # one row
    upto = lambda place: F.max(F.when(F.col("below_") - F.col("first_") <= place, F.col("x_")))
    at = {name: F.col("last_") * F.lit(q) for name, q in qs.items()}
    ends = each.groupBy(*by).agg(F.max("last_").alias("last_"), *[upto(f(c)).alias(f"{name}_{end}_") for name, c in at.items() for end, f in (("low", F.floor), ("high", F.ceil))])

    def between(name: str, c: Column) -> Column:
        low, high = F.col(f"{name}_low_"), F.col(f"{name}_high_")
        return F.when(low == high, low).otherwise((F.ceil(c) - c) * low + (c - F.floor(c)) * high).alias(name)

    return ends.select(*by, *[between(name, c) for name, c in at.items()])


def fanned(df: DataFrame) -> DataFrame:
    """The rows dealt to at least as many tasks as there are cores: for few narrow rows that are about to be multiplied in
    place, where their own number of partitions says nothing about the work."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
