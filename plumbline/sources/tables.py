"""Driver tables and the fixtures derived from them (FIXTURES.md, section 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.ordered import rank0
from plumbline.functions.settle import settle
from plumbline.operators.panel import densify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, slot, act, fc, err, da, low, high: quantity shipped by day and flag, its value seven rows
    before as the forecast, and the day's mean, lowest and highest price in thousands."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), F.concat("l_returnflag", "l_linestatus").alias("slot"), "l_quantity", "l_extendedprice"
    )
    price = F.col("l_extendedprice") / 1000
    daily = lines.groupBy("date", "slot").agg(
        F.sum("l_quantity").alias("act"), F.round(F.avg(price), 10).alias("da"), F.min(price).alias("low"), F.max(price).alias("high")
    )
    ahead = F.lag("act", 7).over(Window.partitionBy("slot").orderBy("date"))
    return densify(settle(daily), "date", "slot").withColumn("fc", ahead).withColumn("err", F.col("act") - F.col("fc"))


def day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipping panel with one slot for all flags: dense at the smallest scale too."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("act"))
    ahead = F.lag("act", 7).over(Window.partitionBy("slot").orderBy("date"))
    return lines.withColumn("slot", F.lit("all")).withColumn("fc", ahead).withColumn("err", F.col("act") - F.col("fc"))


def hour_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, slot (hour), act, fc (the day before), err."""
    hourly = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("slot")).agg(F.round(F.sum("value"), 6).alias("act"))
    ahead = F.lag("act", 1).over(Window.partitionBy("slot").orderBy("date"))
    return densify(settle(hourly), "date", "slot").withColumn("fc", ahead).withColumn("err", F.col("act") - F.col("fc"))


def asset_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, asset, price for the days on which all three assets have one."""
    daily = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("asset")).agg(
        F.round(100 + F.sum("l_extendedprice") / 1e6, 9).alias("price")
    )
    return daily.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date"))).where("n = 3").drop("n")


def choice_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, p (ten probabilities), y (0 to 9)."""
    e = table(spark, sf_dir, "embeddings")
    top = F.slice("embedding", 1, 10)
    z = F.transform(top, lambda x: F.exp(10 * x.cast("double")))
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.transform(z, lambda x: F.round(x / total, 12)).alias("p"), F.col("label").alias("y"))


def binary_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p, y: how long a labelled document is among them, and whether it is good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")
    return ranked_share(labelled, "n_chars", "doc_id").select("doc_id", F.col("share").alias("p"), "y")


def ranked_share(df: DataFrame, value: str, key: str) -> DataFrame:
    """`df` with share = (rank - 0.5) / n over all rows."""
    n = F.broadcast(df.agg(F.count(F.lit(1)).alias("n_")))  # one row
    return rank0(df, [value, key], "k_").crossJoin(n).withColumn("share", (F.col("k_") + 0.5) / F.col("n_")).drop("k_", "n_")


def wear_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case, cut_index, vb: a customer's orders in turn and their running total as a share of all of them."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    running, total = F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("o_totalprice").over(Window.partitionBy("o_custkey"))
    return o.select(F.col("o_custkey").alias("case"), F.row_number().over(w).alias("cut_index"), F.round(running / total, 9).alias("vb"), F.col("o_orderpriority").alias("priority"))


#: The same fixtures as common table expressions.
SHIP = """
daily AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag || l_linestatus AS slot, sum(l_quantity) AS act,
    round(avg(l_extendedprice / 1000), 10) AS da, min(l_extendedprice / 1000) AS low, max(l_extendedprice / 1000) AS high
  FROM lineitem GROUP BY ALL
), panel AS (
  SELECT *, act - fc AS err FROM (
    SELECT d.date, s.slot, y.act, y.da, y.low, y.high, lag(y.act, 7) OVER (PARTITION BY s.slot ORDER BY d.date) AS fc
    FROM (SELECT DISTINCT date FROM daily) d CROSS JOIN (SELECT DISTINCT slot FROM daily) s LEFT JOIN daily y ON y.date = d.date AND y.slot = s.slot)
)"""
DAYS = """
panel AS (
  SELECT *, act - fc AS err FROM (SELECT *, lag(act, 7) OVER (ORDER BY date) AS fc, NULL AS da, NULL AS low, NULL AS high FROM (
    SELECT CAST(l_shipdate AS DATE) AS date, 'all' AS slot, sum(l_quantity) AS act FROM lineitem GROUP BY 1))
)"""
HOURS = """
hourly AS (SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS slot, round(sum(value), 6) AS act FROM events GROUP BY ALL),
hpanel AS (
  SELECT *, act - fc AS err FROM (
    SELECT d.date, s.slot, y.act, lag(y.act) OVER (PARTITION BY s.slot ORDER BY d.date) AS fc
    FROM (SELECT DISTINCT date FROM hourly) d CROSS JOIN (SELECT DISTINCT slot FROM hourly) s LEFT JOIN hourly y ON y.date = d.date AND y.slot = s.slot)
)"""
PRICES = """
prices AS (
  SELECT date, asset, price FROM (
    SELECT *, count(*) OVER (PARTITION BY date) AS n FROM (
      SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS asset, round(100 + sum(l_extendedprice) / 1e6, 9) AS price FROM lineitem GROUP BY ALL)
  ) WHERE n = 3
)"""
CHOICE = """
choice AS (
  SELECT vec_id, list_transform(z, lambda x: round(x / list_sum(z), 12)) AS p, label AS y FROM (
    SELECT vec_id, label, list_transform(embedding[1:10], lambda x: exp(10 * CAST(x AS DOUBLE))) AS z FROM embeddings)
)"""
BINARY = """
binary_p AS (
  SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 0.5) / count(*) OVER () AS p, quality AS y
  FROM labels JOIN documents USING (doc_id)
)"""
WEAR = """
wear AS (
  SELECT o_custkey AS "case", row_number() OVER w AS cut_index, o_orderpriority AS priority,
    round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS vb
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
)"""
