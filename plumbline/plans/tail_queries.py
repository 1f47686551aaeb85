"""Tail risk and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.settle import settle
from plumbline.operators import panel as P
from plumbline.operators import resample as R
from plumbline.operators import tail as T
from plumbline.plans.panel_queries import _RETURNS, _TAG
from plumbline.plans.registry import query
from plumbline.sources import tables as S

ALPHAS = [0.01, 0.025]
WEIGHTS = {"A": 0.5, "N": 0.3, "R": 0.2}
PNL = f"{_RETURNS}, pnl AS (SELECT date, round(sum(r * CASE asset WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.3 ELSE 0.2 END), 12) AS pnl FROM returns GROUP BY date)"
_STEPS = lambda c, t: "CASE " + " ".join(f"WHEN {c} >= {k} THEN {v}" for k, v in sorted(t.items(), reverse=True)) + " ELSE 0.0 END"
DETAILS = f"""{PNL}, past AS MATERIALIZED (
  SELECT *, list(pnl) OVER w AS past, quantile_cont(pnl, 0.01) OVER w AS q1, quantile_cont(pnl, 0.025) OVER w AS q2 FROM pnl
  WINDOW w AS (ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)
), stated AS (
  SELECT date, pnl, past, CAST(0.01 AS DOUBLE) AS alpha, round(q1, 12) AS var FROM past WHERE len(past) = 250
  UNION ALL SELECT date, pnl, past, CAST(0.025 AS DOUBLE), round(q2, 12) FROM past WHERE len(past) = 250
), details AS MATERIALIZED (
  SELECT date, pnl, alpha, var, list_avg(list_filter(past, lambda x: x <= var + 1e-12)) AS es, pnl < var AS breached FROM stated
)"""


def pnl(spark: SparkSession, d: str) -> DataFrame:
    return T.portfolio(T.log_returns(S.asset_prices(spark, d)), WEIGHTS).withColumn("pnl", F.round("pnl", 12))


def details(spark: SparkSession, d: str) -> DataFrame:
    return settle(T.historical(pnl(spark, d), ALPHAS))


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query("q5_q11_historical_var_es", f"WITH {DETAILS} SELECT date, alpha, round(pnl, 9) AS pnl, round(var, 9) AS var, round(es, 9) AS es, breached FROM details")
def q5(spark: SparkSession, d: str) -> DataFrame:
    return details(spark, d).select("date", "alpha", _r("pnl", 9), _r("var", 9), _r("es", 9), "breached")


_CHAIN = f"""{DETAILS}, step AS (SELECT *, lag(breached) OVER (PARTITION BY alpha ORDER BY date) AS px FROM details),
g AS (SELECT alpha, count(*) AS n, count(*) FILTER (breached) AS breaches, count(*) FILTER (NOT px AND NOT breached) AS n00, count(*) FILTER (NOT px AND breached) AS n01,
  count(*) FILTER (px AND NOT breached) AS n10, count(*) FILTER (px AND breached) AS n11 FROM step GROUP BY alpha)"""
_XL = lambda x, y: f"(CASE WHEN {x} = 0 THEN 0.0 ELSE {x} * ln({y}) END)"
_KUPIEC = f"greatest(0, -2 * ({_XL('breaches', 'alpha')} + {_XL('(n - breaches)', '(1 - alpha)')} - {_XL('breaches', '(breaches / n)')} - {_XL('(n - breaches)', '(1 - breaches / n)')}))"
_IND = (
    f"greatest(0, -2 * ({_XL('(n00 + n10)', '(1 - (n01 + n11) / (n00 + n01 + n10 + n11))')} + {_XL('(n01 + n11)', '((n01 + n11) / (n00 + n01 + n10 + n11))')}"
    f" - {_XL('n00', '(1 - n01 / (n00 + n01))')} - {_XL('n01', '(n01 / (n00 + n01))')} - {_XL('n10', '(1 - n11 / (n10 + n11))')} - {_XL('n11', '(n11 / (n10 + n11))')}))"
)


@query("t2_t3_t4_w11_breach_tests", f"WITH {_CHAIN} SELECT alpha, n, breaches, n00, n01, n10, n11, round({_KUPIEC}, 6) AS kupiec, round({_IND}, 6) AS independence, round({_KUPIEC} + {_IND}, 6) AS conditional FROM g")
def t2(spark: SparkSession, d: str) -> DataFrame:
    g = T.breach_stats(details(spark, d), "alpha")
    c = F.col
    out = g.withColumns({"kupiec": T.kupiec(c("n"), c("breaches"), c("alpha")), "independence": T.independence(c("n00"), c("n01"), c("n10"), c("n11"))})
    return out.select("alpha", "n", "breaches", "n00", "n01", "n10", "n11", _r("kupiec"), _r("independence"), F.round(c("kupiec") + c("independence"), 6).alias("conditional"))


@query("t6_t7_t8_acerbi_szekely", f"""WITH {DETAILS}, g AS (SELECT alpha, avg(pnl / greatest(abs(es), 1e-12)) FILTER (breached) + 1 AS z1, coalesce(sum(pnl / greatest(abs(es), 1e-12)) FILTER (breached), 0) / (count(*) * alpha) + 1 AS z2, count(*) AS n, count(*) FILTER (breached) AS b FROM details GROUP BY alpha)
SELECT alpha, round(z1, 6) AS z1, round(z2, 6) AS z2, abs(z2 - (1 + b / (n * alpha) * (z1 - 1))) < 1e-9 AS agrees FROM g""")
def t6(spark: SparkSession, d: str) -> DataFrame:
    g = details(spark, d).groupBy("alpha").agg(T.z1().alias("z1"), T.z2().alias("z2"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("breached"), 1)).alias("b"))
    return g.select("alpha", _r("z1"), _r("z2"), (F.abs(F.col("z2") - (1 + F.col("b") / (F.col("n") * F.col("alpha")) * (F.col("z1") - 1))) < 1e-9).alias("agrees"))


@query("t12_broken_controls", f"""WITH {DETAILS}, m AS (SELECT 'as stated' AS model, alpha, pnl, var, es FROM details UNION ALL SELECT 'scaled', alpha, pnl, 0.8 * var, 0.8 * es FROM details)
SELECT model, alpha, count(*) FILTER (pnl < var) AS breaches, round(avg(pnl / greatest(abs(es), 1e-12)) FILTER (pnl < var) + 1, 6) AS z1 FROM m GROUP BY model, alpha""")
def t12(spark: SparkSession, d: str) -> DataFrame:
    x = details(spark, d).select("alpha", "pnl", "var", "es")
    both = x.withColumn("model", F.lit("as stated")).unionByName(x.withColumns({"var": 0.8 * F.col("var"), "es": 0.8 * F.col("es"), "model": F.lit("scaled")}))
    both = both.withColumn("breached", F.col("pnl") < F.col("var"))
    return both.groupBy("model", "alpha").agg(F.count(F.when(F.col("breached"), 1)).alias("breaches"), F.round(T.z1(), 6).alias("z1"))


@query("t13_zone_and_addends", f"SELECT n, CASE WHEN n < 5 THEN 'green' WHEN n < 10 THEN 'yellow' ELSE 'red' END AS zone, CAST({_STEPS('n', T.ADDEND)} AS DOUBLE) AS addend, CAST({_STEPS('n', T.ADDON_2027)} AS DOUBLE) AS addon_2027 FROM (SELECT unnest(range(0, 20)) AS n)")
def t13(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return spark.range(20).select(F.col("id").alias("n")).select("n", T.zone(n).alias("zone"), T.step_table(n, T.ADDEND).alias("addend"), T.step_table(n, T.ADDON_2027).alias("addon_2027"))


@query("t14_outside_green_if_correct", f"SELECT CAST(round({T.p_outside_green()!r}, 9) AS DOUBLE) AS p")
def t14(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.round(F.lit(T.p_outside_green()), 9).alias("p"))


@query("t17_backtest_integrity", f"""WITH {DETAILS} SELECT alpha, count(*) AS n, count(*) FILTER (breached <> (pnl < var)) AS flag_mismatches, count(*) FILTER (es > var) AS shallow_es, count(*) FILTER (var >= 0) AS positive_var,
  count(*) - count(DISTINCT date) AS repeated_dates FROM details GROUP BY alpha""")
def t17(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.count(F.when(c, 1))
    return details(spark, d).groupBy("alpha").agg(
        F.count(F.lit(1)).alias("n"), one(F.col("breached") != (F.col("pnl") < F.col("var"))).alias("flag_mismatches"), one(F.col("es") > F.col("var")).alias("shallow_es"),
        one(F.col("var") >= 0).alias("positive_var"), (F.count(F.lit(1)) - F.countDistinct("date")).alias("repeated_dates"))


_ROLL = "(PARTITION BY alpha ORDER BY date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)"


@query("w5_rolling_breach_rate", f"WITH {DETAILS} SELECT alpha, date, round(rate, 6) AS rate FROM (SELECT alpha, date, avg(CAST(breached AS INTEGER)) OVER {_ROLL} AS rate, count(*) OVER {_ROLL} AS n FROM details) WHERE n = 250")
def w5(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("alpha").orderBy("date").rowsBetween(-249, 0)
    x = details(spark, d).select("alpha", "date", F.avg(F.col("breached").cast("int")).over(w).alias("rate"), F.count(F.lit(1)).over(w).alias("n"))
    return x.where("n = 250").select("alpha", "date", _r("rate"))


@query("w6_w7_rolling_counts", f"WITH {DETAILS} SELECT alpha, date, CAST(sum(CAST(breached AS INTEGER)) OVER {_ROLL} AS BIGINT) AS partial, CASE WHEN count(*) OVER {_ROLL} = 250 THEN CAST(sum(CAST(breached AS INTEGER)) OVER {_ROLL} AS BIGINT) END AS complete FROM details")
def w6(spark: SparkSession, d: str) -> DataFrame:
    return details(spark, d).select("alpha", "date", T.rolling_count(["alpha"]).alias("partial"), T.rolling_count(["alpha"], complete=True).alias("complete"))


_CAPITAL = f"""{DETAILS}, c AS (SELECT *, sum(CAST(breached AS INTEGER)) OVER {_ROLL} AS k, avg(abs(var)) OVER (PARTITION BY alpha ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m FROM details),
cap AS (SELECT alpha, date, 3.0 + {_STEPS('k', T.ADDEND)} AS multiplier, (3.0 + {_STEPS('k', T.ADDEND)}) * greatest(abs(var), m) AS capital FROM c)"""


@query("w8_a36_capital_path", f"WITH {_CAPITAL} SELECT alpha, round(avg(capital), 9) AS mean, round(max(capital), 9) AS peak, round(avg(multiplier), 6) AS multiplier, round(avg(CASE WHEN multiplier > 3 THEN 1.0 ELSE 0 END), 6) AS above_base FROM cap GROUP BY alpha")
def w8(spark: SparkSession, d: str) -> DataFrame:
    return T.capital(details(spark, d), ["alpha"]).groupBy("alpha").agg(
        F.round(F.avg("capital"), 9).alias("mean"), F.round(F.max("capital"), 9).alias("peak"), F.round(F.avg("multiplier"), 6).alias("multiplier"), F.round(F.avg((F.col("multiplier") > 3).cast("double")), 6).alias("above_base"))


@query("w9_own_funds_component", f"""WITH {DETAILS}, c AS (SELECT *, CASE WHEN count(*) OVER {_ROLL} = 250 THEN sum(CAST(breached AS INTEGER)) OVER {_ROLL} END AS k, abs(var) * sqrt(10) AS v FROM details),
e AS (SELECT *, lag(v) OVER (PARTITION BY alpha ORDER BY date) AS b, avg(v) OVER (PARTITION BY alpha ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m FROM c)
SELECT alpha, date, round(greatest(b, (3.0 + {_STEPS('k', T.ADDEND)}) * m), 9) AS with_addend, round(greatest(b, 3.0 * m), 9) AS base FROM e WHERE k IS NOT NULL""")
def w9(spark: SparkSession, d: str) -> DataFrame:
    return T.own_funds(details(spark, d), ["alpha"]).select("alpha", "date", _r("with_addend", 9), _r("base", 9))


@query("w10_a34_last_breaches", f"""WITH {DETAILS}, k AS (SELECT *, row_number() OVER (PARTITION BY alpha ORDER BY date DESC) AS r, row_number() OVER (PARTITION BY alpha ORDER BY date) AS p FROM details)
SELECT alpha, count(*) FILTER (breached AND r <= 250) AS last_250, max(p) - max(p) FILTER (breached) AS days_since FROM k GROUP BY alpha""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("alpha")
    k = details(spark, d).withColumns({"r": F.row_number().over(w.orderBy(F.desc("date"))), "p": F.row_number().over(w.orderBy("date")).cast("long")})
    return k.groupBy("alpha").agg(F.count(F.when(F.col("breached") & (F.col("r") <= 250), 1)).alias("last_250"), (F.max("p") - F.max(F.when(F.col("breached"), F.col("p")))).alias("days_since"))


@query("a20_breaches_by_year", f"WITH {DETAILS} SELECT alpha, year(date) AS year, count(*) FILTER (breached) AS breaches, round(count(*) * alpha, 6) AS expected FROM details GROUP BY alpha, 2")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return details(spark, d).groupBy("alpha", F.year("date").cast("long").alias("year")).agg(F.count(F.when(F.col("breached"), 1)).alias("breaches"), F.round(F.count(F.lit(1)) * F.first("alpha"), 6).alias("expected"))


@query("a19_rate_by_stress_window", f"""WITH {DETAILS}, r AS (SELECT date, alpha, avg(CAST(breached AS INTEGER)) OVER {_ROLL} AS rate, count(*) OVER {_ROLL} AS n FROM details)
SELECT alpha, round(avg(rate) FILTER (tag = 'long slide'), 6) AS slide, round(avg(rate) FILTER (tag = 'late shock'), 6) AS shock, round(avg(rate) FILTER (tag = ''), 6) AS calm FROM (SELECT *, {_TAG} AS tag FROM r WHERE n = 250) GROUP BY alpha""")
def a19(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("alpha").orderBy("date").rowsBetween(-249, 0)
    r = details(spark, d).select("alpha", P.stress_tag("date").alias("tag"), F.avg(F.col("breached").cast("int")).over(w).alias("rate"), F.count(F.lit(1)).over(w).alias("n")).where("n = 250")
    wide = P.to_wide(r, "alpha", "tag", "rate", ["long slide", "late shock", ""])
    return wide.toDF("alpha", "slide", "shock", "calm").select("alpha", _r("slide"), _r("shock"), _r("calm"))


@query("j7_a33_pairwise_capital", f"""WITH {_CAPITAL}, m AS (SELECT alpha, avg(capital) AS c FROM cap GROUP BY alpha)
SELECT a.alpha AS one, b.alpha AS other, round(a.c - b.c, 9) AS difference, round((a.c - b.c) / b.c, 6) AS share FROM m a JOIN m b ON a.alpha <> b.alpha""")
def j7(spark: SparkSession, d: str) -> DataFrame:
    m = T.capital(details(spark, d), ["alpha"]).groupBy("alpha").agg(F.avg("capital").alias("c"))
    a, b = m.select(F.col("alpha").alias("one"), F.col("c").alias("ca")), m.select(F.col("alpha").alias("other"), F.col("c").alias("cb"))
    return a.join(b, F.col("one") != F.col("other")).select("one", "other", F.round(F.col("ca") - F.col("cb"), 9).alias("difference"), F.round((F.col("ca") - F.col("cb")) / F.col("cb"), 6).alias("share"))


@query("a35_calibration_stability", f"WITH {DETAILS}, r AS (SELECT alpha, avg(CAST(breached AS INTEGER)) OVER {_ROLL} AS rate, count(*) OVER {_ROLL} AS n FROM details) SELECT alpha, round(stddev_samp(rate), 6) AS sd FROM r WHERE n = 250 GROUP BY alpha")
def a35(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("alpha").orderBy("date").rowsBetween(-249, 0)
    r = details(spark, d).select("alpha", F.avg(F.col("breached").cast("int")).over(w).alias("rate"), F.count(F.lit(1)).over(w).alias("n")).where("n = 250")
    return r.groupBy("alpha").agg(F.round(F.stddev_samp("rate"), 6).alias("sd"))


@query("a39_severity_and_time_in_zone", f"""WITH {DETAILS}, k AS (SELECT *, sum(CAST(breached AS INTEGER)) OVER {_ROLL} AS c FROM details)
SELECT alpha, round(avg(abs(pnl) / abs(var)) FILTER (breached), 6) AS severity, round(avg(CASE WHEN c < 5 THEN 1.0 ELSE 0 END), 6) AS green, round(avg(CASE WHEN c BETWEEN 5 AND 9 THEN 1.0 ELSE 0 END), 6) AS yellow, round(avg(CASE WHEN c > 9 THEN 1.0 ELSE 0 END), 6) AS red FROM k GROUP BY alpha""")
def a39(spark: SparkSession, d: str) -> DataFrame:
    k = details(spark, d).withColumn("z", T.zone(T.rolling_count(["alpha"])))
    share = lambda z: F.round(F.avg((F.col("z") == z).cast("double")), 6).alias(z)
    return k.groupBy("alpha").agg(F.round(F.avg(F.when(F.col("breached"), F.abs("pnl") / F.abs("var"))), 6).alias("severity"), share("green"), share("yellow"), share("red"))


_WILSON = lambda z: f"""round(greatest(0, ((p + {z} * {z} / (2 * n)) - {z} * sqrt(p * (1 - p) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)), 9) AS lo%s,
  round(least(1, ((p + {z} * {z} / (2 * n)) + {z} * sqrt(p * (1 - p) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)), 9) AS hi%s"""  # noqa: E731


@query("t1_wilson_interval", f"""WITH {DETAILS}, g AS (SELECT alpha, count(*) AS n, count(*) FILTER (breached) / count(*) AS p FROM details GROUP BY alpha)
SELECT alpha, {_WILSON(repr(T.Z95)) % ("", "")}, {_WILSON("1.96") % ("_fixed", "_fixed")} FROM g""")
def t1(spark: SparkSession, d: str) -> DataFrame:
    """With the normal quantile, and with the 1.96 that some users fix."""
    g = T.breach_stats(details(spark, d), "alpha")
    (lo, hi), (low, high) = T.wilson(F.col("breaches"), F.col("n")), T.wilson(F.col("breaches"), F.col("n"), 1.96)
    return g.select("alpha", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"), F.round(low, 9).alias("lo_fixed"), F.round(high, 9).alias("hi_fixed"))


def _dk(*parts: str) -> str:
    said = " || '|' || ".join(parts)
    return f"('0x' || substr(md5({said}), 1, 8))::BIGINT"


