"""Bands, coverage, exposure and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.settle import settle
from plumbline.operators import bands as B
from plumbline.operators import panel as P
from plumbline.plans.registry import query
from plumbline.sources import tables as S


def _sql_bands(panel: str = S.SHIP) -> str:
    """CTE `scored`: both methods at every level, by the same definitions in SQL."""
    window = "(PARTITION BY slot ORDER BY date ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)"
    tails = ", ".join(f"quantile_cont(err, {t}) OVER {window} AS l{i}, quantile_cont(err, {1 - t}) OVER {window} AS h{i}" for i, t in enumerate(B.LEVELS.values()))
    parts = []
    for i, (level, tail) in enumerate(B.LEVELS.items()):
        for method, lo, hi in (("gaussian", f"m - {B.z(tail)!r} * s", f"m + {B.z(tail)!r} * s"), ("conformal", f"l{i}", f"h{i}")):
            parts.append(f"SELECT date, slot, act, fc, err, da, low, high, CAST({level} AS DOUBLE) AS level, '{method}' AS method, round({lo}, 9) AS lo, round({hi}, 9) AS hi FROM banded WHERE n >= 60 AND err IS NOT NULL")
    return f"""{panel}, banded AS MATERIALIZED (
  SELECT *, count(err) OVER {window} AS n, avg(err) OVER {window} AS m, stddev_samp(err) OVER {window} AS s, {tails} FROM panel
), scored AS MATERIALIZED (
  SELECT *, err >= lo AND err <= hi AS inside, hi - lo AS width, CASE WHEN err > hi THEN err - hi WHEN err < lo THEN lo - err ELSE 0.0 END AS excess,
    CASE WHEN err > 0 THEN greatest(high - da, 0) ELSE greatest(da - low, 0) END AS adverse
  FROM ({" UNION ALL ".join(parts)})
), priced AS (
  SELECT *, adverse >= (SELECT round(quantile_cont(adverse, 0.8), 9) FROM (SELECT DISTINCT date, slot, adverse FROM scored WHERE adverse IS NOT NULL)) AS expensive
  FROM scored WHERE adverse IS NOT NULL
)"""


SCORED = _sql_bands()
SEASON = "CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) IN (3, 4, 5) THEN 'MAM' WHEN month(date) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return B.scored_panel(S.ship_panel(spark, d))


def priced(spark: SparkSession, d: str) -> DataFrame:
    """Unpriced rows go after the bands are made, as they are part of the history."""
    return B.flag_expensive(settle(scored(spark, d).withColumn("adverse", B.adverse_spread()).where("adverse IS NOT NULL")))


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


_COVERAGE = "SELECT level, method, round(avg(CAST(inside AS DOUBLE)), 6) AS coverage, count(*) AS n, round(avg(width), 6) AS mean_width, round(quantile_cont(width, 0.95), 6) AS p95_width FROM scored GROUP BY level, method"


def _coverage(s: DataFrame) -> DataFrame:
    return s.groupBy("level", "method").agg(
        F.round(F.avg(F.col("inside").cast("double")), 6).alias("coverage"), F.count(F.lit(1)).alias("n"), F.round(F.avg("width"), 6).alias("mean_width"), F.round(F.percentile("width", F.lit(0.95)), 6).alias("p95_width"))


@query("w1_w2_band_coverage", f"WITH {SCORED} {_COVERAGE}")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(scored(spark, d))


@query("w1_w2_daily_coverage", f"WITH {_sql_bands(S.DAYS)} {_COVERAGE}")
def w1_days(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: both trailing bands on the daily total."""
    return _coverage(B.scored_panel(S.day_panel(spark, d)))


@query("w1_w2_band_edges", f"WITH {SCORED} SELECT date, slot, method, round(lo, 6) AS lo, round(hi, 6) AS hi, inside FROM scored WHERE level = 0.9")
def w1_edges(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).where("level = 0.9").select("date", "slot", "method", _r("lo"), _r("hi"), "inside")


_ORACLE = f"""{S.SHIP}, ranked AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY date) AS k FROM panel),
fixed AS (SELECT slot, round(quantile_cont(err, 0.05), 9) AS lo, round(quantile_cont(err, 0.95), 9) AS hi FROM ranked WHERE k > 60 GROUP BY slot)"""


@query("w3_oracle_band", f"WITH {_ORACLE} SELECT slot, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, round(avg(CASE WHEN err BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM ranked JOIN fixed USING (slot) WHERE k > 60 AND err IS NOT NULL GROUP BY slot")
def w3(spark: SparkSession, d: str) -> DataFrame:
    panel = S.ship_panel(spark, d)
    rank = F.row_number().over(Window.partitionBy("slot").orderBy("date"))
    later = panel.withColumn("k", rank).where("k > 60 AND err IS NOT NULL").drop("k")
    s = B.score(later.join(B.oracle_edges(panel), "slot"), ["oracle"]).where("level = 0.9")
    return s.groupBy("slot").agg(F.round(F.first("lo"), 6).alias("lo"), F.round(F.first("hi"), 6).alias("hi"), F.round(F.avg(F.col("inside").cast("double")), 6).alias("coverage"))


@query("w4_excess", f"WITH {SCORED} SELECT level, method, round(sum(excess), 4) AS total, round(avg(excess) FILTER (NOT inside), 6) AS mean_on_miss, round(max(excess), 6) AS worst FROM scored GROUP BY level, method")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("level", "method").agg(
        F.round(F.sum("excess"), 4).alias("total"), F.round(F.avg(F.when(~F.col("inside"), F.col("excess"))), 6).alias("mean_on_miss"), F.round(F.max("excess"), 6).alias("worst"))


@query("a1_headline_error", f"WITH {S.SHIP} SELECT round(avg(err), 6) AS bias, round(avg(abs(err)), 6) AS mae, count(err) AS n FROM panel")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return S.ship_panel(spark, d).agg(F.round(F.avg("err"), 6).alias("bias"), F.round(F.avg(F.abs("err")), 6).alias("mae"), F.count("err").alias("n"))


@query("a2_bias_by_hour", f"WITH {S.HOURS} SELECT slot, round(avg(err), 6) AS bias, round(avg(abs(err)), 6) AS mae FROM hpanel WHERE err IS NOT NULL GROUP BY slot")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return S.hour_panel(spark, d).where("err IS NOT NULL").groupBy("slot").agg(F.round(F.avg("err"), 6).alias("bias"), F.round(F.avg(F.abs("err")), 6).alias("mae"))


@query("a3_a4_coverage_by_season", f"WITH {SCORED} SELECT level, method, {SEASON} AS season, round(avg(CAST(inside AS DOUBLE)), 6) AS coverage, count(*) AS n FROM scored GROUP BY ALL")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return B.coverage(scored(spark, d), P.season("date").alias("season")).withColumn("coverage", F.round("coverage", 6))


@query("a5_coverage_by_month_and_slot", f"""WITH {SCORED}
SELECT level, method, strftime(date, '%Y-%m') AS month, slot, round(avg(CAST(inside AS DOUBLE)), 6) AS coverage, count(*) AS n FROM scored
GROUP BY GROUPING SETS ((level, method, strftime(date, '%Y-%m')), (level, method, slot))""")
def a5(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("month", F.date_format("date", "yyyy-MM"))
    cut = s.groupingSets([["level", "method", "month"], ["level", "method", "slot"]], "level", "method", "month", "slot")
    return cut.agg(F.round(F.avg(F.col("inside").cast("double")), 6).alias("coverage"), F.count(F.lit(1)).alias("n"))


@query("a6_width_stats", f"""WITH {SCORED}
SELECT level, method, round(avg(width), 6) AS mean_width, round(quantile_cont(width, 0.95), 6) AS p95, round(max(width), 6) AS widest,
  round(avg(CASE WHEN width > 0.5 * (SELECT avg(act) FROM panel) THEN 1.0 ELSE 0.0 END), 6) AS wide_share FROM scored GROUP BY level, method""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    load = S.ship_panel(spark, d).agg(F.avg("act").alias("load"))
    s = scored(spark, d).crossJoin(F.broadcast(load))  # one row
    return s.groupBy("level", "method").agg(
        F.round(F.avg("width"), 6).alias("mean_width"), F.round(F.percentile("width", F.lit(0.95)), 6).alias("p95"), F.round(F.max("width"), 6).alias("widest"),
        F.round(F.avg((F.col("width") > 0.5 * F.col("load")).cast("double")), 6).alias("wide_share"))


@query("a7_width_by_price", f"""WITH {SCORED}
SELECT level, method, round(avg(width) FILTER (expensive), 6) AS dear_width, round(avg(width) FILTER (NOT expensive), 6) AS cheap_width,
  round(avg(excess) FILTER (NOT inside), 6) AS miss_mean, round(quantile_cont(excess, 0.95) FILTER (NOT inside), 6) AS miss_p95 FROM priced GROUP BY level, method""")
def a7(spark: SparkSession, d: str) -> DataFrame:
    e, miss = F.col("expensive"), F.when(~F.col("inside"), F.col("excess"))
    return priced(spark, d).groupBy("level", "method").agg(
        F.round(F.avg(F.when(e, F.col("width"))), 6).alias("dear_width"), F.round(F.avg(F.when(~e, F.col("width"))), 6).alias("cheap_width"),
        F.round(F.avg(miss), 6).alias("miss_mean"), F.round(F.percentile(miss, F.lit(0.95)), 6).alias("miss_p95"))


@query("a8_a9_miss_concentration", f"""WITH {SCORED}
SELECT level, method, round(avg(CASE WHEN inside THEN 0.0 ELSE 1.0 END) FILTER (expensive) / nullif(avg(CASE WHEN inside THEN 0.0 ELSE 1.0 END) FILTER (NOT expensive), 0), 6) AS concentration,
  count(*) FILTER (expensive) AS n_expensive FROM priced GROUP BY level, method""")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return B.concentration(priced(spark, d), "level", "method").select("level", "method", _r("concentration"), "n_expensive")


@query("a10_day_counts", f"""WITH {SCORED}
SELECT level, method, date, count(*) AS n, count(*) FILTER (inside) AS inside, count(*) FILTER (expensive) AS n_exp, count(*) FILTER (expensive AND NOT inside) AS miss_exp,
  count(*) FILTER (NOT expensive) AS n_cheap, count(*) FILTER (NOT expensive AND NOT inside) AS miss_cheap FROM priced GROUP BY level, method, date""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return B.day_counts(priced(spark, d))


@query("a11_exposure_cost", f"WITH {SCORED} SELECT level, method, strftime(date, '%Y-%m') AS month, round(sum(excess * adverse * 0.25), 4) AS cost FROM priced GROUP BY ALL")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return B.exposure(priced(spark, d).withColumn("month", F.date_format("date", "yyyy-MM")), "level", "method", "month").withColumn("cost", F.round("cost", 4))


@query("a12_adverse_spread", f"WITH {S.SHIP} SELECT date, slot, round(CASE WHEN da IS NULL OR low IS NULL OR high IS NULL THEN NULL WHEN err > 0 THEN greatest(high - da, 0) ELSE greatest(da - low, 0) END, 9) AS adverse FROM panel")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return S.ship_panel(spark, d).select("date", "slot", F.round(B.adverse_spread(), 9).alias("adverse"))


@query("a13_daily_width_and_misses", f"WITH {SCORED} SELECT date, level, method, round(avg(width), 6) AS width, count(*) FILTER (NOT inside) AS misses FROM scored GROUP BY date, level, method")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("date", "level", "method").agg(F.round(F.avg("width"), 6).alias("width"), F.count(F.when(~F.col("inside"), 1)).alias("misses"))


@query("a14_missing_by_quarter", f"WITH {S.SHIP} SELECT date_trunc('quarter', date)::DATE AS quarter, round(avg(CASE WHEN act IS NULL THEN 1.0 ELSE 0 END), 6) AS act, round(avg(CASE WHEN fc IS NULL THEN 1.0 ELSE 0 END), 6) AS fc FROM panel GROUP BY 1")
def a14(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(c)
    return S.ship_panel(spark, d).groupBy(F.to_date(F.date_trunc("quarter", "date")).alias("quarter")).agg(share("act"), share("fc"))


_GATE = """round(corr(act, fc), 6) AS corr, round(regr_slope(act, fc), 6) AS slope, round(regr_intercept(act, fc), 4) AS intercept, round(regr_r2(act, fc), 6) AS r2,
  round((avg(fc) - avg(act)) / avg(act), 6) AS bias, count(*) AS n, corr(act, fc) >= 0.9 AND abs(regr_slope(act, fc) - 1) <= 0.15 AND abs((avg(fc) - avg(act)) / avg(act)) <= 0.05 AS passes"""


def _gate(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, _r("corr"), _r("slope"), _r("intercept", 4), _r("r2"), _r("bias"), "n", "passes")


@query("a15_integrity_gate", f"WITH {S.SHIP} SELECT slot, {_GATE} FROM panel WHERE act IS NOT NULL AND fc IS NOT NULL GROUP BY slot")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return _gate(B.integrity(S.ship_panel(spark, d), "slot"), "slot")


@query("a16_ols_by_year", f"WITH {S.SHIP} SELECT year(date) AS year, {_GATE} FROM panel WHERE act IS NOT NULL AND fc IS NOT NULL GROUP BY 1")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return _gate(B.integrity(S.ship_panel(spark, d).withColumn("year", F.year("date").cast("long")), "year"), "year")


@query("a16_two_regressors", f"""WITH {S.SHIP}, m AS (SELECT slot, covar_samp(act, fc) AS ya, covar_samp(act, da) AS yb, covar_samp(fc, da) AS ab, var_samp(fc) AS aa, var_samp(da) AS bb, var_samp(act) AS yy, avg(act) AS my, avg(fc) AS ma, avg(da) AS mb
  FROM panel WHERE act IS NOT NULL AND fc IS NOT NULL AND da IS NOT NULL GROUP BY slot), c AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS cb FROM m)
SELECT slot, round(ca, 6) AS coef_a, round(cb, 6) AS coef_b, round(my - ca * ma - cb * mb, 4) AS intercept, round((ca * ya + cb * yb) / yy, 6) AS r2 FROM c""")
def a16_two(spark: SparkSession, d: str) -> DataFrame:
    return B.two_regressors(S.ship_panel(spark, d), "act", "fc", "da", "slot").select("slot", _r("coef_a"), _r("coef_b"), _r("intercept", 4), _r("r2"))


@query("a17_variance_split", f"""WITH {S.SHIP}, g AS (SELECT *, avg(act) OVER (PARTITION BY slot) AS ms, avg(act) OVER (PARTITION BY slot, month(date)) AS mm FROM panel WHERE act IS NOT NULL)
SELECT round(1 - var_samp(act - ms) / var_samp(act), 6) AS slot_share, round(1 - var_samp(act - mm) / var_samp(act), 6) AS slot_month_share FROM g""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    g = S.ship_panel(spark, d).where("act IS NOT NULL").withColumns({"ms": F.avg("act").over(Window.partitionBy("slot")), "mm": F.avg("act").over(Window.partitionBy("slot", F.month("date")))})
    share = lambda m: 1 - F.var_samp(F.col("act") - F.col(m)) / F.var_samp("act")
    return g.agg(F.round(share("ms"), 6).alias("slot_share"), F.round(share("mm"), 6).alias("slot_month_share"))


@query("a37_completeness", f"WITH {S.SHIP} SELECT strftime(date, '%Y-%m') AS month, count(*) AS cells, count(act) AS filled, count(DISTINCT date) AS days FROM panel GROUP BY 1")
def a37(spark: SparkSession, d: str) -> DataFrame:
    return S.ship_panel(spark, d).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("cells"), F.count("act").alias("filled"), F.countDistinct("date").alias("days"))


@query("a38_within_day_correlation", f"""WITH {S.HOURS}, c AS (SELECT date, corr(act, fc) AS c FROM hpanel WHERE act IS NOT NULL AND fc IS NOT NULL GROUP BY date HAVING count(*) > 2)
SELECT {SEASON} AS season, round(median(c), 6) AS median_corr, count(*) AS days FROM c WHERE c IS NOT NULL AND NOT isnan(c) GROUP BY 1""")
def a38(spark: SparkSession, d: str) -> DataFrame:
    c = S.hour_panel(spark, d).where("act IS NOT NULL AND fc IS NOT NULL").groupBy("date").agg(F.corr("act", "fc").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 2 AND c IS NOT NULL AND NOT isnan(c)")
    return c.groupBy(P.season("date").alias("season")).agg(F.round(F.percentile("c", F.lit(0.5)), 6).alias("median_corr"), F.count(F.lit(1)).alias("days"))


@query("a40_corrected_basis", f"""WITH {S.SHIP}, day AS (SELECT date, sum(act) AS t FROM panel GROUP BY date), good AS (SELECT date FROM day WHERE t >= 0.75 * (SELECT median(t) FROM day))
SELECT {_GATE} FROM panel WHERE act IS NOT NULL AND fc IS NOT NULL AND date IN (SELECT date FROM good)""")
def a40(spark: SparkSession, d: str) -> DataFrame:
    panel = S.ship_panel(spark, d)
    day = panel.groupBy("date").agg(F.sum("act").alias("t"))
    middle = day.agg(F.percentile("t", F.lit(0.5)).alias("m"))
    good = day.crossJoin(F.broadcast(middle)).where("t >= 0.75 * m").select("date")  # one row
    return _gate(B.integrity(panel.join(good, "date", "left_semi")))


@query("a41_weekend_profile", f"WITH {S.HOURS} SELECT slot, round(avg(act) FILTER (isodow(date) < 6), 6) AS weekday, round(avg(act) FILTER (isodow(date) >= 6), 6) AS weekend FROM hpanel GROUP BY slot")
def a41(spark: SparkSession, d: str) -> DataFrame:
    w = F.weekday("date") >= 5
    return S.hour_panel(spark, d).groupBy("slot").agg(F.round(F.avg(F.when(~w, F.col("act"))), 6).alias("weekday"), F.round(F.avg(F.when(w, F.col("act"))), 6).alias("weekend"))


@query("a42_price_in_worst_slots", f"""WITH {SCORED}, worst AS (SELECT slot, avg(CAST(inside AS DOUBLE)) AS c FROM scored WHERE level = 0.9 AND method = 'gaussian' GROUP BY slot ORDER BY round(c, 9), slot LIMIT 2)
SELECT slot, round(c, 6) AS coverage, round((SELECT avg(da) FROM panel p WHERE p.slot = worst.slot), 6) AS price FROM worst""")
def a42(spark: SparkSession, d: str) -> DataFrame:
    worst = B.coverage(scored(spark, d).where("level = 0.9 AND method = 'gaussian'"), "slot").orderBy(F.round("coverage", 9), "slot").limit(2)
    price = S.ship_panel(spark, d).groupBy("slot").agg(F.round(F.avg("da"), 6).alias("price"))
    return worst.join(price, "slot").select("slot", _r("coverage"), "price")


@query("w12_lag_scan", f"""WITH {S.HOURS}, s AS (SELECT slot, avg(act) AS a, avg(fc) AS f FROM hpanel GROUP BY slot), k AS (SELECT unnest(range(-4, 5)) AS k)
SELECT k, round(corr(x.a, y.f), 6) AS corr FROM k, s x, s y WHERE y.slot = ((x.slot + k) % 24 + 24) % 24 GROUP BY k""")
def w12(spark: SparkSession, d: str) -> DataFrame:
    s = S.hour_panel(spark, d).groupBy("slot").agg(F.avg("act").alias("a"), F.avg("fc").alias("f"))
    shifted = s.select(F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("k"), "slot", "f").select(F.col("k").cast("long").alias("k"), F.pmod(F.col("slot") - F.col("k"), F.lit(24)).cast("int").alias("slot"), "f")
    return shifted.join(s.select("slot", "a"), "slot").groupBy("k").agg(F.round(F.corr("a", "f"), 6).alias("corr"))


@query("w13_first_difference", f"""WITH {S.SHIP}, x AS (SELECT slot, date, act - lag(act) OVER (PARTITION BY slot ORDER BY date) AS x FROM panel)
SELECT slot, round(quantile_cont(abs(x), 0.99), 6) AS p99, round(max(abs(x)) FILTER (date BETWEEN DATE '1998-03-25' AND DATE '1998-04-05'), 6) AS near FROM x GROUP BY slot""")
def w13(spark: SparkSession, d: str) -> DataFrame:
    x = S.ship_panel(spark, d).withColumn("x", F.abs(F.col("act") - F.lag("act").over(Window.partitionBy("slot").orderBy("date"))))
    near = F.when(F.col("date").between(F.lit("1998-03-25").cast("date"), F.lit("1998-04-05").cast("date")), F.col("x"))
    return x.groupBy("slot").agg(F.round(F.percentile("x", F.lit(0.99)), 6).alias("p99"), F.round(F.max(near), 6).alias("near"))


@query("w14_autocorrelation_and_weeks", f"""WITH {S.SHIP}, x AS (SELECT slot, date, act, lag(act) OVER (PARTITION BY slot ORDER BY date) AS b FROM panel),
w AS (SELECT slot, date_trunc('week', date)::DATE + 6 AS week, avg(act) AS m FROM panel WHERE act IS NOT NULL GROUP BY 1, 2),
e AS (SELECT slot, first(week ORDER BY round(m, 6) DESC, week) AS top_week, first(week ORDER BY round(m, 6), week) AS low_week FROM w GROUP BY slot)
SELECT slot, r AS autocorr, top_week, low_week FROM e JOIN (SELECT slot, round(corr(act, b), 6) AS r FROM x GROUP BY slot) USING (slot)""")
def w14(spark: SparkSession, d: str) -> DataFrame:
    """Weeks are named by the Sunday that ends them."""
    p = S.ship_panel(spark, d)
    r = p.withColumn("b", F.lag("act").over(Window.partitionBy("slot").orderBy("date"))).groupBy("slot").agg(F.round(F.corr("act", "b"), 6).alias("autocorr"))
    weeks = p.where("act IS NOT NULL").groupBy("slot", F.date_add(F.to_date(F.date_trunc("week", "date")), 6).alias("week")).agg(F.round(F.avg("act"), 6).alias("m"))
    late = -F.datediff("week", F.lit("1970-01-01").cast("date"))
    ends = weeks.groupBy("slot").agg(F.max_by("week", F.struct("m", late.alias("t"))).alias("top_week"), F.min_by("week", F.struct("m", "week")).alias("low_week"))
    return r.join(ends, "slot")
