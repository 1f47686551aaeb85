"""Clusters, policies, tolerances, signals, sequential state and rules."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import groups as G
from plumbline.operators import resample as R
from plumbline.operators import rules, sequential
from plumbline.operators import tail as T
from plumbline.plans.band_queries import SCORED
from plumbline.plans.registry import query
from plumbline.plans.tail_queries import _dk
from plumbline.sources import tables as S
from plumbline.sources.files import shipped


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


_ACCT = "acct AS (SELECT c_custkey AS id, c_nationkey AS g, abs(c_acctbal) AS a FROM customer)"


def _acct(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), F.abs("c_acctbal").alias("a"))


_RADIUS = lambda k: f"WITH {_ACCT}, r AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY a) AS r FROM acct) SELECT g, coalesce(max(a) FILTER (r = {k}), CAST('Infinity' AS DOUBLE)) AS radius FROM r GROUP BY g"


@query("m9_conformal_rank", _RADIUS("ceil(round((n + 1) * 0.9, 9))"))
def m9(spark: SparkSession, d: str) -> DataFrame:
    return G.conformal_rank(_acct(spark, d), "a", 0.9, "g")


@query("m9_conformal_higher", _RADIUS("ceil(round(least(1, ceil(round((n + 1) * 0.9, 9)) / n) * (n - 1), 9)) + 1"))
def m9_higher(spark: SparkSession, d: str) -> DataFrame:
    return G.conformal_higher(_acct(spark, d), "a", 0.1, "g")


_LINE = """pts AS (SELECT p_partkey AS id, p_brand AS g, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
own AS (SELECT g, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM pts GROUP BY g), w AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM own),
fit AS (SELECT g, ((w.n - o.n) * (w.sxy - o.sxy) - (w.sx - o.sx) * (w.sy - o.sy)) / ((w.n - o.n) * (w.sxx - o.sxx) - pow(w.sx - o.sx, 2)) AS slope, w.n - o.n AS n, w.sy - o.sy AS sy, w.sx - o.sx AS sx FROM own o, w),
pred AS (SELECT id, g, x, y, (sy - slope * sx) / n + slope * x AS pred FROM pts JOIN fit USING (g))"""


def _line(spark: SparkSession, d: str) -> DataFrame:
    pts = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return G.leave_one_out_line(pts, "g", "x", "y")


@query("q12_m13_leave_one_group_out", f"WITH {_LINE} SELECT g, round(avg(abs(y - pred)), 4) AS mae, count(*) AS n FROM pred GROUP BY g")
def q12(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d).groupBy("g").agg(F.round(F.avg(F.abs(F.col("y") - F.col("pred"))), 4).alias("mae"), F.count(F.lit(1)).alias("n"))


@query("m13_ridge_by_group")
def m13(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.models import ridge

    shipped(spark)
    p = S.table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 7).cast("double").alias("lot"), F.col("p_retailprice").alias("price"))
    return ridge(p, "p_brand", ["size", "lot"], "price").groupBy("p_brand").agg(F.avg(F.abs(F.col("price") - F.col("pred"))).alias("mae"))


_TRIGGER = lambda t: f"min(cut_index) FILTER (vb >= {t})"
_POLICY = " UNION ALL ".join(f"SELECT '{n}' AS rule, {a} AS chg, first_over, last FROM per" for n, a in (("point", "point_at"), ("upper", "upper_at"), ("fixed", "CASE WHEN last >= 6 THEN 6 END")))


@query("m16_w15_w16_change_policies", f"""WITH {S.WEAR}, per AS (SELECT "case", {_TRIGGER(0.6)} AS first_over, max(cut_index) AS last, {_TRIGGER(0.5)} AS point_at, min(cut_index) FILTER (vb + 0.08 >= 0.6) AS upper_at FROM wear GROUP BY 1), o AS ({_POLICY})
SELECT rule, CAST(sum(CASE WHEN chg IS NULL THEN 0 WHEN first_over IS NULL THEN greatest(0, last - chg) WHEN chg <= first_over THEN first_over - chg ELSE 0 END) AS BIGINT) AS waste,
  CAST(sum(CASE WHEN chg IS NULL THEN CASE WHEN first_over IS NULL THEN 0 ELSE last - first_over END WHEN first_over IS NULL THEN 0 WHEN chg <= first_over THEN 0 ELSE chg - first_over END) AS BIGINT) AS late,
  CAST(sum(last) AS BIGINT) AS cuts, count(*) FILTER (chg IS NULL) AS inert FROM o GROUP BY rule""")
def m16(spark: SparkSession, d: str) -> DataFrame:
    vb = F.col("vb")
    return G.change_outcomes(S.wear_tracks(spark, d), 0.6, {"point": G.first_cut(vb >= 0.5), "upper": G.first_cut(vb + 0.08 >= 0.6), "fixed": G.fixed_change(6)})


@query("a23_threshold_sweep", f"""WITH {S.WEAR}, t AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS t) SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (vb >= t) AS over, count(DISTINCT "case") FILTER (vb >= t) AS cases FROM wear, t GROUP BY t""")
def a23(spark: SparkSession, d: str) -> DataFrame:
    each = S.wear_tracks(spark, d).select("case", "vb", F.explode(F.array(*[F.lit(k / 10) for k in range(3, 11)])).alias("threshold"))
    over = F.col("vb") >= F.col("threshold")
    return each.groupBy("threshold").agg(F.count(F.when(over, 1)).alias("over"), F.countDistinct(F.when(over, F.col("case"))).alias("cases"))


@query("a24_a25_group_structure", f"""WITH {S.WEAR} SELECT "case", count(*) AS runs, max(vb) AS top, count(DISTINCT priority) AS cells, first(priority ORDER BY cut_index) AS first_priority FROM wear GROUP BY 1""")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return S.wear_tracks(spark, d).groupBy("case").agg(F.count(F.lit(1)).alias("runs"), F.max("vb").alias("top"), F.countDistinct("priority").alias("cells"), F.min_by("priority", "cut_index").alias("first_priority"))


@query("a22_mean_of_seed_means", f"""WITH s AS (SELECT o_orderpriority AS g, {_dk("'seed'", 'o_orderkey')} % 5 AS seed, o_totalprice AS v FROM orders), m AS (SELECT g, seed, avg(v) AS m, median(v) AS d FROM s GROUP BY g, seed)
SELECT g, round(avg(m), 4) AS mean, round(avg(d), 4) AS median, round(quantile_cont(m, 0.1), 4) AS p10 FROM m GROUP BY g""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    s = S.table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (R.draw("seed", "o_orderkey") % 5).alias("seed"), F.col("o_totalprice").alias("v"))
    m = s.groupBy("g", "seed").agg(F.avg("v").alias("m"), F.percentile("v", F.lit(0.5)).alias("d"))
    return m.groupBy("g").agg(F.round(F.avg("m"), 4).alias("mean"), F.round(F.avg("d"), 4).alias("median"), F.round(F.percentile("m", F.lit(0.1)), 4).alias("p10"))


@query("b3_cluster_bootstrap", f"""WITH c AS (SELECT c_nationkey AS g, sum(c_acctbal) AS s, count(*) AS n, row_number() OVER (ORDER BY c_nationkey) - 1 AS u FROM customer GROUP BY 1), t AS (SELECT count(*) AS n FROM c),
d AS (SELECT b, i, {_dk("'clusters'", 'b', 'i')} % (SELECT n FROM t) AS u FROM (SELECT unnest(range(0, {R.DRAWS})) AS b), (SELECT unnest(range(0, (SELECT n FROM t))) AS i)), r AS (SELECT b, sum(s) / sum(n) AS m FROM d JOIN c USING (u) GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM r""")
def b3(spark: SparkSession, d: str) -> DataFrame:
    """2,000 draws of whole clusters, from their sums alone."""
    c = S.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.sum("c_acctbal").alias("s"), F.count(F.lit(1)).alias("n"))
    means = R.redrawn(c, "clusters", R.DRAWS, "g").groupBy("b").agg((F.sum("s") / F.sum("n")).alias("m"))
    return R.interval(means, "m", digits=4)


@query("b6_seeded_calibration_groups", f"SELECT seed, c_nationkey FROM (SELECT seed, c_nationkey, row_number() OVER (PARTITION BY seed ORDER BY {_dk("'folds'", 'seed', 'c_nationkey')}, c_nationkey) AS k FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT unnest(range(0, 25)) AS seed)) WHERE k <= 4")
def b6(spark: SparkSession, d: str) -> DataFrame:
    cells = S.table(spark, d, "customer").select("c_nationkey").distinct().crossJoin(spark.range(25).withColumnRenamed("id", "seed"))
    w = Window.partitionBy("seed").orderBy(R.draw("folds", "seed", "c_nationkey"), "c_nationkey")
    return cells.withColumn("k", F.row_number().over(w)).where("k <= 4").select("seed", "c_nationkey")


_TOL = """lim AS (SELECT p_brand AS g, avg(p_retailprice) - 1.5 * stddev_samp(p_retailprice) AS lo, avg(p_retailprice) + 2.5 * stddev_samp(p_retailprice) AS hi FROM part GROUP BY 1),
cap AS (SELECT p_brand AS g, count(*) AS n, avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s, count(*) FILTER (p_retailprice < round(lo, 6) OR p_retailprice > round(hi, 6)) AS o, any_value(round(lo, 6)) AS lo, any_value(round(hi, 6)) AS hi FROM part JOIN lim ON g = p_brand GROUP BY 1)"""


def _capability(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_retailprice").alias("v"))
    limits = p.groupBy("g").agg(F.round(F.avg("v") - 1.5 * F.stddev_samp("v"), 6).alias("lower"), F.round(F.avg("v") + 2.5 * F.stddev_samp("v"), 6).alias("upper"))
    return G.capability(p.join(limits, "g"), "g", "v", "lower", "upper")


@query("a30_process_capability", f"WITH {_TOL} SELECT g, n, round(m, 8) AS mean, round(s, 4) AS sd, o AS outside, round(o / n, 6) AS share, round(least(hi - m, m - lo) / s / 3, 6) AS cpk FROM cap")
def a30(spark: SparkSession, d: str) -> DataFrame:
    return _capability(spark, d).select("g", "n", _r("mean", 8), _r("sd", 4), "outside", _r("share"), _r("cpk"))


@query("r2_tolerance_severity", f"""WITH {_TOL}, w AS (SELECT *, greatest(0, ((o / n + {T.Z95 ** 2!r} / (2 * n)) - {T.Z95!r} * sqrt((o / n) * (1 - o / n) / n + {T.Z95 ** 2!r} / (4 * n * n))) / (1 + {T.Z95 ** 2!r} / n)) AS low, least(hi - m, m - lo) / s AS near FROM cap)
SELECT g, CASE WHEN low > 0.01 THEN 'Material' WHEN near / 3 < 1.33 THEN 'Significant' ELSE 'Observation' END AS severity, near > 6 AS untested FROM w""")
def r2(spark: SparkSession, d: str) -> DataFrame:
    c = _capability(spark, d)
    low, _ = T.wilson(F.col("outside"), F.col("n"))
    return c.select("g", rules.tolerance(low, F.col("cpk")).alias("severity"), rules.untested(F.col("nearest_sd")).alias("untested"))


@query("a31_all_inside", "SELECT count(*) FILTER (ok) AS inside, count(*) AS orders FROM (SELECT l_orderkey, bool_and(l_discount BETWEEN 0.0 AND 0.09 AND l_tax <= 0.07 AND l_quantity <= 45) AS ok FROM lineitem GROUP BY 1)")
def a31(spark: SparkSession, d: str) -> DataFrame:
    ok = F.bool_and(F.col("l_discount").between(0.0, 0.09) & (F.col("l_tax") <= 0.07) & (F.col("l_quantity") <= 45))
    return S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(ok.alias("ok")).agg(F.count_if("ok").alias("inside"), F.count(F.lit(1)).alias("orders"))


@query("a32_structure_checks", "SELECT 'l_tax' AS feature, stddev_samp(l_tax) < 1e-12 AS flat, count(*) - count(l_tax) AS missing, round(quantile_cont(l_tax, 0.95), 6) AS p95 FROM lineitem UNION ALL SELECT 'one', true, 0, 1.0 FROM (SELECT 1)")
def a32(spark: SparkSession, d: str) -> DataFrame:
    x = S.table(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    checks = [F.struct(F.lit(c).alias("feature"), (F.stddev_samp(c) < 1e-12).alias("flat"), (F.count(F.lit(1)) - F.count(c)).alias("missing"), F.round(F.percentile(c, F.lit(0.95)), 6).alias("p95")) for c in ("l_tax", "one")]
    return x.agg(F.array(*checks).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query("m17_check_policies", "WITH t AS (SELECT unnest([10.0, 20.0, 30.0, 40.0]) AS t) SELECT CAST(t AS DOUBLE) AS threshold, round(100 * avg(CAST(p_size > t AS INTEGER)), 6) AS flagged, round(100 * avg(CAST(p_size > t AND p_retailprice <= 1500 AS INTEGER)), 6) AS in_limit_flagged, round(100 * avg(CAST(p_size <= t AND p_retailprice > 1500 AS INTEGER)), 6) AS escaped, round(100 * avg(CAST(p_size > t AND p_retailprice > 1500 AS INTEGER)), 6) AS caught FROM part, t GROUP BY t")
def m17(spark: SparkSession, d: str) -> DataFrame:
    c = G.check_policy(S.table(spark, d, "part"), [10.0, 20.0, 30.0, 40.0], "p_size", F.col("p_retailprice") > 1500)
    return c.select("threshold", *[_r(x) for x in ("flagged", "in_limit_flagged", "escaped", "caught")])


_SIG = "sig AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, max(abs(value)) OVER (PARTITION BY user_id) AS top FROM events)"


@query("a28_signal_summary", f"""WITH {_SIG}, g AS (SELECT user_id, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak, quantile_cont(abs(value), 0.9) AS p90, kurtosis_pop(value) AS k,
  avg(pow(value, 3)) - 3 * avg(value) * avg(value * value) + 2 * pow(avg(value), 3) AS m3, stddev_pop(value) AS sp, regr_slope(value, i) AS slope, avg(CASE WHEN abs(value) >= 0.999 * top THEN 1.0 ELSE 0 END) AS clipped FROM sig GROUP BY user_id)
SELECT user_id, n, CASE WHEN n >= 10 THEN round(mean, 6) END AS mean, CASE WHEN n >= 10 THEN round(sd, 6) END AS sd, CASE WHEN n >= 10 THEN round(rms, 6) END AS rms, CASE WHEN n >= 10 THEN round(p90, 6) END AS p90,
  CASE WHEN n >= 10 AND sd >= 1e-12 THEN round(k, 4) END AS kurtosis, CASE WHEN n >= 10 AND sd >= 1e-12 THEN round(m3 / pow(sp, 3), 4) END AS skew, CASE WHEN n >= 10 THEN round(slope, 6) END AS slope, CASE WHEN n >= 10 THEN round(clipped, 6) END AS clipped FROM g""")
def a28(spark: SparkSession, d: str) -> DataFrame:
    s = G.signal_summary(S.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return s.select("user_id", "n", _r("mean"), _r("sd"), _r("rms"), _r("p90"), _r("kurtosis", 4), _r("skew", 4), _r("slope"), _r("clipped"))


@query("a29_trace_features", f"""WITH {_SIG}, e AS (SELECT user_id, min(i) FILTER (value > 50) AS a, max(i) FILTER (value > 50) AS b FROM sig GROUP BY user_id)
SELECT user_id, b - a AS span, round(quantile_cont(value, 0.95), 6) AS p95, round(min(value), 6) AS low FROM sig JOIN e USING (user_id) WHERE i BETWEEN a AND b GROUP BY user_id, a, b""")
def a29(spark: SparkSession, d: str) -> DataFrame:
    """The segment from the first to the last sample over 50."""
    w = Window.partitionBy("user_id")
    s = S.table(spark, d, "events").withColumn("i", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long"))
    s = s.withColumns({"a": F.min(F.when(F.col("value") > 50, F.col("i"))).over(w), "b": F.max(F.when(F.col("value") > 50, F.col("i"))).over(w)}).where("i BETWEEN a AND b")
    return s.groupBy("user_id").agg((F.first("b") - F.first("a")).alias("span"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.min("value"), 6).alias("low"))


@query("w20_boxcar_envelope", "SELECT event_id, round(sum(abs(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15, 6) AS e FROM events")
def w20(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "events").select("event_id", F.round(G.envelope("value", "user_id", ["ts", "event_id"], 15), 6).alias("e"))


@query("w21_plateau", f"""WITH {_SIG}, e AS (SELECT user_id, i, sum(abs(value)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15 AS e, count(*) OVER (PARTITION BY user_id) AS n FROM sig),
h AS (SELECT user_id, 0.5 * quantile_cont(e, 0.95) AS h FROM e GROUP BY user_id), x AS (SELECT user_id, min(i) FILTER (e > h) AS a, max(i) FILTER (e > h) AS b, any_value(n) AS n FROM e JOIN h USING (user_id) GROUP BY user_id),
y AS (SELECT user_id, CASE WHEN b - a + 1 >= 20 THEN a ELSE n // 4 END AS a, CASE WHEN b - a + 1 >= 20 THEN b ELSE 3 * n // 4 END AS b FROM x)
SELECT user_id, CAST(a + floor((b - a) * 0.1) AS BIGINT) AS first, CAST(b - floor((b - a) * 0.1) AS BIGINT) AS last FROM y""")
def w21(spark: SparkSession, d: str) -> DataFrame:
    return G.plateau(S.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 15, 20)


_ACI = f"""{S.SHIP}, few AS (SELECT slot, date, err, row_number() OVER (PARTITION BY slot ORDER BY date) AS k FROM panel),
win AS MATERIALIZED (SELECT slot, date, err, k, list_sort(list_filter(list(err) OVER (PARTITION BY slot ORDER BY k ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL)) AS w FROM few),
sc AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY k) AS j FROM win WHERE len(w) >= 60 AND err IS NOT NULL)"""
_Q7 = lambda q: f"(w[CAST(floor((len(w) - 1) * ({q})) AS BIGINT) + 1] + ((len(w) - 1) * ({q}) - floor((len(w) - 1) * ({q}))) * (w[least(CAST(floor((len(w) - 1) * ({q})) AS BIGINT) + 2, len(w))] - w[CAST(floor((len(w) - 1) * ({q})) AS BIGINT) + 1]))"
_TAIL = "least(greatest(a, 0.001), 0.45)"
_ACI_STEP = f"""SELECT slot, level, gain, j, date, err, lo, hi, err BETWEEN lo AND hi AS inside, a + gain * (round(1 - level, 12) - CASE WHEN err BETWEEN lo AND hi THEN 0 ELSE 1 END) AS a FROM (
  SELECT s.slot, level, gain, s.j, s.date, s.err, a, round({_Q7(f"{_TAIL} / 2")}, 9) AS lo, round({_Q7(f"1 - {_TAIL} / 2")}, 9) AS hi FROM sc s JOIN %s)"""


def _walk(levels: list[float], gains: list[float]) -> str:
    """CTE `walk`: the adaptive bands of every slot, level and gain, a row of each in a step."""
    cells = " UNION ALL ".join(f"SELECT CAST({v} AS DOUBLE) AS level, CAST({g} AS DOUBLE) AS gain, round(1 - CAST({v} AS DOUBLE), 12) AS a" for v in levels for g in gains)
    first, later = f"({cells}) ON s.j = 1", "walk p ON p.slot = s.slot AND s.j = p.j + 1"
    return f"WITH RECURSIVE {_ACI}, walk AS ({_ACI_STEP % first} UNION ALL {_ACI_STEP % later})"


@query("q1_adaptive_bands", f"{_walk([0.9], [0.02])} SELECT slot, date, round(lo, 6) AS lo, round(hi, 6) AS hi, inside, round(a, 6) AS a_t FROM walk")
def q1(spark: SparkSession, d: str) -> DataFrame:
    shipped(spark)
    return sequential.adaptive_bands(S.ship_panel(spark, d), [0.9]).select("slot", "date", _r("lo"), _r("hi"), "inside", _r("a_t"))


@query("q1_adaptive_coverage", f"{_walk([0.8, 0.9, 0.95], [0.02])} SELECT level, round(avg(CASE WHEN inside THEN 1.0 ELSE 0 END), 6) AS coverage, count(*) AS n FROM walk GROUP BY level")
def q1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The whole history at every level."""
    shipped(spark)
    return sequential.adaptive_bands(S.ship_panel(spark, d), [0.8, 0.9, 0.95]).groupBy("level").agg(F.round(F.avg(F.col("inside").cast("double")), 6).alias("coverage"), F.count(F.lit(1)).alias("n"))


_GAINS = [0.0, 0.01, 0.02, 0.05, 0.10]


@query("q13_gain_sweep", f"""{_walk([0.9], _GAINS)}, by_ AS (SELECT gain, slot, avg(CASE WHEN inside THEN 1.0 ELSE 0 END) AS c, avg(hi - lo) AS w FROM walk GROUP BY gain, slot)
SELECT gain AS gamma, round(avg(c), 6) AS coverage, round(min(c), 6) AS worst, round(max(c) - min(c), 6) AS spread, round(avg(w), 4) AS width FROM by_ GROUP BY gain""")
def q13(spark: SparkSession, d: str) -> DataFrame:
    shipped(spark)
    a = sequential.adaptive_bands(S.ship_panel(spark, d), [0.9], _GAINS)
    by = a.groupBy("gamma", "slot").agg(F.avg(F.col("inside").cast("double")).alias("c"), F.avg(F.col("hi") - F.col("lo")).alias("w"))
    return by.groupBy("gamma").agg(F.round(F.avg("c"), 6).alias("coverage"), F.round(F.min("c"), 6).alias("worst"), F.round(F.max("c") - F.min("c"), 6).alias("spread"), F.round(F.avg("w"), 4).alias("width"))


@query("q2_gain_zero_is_rolling", f"WITH {SCORED} SELECT date, slot, round(lo, 6) AS lo, round(hi, 6) AS hi, inside FROM scored WHERE level = 0.9 AND method = 'conformal'")
def q2(spark: SparkSession, d: str) -> DataFrame:
    """Without a gain the adaptive band is the rolling one."""
    shipped(spark)
    return sequential.adaptive_bands(S.ship_panel(spark, d), [0.9], [0.0]).select("date", "slot", _r("lo"), _r("hi"), "inside")


@query("t15_t16_distribution_functions")
def t15(spark: SparkSession, d: str) -> DataFrame:
    """Quantile, cdf of it and shortfall of a normal and two t distributions."""
    from plumbline.functions.dist import table

    return spark.createDataFrame(table([0.01, 0.025, 0.05], [None, 8.0, 5.0]), "nu double, p double, quantile double, cdf double, es double")


@query("t28_exact_null_stability")
def t28(spark: SparkSession, d: str) -> DataFrame:
    """5th percentiles of Z1 and Z2 when a model states the true VaR and ES; a task a (tail, distribution)."""
    shipped(spark)
    cells = spark.createDataFrame([(a, nu) for a in (0.01, 0.025) for nu in (4.0, 8.0, 1e6)], "alpha double, nu double")

    def run(pdf):
        import numpy as np
        import pandas as pd

        from plumbline.functions import dist

        alpha, nu = float(pdf["alpha"].iloc[0]), float(pdf["nu"].iloc[0])
        var, es = dist.t_quantile(alpha, nu), dist.t_es(alpha, nu)
        x = np.random.default_rng(int(nu) + int(1e4 * alpha)).standard_t(nu, (2000, 500))
        hit, ratio = x < var, x / abs(es)
        total = np.where(hit, ratio, 0).sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            z1 = total / hit.sum(1) + 1
        z2 = total / (500 * alpha) + 1
        return pd.DataFrame({"alpha": [alpha], "nu": [nu], "z1_p5": [float(np.nanpercentile(z1, 5))], "z2_p5": [float(np.percentile(z2, 5))]})

    return cells.groupBy("alpha", "nu").applyInPandas(run, "alpha double, nu double, z1_p5 double, z2_p5 double")


@query("m19_fixed_change_reach", f"""WITH {S.WEAR}, g AS (SELECT "case", max(cut_index) AS n FROM wear GROUP BY 1) SELECT count(*) AS cases, count(*) FILTER (n < 5) AS short, count(*) FILTER (n < 12) AS inert_12, round(avg(n), 6) AS mean_cuts FROM g""")
def m19(spark: SparkSession, d: str) -> DataFrame:
    g = S.wear_tracks(spark, d).groupBy("case").agg(F.max("cut_index").alias("n"))
    return g.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("n") < 5).alias("short"), F.count_if(F.col("n") < 12).alias("inert_12"), F.round(F.avg("n"), 6).alias("mean_cuts"))


