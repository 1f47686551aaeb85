"""Findings on the bands and on the records they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.settle import settle
from plumbline.operators import bands as B
from plumbline.operators import integrity as I
from plumbline.operators import resample as R
from plumbline.operators import rules
from plumbline.plans.band_queries import SCORED, priced
from plumbline.plans.registry import query
from plumbline.plans.walk_queries import _DRAWN
from plumbline.sources import tables as S


def _r(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


BOOT = f"""{SCORED}, day_counts AS MATERIALIZED (SELECT level, method, date, count(*) AS n, count(*) FILTER (inside) AS inside, count(*) FILTER (expensive) AS n_exp, count(*) FILTER (expensive AND NOT inside) AS miss_exp,
  count(*) FILTER (NOT expensive) AS n_cheap, count(*) FILTER (NOT expensive AND NOT inside) AS miss_cheap FROM priced GROUP BY level, method, date),
days AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS u FROM (SELECT DISTINCT date FROM day_counts)),
drawn AS MATERIALIZED (SELECT b, u, count(*) AS w FROM ({_DRAWN('days', 'days')}) GROUP BY b, u),
redrawn AS (SELECT level, method, b, sum(w * inside) / sum(w * n) AS coverage, (sum(w * miss_exp) / greatest(sum(w * n_exp), 1)) / greatest(sum(w * miss_cheap) / greatest(sum(w * n_cheap), 1), 1e-9) AS concentration
  FROM drawn JOIN days USING (u) JOIN day_counts USING (date) GROUP BY level, method, b),
boot AS MATERIALIZED (SELECT level, method, round(quantile_cont(coverage, 0.025), 6) AS lo, round(quantile_cont(coverage, 0.975), 6) AS hi, round(quantile_cont(concentration, 0.025), 6) AS conc_lo, round(quantile_cont(concentration, 0.975), 6) AS conc_hi FROM redrawn GROUP BY level, method)"""
GRADED = f"""{BOOT}, seen AS (SELECT level, method, avg(CASE WHEN inside THEN 1.0 ELSE 0 END) AS coverage, avg(CASE WHEN inside THEN 0.0 ELSE 1.0 END) FILTER (expensive) / nullif(avg(CASE WHEN inside THEN 0.0 ELSE 1.0 END) FILTER (NOT expensive), 0) AS concentration FROM priced GROUP BY level, method),
graded AS (SELECT *, CASE WHEN level BETWEEN lo AND hi THEN 'Observation' WHEN concentration >= 1.25 AND conc_lo > 1 THEN 'Material' ELSE 'Significant' END AS severity FROM seen JOIN boot USING (level, method))"""


def day_intervals(scored: DataFrame, draws: int = R.DRAWS) -> DataFrame:
    """level, method and the intervals of coverage (lo, hi) and of concentration (conc_lo, conc_hi): whole days redrawn, both
    ratios of sums over a day's counts."""
    counts = settle(B.day_counts(scored))
    drawn = R.redrawn(counts.select("date").distinct(), "days", draws, "date").join(counts, "date")
    one = lambda c: F.greatest(F.sum(c), F.lit(1))
    ratio = (F.sum("miss_exp") / one("n_exp")) / F.greatest(F.sum("miss_cheap") / one("n_cheap"), F.lit(1e-9))
    each = settle(drawn.groupBy("level", "method", "b").agg((F.sum("inside") / F.sum("n")).alias("coverage"), ratio.alias("concentration")))
    conc = R.interval(each, "concentration", "level", "method").withColumnsRenamed({"lo": "conc_lo", "hi": "conc_hi"})
    return R.interval(each, "coverage", "level", "method").join(conc, ["level", "method"])


def graded(spark: SparkSession, d: str) -> DataFrame:
    p = settle(priced(spark, d))
    g = B.concentration(p, "level", "method").join(B.coverage(p), ["level", "method"]).join(day_intervals(p), ["level", "method"])
    return g.withColumn("severity", rules.band(F.col("level").between(F.col("lo"), F.col("hi")), F.col("concentration"), F.col("conc_lo")))


@query("b0_b1_day_bootstrap", f"WITH {BOOT} SELECT * FROM boot")
def b1(spark: SparkSession, d: str) -> DataFrame:
    """2,000 draws of whole days."""
    return day_intervals(priced(spark, d))


@query("r1_band_severity", f"WITH {GRADED} SELECT level, method, round(coverage, 6) AS coverage, lo, hi, round(concentration, 6) AS concentration, conc_lo, severity FROM graded")
def r1(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).select("level", "method", _r("coverage"), "lo", "hi", _r("concentration"), "conc_lo", "severity")


@query("r9_findings_register", f"""WITH {GRADED}, k AS (SELECT *, CASE severity WHEN 'Material' THEN 2 WHEN 'Significant' THEN 1 ELSE 0 END AS rk FROM graded),
worst AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY rk DESC, level = 0.9 DESC, level) AS place FROM k)
SELECT printf('F-%02d', row_number() OVER (ORDER BY rk DESC, method)) AS id, method, level, severity FROM worst WHERE place = 1""")
def r9(spark: SparkSession, d: str) -> DataFrame:
    return rules.register(graded(spark, d), "method", "level", 0.9).select("id", "method", "level", "severity")


_FEATURES = ["l_quantity", "l_tax", "l_discount", "one", "sparse"]
_CELLS = "SELECT *, 1.0 AS one, CASE WHEN l_orderkey % 3 = 0 THEN l_tax END AS sparse FROM lineitem"


@query("r4_structure_severity", " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(1 - count({c}) / count(*), 6) AS missing, coalesce(stddev_samp({c}), 0) < 1e-12 AS flat,
  CASE WHEN 1 - count({c}) / count(*) > 0.5 THEN 'Material' WHEN coalesce(stddev_samp({c}), 0) < 1e-12 OR count({c}) < count(*) THEN 'Significant' ELSE 'Observation' END AS severity FROM ({_CELLS})""" for c in _FEATURES))
def r4(spark: SparkSession, d: str) -> DataFrame:
    """A channel that is mostly missing blocks an analysis; a constant or incomplete one leaves it ambiguous."""
    rows = S.table(spark, d, "lineitem").withColumns({"one": F.lit(1.0), "sparse": F.when(F.col("l_orderkey") % 3 == 0, F.col("l_tax"))})
    share = lambda c: 1 - F.count(c) / F.count(F.lit(1))
    flat = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)) < 1e-12
    cells = [F.struct(F.lit(c).alias("feature"), F.round(share(c), 6).alias("missing"), flat(c).alias("flat"), rules.structure(share(c) > 0.5, flat(c) | (F.count(c) < F.count(F.lit(1)))).alias("severity")) for c in _FEATURES]
    return rows.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


# ---- ten tests of two series that should be a forecast and its outcome

_NIGHT, _NOON = "slot BETWEEN 0 AND 5", "slot BETWEEN 11 AND 13"
_LATE = "day(date) > 15"


def _battery(name: str, panel: str) -> str:
    """CTEs of tests 4, 6 and 7 on one panel (date, slot, act, fc, sun)."""
    return f"""{name}_both AS MATERIALIZED (SELECT *, act - fc AS gap FROM {panel} WHERE act IS NOT NULL AND fc IS NOT NULL),
{name}_prof AS MATERIALIZED (SELECT slot, avg(act) AS a, avg(fc) AS f FROM {name}_both GROUP BY slot),
{name}_lag AS (SELECT k, corr(x.a, y.f) AS c FROM (SELECT unnest(range(-3, 4)) AS k), {name}_prof x, {name}_prof y WHERE y.slot = ((x.slot - k) % 24 + 24) % 24 GROUP BY k),
{name}_phase AS (SELECT max(c) - max(c) FILTER (k = 0) AS gain FROM {name}_lag),
{name}_slots AS (SELECT slot, avg(gap) AS g FROM {name}_both GROUP BY slot),
{name}_shape AS (SELECT avg(g) FILTER ({_NOON}) / nullif(avg(g) FILTER ({_NIGHT}), 0) AS ratio FROM {name}_slots),
{name}_season AS (SELECT avg(gap) FILTER ({_LATE} AND {_NOON}) AS late, avg(gap) FILTER (NOT ({_LATE}) AND {_NOON}) AS early FROM {name}_both),
{name}_net AS (SELECT regr_slope(gap, sun) AS slope, regr_r2(gap, sun) AS r2 FROM {name}_both)"""


_PANELS = f"""{S.HOURS}, sun AS (SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS slot, round(sum(value) FILTER (event_type = 'purchase'), 6) AS s FROM events GROUP BY ALL),
main AS MATERIALIZED (SELECT p.date, p.slot, p.act, p.fc, coalesce(s, 0) AS sun FROM hpanel p LEFT JOIN sun USING (date, slot)),
control AS MATERIALIZED (SELECT date, slot, act, round(act + 3 * sin(slot), 6) AS fc, sun FROM main)"""
_REF = "(SELECT avg(value) * count(*) / (count(DISTINCT CAST(ts AS DATE)) * 24) FROM events)"


@query("r11_integrity_battery", f"""WITH {_PANELS}, {_battery('m', 'main')}, {_battery('c', 'control')},
raw AS (SELECT max(abs(n - 24) / 24.0) AS off, max(dups) AS dups, avg(CASE WHEN act IS NULL THEN 1.0 ELSE 0 END) AS nulls FROM (SELECT date, count(*) OVER (PARTITION BY date) AS n, count(*) OVER (PARTITION BY date, slot) - 1 AS dups, act FROM main)),
res AS (SELECT count(*) AS slots, max(n) / min(n) AS ratio FROM (SELECT slot, count(*) AS n FROM m_both GROUP BY slot)),
unit AS (SELECT avg(act) / {_REF} AS a, avg(fc) / {_REF} AS f FROM m_both),
jumps AS (SELECT date, slot, abs(gap - lag(gap) OVER (ORDER BY date, slot)) AS j FROM m_both),
edge AS (SELECT (SELECT max(j) FROM jumps WHERE date = (SELECT min(date) + 14 FROM main) AND slot <= 3) AS near, quantile_cont(j, 0.99) AS p99, (SELECT count(*) FROM main WHERE date = (SELECT min(date) + 14 FROM main)) AS rows FROM jumps),
floor_ AS (SELECT avg(n) AS mean, stddev_samp(n) AS sd FROM (SELECT date, avg(gap) FILTER ({_NIGHT}) AS n FROM m_both GROUP BY date)),
again AS (SELECT count(*) AS off FROM (SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS slot, round(sum(value), 6) AS x FROM events GROUP BY ALL) f FULL JOIN main m USING (date, slot) WHERE coalesce(x, 0) <> coalesce(act, 0)),
v AS (SELECT (SELECT off <= 0.02 AND dups = 0 AND nulls < 0.01 FROM raw) AS t1, (SELECT slots = 24 AND ratio <= 1.02 FROM res) AS t2, (SELECT a BETWEEN 0.85 AND 1.15 AND f BETWEEN 0.85 AND 1.15 FROM unit) AS t3,
  (SELECT gain <= 0.02 FROM m_phase) AS t4, (SELECT rows = 24 AND near < p99 FROM edge) AS t5, (SELECT ratio > 3 FROM m_shape) AND (SELECT late > early FROM m_season) AS t6, (SELECT slope BETWEEN 0.7 AND 1.3 AND r2 > 0.6 FROM m_net) AS t7,
  (SELECT gain <= 0.02 FROM c_phase) AND NOT coalesce((SELECT ratio > 3 FROM c_shape) AND (SELECT late > early FROM c_season), false) AND (SELECT r2 < 0.3 FROM c_net) AS t9, (SELECT off = 0 FROM again) AS t10)
SELECT t.* FROM v, LATERAL (VALUES ('01 raw series', coalesce(t1, false)), ('02 resolution', coalesce(t2, false)), ('03 unit and scale', coalesce(t3, false)), ('04 phase shift', coalesce(t4, false)), ('05 clock change', coalesce(t5, false)),
  ('06 gap shape', coalesce(t6, false)), ('07 netting', coalesce(t7, false)), ('08 intercept', CAST(NULL AS BOOLEAN)), ('09 control', coalesce(t9, false)), ('10 independent pull', coalesce(t10, false)),
  ('conclusion: ' || CASE WHEN NOT (t1 AND t2 AND t4 AND t5 AND t10) THEN 'a fault in the pull or the panel' WHEN t7 AND t9 THEN 'a property of the series' ELSE 'only in part a property of the series' END, CAST(NULL AS BOOLEAN))) AS t(test, passes)""")
def r11(spark: SparkSession, d: str) -> DataFrame:
    """Ten tests, and the conclusion that their verdicts select."""
    hours = S.hour_panel(spark, d).select("date", "slot", "act", "fc")
    events = S.table(spark, d, "events")
    sun = events.where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("slot")).agg(F.round(F.sum("value"), 6).alias("s"))
    main = settle(hours.join(sun, ["date", "slot"], "left").withColumn("sun", F.coalesce("s", F.lit(0.0))).drop("s"))
    control = main.withColumn("fc", F.round(F.col("act") + 3 * F.sin(F.col("slot").cast("double")), 6))
    fresh = events.groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("slot")).agg(F.round(F.sum("value"), 6).alias("x"))
    reference = events.agg((F.sum("value") / (F.countDistinct(F.to_date("ts")) * 24)).alias("reference"))
    return I.battery(main, control, fresh, reference)
