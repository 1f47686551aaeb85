"""Sources, projections, reshaping and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import panel as P
from plumbline.operators import probs
from plumbline.plans.registry import query
from plumbline.sources import tables as S


@query("s1_series_dedup_first", """
SELECT ts, value, event_id FROM (
  SELECT date_trunc('hour', ts) AS ts, value, event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM events
) WHERE k = 1""")
def s1(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("hour"), "ts", "value", "event_id")
    return P.dedup_first(e, ["hour"], ["ts", "event_id"]).select(F.col("hour").alias("ts"), "value", "event_id")


@query("s2_s3_typed_scan", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders WHERE o_totalprice > 300000")
def s2(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "orders").where("o_totalprice > 300000").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")


@query("s5_localized_numbers", "SELECT c_custkey, round(c_acctbal, 2) AS amount, strftime(TIMESTAMP '2024-03-01 00:00:00' + INTERVAL 15 MINUTE * (c_custkey % 96), '%d.%m.%Y %H:%M') AS said, TIMESTAMP '2024-03-01 00:00:00' + INTERVAL 15 MINUTE * (c_custkey % 96) AS ts FROM customer")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """Amounts written with dotted thousands and a decimal comma, times as dd.MM.yyyy HH:mm; read back."""
    from plumbline.sources.files import localized_number

    c = S.table(spark, d, "customer")
    quarter = F.make_timestamp(F.lit(2024), F.lit(3), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(mins=(F.col("c_custkey") % 96 * 15).cast("int"))
    said = c.select("c_custkey", F.translate(F.format_number(F.round("c_acctbal", 2), 2), ",.", ".,").alias("amount"), F.date_format(quarter, "dd.MM.yyyy HH:mm").alias("said"))
    return said.select("c_custkey", localized_number("amount").alias("amount"), "said", F.to_timestamp("said", "dd.MM.yyyy HH:mm").cast("timestamp_ntz").alias("ts"))


@query("s8_last_record_per_key", """
SELECT user_id, event_id, k FROM (
  SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r
  FROM events WHERE event_type <> 'error') WHERE r = 1""")
def s8(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").where("event_type <> 'error'").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return P.dedup_first(e, ["user_id"], [F.desc("event_id")])


@query("s9_j13_items_with_answers", "SELECT l.doc_id, quality, toxic, lang, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "labels").join(S.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", "quality", "toxic", "lang", "n_chars")


@query("s13_j2_inner_alignment", f"WITH {S.PRICES} SELECT date, a.price AS a, n.price AS n, r.price AS r FROM (SELECT * FROM prices WHERE asset = 'A') a JOIN (SELECT * FROM prices WHERE asset = 'N') n USING (date) JOIN (SELECT * FROM prices WHERE asset = 'R') r USING (date)")
def s13(spark: SparkSession, d: str) -> DataFrame:
    p = S.asset_prices(spark, d)
    one = lambda x: p.where(F.col("asset") == x.upper()).select("date", F.col("price").alias(x))
    return one("a").join(one("n"), "date").join(one("r"), "date")


@query("s14_filtered_first_records", """
SELECT user_id, event_id, value FROM (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
  WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND value >= 20 AND NOT regexp_matches(event_type, '^(err|sign)')
) WHERE k = 1""")
def s14(spark: SparkSession, d: str) -> DataFrame:
    """A date window, a floor, a pattern of what is left out, and one record a source."""
    e = S.table(spark, d, "events").where("ts BETWEEN timestamp_ntz'2024-01-05' AND timestamp_ntz'2024-01-25' AND value >= 20").where(~F.col("event_type").rlike("^(err|sign)"))
    return P.dedup_first(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("s19_w19_weekly_payload", f"""WITH {S.SHIP}, k AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY date) AS r FROM panel WHERE act IS NOT NULL)
SELECT slot, count(*) AS points, round(sum(act), 3) AS total, min(date) AS first FROM k WHERE (r - 1) % 5 = 0 GROUP BY slot""")
def s19(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("slot").orderBy("date")
    kept = S.ship_panel(spark, d).where("act IS NOT NULL").withColumn("r", F.row_number().over(w)).where("(r - 1) % 5 = 0")
    return kept.groupBy("slot").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("act"), 3).alias("total"), F.min("date").alias("first"))


@query("p1_p2_regular_grid", """
WITH hours AS (SELECT date_trunc('hour', ts) AS ts, round(sum(value), 6) AS v FROM events GROUP BY 1),
axis AS (SELECT unnest(generate_series((SELECT min(ts) FROM hours), (SELECT max(ts) FROM hours), INTERVAL 15 MINUTE)) AS ts)
SELECT axis.ts, v FROM axis LEFT JOIN hours USING (ts)""")
def p1(spark: SparkSession, d: str) -> DataFrame:
    hours = S.table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum("value"), 6).alias("v"))
    return P.reindex(hours, P.grid(hours, "ts", "15 minutes"), "ts")


@query("p3_bounded_fill", f"""WITH {S.SHIP}
SELECT date, slot, last_value(act IGNORE NULLS) OVER (PARTITION BY slot ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS filled, act IS NOT NULL AS own FROM panel""")
def p3(spark: SparkSession, d: str) -> DataFrame:
    filled, own = P.bounded_fill("act", 3, by=["slot"], order="date")
    return S.ship_panel(spark, d).select("date", "slot", filled.alias("filled"), own.alias("own"))


@query("p4_row_sum", f"""WITH {S.SHIP}
SELECT date, slot, CASE WHEN act IS NOT NULL OR fc IS NOT NULL THEN coalesce(act, 0) + coalesce(fc, 0) END AS total FROM panel""")
def p4(spark: SparkSession, d: str) -> DataFrame:
    p = S.ship_panel(spark, d)
    return p.select("date", "slot", P.row_sum(P.pick(p, "ACT"), P.pick(p, "fc")).alias("total"))


@query("p5_local_calendar", """
SELECT event_id, CAST(l AS DATE) AS date, CAST(hour(l) * 4 + minute(l) // 15 AS INTEGER) AS slot, strftime(l, '%Y-%m') AS month
FROM (SELECT event_id, ts + INTERVAL 1 HOUR AS l FROM events)""")
def p5(spark: SparkSession, d: str) -> DataFrame:
    """January lies in winter time, an hour ahead of UTC in this zone."""
    e = S.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", *P.local_calendar("ts", "Europe/Berlin"))


@query("p6_p7_error_rows", f"WITH {S.SHIP} SELECT date, slot, act - fc AS err FROM panel WHERE act IS NOT NULL AND fc IS NOT NULL")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return S.ship_panel(spark, d).dropna(subset=["act", "fc"]).select("date", "slot", "err")


@query("p8_pivot_long_to_wide", f"WITH {S.SHIP} SELECT date, avg(act) FILTER (slot = 'AF') AS AF, avg(act) FILTER (slot = 'NO') AS \"NO\", avg(act) FILTER (slot = 'RF') AS RF FROM panel GROUP BY date")
def p8(spark: SparkSession, d: str) -> DataFrame:
    return P.to_wide(S.ship_panel(spark, d), "date", "slot", "act", ["AF", "NO", "RF"])


@query("p9_unpivot", "SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_discount, l_tax))")
def p9(spark: SparkSession, d: str) -> DataFrame:
    lines = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return P.to_long(lines, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "name", "value")


@query("p10_season", "SELECT CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'DJF' WHEN month(l_shipdate) IN (3, 4, 5) THEN 'MAM' WHEN month(l_shipdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, count(*) AS n FROM lineitem GROUP BY 1")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "lineitem").groupBy(P.season("l_shipdate").alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_regime", f"WITH {S.WEAR} SELECT CASE WHEN vb < 0.3 THEN 'fresh' WHEN vb < 0.6 THEN 'mid' ELSE 'worn' END AS regime, count(*) AS n FROM wear GROUP BY 1")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return S.wear_tracks(spark, d).groupBy(P.regime("vb").alias("regime")).agg(F.count(F.lit(1)).alias("n"))


_TAG = "CASE WHEN date BETWEEN DATE '2000-03-01' AND DATE '2000-05-31' THEN 'late shock' WHEN date BETWEEN DATE '1998-07-01' AND DATE '1998-12-31' THEN 'long slide' WHEN date BETWEEN DATE '1996-02-01' AND DATE '1996-04-30' THEN 'first squeeze' ELSE '' END"


@query("p12_j3_j8_stress_tag", f"WITH {S.SHIP} SELECT {_TAG} AS tag, count(*) AS rows, count(DISTINCT date) AS days, round(avg(err), 6) AS mean_err FROM panel GROUP BY 1")
def p12(spark: SparkSession, d: str) -> DataFrame:
    p = S.ship_panel(spark, d).withColumn("tag", P.stress_tag("date"))
    return p.groupBy("tag").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("days"), F.round(F.avg("err"), 6).alias("mean_err"))


@query("j8_range_join", f"""WITH {S.SHIP}, w(name, a, b) AS (VALUES ('first squeeze', DATE '1996-02-01', DATE '1996-04-30'), ('long slide', DATE '1998-07-01', DATE '1998-12-31'), ('late shock', DATE '2000-03-01', DATE '2000-05-31'))
SELECT name, count(*) AS rows, round(sum(act), 3) AS act FROM panel JOIN w ON date BETWEEN a AND b GROUP BY name""")
def j8(spark: SparkSession, d: str) -> DataFrame:
    windows = spark.createDataFrame(P.STRESS_WINDOWS, "name string, a date, b date")  # a handful of rows by definition
    p = S.ship_panel(spark, d).join(F.broadcast(windows), F.col("date").between(F.col("a"), F.col("b")))
    return p.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("act"), 3).alias("act"))


_RETURNS = f"{S.PRICES}, returns AS (SELECT date, asset, ln(price / before) AS r FROM (SELECT *, lag(price) OVER (PARTITION BY asset ORDER BY date) AS before FROM prices) WHERE before IS NOT NULL)"


@query("p13_log_returns", f"WITH {_RETURNS} SELECT date, asset, round(r, 9) AS r FROM returns")
def p13(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.tail import log_returns

    return log_returns(S.asset_prices(spark, d)).select("date", "asset", F.round("r", 9).alias("r"))


@query("p14_weighted_portfolio", f"WITH {_RETURNS} SELECT date, round(sum(r * CASE asset WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.3 ELSE 0.2 END), 9) AS pnl FROM returns GROUP BY date")
def p14(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.tail import log_returns, portfolio

    return portfolio(log_returns(S.asset_prices(spark, d)), {"A": 0.5, "N": 0.3, "R": 0.2}).select("date", F.round("pnl", 9).alias("pnl"))


@query("p15_p16_p17_vector_stats", f"""WITH {S.CHOICE}, n AS (SELECT vec_id, y, list_transform(p, lambda x: x / list_sum(p)) AS p FROM choice WHERE list_sum(p) > 0)
SELECT vec_id, round(list_max(p), 9) AS conf, round(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 9) AS margin,
  round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)), 9) AS entropy, round(p[y + 1], 9) AS p_true, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS top FROM n""")
def p15(spark: SparkSession, d: str) -> DataFrame:
    c = probs.renormalise(S.choice_probs(spark, d))
    return probs.vector_stats(c).select("vec_id", *[F.round(x, 9).alias(x) for x in ("conf", "margin", "entropy", "p_true")], "top")


@query("p18_ordinal_and_size", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders")
def p18(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return S.table(spark, d, "orders").select("o_orderkey", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("ordinal"), F.count(F.lit(1)).over(w).alias("size"))


@query("p19_clip", f"WITH {S.SHIP} SELECT date, slot, CASE WHEN err IS NOT NULL THEN greatest(-50, least(50, err)) END AS err FROM panel")
def p19(spark: SparkSession, d: str) -> DataFrame:
    return S.ship_panel(spark, d).select("date", "slot", P.clip(F.col("err"), -50.0, 50.0).alias("err"))


@query("p20_plausibility_mask", """
SELECT user_id, count(*) AS samples, count(*) FILTER (abs(value) > 150) AS masked, count(*) FILTER (abs(value) > 150) > 0.01 * count(*) AS flagged, round(avg(value) FILTER (abs(value) <= 150), 6) AS mean
FROM events GROUP BY user_id""")
def p20(spark: SparkSession, d: str) -> DataFrame:
    bad = F.isnan("value") | (F.abs("value") > 150)
    g = S.table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("samples"), F.count(F.when(bad, 1)).alias("masked"), F.round(F.avg(F.when(~bad, F.col("value"))), 6).alias("mean"))
    return g.withColumn("flagged", F.col("masked") > 0.01 * F.col("samples"))


@query("p21_worst_hours", f"WITH {S.HOURS} SELECT slot, round(avg(err), 6) AS bias FROM hpanel WHERE err IS NOT NULL GROUP BY slot ORDER BY abs(avg(err)) DESC, slot LIMIT 4")
def p21(spark: SparkSession, d: str) -> DataFrame:
    b = S.hour_panel(spark, d).where("err IS NOT NULL").groupBy("slot").agg(F.avg("err").alias("b"))
    return b.orderBy(F.desc(F.abs("b")), "slot").limit(4).select("slot", F.round("b", 6).alias("bias"))


@query("p22_trimmed_window", f"WITH {S.SHIP} SELECT slot, count(err) AS n, round(avg(err), 6) AS bias FROM panel WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' GROUP BY slot")
def p22(spark: SparkSession, d: str) -> DataFrame:
    return P.trimmed(S.ship_panel(spark, d), "date", "1997-01-01", "1999-12-31").groupBy("slot").agg(F.count("err").alias("n"), F.round(F.avg("err"), 6).alias("bias"))


@query("p23_rounding", "SELECT l_orderkey, l_linenumber, round_even(CAST(l_extendedprice AS DECIMAL(18, 4)), 1)::DOUBLE AS even, round(l_extendedprice, 0) AS half_up FROM lineitem")
def p23(spark: SparkSession, d: str) -> DataFrame:
    lines = S.table(spark, d, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", F.bround(F.col("l_extendedprice").cast("decimal(18,4)"), 1).cast("double").alias("even"), F.round("l_extendedprice", 0).alias("half_up"))


@query("p24_p25_p26_labels", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS label,
  regexp_replace(lower(p_name), '[[:punct:]]+$', '') AS surface, trim(replace(replace(p_type, '_', ' '), '?', '')) AS described FROM part""")
def p24(spark: SparkSession, d: str) -> DataFrame:
    back = F.create_map(F.lit(0), F.lit("small"), F.lit(1), F.lit("medium"), F.lit(2), F.lit("large"))
    return S.table(spark, d, "part").select(
        "p_partkey", F.element_at(back, (F.col("p_size") % 3).cast("int")).alias("label"),
        F.regexp_replace(F.lower("p_name"), r"\p{Punct}+$", "").alias("surface"), F.trim(F.replace(F.replace("p_type", F.lit("_"), F.lit(" ")), F.lit("?"), F.lit(""))).alias("described"))


_DRAW = "('0x' || substr(md5('{0}|' || {1}), 1, 8))::BIGINT"


@query("p27_stratified_sample", f"""
SELECT o_orderkey, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_DRAW.format('sample', 'o_orderkey')}, o_orderkey) AS k FROM orders WHERE o_totalprice > 1000) WHERE k <= 20""")
def p27(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.resample import draw

    w = Window.partitionBy("o_orderpriority").orderBy(draw("sample", "o_orderkey"), "o_orderkey")
    return S.table(spark, d, "orders").where("o_totalprice > 1000").withColumn("k", F.row_number().over(w)).where("k <= 20").select("o_orderkey", "o_orderpriority")


@query("p28_synthetic_factorial", f"""
SELECT b.block, p.p, f.form, ({_DRAW.format('probe', "b.block || '|' || p.p || '|' || f.form")} % 1000) / 1000.0 < p.p / 10.0 AS truth
FROM (SELECT unnest(range(0, 6)) AS block) b CROSS JOIN (SELECT unnest(range(1, 10)) AS p) p CROSS JOIN (SELECT unnest(['plain', 'odds', 'words']) AS form) f""")
def p28(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.resample import draw

    cells = spark.range(6).withColumnRenamed("id", "block").crossJoin(spark.range(1, 10).withColumnRenamed("id", "p"))
    cells = cells.crossJoin(spark.createDataFrame([("plain",), ("odds",), ("words",)], "form string"))
    return cells.withColumn("truth", (draw("probe", "block", "p", "form") % 1000) / 1000.0 < F.col("p") / 10.0)


@query("p29_prior_cohort_exclusion", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')")
def p29(spark: SparkSession, d: str) -> DataFrame:
    seen = S.table(spark, d, "orders").where("o_orderdate < timestamp'1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return S.table(spark, d, "customer").select("c_custkey").join(seen, "c_custkey", "left_anti")


@query("j1_j6_left_lookup", f"WITH {S.SHIP} SELECT p.date, p.slot, p.act, b.da FROM panel p LEFT JOIN (SELECT date, slot, da FROM daily WHERE slot = 'NO') b ON p.date = b.date AND p.slot = b.slot")
def j1(spark: SparkSession, d: str) -> DataFrame:
    p = S.ship_panel(spark, d)
    look = p.where("slot = 'NO' AND da IS NOT NULL").select("date", "slot", "da")
    return p.select("date", "slot", "act").join(look, ["date", "slot"], "left")


@query("j4_inner_merge", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j4(spark: SparkSession, d: str) -> DataFrame:
    n, r, s = (S.table(spark, d, t) for t in ("nation", "region", "supplier"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@query("j9_semi_anti", """
SELECT (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS returned,
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS kept""")
def j9(spark: SparkSession, d: str) -> DataFrame:
    back = S.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    o = S.table(spark, d, "orders").select("o_orderkey")
    both = o.join(back, "o_orderkey", "left_semi").select(F.lit(True).alias("back")).unionAll(o.join(back, "o_orderkey", "left_anti").select(F.lit(False).alias("back")))
    return both.agg(F.count_if("back").alias("returned"), F.count_if(~F.col("back")).alias("kept"))


@query("j10_index_set_ops", """
WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT 'both' AS side, count(*) AS days FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'orders', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'lines', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    a = S.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    b = S.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    n = lambda side, df: df.agg(F.count(F.lit(1)).alias("days")).select(F.lit(side).alias("side"), "days")
    return n("both", a.intersect(b)).unionAll(n("orders", a.exceptAll(b))).unionAll(n("lines", b.exceptAll(a)))


@query("j11_j12_union_replace", "SELECT method, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE 'other' END AS method FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'new' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'scaled' FROM orders) GROUP BY method")
def j11(spark: SparkSession, d: str) -> DataFrame:
    o = S.table(spark, d, "orders").select("o_orderstatus")
    old = o.withColumn("method", F.when(F.col("o_orderstatus") == "F", "old").otherwise("other"))
    both = old.where("method <> 'old'").unionByName(o.where("o_orderstatus = 'F'").withColumn("method", F.lit("new"))).unionByName(o.withColumn("method", F.lit("scaled")))
    return both.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
