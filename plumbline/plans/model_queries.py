"""Fitted models and the intervals around them, when rows come in groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.ordered import quantile
from plumbline.functions.settle import settle
from plumbline.operators import clustered as C
from plumbline.operators import folds, rules
from plumbline.operators import panel as P
from plumbline.operators import resample as R
from plumbline.operators import tail as T
from plumbline.plans.registry import query
from plumbline.plans.tail_queries import _dk
from plumbline.sources import tables as S
from plumbline.sources.files import shipped


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


#: Rows a case that the forests are fitted to and judged on, those with the lowest hash of their id, and the cases.
ROWS_A_CASE, CASES = 9, 16
VARIANTS = {
    "meta": ["size", "kind", "cut_index"], "+clip": ["size", "kind", "cut_index", "lot"],
    "+compact": ["size", "kind", "cut_index", "lot", "letters", "colour"], "+all": ["size", "kind", "cut_index", "lot", "letters", "colour", "noise", "hum"],
}


def wear_sample(spark: SparkSession, d: str) -> DataFrame:
    """id, case, y (0 to 1) and features, some of them missing, of a bounded number of parts."""
    p = S.table(spark, d, "part")
    ends = F.broadcast(p.agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("z")))  # one row
    case = F.concat(F.lit("c"), F.pmod(F.crc32(F.col("p_brand").cast("binary")), F.lit(CASES)).cast("string"))
    rows = p.withColumn("case", case).withColumn("k", F.row_number().over(Window.partitionBy("case").orderBy(R.draw("sample", "p_partkey"), "p_partkey"))).where(F.col("k") <= ROWS_A_CASE)
    turn = F.row_number().over(Window.partitionBy("case").orderBy("p_partkey"))
    return settle(rows.crossJoin(ends).select(
        F.col("p_partkey").alias("id"), "case", ((F.col("p_retailprice") - F.col("a")) / F.greatest(F.lit(1e-9), F.col("z") - F.col("a"))).alias("y"),
        F.when(F.col("p_partkey") % 11 > 0, F.col("p_size")).cast("double").alias("size"), F.pmod(F.crc32(F.col("p_type").cast("binary")), F.lit(97)).cast("double").alias("kind"),
        turn.cast("double").alias("cut_index"), (F.col("p_partkey") % 7).cast("double").alias("lot"), F.length("p_name").cast("double").alias("letters"),
        F.pmod(F.crc32(F.substring_index("p_name", " ", 1).cast("binary")), F.lit(89)).cast("double").alias("colour"), R.uniform("noise", "p_partkey").alias("noise"), R.uniform("hum", "p_partkey").alias("hum"),
    ))


@query("m10_m11_m12_grouped_forest")
def m10(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and width of six constructions around forests of 200 trees on four sets of features, over 25 seeds."""
    shipped(spark)
    return C.coverage(settle(C.held_out(wear_sample(spark, d), VARIANTS)), "variant")


@query("m15_m18_clustered_simulation")
def m18(spark: SparkSession, d: str) -> DataFrame:
    """200 repetitions at nine correlations: calibration on groups, on rows, and on groups into which rows of the fit leak."""
    shipped(spark)
    return C.simulation(spark)


@query("m20_three_construction_prototype")
def m20(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by regime of three constructions on two sets of features, one seed, with Wilson bounds."""
    shipped(spark)
    scored = C.held_out(wear_sample(spark, d), {v: VARIANTS[v] for v in ("meta", "+all")}, seeds=1)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("construction"), F.col(c).alias("q")) for c in ("G", "C_row", "C_grp")])).alias("e")
    hit = (F.abs(F.col("y") - F.col("pred")) <= F.col("e.q")).cast("long")
    g = scored.select("variant", P.regime("y").alias("regime"), "y", "pred", each).groupBy("variant", "regime", "e.construction").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("k"))
    lo, hi = T.wilson(F.col("k"), F.col("n"), 1.96)
    return g.select("variant", "regime", "construction", "n", (F.col("k") / F.col("n")).alias("coverage"), lo.alias("lo"), hi.alias("hi"))


@query("m19_self_review_checks")
def m19(spark: SparkSession, d: str) -> DataFrame:
    """check, item and up to three figures: what a sceptic asks of the constructions.

    1 is the Gaussian a strawman (coverage with in-sample and held-out sd, and conformal; all, worn, width); 2 Wilson against
    the cluster bootstrap (coverage, half the width of either interval); 3 do predictions reach high values (shares of truth
    and predictions over a level); 5 how often the bucketed radius is the pooled one (share, share of predictions over the
    limit); 6 share of features a node may use (root mean squared error).  4 is m19_fixed_change_reach."""
    shipped(spark)
    sample = wear_sample(spark, d)
    scored = settle(C.held_out(sample, {"meta": VARIANTS["meta"]}))
    row = lambda check, item, *figures: [F.lit(check).alias("check"), item.alias("item"), *[f.cast("double").alias(n) for f, n in zip((*figures, F.lit(None), F.lit(None)), "abc", strict=False)]]
    first = C.coverage(scored).where(F.col("construction").isin("G", "G_cal", "C_grp")).select(*row(1, F.col("construction"), F.col("coverage"), F.col("worn"), F.col("width")))

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("construction"), F.col(c).alias("q")) for c in ("G", "C_grp", "C_norm")])).alias("e")
    part = F.explode(F.when(F.col("y") >= C.LIMIT, F.array(F.lit("all"), F.lit("worn"))).otherwise(F.array(F.lit("all")))).alias("part")
    hits = scored.select("case", "seed", "y", "pred", each).select("*", part).select("case", "seed", "part", "e.construction", (F.abs(F.col("y") - F.col("pred")) <= F.col("e.q")).cast("double").alias("hit"))
    by_case = settle(hits.groupBy("part", "construction", "case").agg(F.sum("hit").alias("s"), F.count(F.lit(1)).alias("n")))
    seeds = scored.agg(F.countDistinct("seed").alias("seeds"))
    pooled = by_case.groupBy("part", "construction").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).crossJoin(F.broadcast(seeds))  # one row
    n, k = F.round(F.col("n") / F.col("seeds")), F.round(F.col("s") / F.col("seeds"))
    lo, hi = T.wilson(k, n, 1.96)
    drawn = R.redrawn(by_case.select("case").distinct(), "cases", R.DRAWS, "case").join(by_case, "case")
    rates = drawn.groupBy("part", "construction", "b").agg((F.sum("s") / F.sum("n")).alias("rate"))
    ci = R.interval(rates, "rate", "part", "construction").withColumnsRenamed({"lo": "b_lo", "hi": "b_hi"})
    second = pooled.withColumns({"w": (hi - lo) / 2, "c": F.col("s") / F.col("n")}).join(ci, ["part", "construction"])
    second = second.select(*row(2, F.concat_ws(" ", "part", "construction"), F.col("c"), F.col("w"), (F.col("b_hi") - F.col("b_lo")) / 2))

    levels = F.explode(F.array(*[F.lit(v) for v in (0.5, 0.6, 0.7, 0.75, 0.8)])).alias("level")
    reach = scored.select("y", "pred", levels).groupBy("level").agg(F.avg((F.col("y") >= F.col("level")).cast("double")).alias("t"), F.avg((F.col("pred") >= F.col("level")).cast("double")).alias("p"))
    third = reach.select(*row(3, F.col("level").cast("string"), F.col("t"), F.col("p")))
    same = (F.abs(F.col("C_mond") - F.col("C_grp")) <= 1e-8 + 1e-5 * F.abs("C_grp")).cast("double")
    fifth = scored.agg(F.avg(same).alias("same"), F.avg((F.col("pred") >= C.LIMIT).cast("double")).alias("over")).select(*row(5, F.lit("pooled radius"), F.col("same"), F.col("over")))

    names = sorted({c for f in VARIANTS.values() for c in f})
    cells = spark.createDataFrame([(v, f, s) for v in ("meta", "+all") for f in ("1.0", "sqrt", "0.33") for s in range(3)], "variant string, share string, seed int")
    table = sample.select("id", "case", "y", *names).crossJoin(F.broadcast(cells))  # 18 cells

    def errors(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("id", kind="stable")
        variant, share = pdf["variant"].iloc[0], pdf["share"].iloc[0]
        x, y, case = pdf[VARIANTS[variant]].to_numpy(float), pdf["y"].to_numpy(float), pdf["case"].to_numpy()
        total = 0.0
        for held in np.unique(case):
            test = case == held
            model = C.Model(x[~test], y[~test], features=None if share == "sqrt" else float(share))
            total += float(((y[test] - model(x[test])) ** 2).sum())
        return pd.DataFrame({"variant": [variant], "share": [share], "sse": [total], "n": [len(y)]})

    sse = C.spread(table, 18, "variant", "share", "seed").groupBy("variant", "share", "seed").applyInPandas(errors, "variant string, share string, sse double, n long")
    sixth = sse.groupBy("variant", "share").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse")).select(*row(6, F.concat_ws(" ", "variant", "share"), F.col("rmse")))
    return first.unionByName(second).unionByName(third).unionByName(fifth).unionByName(sixth)


# ---- three half-widths around a ridge line

_FIT = lambda n, sx, sy, sxx, sxy, syy: {
    "xx": f"({sxx} - {sx} * {sx} / ({n}))", "xy": f"({sxy} - {sx} * {sy} / ({n}))", "yy": f"({syy} - {sy} * {sy} / ({n}))"
}


def _line(cells: list[str]) -> tuple[str, str, str]:
    """slope, base and in-sample sd in SQL, of sums given as expressions."""
    n, sx, sy = cells[0], cells[1], cells[2]
    f = _FIT(*[f"({c})" for c in cells])
    slope = f"(CASE WHEN {f['xx']} > 1e-9 THEN {f['xy']} / {f['xx']} * (({n}) - 1) / (({n}) - 1 + 1.0) ELSE 0.0 END)"
    sd = f"sqrt(greatest(0.0, {f['yy']} - 2 * {slope} * {f['xy']} + {slope} * {slope} * {f['xx']}) / (({n}) - 1))"
    return slope, f"(({sy}) / ({n}) - {slope} * ({sx}) / ({n}))", sd


_SUMS = "count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy"
_ALL = ", ".join(f"(SELECT sum({c}) FROM own) - o.{c} AS {c}" for c in folds.SUMS)
_HELD, _IN = _line([f"o.{c}" for c in folds.SUMS]), _line([f"o.{c} - i.{c}" for c in folds.SUMS])
_ROW = _line([f"o.{c} - (p.{c} - coalesce(c.{c}, 0))" for c in folds.SUMS])
_Z = repr(T.NormalDist().inv_cdf(0.95))
_MISS = "CAST(round(abs(y - base - slope * x) * 1e6) AS BIGINT)"
HALF = f"""pts AS MATERIALIZED (SELECT p_partkey AS id, p_brand AS g, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
own AS MATERIALIZED (SELECT g, {_SUMS} FROM pts GROUP BY g), held AS MATERIALIZED (SELECT o.g AS held, {_ALL} FROM own o),
fits AS (SELECT held, {_HELD[0]} AS slope, {_HELD[1]} AS base, {_Z} * {_HELD[2]} AS hw_insample, least(n, CAST(ceil(round((n + 1) * 0.9, 9)) AS BIGINT)) AS k FROM held o),
pairs AS MATERIALIZED (SELECT held, i.g, {_IN[0]} AS slope, {_IN[1]} AS base FROM held o JOIN own i ON i.g <> o.held),
grouped AS (SELECT held, v / 1e6 AS hw_group FROM (SELECT held, {_MISS} AS v, row_number() OVER (PARTITION BY held ORDER BY {_MISS}) AS r FROM pts JOIN pairs USING (g)) JOIN fits USING (held) WHERE r = k),
dealt AS MATERIALIZED (SELECT *, {_dk("'split'", 'rep', 'id')} % 5 AS part FROM pts, (SELECT unnest(range(0, 25)) AS rep)),
cells AS MATERIALIZED (SELECT rep, part, g, {_SUMS} FROM dealt GROUP BY rep, part, g),
parts AS (SELECT rep, part, {", ".join(f"sum({c}) AS {c}" for c in folds.SUMS)} FROM cells GROUP BY rep, part),
split AS MATERIALIZED (SELECT held, p.rep, p.part, {_ROW[0]} AS slope, {_ROW[1]} AS base FROM held o CROSS JOIN parts p LEFT JOIN cells c ON c.g = o.held AND c.rep = p.rep AND c.part = p.part),
by_rep AS (SELECT held, rep, v FROM (SELECT held, rep, {_MISS} AS v, row_number() OVER (PARTITION BY held, rep ORDER BY {_MISS}) AS r FROM dealt JOIN split USING (rep, part) WHERE held <> g) JOIN fits USING (held) WHERE r = k),
by_row AS (SELECT held, avg(v) / 1e6 AS hw_row FROM by_rep GROUP BY held),
widths AS MATERIALIZED (SELECT held AS g, slope, base, hw_insample, hw_group, hw_row FROM fits JOIN grouped USING (held) JOIN by_row USING (held))"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


@query("m14_three_half_widths", f"WITH {HALF} SELECT g, round(hw_insample, 4) AS hw_insample, round(hw_group, 6) AS hw_group, round(hw_row, 8) AS hw_row FROM widths")
def m14(spark: SparkSession, d: str) -> DataFrame:
    """For each held-out group: from in-sample residuals, from groups held out in turn, and from random rows."""
    w = folds.half_widths(_points(spark, d), R.draw("split", "rep", "id"))
    return w.select("g", _r("hw_insample", 4), _r("hw_group"), _r("hw_row", 8))


_Z2 = repr(T.Z95)
_BOUND = lambda k, n, s: f"(({k} / {n} + {_Z2} * {_Z2} / (2 * {n})) {s} {_Z2} * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + {_Z2} * {_Z2} / (4 * {n} * {n}))) / (1 + {_Z2} * {_Z2} / {n})"


@query("r3_range_severity", f"""WITH {HALF}, top AS (SELECT quantile_cont(y, 0.8) AS t FROM pts),
hits AS (SELECT c.construction, y >= (SELECT t FROM top) AS long_, CAST(abs(y - base - slope * x) <= CASE c.construction WHEN 'insample' THEN hw_insample WHEN 'group' THEN hw_group ELSE hw_row END + 1e-9 AS INTEGER) AS hit
  FROM pts JOIN widths USING (g), (SELECT unnest(['insample', 'group', 'row']) AS construction) c),
s AS (SELECT construction, count(*) AS n, sum(hit) AS k, count(*) FILTER (long_) AS m, sum(hit) FILTER (long_) AS j FROM hits GROUP BY construction),
b AS (SELECT *, greatest(0, {_BOUND('k', 'n', '-')}) AS lo, least(1, {_BOUND('k', 'n', '+')}) AS hi, least(1, {_BOUND('j', 'm', '+')}) AS long_hi FROM s)
SELECT construction, n, round(k / n, 9) AS coverage, round(lo, 9) AS lo, round(hi, 9) AS hi, round(long_hi, 9) AS long_hi, CASE WHEN 0.9 BETWEEN lo AND hi THEN 'Observation' WHEN long_hi < 0.9 THEN 'Material' ELSE 'Significant' END AS severity FROM b""")
def r3(spark: SparkSession, d: str) -> DataFrame:
    """Delivered coverage of the three half-widths on held-out groups, and on the fifth with the highest values."""
    pts = _points(spark, d)
    top = F.broadcast(quantile(pts, "y", {"t": 0.8}))  # one row
    w = settle(folds.half_widths(pts, R.draw("split", "rep", "id")))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("construction"), F.col(f"hw_{c}").alias("q")) for c in ("insample", "group", "row")])).alias("e")
    rows = pts.join(w, "g").crossJoin(top).select("y", "t", (F.abs(F.col("y") - F.col("base") - F.col("slope") * F.col("x"))).alias("a"), each)
    hit, far = (F.col("a") <= F.col("e.q") + 1e-9).cast("long"), F.col("y") >= F.col("t")
    s = rows.groupBy("e.construction").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("k"), F.count(F.when(far, 1)).alias("m"), F.sum(F.when(far, hit)).alias("j"))
    lo, hi = T.wilson(F.col("k"), F.col("n"))
    _, long_hi = T.wilson(F.col("j"), F.col("m"))
    b = s.withColumns({"lo": lo, "hi": hi, "long_hi": long_hi})
    severity = rules.stated_range(F.lit(0.9), F.col("lo"), F.col("hi"), F.col("long_hi"))
    return b.select("construction", "n", F.round(F.col("k") / F.col("n"), 9).alias("coverage"), _r("lo", 9), _r("hi", 9), _r("long_hi", 9), severity.alias("severity"))
