"""Probability calibration."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.ordered import quantile
from plumbline.functions.settle import settle
from plumbline.operators import probs as C
from plumbline.operators import resample as R
from plumbline.plans.registry import query
from plumbline.plans.tail_queries import _dk
from plumbline.sources import tables as S
from plumbline.sources.files import shipped

TOP = f"{S.CHOICE}, top AS (SELECT vec_id, p, y, list_max(p) AS conf, list_position(p, list_max(p)) - 1 = y AS correct FROM choice)"
_BINNED = "SELECT *, CAST(floor(((row_number() OVER (ORDER BY {v}, {k}) - 1 + 1) * {b} - 1) / count(*) OVER ()) AS INTEGER) AS bin FROM {t}"


def top(spark: SparkSession, d: str) -> DataFrame:
    return C.vector_stats(S.choice_probs(spark, d)).withColumn("correct", F.col("top") == F.col("y"))


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query("t19_reliability_table", f"WITH {TOP} SELECT bin, count(*) AS n, round(avg(conf), 6) AS conf, round(avg(CAST(correct AS INTEGER)), 6) AS acc, round(min(conf), 6) AS lo, round(max(conf), 6) AS hi FROM ({_BINNED.format(v='conf', k='vec_id', b=10, t='top')}) GROUP BY bin")
def t19(spark: SparkSession, d: str) -> DataFrame:
    return C.reliability(top(spark, d), "conf", "correct", "vec_id").select("bin", "n", _r("conf"), _r("acc"), _r("lo"), _r("hi"))


@query("t18_top_label_ece", f"WITH {TOP}, g AS (SELECT count(*) AS n, avg(conf) AS c, avg(CAST(correct AS INTEGER)) AS a FROM ({_BINNED.format(v='conf', k='vec_id', b=10, t='top')}) GROUP BY bin) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM g")
def t18(spark: SparkSession, d: str) -> DataFrame:
    return C.ece(C.reliability(top(spark, d), "conf", "correct", "vec_id")).select(_r("ece"))


@query("t20_brier_and_log_score", f"WITH {S.BINARY} SELECT round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-(y * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, p))))), 6) AS log_score FROM binary_p")
def t20(spark: SparkSession, d: str) -> DataFrame:
    return S.binary_probs(spark, d).agg(F.round(C.brier(), 6).alias("brier"), F.round(C.log_score(), 6).alias("log_score"))


@query("t21_ranked_probability_score", f"""WITH {S.CHOICE}, o AS (SELECT vec_id, list_transform(p[1:5], lambda x: x / list_sum(p[1:5])) AS q, y % 5 AS y FROM choice),
e AS (SELECT vec_id, y, i, list_sum(q[1:i + 1]) AS cum FROM o, (SELECT unnest(range(0, 5)) AS i)), s AS (SELECT vec_id, sum(pow(cum - CASE WHEN i >= y THEN 1 ELSE 0 END, 2)) / 4 AS rps FROM e GROUP BY vec_id)
SELECT round(avg(rps), 6) AS rps, round(max(rps), 6) AS worst FROM s""")
def t21(spark: SparkSession, d: str) -> DataFrame:
    o = S.choice_probs(spark, d).withColumns({"p": F.slice("p", 1, 5), "y": F.col("y") % 5})
    s = C.renormalise(o).select(C.rps("p", "y", 5).alias("rps"))
    return s.agg(F.round(F.avg("rps"), 6).alias("rps"), F.round(F.max("rps"), 6).alias("worst"))


@query("t22_w17_auroc", f"WITH {S.BINARY}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM binary_p) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auroc FROM r")
def t22(spark: SparkSession, d: str) -> DataFrame:
    return C.auroc(S.binary_probs(spark, d)).select(_r("auroc"))


@query("t23_accuracy_and_classwise", f"""WITH {TOP}, w AS (SELECT i, p[i + 1] AS q, CAST(y = i AS INTEGER) AS hit, vec_id FROM top, (SELECT unnest(range(0, 10)) AS i)),
b AS (SELECT i, least(9, CAST(floor(q * 10) AS INTEGER)) AS bin, avg(q) AS c, avg(hit) AS a, count(*) AS n FROM w GROUP BY 1, 2), e AS (SELECT i, sum(n * abs(c - a)) / sum(n) AS e FROM b GROUP BY i)
SELECT round(avg(CAST(correct AS INTEGER)), 6) AS accuracy, round(avg(CAST(abs(list_position(p, conf) - 1 - y) <= 1 AS INTEGER)), 6) AS within_one, round(avg(CAST(conf >= 0.995 AS INTEGER)), 6) AS sure, (SELECT round(avg(e), 6) FROM e) AS classwise FROM top""")
def t23(spark: SparkSession, d: str) -> DataFrame:
    t = top(spark, d)
    w = t.select("y", F.posexplode("p").alias("i", "q")).withColumns({"hit": (F.col("y") == F.col("i")).cast("int"), "bin": F.least(F.lit(9), F.floor(F.col("q") * 10).cast("int"))})
    b = w.groupBy("i", "bin").agg(F.avg("q").alias("c"), F.avg("hit").alias("a"), F.count(F.lit(1)).alias("n"))
    classwise = b.groupBy("i").agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("e")).agg(F.round(F.avg("e"), 6).alias("classwise"))
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    return t.agg(share(F.col("correct"), "accuracy"), share(F.abs(F.col("top") - F.col("y")) <= 1, "within_one"), share(F.col("conf") >= 0.995, "sure")).crossJoin(F.broadcast(classwise))  # one row each


@query("t24_total_variation", f"WITH {S.CHOICE} SELECT y, round(avg(list_sum(list_transform(range(0, 10), lambda i: abs(p[i + 1] - CASE WHEN i = y THEN 1 ELSE 0 END))) / 2), 6) AS tv, count(*) AS n FROM choice GROUP BY y")
def t24(spark: SparkSession, d: str) -> DataFrame:
    gap = F.aggregate(F.transform("p", lambda x, i: F.abs(x - F.when(i == F.col("y"), 1.0).otherwise(0.0))), F.lit(0.0), lambda a, x: a + x) / 2
    return S.choice_probs(spark, d).groupBy("y").agg(F.round(F.avg(gap), 6).alias("tv"), F.count(F.lit(1)).alias("n"))


@query("t25_invariance_table", f"""WITH {TOP}, base AS (SELECT vec_id, conf, correct FROM top WHERE vec_id % 2 = 0), other AS (SELECT vec_id - 1 AS vec_id, conf, correct, y FROM top WHERE vec_id % 2 = 1)
SELECT y, count(*) AS n, round(avg(abs(b.conf - o.conf)), 6) AS moved, round(avg(CAST(b.correct <> o.correct AS INTEGER)), 6) AS flips FROM base b JOIN other o USING (vec_id) GROUP BY y""")
def t25(spark: SparkSession, d: str) -> DataFrame:
    """Each odd vector stands for a perturbed form of the even one before it."""
    t = top(spark, d)
    base = t.where("vec_id % 2 = 0").select("vec_id", F.col("conf").alias("bc"), F.col("correct").alias("bk"))
    other = t.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), "conf", "correct", "y")
    return base.join(other, "vec_id").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("bc") - F.col("conf"))), 6).alias("moved"), F.round(F.avg((F.col("bk") != F.col("correct")).cast("int")), 6).alias("flips"))


@query("t26_confidence_formula", f"WITH {TOP}, c AS (SELECT conf, (10 * conf - 1) / 9 + 0.01 * (vec_id % 3) AS stated FROM top) SELECT round(regr_r2(stated, conf), 6) AS r2, round(max(abs(stated - (10 * conf - 1) / 9)), 6) AS gap FROM c")
def t26(spark: SparkSession, d: str) -> DataFrame:
    formula = (10 * F.col("conf") - 1) / 9
    c = top(spark, d).select("conf", (formula + 0.01 * (F.col("vec_id") % 3)).alias("stated"))
    return c.agg(F.round(F.regr_r2("stated", "conf"), 6).alias("r2"), F.round(F.max(F.abs(F.col("stated") - formula)), 6).alias("gap"))


@query("t27_market_comparison", f"WITH {S.BINARY}, m AS (SELECT p, CASE WHEN doc_id % 4 > 0 THEN (p + y) / 2 END AS market FROM binary_p) SELECT round(corr(p, market), 6) AS corr, round(avg(abs(p - market)), 6) AS gap, count(market) AS n FROM m")
def t27(spark: SparkSession, d: str) -> DataFrame:
    m = S.binary_probs(spark, d).select("p", F.when(F.col("doc_id") % 4 > 0, (F.col("p") + F.col("y")) / 2).alias("market"))
    return m.where("market IS NOT NULL").agg(F.round(F.corr("p", "market"), 6).alias("corr"), F.round(F.avg(F.abs(F.col("p") - F.col("market"))), 6).alias("gap"), F.count("market").alias("n"))


@query("w18_m6_mass_sets", f"""WITH {S.CHOICE}, e AS (SELECT vec_id, y, i, p[i + 1] AS q FROM choice, (SELECT unnest(range(0, 10)) AS i)),
c AS (SELECT *, sum(q) OVER (PARTITION BY vec_id ORDER BY q DESC, i ROWS UNBOUNDED PRECEDING) - q AS below FROM e), s AS (SELECT vec_id, count(*) FILTER (below < 0.9 - 1e-9) AS size, bool_or(i = y AND below < 0.9 - 1e-9) AS hit FROM c GROUP BY vec_id)
SELECT size, count(*) AS n, round(avg(CAST(hit AS INTEGER)), 6) AS coverage FROM s GROUP BY size""")
def w18(spark: SparkSession, d: str) -> DataFrame:
    held = F.filter(C.cumulative("p"), lambda x: x["cum"] - x["p"] < 0.9 - 1e-9)
    s = S.choice_probs(spark, d).select(C.mass_set("p", 0.9).cast("long").alias("size"), F.exists(held, lambda x: x["c"] == F.col("y")).alias("hit"))
    return s.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("coverage"))


_GRID = [round(0.25 * k, 2) for k in range(1, 17)]


@query("m1_m2_temperature_grid", f"""WITH {S.CHOICE}, g AS (SELECT unnest({_GRID!r}) AS temperature), e AS (SELECT vec_id, y, temperature, list_transform(p, lambda x: pow(greatest(x, 1e-6), 1 / temperature)) AS r FROM choice, g)
SELECT CAST(temperature AS DOUBLE) AS temperature, round(avg(-ln(greatest(r[y + 1] / list_sum(r), 1e-6))), 6) AS nll FROM e GROUP BY 1""")
def m1(spark: SparkSession, d: str) -> DataFrame:
    return C.temperature_grid(S.choice_probs(spark, d), _GRID).select("temperature", _r("nll"))


@query("m1_temperature_fit")
def m1_fit(spark: SparkSession, d: str) -> DataFrame:
    """The fitted temperature and the loss before and after."""
    c = S.choice_probs(spark, d)
    t = C.fit_temperature(c)
    return C.temperature_grid(c, [1.0, t])


@query("m3_platt_scaling")
def m3(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression on the logit, nearly without a penalty."""
    from plumbline.operators.models import platt

    return platt(S.binary_probs(spark, d))


@query("m4_isotonic")
def m4(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.models import isotonic

    return isotonic(S.binary_probs(spark, d))


_APS = f"""{S.CHOICE}, e AS (SELECT vec_id, y, i, p[i + 1] AS q, ({_dk("'aps'", 'vec_id')} + 0.5) / 4294967296.0 AS u FROM choice, (SELECT unnest(range(0, 10)) AS i)),
c AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, i) AS k, sum(q) OVER (PARTITION BY vec_id ORDER BY q DESC, i ROWS UNBOUNDED PRECEDING) - u * q AS s FROM e),
cal AS (SELECT round(s, 9) AS s, row_number() OVER (ORDER BY round(s, 9)) AS r, count(*) OVER () AS n FROM c WHERE i = y AND vec_id % 2 = 0),
q AS (SELECT s AS q FROM cal WHERE r = ceil(round(least(1, ceil((n + 1) * 0.9) / n) * (n - 1), 9)) + 1)"""


@query("m5_aps_sets", f"WITH {_APS}, s AS (SELECT vec_id, count(*) FILTER (round(s, 9) <= q.q OR k = 1) AS size, bool_or(i = y AND (round(s, 9) <= q.q OR k = 1)) AS hit FROM c, q WHERE vec_id % 2 = 1 GROUP BY vec_id) SELECT count(*) AS n, round(avg(size), 6) AS size, round(avg(CAST(hit AS INTEGER)), 6) AS coverage FROM s")
def m5(spark: SparkSession, d: str) -> DataFrame:
    """Randomised cumulative scores; even vectors calibrate, odd ones are tested."""
    c = S.choice_probs(spark, d).select("vec_id", "y", R.uniform("aps", "vec_id").alias("u"), C.cumulative("p").alias("c"))
    each = c.select("vec_id", "y", "u", F.posexplode("c").alias("k", "x")).select("vec_id", "y", "k", F.col("x.c").alias("i"), F.round(F.col("x.cum") - F.col("u") * F.col("x.p"), 9).alias("s"))
    cal = each.where("i = y AND vec_id % 2 = 0").select("s")
    q = C.higher_quantile(cal, "s", F.ceil((F.col("n") + 1) * 0.9) / F.col("n"))
    held = (F.col("s") <= F.col("q")) | (F.col("k") == 0)
    s = each.where("vec_id % 2 = 1").crossJoin(F.broadcast(q)).groupBy("vec_id").agg(F.count(F.when(held, 1)).alias("size"), F.bool_or(held & (F.col("i") == F.col("y"))).alias("hit"))  # one row
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("size"), 6).alias("size"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("coverage"))


_THRESHOLDS = [round(k / 20, 2) for k in range(1, 20)] + [round(1 / 11, 9)]


@query("m8_decision_costs", f"WITH {S.BINARY}, t AS (SELECT CAST(unnest({_THRESHOLDS!r}) AS DOUBLE) AS threshold) SELECT threshold, round(1000 * avg(CASE WHEN p >= threshold AND y = 0 THEN 1.0 WHEN p < threshold AND y = 1 THEN 10.0 ELSE 0 END), 6) AS cost, count(*) FILTER (p >= threshold) AS acts FROM binary_p, t GROUP BY threshold")
def m8(spark: SparkSession, d: str) -> DataFrame:
    """Costs of 10 to 1; 1/11 is the threshold that is best if the probabilities are right."""
    return C.decision_costs(S.binary_probs(spark, d), _THRESHOLDS).select("threshold", _r("cost"), "acts")


_CURVE, _SIZES, _SEEDS = [math.exp(x / 4) for x in range(-12, 13)], (25, 50, 100, 200), 25
_KEY = _dk("'curve'", "seed", "vec_id")
_LOSSES = f"list_transform({_CURVE!r}, lambda t: -ln(greatest(pow(greatest(p[y + 1], 1e-6), 1 / t) / list_sum(list_transform(p, lambda x: pow(greatest(x, 1e-6), 1 / t))), 1e-6)))"


@query("m7_learning_curve", f"""WITH {S.CHOICE}, l AS MATERIALIZED (SELECT vec_id, {_LOSSES} AS l FROM choice),
k AS (SELECT seed, vec_id, row_number() OVER (PARTITION BY seed ORDER BY {_KEY}, vec_id) AS k FROM l, (SELECT unnest(range(0, {_SEEDS})) AS seed)),
g AS (SELECT size, seed, i, avg(l.l[i]) AS nll FROM k JOIN l USING (vec_id), (SELECT unnest({list(_SIZES)!r}) AS size), (SELECT unnest(range(1, {len(_CURVE) + 1})) AS i) WHERE k <= size GROUP BY size, seed, i),
b AS (SELECT size, seed, first({_CURVE!r}[i] ORDER BY round(nll, 9), i) AS t FROM g GROUP BY size, seed)
SELECT size, round(quantile_cont(t, 0.25), 6) AS q25, round(quantile_cont(t, 0.5), 6) AS median, round(quantile_cont(t, 0.75), 6) AS q75 FROM b GROUP BY size""")
def m7(spark: SparkSession, d: str) -> DataFrame:
    """Best grid temperature of samples of four sizes, 25 draws each.  One pass: the losses of a row on the whole grid are made
    once, a seed's first rows by hash serve all sizes, and only sums by size, seed and grid point move on."""
    c = S.choice_probs(spark, d)
    losses = F.array(*[-F.log(F.greatest(F.element_at(C.tempered("p", t), F.col("y") + 1), F.lit(1e-6))) for t in _CURVE])
    rows = c.select("vec_id", losses.alias("l")).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SEEDS - 1).cast("long"))))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(R.draw("curve", "seed", "vec_id"), "vec_id"))
    few = rows.withColumn("k", place).where(F.col("k") <= max(_SIZES))
    each = few.select("seed", "k", F.posexplode("l").alias("i", "nll")).withColumn("size", F.explode(F.array(*[F.lit(n) for n in _SIZES]))).where("k <= size")
    means = each.groupBy("size", "seed", "i").agg(F.round(F.avg("nll"), 9).alias("nll"))
    best = means.groupBy("size", "seed").agg(F.min(F.struct("nll", "i")).alias("b")).select("size", F.element_at(F.array(*[F.lit(t) for t in _CURVE]), F.col("b.i") + 1).alias("t"))
    q = F.percentile("t", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return best.groupBy("size").agg(q.alias("q")).select("size", *[F.round(F.element_at("q", i), 6).alias(n) for i, n in ((1, "q25"), (2, "median"), (3, "q75"))])


_TIMES = lambda u: " + ".join(f"CASE WHEN {u} >= {c!r} THEN 1 ELSE 0 END" for c in R.POISSON)


@query("b5_item_bootstrap", f"""WITH {S.BINARY}, s AS (SELECT b, ({_dk("'items'", 'b', 'doc_id')} + 0.5) / 4294967296.0 AS u, pow(p - y, 2) AS l FROM binary_p, (SELECT unnest(range(0, {R.DRAWS})) AS b)),
r AS (SELECT b, sum(w * l) / sum(w) AS m FROM (SELECT b, l, {_TIMES('u')} AS w FROM s) GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM r""")
def b5(spark: SparkSession, d: str) -> DataFrame:
    """2,000 draws by Poisson weights made beside the items."""
    shipped(spark)
    items = S.binary_probs(spark, d).select("doc_id", F.pow(F.col("p") - F.col("y"), F.lit(2)).alias("l"))
    sums = R.weighted_sums(items, "items", R.DRAWS, "doc_id", "l").where("w > 0")
    return R.interval(sums.select("b", (F.col("s") / F.col("w")).alias("m")), "m")


@query("a26_a27_histogram_percentiles", f"WITH {TOP} SELECT least(9, CAST(floor(conf * 10) AS INTEGER)) AS bin, count(*) AS n, round(quantile_cont(conf, 0.1), 6) AS p10, round(quantile_cont(conf, 0.5), 6) AS p50, round(quantile_cont(conf, 0.9), 6) AS p90 FROM top GROUP BY 1")
def a26(spark: SparkSession, d: str) -> DataFrame:
    """Ten equal bins of [0, 1], the last one closed."""
    bin_ = F.least(F.lit(9), (F.width_bucket("conf", F.lit(0.0), F.lit(1.0), F.lit(10)) - 1).cast("int"))
    rows = settle(top(spark, d).select(bin_.alias("bin"), "conf"))
    g = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).join(quantile(rows, "conf", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, "bin"), "bin", "left")
    return g.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])
