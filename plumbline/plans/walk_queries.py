"""The walk-forward of all models: forecasts by date, level and asset, and what is tested on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.settle import settle
from plumbline.operators import nulls as N
from plumbline.operators import panel as P
from plumbline.operators import resample as R
from plumbline.operators import rules
from plumbline.operators import tail as T
from plumbline.operators import walk as W
from plumbline.plans.panel_queries import _RETURNS, _TAG
from plumbline.plans.registry import query
from plumbline.plans.tail_queries import _CHAIN, _IND, _KUPIEC, ALPHAS, DETAILS, WEIGHTS, _dk, details
from plumbline.sources import tables as S
from plumbline.sources.files import shipped

#: Days before the first report: the fit window and the warm-up of the models that carry a state.
BEFORE = W.FIT + W.WARM
ASSETS = sorted(WEIGHTS)


def _r(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


def asset_returns(spark: SparkSession, d: str) -> DataFrame:
    """date, asset, r: log returns to twelve digits, so that a breach is one in any engine."""
    return settle(T.log_returns(S.asset_prices(spark, d)).withColumn("r", F.round("r", 12)))


def series(returns: DataFrame) -> DataFrame:
    """date, asset, pnl: each asset's returns and, as asset '', the book's."""
    book = T.portfolio(returns, WEIGHTS).select("date", F.lit("").alias("asset"), F.round("pnl", 12).alias("pnl"))
    return returns.select("date", "asset", F.col("r").alias("pnl")).unionByName(book)


def reported(returns: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows from the first reported day on."""
    days = returns.select("date").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))  # a row a day
    first = days.where(F.col("k") == BEFORE + 1).select(F.col("date").alias("first_"))
    return rows.crossJoin(F.broadcast(first)).where("date >= first_").drop("first_")  # one row


def stateless(spark: SparkSession, d: str) -> DataFrame:
    """date, method, alpha, asset, var, es, realized, breached, mu, sigma, kurt of the two models without a state."""
    returns = asset_returns(spark, d)
    past = T.historical(series(returns), ALPHAS, by=["asset"], moments=True)
    names = ["date", "method", "alpha", "asset", "var", "es", "realized", "breached", "mu", "sigma", "kurt"]
    one = past.withColumnsRenamed({"pnl": "realized"}).withColumn("method", F.lit("historical")).select(*names)
    two = T.parametric(returns, WEIGHTS, ALPHAS).withColumns({"method": F.lit("parametric"), "realized": F.round("realized", 12), "mu": F.lit(0.0), "kurt": F.lit(0.0)}).select(*names)
    return settle(reported(returns, one.unionByName(two)))


def stateful(spark: SparkSession, d: str, copula: str = "t") -> DataFrame:
    """The rows of the GARCH model and its two calibrations."""
    shipped(spark)
    books = asset_returns(spark, d).withColumn("book", F.lit("all"))
    return settle(W.walk_books(books, WEIGHTS, ALPHAS, copula=copula))


def all_models(spark: SparkSession, d: str) -> DataFrame:
    return stateless(spark, d).unionByName(stateful(spark, d).drop("book", "level", "es_scale"))


_PAST = "(ORDER BY date ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING)"
_VOL = lambda a: f"sqrt(list_dot_product(list_transform(p_{a}, lambda x: x * x), w))"
_NORMAL = [(a, T.NormalDist().inv_cdf(a), -T.NormalDist().pdf(T.NormalDist().inv_cdf(a)) / a) for a in ALPHAS]
_SERIES = f"""{_RETURNS}, rr AS MATERIALIZED (SELECT date, asset, round(r, 12) AS r FROM returns),
wide AS MATERIALIZED (SELECT date, max(r) FILTER (asset = 'A') AS A, max(r) FILTER (asset = 'N') AS N, max(r) FILTER (asset = 'R') AS R FROM rr GROUP BY date HAVING count(*) = 3),
book AS (SELECT date, round(sum(r * CASE asset WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.3 ELSE 0.2 END), 12) AS x FROM rr GROUP BY date),
series AS MATERIALIZED (SELECT date, '' AS asset, x FROM book UNION ALL SELECT date, asset, r FROM rr),
w AS (SELECT list(CASE WHEN k = 0 THEN pow(0.94, 499) ELSE (1 - 0.94) * pow(0.94, 499 - k) END ORDER BY k) AS w FROM (SELECT unnest(range(0, 500)) AS k)),
seen AS MATERIALIZED (SELECT *, list(A) OVER {_PAST} AS p_A, list(N) OVER {_PAST} AS p_N, list(R) OVER {_PAST} AS p_R,
  corr(A, N) OVER {_PAST} AS c_AN, corr(A, R) OVER {_PAST} AS c_AR, corr(N, R) OVER {_PAST} AS c_NR FROM wide),
vol AS MATERIALIZED (SELECT date, {_VOL('A')} AS s_A, {_VOL('N')} AS s_N, {_VOL('R')} AS s_R, c_AN, c_AR, c_NR FROM seen, w WHERE len(p_A) = 500),
sigmas AS MATERIALIZED (
  SELECT date, '' AS asset, sqrt(pow(0.5 * s_A, 2) + pow(0.3 * s_N, 2) + pow(0.2 * s_R, 2) + 2 * 0.5 * 0.3 * s_A * s_N * c_AN + 2 * 0.5 * 0.2 * s_A * s_R * c_AR + 2 * 0.3 * 0.2 * s_N * s_R * c_NR) AS sigma FROM vol
  UNION ALL SELECT date, 'A', s_A FROM vol UNION ALL SELECT date, 'N', s_N FROM vol UNION ALL SELECT date, 'R', s_R FROM vol),
normals AS ({" UNION ALL ".join(f"SELECT CAST({a} AS DOUBLE) AS alpha, {q!r} AS q, {e!r} AS e" for a, q, e in _NORMAL)}),
param AS MATERIALIZED (SELECT date, alpha, asset, sigma, round(q * sigma, 12) AS var, e * sigma AS es, x AS realized, x < round(q * sigma, 12) AS breached FROM sigmas CROSS JOIN normals JOIN series USING (date, asset))"""
WALK = f"""{_SERIES}, past AS MATERIALIZED (SELECT *, list(x) OVER h AS past, quantile_cont(x, 0.01) OVER h AS q1, quantile_cont(x, 0.025) OVER h AS q2 FROM series
  WINDOW h AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
hist AS (SELECT date, asset, x, past, CAST(0.01 AS DOUBLE) AS alpha, round(q1, 12) AS var FROM past WHERE len(past) = 250 UNION ALL SELECT date, asset, x, past, CAST(0.025 AS DOUBLE), round(q2, 12) FROM past WHERE len(past) = 250),
first_day AS (SELECT date AS first FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM wide) WHERE k = {BEFORE + 1}),
walk AS MATERIALIZED (SELECT * FROM (
  SELECT date, 'historical' AS method, alpha, asset, var, list_avg(list_filter(past, lambda y: y <= var + 1e-12)) AS es, x AS realized, x < var AS breached FROM hist
  UNION ALL SELECT date, 'parametric', alpha, asset, var, es, realized, breached FROM param) WHERE date >= (SELECT first FROM first_day))"""


@query("q3_ewma_volatility", f"WITH {_SERIES} SELECT date, asset, round(sigma, 9) AS sigma FROM sigmas WHERE asset <> ''")
def q3(spark: SparkSession, d: str) -> DataFrame:
    """Each asset's volatility at every date, from the 500 returns before it."""
    sigma = asset_returns(spark, d).select("date", "asset", T.ewma_sigma("r", W.FIT, ["asset"]).alias("sigma"))
    return sigma.where("sigma IS NOT NULL").select("date", "asset", _r("sigma", 9))


@query("q4_parametric_var", f"WITH {_SERIES} SELECT date, alpha, asset, round(sigma, 9) AS sigma, round(var, 9) AS var, round(es, 9) AS es, breached FROM param")
def q4(spark: SparkSession, d: str) -> DataFrame:
    """VaR and ES of the book and of each asset at every date."""
    return T.parametric(asset_returns(spark, d), WEIGHTS, ALPHAS).select("date", "alpha", "asset", _r("sigma", 9), _r("var", 9), _r("es", 9), "breached")


_ROWS = "date, method, alpha, asset, round(var, 9) AS var, round(es, 9) AS es, round(realized, 9) AS realized, breached"


@query("q11_walk_forward_stateless", f"WITH {WALK} SELECT {_ROWS} FROM walk")
def q11(spark: SparkSession, d: str) -> DataFrame:
    return stateless(spark, d).select("date", "method", "alpha", "asset", _r("var", 9), _r("es", 9), _r("realized", 9), "breached")


@query("q8_q9_q10_q11_walk_forward")
def q11_all(spark: SparkSession, d: str) -> DataFrame:
    """All five models with their moments; the calibrated ones with the state of their controllers."""
    plain = stateless(spark, d).withColumns({"level": F.lit(None).cast("double"), "es_scale": F.lit(None).cast("double")})
    return plain.unionByName(stateful(spark, d).drop("book"))


@query("q6_garch_volatility")
def q6(spark: SparkSession, d: str) -> DataFrame:
    shipped(spark)
    return W.garch_path(asset_returns(spark, d))


@query("q7_copula_monte_carlo")
def q7(spark: SparkSession, d: str) -> DataFrame:
    """VaR and ES of the book by day under both copulas, over the same t marginals."""
    rows = None
    for copula in ("gaussian", "t"):
        one = stateful(spark, d, copula).where("method = 'distributional' AND asset = ''").withColumn("copula", F.lit(copula))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("date", "copula", "alpha", "var", "es", "breached")


@query("a18_group_and_asset_breaches", f"WITH {WALK} SELECT method, alpha, asset, count(*) AS n, count(*) FILTER (breached) AS breaches, round(count(*) FILTER (breached) / count(*), 9) AS rate, round(count(*) * alpha, 6) AS expected FROM walk GROUP BY method, alpha, asset")
def a18(spark: SparkSession, d: str) -> DataFrame:
    hits = F.count(F.when(F.col("breached"), 1))
    return stateless(spark, d).groupBy("method", "alpha", "asset").agg(
        F.count(F.lit(1)).alias("n"), hits.alias("breaches"), F.round(hits / F.count(F.lit(1)), 9).alias("rate"), F.round(F.count(F.lit(1)) * F.first("alpha"), 6).alias("expected"))


@query("j5_forecast_to_breach_and_outcome", f"""WITH {WALK}, f AS (SELECT date, method, alpha, asset, var, es FROM walk), b AS (SELECT date, method, alpha, asset, breached FROM walk WHERE breached)
SELECT f.method, f.alpha, f.asset, count(*) AS rows, count(b.breached) AS breaches, count(*) FILTER ((s.x < f.var) <> (b.breached IS NOT NULL)) AS mismatches, round(avg(s.x - f.es) FILTER (b.breached), 9) AS beyond_es
FROM f LEFT JOIN b USING (date, method, alpha, asset) JOIN series s ON s.date = f.date AND s.asset = f.asset GROUP BY ALL""")
def j5(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts meet their breaches by (date, method, alpha, asset) and outcomes by (date, asset)."""
    walk = stateless(spark, d)
    key = ["date", "method", "alpha", "asset"]
    hit = walk.where("breached").select(*key, F.lit(True).alias("hit"))
    outcomes = series(asset_returns(spark, d)).withColumnRenamed("pnl", "x")
    rows = walk.select(*key, "var", "es").join(hit, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False))).join(outcomes, ["date", "asset"])
    return rows.groupBy("method", "alpha", "asset").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("hit"), 1)).alias("breaches"), F.count(F.when((F.col("x") < F.col("var")) != F.col("hit"), 1)).alias("mismatches"),
        F.round(F.avg(F.when(F.col("hit"), F.col("x") - F.col("es"))), 9).alias("beyond_es"))


CUT = "2000-01-01"
_LAST = "sum(CAST(breached AS INTEGER)) FILTER (back <= 250)"
_LR = _KUPIEC.replace("breaches", "x")
_RUN = lambda name, rows: f"""{name} AS (SELECT *, CASE WHEN c < 5 THEN 'green' WHEN c < 10 THEN 'yellow' ELSE 'red' END AS zone, round({_LR}, 9) < 3.841458821 AS passes FROM (
  SELECT method, alpha, count(*) AS n, CAST(count(*) FILTER (breached) AS BIGINT) AS x, CAST({_LAST} AS BIGINT) AS c FROM (SELECT *, row_number() OVER (PARTITION BY method, alpha ORDER BY date DESC) AS back FROM ({rows})) GROUP BY method, alpha))"""  # noqa: E731
_BOOK = "SELECT date, method, alpha, var, realized, breached FROM walk WHERE asset = ''"
_SCALED = lambda name, k: f"SELECT date, '{name}' AS method, alpha, {k} * var AS var, realized, realized < round({k} * var, 12) AS breached FROM walk WHERE asset = '' AND method = 'historical'"
_RUNS = f"""{WALK}, {_RUN('was', f"SELECT * FROM ({_BOOK} UNION ALL {_SCALED('retired', 1.2)}) WHERE date < DATE '{CUT}'")}, {_RUN('now', f"{_BOOK} UNION ALL {_SCALED('scaled', 0.8)}")},
compared AS (SELECT coalesce(w.method, n.method) AS method, coalesce(w.alpha, n.alpha) AS alpha, w.n AS n_was, n.n AS n_now, w.x AS x_was, n.x AS x_now, w.zone AS zone_was, n.zone AS zone_now, w.passes AS passes_was, n.passes AS passes_now FROM was w FULL JOIN now n ON w.method = n.method AND w.alpha = n.alpha)"""


def _scaled(book: DataFrame, name: str, k: float) -> DataFrame:
    """A model made from the historical one, wider or narrower by a factor."""
    var = k * F.col("var")
    return book.where("method = 'historical'").withColumns({"method": F.lit(name), "breached": F.col("realized") < F.round(var, 12), "var": var})


def run_summary(book: DataFrame) -> DataFrame:
    """method, alpha, n, x (breaches), zone of the last 250 days and whether the breach rate passes at 5 %."""
    back = F.row_number().over(Window.partitionBy("method", "alpha").orderBy(F.desc("date")))
    hit = F.count(F.when(F.col("breached"), 1))
    g = book.withColumn("back", back).groupBy("method", "alpha").agg(F.count(F.lit(1)).alias("n"), hit.alias("x"), F.count(F.when(F.col("breached") & (F.col("back") <= 250), 1)).alias("c"))
    return g.select("method", "alpha", "n", "x", T.zone(F.col("c")).alias("zone"), (F.round(T.kupiec(F.col("n"), F.col("x"), F.col("alpha")), 9) < 3.841458821).alias("passes"))


def compared_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs side by side, whichever of them has a model: one up to the cut with a model that is gone since, one to the end
    with a new one."""
    book = stateless(spark, d).where("asset = ''").select("date", "method", "alpha", "var", "realized", "breached")
    was = run_summary(book.unionByName(_scaled(book, "retired", 1.2)).where(F.col("date") < F.lit(CUT).cast("date")))
    now = run_summary(book.unionByName(_scaled(book, "scaled", 0.8)))
    named = lambda run, tag: run.select("method", "alpha", *[F.col(c).alias(f"{c}_{tag}") for c in ("n", "x", "zone", "passes")])
    return named(was, "was").join(named(now, "now"), ["method", "alpha"], "full")


@query("j14_run_comparison", f"WITH {_RUNS} SELECT method, alpha, n_was, n_now, round(x_was / n_was, 9) AS rate_was, round(x_now / n_now, 9) AS rate_now, zone_was, zone_now, CASE WHEN n_was IS NULL THEN 'new' WHEN n_now IS NULL THEN 'gone' ELSE 'both' END AS found FROM compared")
def j14(spark: SparkSession, d: str) -> DataFrame:
    found = F.when(F.col("n_was").isNull(), "new").when(F.col("n_now").isNull(), "gone").otherwise("both").alias("found")
    rate = lambda t: F.round(F.col(f"x_{t}") / F.col(f"n_{t}"), 9).alias(f"rate_{t}")
    return compared_runs(spark, d).select("method", "alpha", "n_was", "n_now", rate("was"), rate("now"), "zone_was", "zone_now", found)


@query("r13_verdict_survival", f"""WITH {_RUNS} SELECT method, alpha, zone_was <> zone_now AS zone_changed, passes_was <> passes_now AS rate_flipped,
  CASE WHEN zone_was <> zone_now OR passes_was <> passes_now THEN 'changes' ELSE 'survives' END AS verdict FROM compared WHERE n_was IS NOT NULL AND n_now IS NOT NULL""")
def r13(spark: SparkSession, d: str) -> DataFrame:
    """Whether a verdict of the earlier run still stands; models that only one run has are skipped."""
    both = compared_runs(spark, d).where("n_was IS NOT NULL AND n_now IS NOT NULL")
    zone, flip = F.col("zone_was") != F.col("zone_now"), F.col("passes_was") != F.col("passes_now")
    return both.select("method", "alpha", zone.alias("zone_changed"), flip.alias("rate_flipped"), F.when(zone | flip, "changes").otherwise("survives").alias("verdict"))


# ---- intervals and p-values

MC = 5_000


def _sql_paths(name: str, cells: str, p: str, draws: int = MC) -> str:
    """CTE of simulated breach counts by gaps, twin of tail.simulated_breaches(); cells has the columns of by, n and p."""
    by = "method, alpha"
    key = _dk(f"'{name}'", "method", "alpha", "b", "k")
    return f"""{name}_cells AS (SELECT {by}, n, {p} AS p FROM {cells}),
{name}_gaps AS (SELECT {by}, n, p, b, k, CASE WHEN p <= 0 THEN n + 1 ELSE 1 + CAST(floor(ln(({key} + 0.5) / 4294967296.0) / ln(1 - p)) AS BIGINT) END AS gap
  FROM {name}_cells, (SELECT unnest(range(0, {draws})) AS b), (SELECT unnest(range(0, (SELECT CAST(max(ceil(n * p + 12 * sqrt(n * p) + 20)) AS BIGINT) + 1 FROM {name}_cells))) AS k) WHERE k <= ceil(n * p + 12 * sqrt(n * p) + 20)),
{name}_at AS (SELECT *, sum(gap) OVER (PARTITION BY {by}, b ORDER BY k ROWS UNBOUNDED PRECEDING) AS pos FROM {name}_gaps),
{name}_sum AS (SELECT {by}, b, any_value(n) AS n, count(*) FILTER (pos <= n) AS breaches, count(*) FILTER (pos <= n AND gap = 1 AND k > 0) AS n11, count(*) FILTER (pos <= n AND pos > 1) AS into_, count(*) FILTER (pos < n) AS out_ FROM {name}_at GROUP BY {by}, b),
{name}_paths AS (SELECT {by}, b, n, breaches, n11, into_ - n11 AS n01, out_ - n11 AS n10, n - 1 - into_ - out_ + n11 AS n00 FROM {name}_sum)"""


_SUMMED = "({} + {})".format(_KUPIEC, _IND)  # noqa: UP032
_P = lambda name, lr: f"""{_sql_paths(name, 'stats', 'breaches / n' if name == 'independence' else 'alpha')},
{name}_seen AS (SELECT method, alpha, round({lr}, 9) AS seen FROM stats),
{name}_p AS (SELECT method, alpha, avg(CASE WHEN round({lr}, 9) >= seen THEN 1.0 ELSE 0 END) AS {name}_p FROM {name}_paths JOIN {name}_seen USING (method, alpha) GROUP BY method, alpha)"""  # noqa: E731
_STATS = lambda rows: f"""step AS (SELECT *, lag(breached) OVER (PARTITION BY method, alpha ORDER BY date) AS px FROM ({rows})),
stats AS MATERIALIZED (SELECT method, alpha, count(*) AS n, count(*) FILTER (breached) AS breaches, count(*) FILTER (NOT px AND NOT breached) AS n00, count(*) FILTER (NOT px AND breached) AS n01, count(*) FILTER (px AND NOT breached) AS n10, count(*) FILTER (px AND breached) AS n11 FROM step GROUP BY method, alpha)"""  # noqa: E731


@query("t5_monte_carlo_p_values", f"""WITH {DETAILS}, {_STATS("SELECT 'historical' AS method, alpha, date, breached FROM details")}, {_P('kupiec', _KUPIEC)}, {_P('independence', _IND)}, {_P('conditional', _SUMMED)}
SELECT alpha, round(kupiec_p, 6) AS kupiec_p, round(independence_p, 6) AS independence_p, round(conditional_p, 6) AS conditional_p FROM kupiec_p JOIN independence_p USING (method, alpha) JOIN conditional_p USING (method, alpha)""")
def t5(spark: SparkSession, d: str) -> DataFrame:
    """All three tests by 5,000 simulated paths each."""
    stats = settle(T.breach_stats(details(spark, d).withColumn("method", F.lit("historical")), "method", "alpha"))
    return T.simulated_p_values(stats, "method", "alpha", draws=MC).select("alpha", _r("kupiec_p"), _r("independence_p"), _r("conditional_p"))


_DRAWN = lambda stream, n, draws=R.DRAWS: f"SELECT b, i, {_dk(repr(stream), 'b', 'i')} % (SELECT count(*) FROM {n}) AS u FROM (SELECT unnest(range(0, {draws})) AS b), (SELECT unnest(range(0, (SELECT count(*) FROM {n}))) AS i)"
#: By (method, alpha): months redrawn whole, the breach rate from their counts and the share of windows outside green from their rows in order.
_MONTHS = lambda rows: f"""graded AS MATERIALIZED (SELECT *, date_trunc('month', date) AS m FROM ({rows})),
months AS MATERIALIZED (SELECT m, row_number() OVER (ORDER BY m) - 1 AS u FROM (SELECT DISTINCT m FROM graded)),
drawn AS MATERIALIZED ({_DRAWN('months', 'months')}),
counts AS (SELECT method, alpha, u, count(*) AS n, count(*) FILTER (breached) AS x FROM graded JOIN months USING (m) GROUP BY method, alpha, u),
rates AS (SELECT method, alpha, b, sum(x) / sum(n) AS rate FROM drawn JOIN counts USING (u) GROUP BY method, alpha, b),
rate_ci AS (SELECT method, alpha, round(quantile_cont(rate, 0.025), 6) AS rate_lo, round(quantile_cont(rate, 0.975), 6) AS rate_hi FROM rates GROUP BY method, alpha),
laid AS (SELECT method, b, breached, row_number() OVER (PARTITION BY method, b ORDER BY i, date) AS k FROM drawn JOIN months USING (u) JOIN graded USING (m) WHERE alpha = 0.01),
sums AS (SELECT method, b, k, sum(CAST(breached AS INTEGER)) OVER (PARTITION BY method, b ORDER BY k ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS c FROM laid),
shares AS (SELECT method, b, avg(CASE WHEN c >= 5 THEN 1.0 ELSE 0 END) AS share FROM sums WHERE k >= 250 GROUP BY method, b),
share_ci AS (SELECT method, round(quantile_cont(share, 0.025), 6) AS share_lo, round(quantile_cont(share, 0.975), 6) AS share_hi FROM shares GROUP BY method)"""  # noqa: E731


def month_intervals(book: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(method, alpha, rate_lo, rate_hi) and, at the 99 % level, (method, share_lo, share_hi): whole months are redrawn
    2,000 times; rates need their counts alone, windows over the joined months their rows, by prefix sums."""
    graded = book.select("method", "alpha", "date", F.col("breached").cast("int").alias("x"), F.date_trunc("month", "date").alias("m"))
    drawn = settle(R.redrawn(graded.select("m").distinct(), "months", R.DRAWS, "m"))
    counts = graded.groupBy("method", "alpha", "m").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))
    rates = drawn.join(counts, "m").groupBy("method", "alpha", "b").agg((F.sum("x") / F.sum("n")).alias("rate"))
    laid = drawn.join(graded.where("alpha = 0.01"), "m")
    w = Window.partitionBy("method", "b").orderBy("i", "date")
    sums = laid.select("method", "b", "i", "date", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.row_number().over(w).alias("k"))
    windows = sums.select("method", "b", "k", (F.col("s") - F.coalesce(F.lag("s", T.WINDOW).over(w), F.lit(0))).alias("c")).where(F.col("k") >= T.WINDOW)
    shares = windows.groupBy("method", "b").agg(F.avg((F.col("c") >= 5).cast("double")).alias("share"))
    rename = lambda df, name: df.withColumnsRenamed({"lo": f"{name}_lo", "hi": f"{name}_hi"})
    return rename(R.interval(rates, "rate", "method", "alpha"), "rate"), rename(R.interval(shares, "share", "method"), "share")


@query("b2_month_bootstrap_of_rates_and_rolling_counts", f"""WITH {DETAILS}, {_MONTHS("SELECT 'historical' AS method, alpha, date, breached FROM details")}
SELECT alpha, rate_lo, rate_hi, CASE WHEN alpha = 0.01 THEN share_lo END AS share_lo, CASE WHEN alpha = 0.01 THEN share_hi END AS share_hi FROM rate_ci JOIN share_ci USING (method)""")
def b2(spark: SparkSession, d: str) -> DataFrame:
    rates, shares = month_intervals(details(spark, d).withColumn("method", F.lit("historical")))
    at = lambda c: F.when(F.col("alpha") == 0.01, F.col(c)).alias(c)
    return rates.join(shares, "method").select("alpha", "rate_lo", "rate_hi", at("share_lo"), at("share_hi"))


_MODEL = f"""{WALK}, {_STATS(_BOOK)}, {_P('independence', _IND)}, {_MONTHS(_BOOK)},
windows AS (SELECT method, avg(CASE WHEN c >= 5 THEN 1.0 ELSE 0 END) AS share FROM (SELECT method, sum(CAST(breached AS INTEGER)) OVER w AS c, count(*) OVER w AS n FROM graded WHERE alpha = 0.01 WINDOW w AS (PARTITION BY method ORDER BY date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)) WHERE n = 250 GROUP BY method),
judged AS (SELECT s.method, s.alpha, n, breaches, rate_lo, rate_hi, independence_p, share, share_lo, alpha BETWEEN rate_lo AND rate_hi AS inside FROM stats s JOIN rate_ci USING (method, alpha) JOIN independence_p USING (method, alpha) LEFT JOIN windows USING (method) LEFT JOIN share_ci USING (method)),
severe AS (SELECT *, CASE WHEN inside AND independence_p >= 0.05 THEN 'Observation' WHEN alpha = 0.01 AND share >= 0.25 AND share_lo > {T.p_outside_green()!r} THEN 'Material' ELSE 'Significant' END AS severity FROM judged)"""


def judged_models(spark: SparkSession, d: str) -> DataFrame:
    """Each model and level of the book: its intervals, its independence p-value and its severity."""
    book = settle(stateless(spark, d).where("asset = ''").select("date", "method", "alpha", "breached"))
    stats = settle(T.breach_stats(book, "method", "alpha"))
    rates, shares = month_intervals(book)
    counted = book.where("alpha = 0.01").withColumn("c", T.rolling_count(["method"], complete=True)).where("c IS NOT NULL")
    outside = counted.groupBy("method").agg(F.avg((F.col("c") >= 5).cast("double")).alias("share"))
    p = T.simulated_p_values(stats, "method", "alpha", draws=MC).select("method", "alpha", "independence_p")
    found = stats.join(rates, ["method", "alpha"]).join(p, ["method", "alpha"]).join(outside, "method", "left").join(shares, "method", "left")
    inside = F.col("alpha").between(F.col("rate_lo"), F.col("rate_hi"))
    severity = rules.model(inside, F.col("independence_p"), F.col("alpha") == 0.01, F.col("share"), F.col("share_lo"), T.p_outside_green())
    return found.withColumn("severity", severity)


@query("r5_model_severity", f"WITH {_MODEL} SELECT method, alpha, n, breaches, rate_lo, rate_hi, round(independence_p, 6) AS independence_p, round(share, 6) AS share, share_lo, severity FROM severe")
def r5(spark: SparkSession, d: str) -> DataFrame:
    return judged_models(spark, d).select("method", "alpha", "n", "breaches", "rate_lo", "rate_hi", _r("independence_p"), _r("share"), "share_lo", "severity")


@query("r9_model_register", f"""WITH {_MODEL}, k AS (SELECT *, CASE severity WHEN 'Material' THEN 2 WHEN 'Significant' THEN 1 ELSE 0 END AS rk FROM severe),
worst AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY rk DESC, alpha = 0.01 DESC, alpha) AS place FROM k)
SELECT printf('F-%02d', row_number() OVER (ORDER BY rk DESC, method)) AS id, method, alpha, severity FROM worst WHERE place = 1""")
def r9(spark: SparkSession, d: str) -> DataFrame:
    return rules.register(judged_models(spark, d), "method", "alpha", 0.01).select("id", "method", "alpha", "severity")


@query("r7_integrity_severity", f"""WITH {WALK}, m AS (SELECT method, alpha, var, es FROM walk WHERE asset = '' UNION ALL SELECT 'control', alpha, var, 0.9 * var FROM walk WHERE asset = '' AND method = 'historical' AND year(date) = 2000),
s AS (SELECT method, alpha, avg(CASE WHEN es > var + 1e-12 THEN 1.0 ELSE 0 END) AS share FROM m GROUP BY method, alpha)
SELECT method, round(max(share), 6) AS worst_share, CASE WHEN max(share) > 0.01 THEN 'Material' ELSE 'Observation' END AS severity FROM s GROUP BY method""")
def r7(spark: SparkSession, d: str) -> DataFrame:
    """Shortfalls shallower than their own VaR, by model at its worst level; the control states such ones."""
    book = stateless(spark, d).where("asset = ''").select("date", "method", "alpha", "var", "es")
    control = book.where("method = 'historical' AND year(date) = 2000").withColumns({"method": F.lit("control"), "es": 0.9 * F.col("var")})
    s = book.unionByName(control).groupBy("method", "alpha").agg(F.avg((F.col("es") > F.col("var") + 1e-12).cast("double")).alias("share"))
    worst = s.groupBy("method").agg(F.max("share").alias("worst_share"))
    return worst.select("method", _r("worst_share"), rules.pair_integrity(F.col("worst_share")).alias("severity"))


_BLOCKS = f"""{DETAILS}, tagged AS MATERIALIZED (SELECT alpha, CASE WHEN {_TAG} = '' THEN 'calm' ELSE {_TAG} END AS tag, date, CAST(breached AS INTEGER) AS x FROM details),
psum AS MATERIALIZED (SELECT alpha, tag, row_number() OVER w AS p, sum(x) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM tagged WINDOW w AS (PARTITION BY alpha, tag ORDER BY date)),
sized AS (SELECT alpha, tag, n, greatest(2, least(5, n // 3)) AS l FROM (SELECT alpha, tag, max(p) AS n FROM psum GROUP BY alpha, tag) WHERE n >= 6),
cut AS (SELECT alpha, tag, b, j, n, l, {_dk("'blocks'", 'alpha', 'tag', 'b', 'j')} % (n - l + 1) AS f FROM sized, (SELECT unnest(range(0, 4000)) AS b), (SELECT unnest(range(0, (SELECT CAST(max(ceil(n / l)) AS BIGINT) FROM sized))) AS j) WHERE j < ceil(n / l)),
block_rates AS (SELECT c.alpha, c.tag, b, sum(z.s - coalesce(a.s, 0)) / any_value(c.n) AS rate FROM cut c JOIN psum z ON z.alpha = c.alpha AND z.tag = c.tag AND z.p = f + least(l, c.n - j * l) LEFT JOIN psum a ON a.alpha = c.alpha AND a.tag = c.tag AND a.p = f GROUP BY c.alpha, c.tag, b),
block_ci AS (SELECT alpha, tag, round(quantile_cont(rate, 0.025), 6) AS lo, round(quantile_cont(rate, 0.975), 6) AS hi FROM block_rates GROUP BY alpha, tag)"""


def regime_intervals(spark: SparkSession, d: str) -> DataFrame:
    """alpha, tag, n, x and the moving-block interval of the breach rate; without a breach the rule of three."""
    tag = F.when(P.stress_tag("date") == "", "calm").otherwise(P.stress_tag("date"))
    rows = settle(details(spark, d).select("alpha", tag.alias("tag"), "date", F.col("breached").cast("int").alias("x")))
    ci = R.interval(R.moving_blocks(rows, "x", "blocks", 4_000, "alpha", "tag"), "rate", "alpha", "tag")
    g = rows.groupBy("alpha", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum("x").cast("long").alias("x"))
    none = F.col("x") == 0
    lo, hi = F.when(none, 0.0).otherwise(F.col("lo")), F.when(none, F.least(F.lit(1.0), 3.0 / F.col("n"))).otherwise(F.col("hi"))
    return g.join(ci, ["alpha", "tag"], "left").select("alpha", "tag", "n", "x", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("b4_moving_block_bootstrap", f"WITH {_BLOCKS} SELECT alpha, tag, lo, hi FROM block_ci")
def b4(spark: SparkSession, d: str) -> DataFrame:
    """4,000 draws of blocks of five days by regime."""
    tag = F.when(P.stress_tag("date") == "", "calm").otherwise(P.stress_tag("date"))
    rows = settle(details(spark, d).select("alpha", tag.alias("tag"), "date", F.col("breached").cast("int").alias("x")))
    return R.interval(R.moving_blocks(rows, "x", "blocks", 4_000, "alpha", "tag"), "rate", "alpha", "tag")


@query("r10_regime_verdict", f"""WITH {_BLOCKS}, g AS (SELECT alpha, tag, count(*) AS n, CAST(sum(x) AS BIGINT) AS x FROM tagged GROUP BY alpha, tag),
e AS (SELECT alpha, tag, n, x, round(CASE WHEN x = 0 THEN 0.0 ELSE lo END, 6) AS lo, round(CASE WHEN x = 0 THEN least(1.0, 3.0 / n) ELSE hi END, 6) AS hi FROM g LEFT JOIN block_ci USING (alpha, tag))
SELECT *, CASE WHEN lo IS NULL OR hi - lo >= 0.5 THEN 'too few days to say' WHEN alpha BETWEEN lo AND hi THEN 'consistent with target' WHEN x / n < alpha THEN 'below target' ELSE 'above target' END AS verdict FROM e""")
def r10(spark: SparkSession, d: str) -> DataFrame:
    e, lo, hi = regime_intervals(spark, d), F.col("lo"), F.col("hi")
    verdict = (
        F.when(lo.isNull() | (hi - lo >= 0.5), "too few days to say").when(F.col("alpha").between(lo, hi), "consistent with target")
        .when(F.col("x") / F.col("n") < F.col("alpha"), "below target").otherwise("above target")
    )
    return e.withColumn("verdict", verdict)


# ---- null distributions of Z1 and Z2

def null_sweep(spark: SparkSession, d: str, copula: str = "t") -> DataFrame:
    """Every model and the two broken ones under the six nulls."""
    shipped(spark)
    book = stateless(spark, d).unionByName(stateful(spark, d, copula).drop("book", "level", "es_scale")).where("asset = ''")
    return settle(N.sweep(N.with_broken(book, "conformal_pid")))


@query("t9_t10_t11_t12_null_sweep")
def t11(spark: SparkSession, d: str) -> DataFrame:
    """Z1 and Z2 on the same 2,000 paths of each of six nulls: statistic, p-value, thresholds and zone by model and level."""
    return null_sweep(spark, d)


@query("a21_flips_across_nulls")
def a21(spark: SparkSession, d: str) -> DataFrame:
    """Models and levels whose zone, and whose pass or fail, changes with the null alone; real models and parametric nulls."""
    return N.flips(null_sweep(spark, d).where(~F.col("method").startswith("broken")))


@query("r6_r8_test_and_process_severity")
def r6(spark: SparkSession, d: str) -> DataFrame:
    """Severity of both statistics (zones that change with the null, broken models that pass), and of a revision that changed
    the copula and the null at once."""
    t, g = null_sweep(spark, d, "t"), null_sweep(spark, d, "gaussian")
    tests = N.test_findings(t)
    graded = tests.select(F.col("statistic").alias("finding"), rules.test(F.col("share_changed"), F.col("missed")).alias("severity"), "share_changed", F.col("missed").cast("double").alias("missed"))
    p = N.process_effects(g, t)
    alone = F.col("zone_model_alone") == "green"
    process = p.select(F.lit("process").alias("finding"), rules.process(F.lit(True), F.col("model_effect"), F.col("reference_effect"), alone).alias("severity"), F.col("model_effect").alias("share_changed"), F.col("reference_effect").alias("missed"))
    named = lambda df: df.select("finding", "severity", F.col("share_changed").alias("first_measure"), F.col("missed").alias("second_measure"))
    return named(graded).unionByName(named(process))
