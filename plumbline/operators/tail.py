"""Tail risk: returns, VaR and ES forecasts, breaches, tests, supervisory zones and capital."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import resample as R

FIT, LOOKBACK, DECAY = 500, 250, 0.94
WINDOW, AVERAGE, HOLDING, BASE = 250, 60, 10, 3.0
# Supervisory add-ons by breaches in 250 days, from 5 on; more than the last count as the last.
ADDEND = {5: 0.40, 6: 0.50, 7: 0.65, 8: 0.75, 9: 0.85, 10: 1.00}
ADDON_2027 = {5: 0.20, 6: 0.26, 7: 0.33, 8: 0.38, 9: 0.42, 10: 0.50}


def log_returns(prices: DataFrame) -> DataFrame:
    """date, asset, r; the first day has none."""
    before = F.lag("price").over(Window.partitionBy("asset").orderBy("date"))
    return prices.select("date", "asset", F.log(F.col("price") / before).alias("r")).where("r IS NOT NULL")


def portfolio(returns: DataFrame, weights: dict[str, float]) -> DataFrame:
    """date, pnl: the weighted sum of the assets' returns."""
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    w = F.lit(0.0)
    for asset, share in weights.items():
        w = F.when(F.col("asset") == asset, share).otherwise(w)
    return returns.groupBy("date").agg(F.sum(F.col("r") * w).alias("pnl"))


def historical(pnl: DataFrame, alphas: list[float], lookback: int = LOOKBACK, by: list[str] | None = None, moments: bool = False) -> DataFrame:
    """date, pnl, alpha, var, es of historical simulation: a type-7 quantile of the rows before, and their mean below it.
    moments: with mu, sigma and excess kurtosis (population) of those rows."""
    w = Window.partitionBy(*(by or [])).orderBy("date").rowsBetween(-lookback, -1)
    about = [F.avg("pnl").over(w).alias("mu"), F.stddev_pop("pnl").over(w).alias("sigma"), F.kurtosis("pnl").over(w).alias("kurt")] if moments else []
    kept = [*pnl.columns, *(["mu", "sigma", "kurt"] if moments else [])]
    past = pnl.select("*", *about, F.collect_list("pnl").over(w).alias("past"), F.percentile("pnl", F.array(*[F.lit(a) for a in alphas])).over(w).alias("q")).where(F.size("past") == lookback)
    each = past.select(*kept, "past", F.explode(F.arrays_zip(F.array(*[F.lit(a) for a in alphas]).alias("alpha"), F.col("q").alias("var"))).alias("f"))
    each = each.select(*kept, "past", F.col("f.alpha").alias("alpha"), F.round("f.var", 12).alias("var"))
    below = F.filter("past", lambda x: x <= F.col("var") + 1e-12)
    mean = F.aggregate(below, F.lit(0.0), lambda a, x: a + x) / F.size(below)
    return each.withColumn("es", mean).drop("past").withColumn("breached", F.col("pnl") < F.col("var"))


def ewma_sigma(value: str, rows: int, by: list[str], decay: float = DECAY) -> Column:
    """Volatility from the `rows` values before: the recursion v = decay v + (1 - decay) x^2 from v = x0^2, as a fold."""
    past = F.collect_list(value).over(Window.partitionBy(*by).orderBy("date").rowsBetween(-rows, -1))
    v = F.aggregate(F.slice(past, 2, rows), F.pow(F.element_at(past, 1), F.lit(2)), lambda v, x: decay * v + (1 - decay) * x * x)
    return F.when(F.size(past) == rows, F.sqrt(v))


def normal_tails(sigma: Column, alphas: list[float]) -> Column:
    """array of (alpha, var, es) of a zero-mean normal outcome."""
    n = NormalDist()
    return F.array(*[F.struct(F.lit(a).alias("alpha"), (n.inv_cdf(a) * sigma).alias("var"), (-n.pdf(n.inv_cdf(a)) / a * sigma).alias("es")) for a in alphas])


def parametric(returns: DataFrame, weights: dict[str, float], alphas: list[float], rows: int = FIT) -> DataFrame:
    """date, alpha, asset ('' for the book), realized, var, es, sigma, breached of the parametric model at every date with
    `rows` returns before it: zero mean, EWMA volatilities, the window's correlations, and the weights' quadratic form."""
    names = sorted(weights)
    wide = returns.groupBy("date").pivot("asset", names).agg(F.first("r")).dropna()
    before = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-rows, -1)  # one book: its days are the calendar's
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    seen = wide.select(
        "*", F.count(F.lit(1)).over(before).alias("n_"), *[ewma_sigma(a, rows, []).alias(f"s_{a}") for a in names],
        *[F.corr(a, b).over(before).alias(f"c_{a}_{b}") for a, b in pairs],
    ).where(F.col("n_") == rows)
    square = sum((F.pow(weights[a] * F.col(f"s_{a}"), F.lit(2)) for a in names), F.lit(0.0))
    for a, b in pairs:
        square = square + 2 * weights[a] * weights[b] * F.col(f"s_{a}") * F.col(f"s_{b}") * F.col(f"c_{a}_{b}")
    total = sum((weights[a] * F.col(a) for a in names), F.lit(0.0))
    each = [F.struct(F.lit("").alias("asset"), total.alias("realized"), F.sqrt(square).alias("sigma"))]
    each += [F.struct(F.lit(a).alias("asset"), F.col(a).alias("realized"), F.col(f"s_{a}").alias("sigma")) for a in names]
    rows_ = seen.select("date", F.explode(F.array(*each)).alias("e")).select("date", "e.*")
    out = rows_.select("*", F.explode(normal_tails(F.col("sigma"), alphas)).alias("t")).select("date", "t.alpha", "asset", "realized", F.round("t.var", 12).alias("var"), "t.es", "sigma")
    return out.withColumn("breached", F.round("realized", 12) < F.col("var"))


def breach_stats(df: DataFrame, *by: str) -> DataFrame:
    """n, breaches, rate and the transition counts n00 to n11 by group; rows have date and breached."""
    w = Window.partitionBy(*by).orderBy("date")
    step = df.withColumns({"x": F.col("breached").cast("int"), "px": F.lag(F.col("breached").cast("int")).over(w)})
    pair = lambda a, b: F.count(F.when((F.col("px") == a) & (F.col("x") == b), 1)).alias(f"n{a}{b}")
    return step.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("x").cast("long").alias("breaches"), F.avg("x").alias("rate"), pair(0, 0), pair(0, 1), pair(1, 0), pair(1, 1))


def xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.log(y))


def kupiec(n: Column, x: Column, alpha: Column) -> Column:
    """Likelihood ratio of the stated against the observed breach rate."""
    rate = x / n
    stated = xlogy(x, alpha) + xlogy(n - x, 1 - alpha)
    seen = xlogy(x, rate) + xlogy(n - x, 1 - rate)
    return F.greatest(F.lit(0.0), -2 * (stated - seen))


def independence(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """Likelihood ratio of breaches that follow on breaches against ones that don't."""
    p01, p11 = F.try_divide(n01, n00 + n01), F.try_divide(n11, n10 + n11)
    p = F.try_divide(n01 + n11, n00 + n01 + n10 + n11)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    alone = xlogy(n00 + n10, 1 - zero(p)) + xlogy(n01 + n11, zero(p))
    chain = xlogy(n00, 1 - zero(p01)) + xlogy(n01, zero(p01)) + xlogy(n10, 1 - zero(p11)) + xlogy(n11, zero(p11))
    return F.greatest(F.lit(0.0), -2 * (alone - chain))


def simulated_breaches(cells: DataFrame, draws: int, stream: str, *by: str) -> DataFrame:
    """by, b and the counts of breach_stats() for `draws` independent paths of each cell (by, n days, breach probability p).

    A path is drawn by its gaps: from breach to breach a geometric number of days, so a path costs as many draws as it has
    breaches, not as it has days."""
    most = F.ceil(F.col("n") * F.col("p") + 12 * F.sqrt(F.col("n") * F.col("p")) + 20).cast("int")
    paths = cells.select(*by, "n", "p", most.alias("most"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("b"))
    steps = paths.select(*by, "n", "p", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most").cast("long"))).alias("k"))
    gap = F.when(F.col("p") <= 0, F.col("n") + 1).otherwise(1 + F.floor(F.log(R.uniform(stream, *by, "b", "k")) / F.log(1 - F.col("p"))))
    w = Window.partitionBy(*by, "b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    at = steps.withColumn("gap", gap.cast("long")).withColumn("at", F.sum("gap").over(w))
    here, one = F.col("at") <= F.col("n"), lambda c: F.count(F.when(c, 1))
    found = at.groupBy(*by, "b").agg(
        F.first("n").alias("n"), one(here).alias("breaches"), one(here & (F.col("gap") == 1) & (F.col("k") > 0)).alias("n11"),
        one(here & (F.col("at") > 1)).alias("into"), one(here & (F.col("at") < F.col("n"))).alias("out"),
    )
    n01, n10 = F.col("into") - F.col("n11"), F.col("out") - F.col("n11")
    return found.select(*by, "b", "n", "breaches", (F.col("n") - 1 - n01 - n10 - F.col("n11")).alias("n00"), n01.alias("n01"), n10.alias("n10"), "n11")


def simulated_p_values(stats: DataFrame, *by: str, draws: int = 5_000) -> DataFrame:
    """by, kupiec_p, independence_p, conditional_p for breach_stats() by `by`, one of which is alpha: the share of simulated
    statistics at or over the observed one, each test on paths of its own; independence at the observed rate."""
    c, out = F.col, stats.select(*by)
    ratio = {
        "kupiec": lambda: kupiec(c("n"), c("breaches"), c("alpha")),
        "independence": lambda: independence(c("n00"), c("n01"), c("n10"), c("n11")),
        "conditional": lambda: kupiec(c("n"), c("breaches"), c("alpha")) + independence(c("n00"), c("n01"), c("n10"), c("n11")),
    }
    for name, lr in ratio.items():
        seen = stats.select(*by, F.round(lr(), 9).alias("seen"))
        cells = stats.select(*by, "n", (c("breaches") / c("n") if name == "independence" else c("alpha")).alias("p"))
        paths = simulated_breaches(cells, draws, name, *by).join(seen, [*by])
        null = paths.select(*by, "seen", F.round(lr(), 9).alias("lr"))
        out = out.join(null.groupBy(*by).agg(F.avg((c("lr") >= c("seen")).cast("double")).alias(f"{name}_p")), [*by])
    return out


def z1(pnl: str = "pnl", es: str = "es") -> Column:
    """Mean of outcome over stated shortfall on breach days, plus one; null without breaches."""
    return F.avg(F.when(F.col("breached"), F.col(pnl) / F.greatest(F.abs(es), F.lit(1e-12)))) + 1


def z2(alpha: str = "alpha", pnl: str = "pnl", es: str = "es") -> Column:
    total = F.sum(F.when(F.col("breached"), F.col(pnl) / F.greatest(F.abs(es), F.lit(1e-12))).otherwise(0.0))
    return total / (F.count(F.lit(1)) * F.first(alpha)) + 1


def zone(count: Column) -> Column:
    return F.when(count < 5, "green").when(count < 10, "yellow").otherwise("red")


def step_table(count: Column, steps: dict[int, float]) -> Column:
    out = F.lit(0.0)
    for at, value in sorted(steps.items()):
        out = F.when(count >= at, value).otherwise(out)
    return out


def p_outside_green(alpha: float = 0.01, window: int = WINDOW) -> float:
    """Share of windows that a correct model spends with five breaches or more."""
    return 1 - sum(math.comb(window, k) * alpha**k * (1 - alpha) ** (window - k) for k in range(5))


def rolling_count(by: list[str], window: int = WINDOW, complete: bool = False) -> Column:
    """Breaches in the last `window` rows; complete: null until there are so many."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(1 - window, 0)
    total = F.sum(F.col("breached").cast("int")).over(w).cast("long")
    return F.when(F.count(F.lit(1)).over(w) == window, total) if complete else total


def capital(df: DataFrame, by: list[str]) -> DataFrame:
    """Internal-model capital: (base + addend) times the larger of |VaR| and its 60-day mean, partial at the start."""
    mean = F.avg(F.abs("var")).over(Window.partitionBy(*by).orderBy("date").rowsBetween(1 - AVERAGE, 0))
    counted = df.withColumn("count", rolling_count(by)).withColumn("multiplier", BASE + step_table(F.col("count"), ADDEND))
    return counted.withColumn("capital", F.col("multiplier") * F.greatest(F.abs("var"), mean))


def own_funds(df: DataFrame, by: list[str]) -> DataFrame:
    """VaR component: the higher of yesterday's ten-day VaR and the full 60-day mean times the factor, with and without the addend."""
    order = Window.partitionBy(*by).orderBy("date")
    v = F.abs("var") * math.sqrt(HOLDING)
    frame = order.rowsBetween(1 - AVERAGE, 0)
    mean = F.when(F.count(F.lit(1)).over(frame) == AVERAGE, F.avg(v).over(frame))
    out = df.withColumns({"count": rolling_count(by, complete=True), "before": F.lag(v).over(order), "mean60": mean}).where("count IS NOT NULL AND before IS NOT NULL AND mean60 IS NOT NULL")
    addend = step_table(F.col("count"), ADDEND)
    return out.withColumns({"with_addend": F.greatest(F.col("before"), (BASE + addend) * F.col("mean60")), "base": F.greatest(F.col("before"), BASE * F.col("mean60"))})


#: The normal quantile of a two-sided interval of 95 %.  Some users take 1.96 for it.
Z95 = NormalDist().inv_cdf(0.975)


def wilson(x: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p = x / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    # at the ends the bound is exact, whatever the roots round to
    return F.when(x == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(x == n, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
