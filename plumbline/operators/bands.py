"""Trailing forecast bands, how they cover, and what their misses cost."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, LEAST = 90, 60
#: Stated level -> its lower tail.
LEVELS = {0.80: 0.10, 0.90: 0.05, 0.95: 0.025}
#: Edges are rounded, so that a value on an edge is inside in any order of summation.
EDGE_DIGITS = 9


def z(tail: float) -> float:
    return NormalDist().inv_cdf(1 - tail)


def trailing(panel: DataFrame, window: int = WINDOW, least: int = LEAST, levels: dict[float, float] = LEVELS) -> DataFrame:
    """`panel` with the `window` rows before each row of its slot summed up: n, mean, sd and the tails' quantiles (one
    array, so that one sorted window serves them all).  Rows with fewer than `least` errors are dropped."""
    before = Window.partitionBy("slot").orderBy("date").rowsBetween(-window, -1)
    tails = [p for tail in levels.values() for p in (tail, 1 - tail)]
    summed = panel.select(
        "*", F.count("err").over(before).alias("n"), F.avg("err").over(before).alias("mean"), F.stddev_samp("err").over(before).alias("sd"),
        F.percentile("err", F.array(*[F.lit(p) for p in tails])).over(before).alias("q"),
    )
    return summed.where((F.col("n") >= least) & F.col("err").isNotNull())


def oracle_edges(panel: DataFrame, first: int = LEAST, levels: dict[float, float] = LEVELS) -> DataFrame:
    """slot and the tails' quantiles over its whole history from the `first` row on: a floor, as it looks ahead."""
    tails = [p for tail in levels.values() for p in (tail, 1 - tail)]
    rank = F.row_number().over(Window.partitionBy("slot").orderBy("date"))
    return panel.withColumn("k", rank).where(F.col("k") > first).groupBy("slot").agg(F.percentile("err", F.array(*[F.lit(p) for p in tails])).alias("q"))


def edges(method: str, levels: dict[float, float] = LEVELS) -> Column:
    """array of (level, method, lo, hi) from what trailing() or oracle_edges() add."""
    out = []
    for i, (level, tail) in enumerate(levels.items()):
        if method == "gaussian":
            lo, hi = F.col("mean") - z(tail) * F.col("sd"), F.col("mean") + z(tail) * F.col("sd")
        else:
            lo, hi = F.element_at("q", 2 * i + 1), F.element_at("q", 2 * i + 2)
        out.append(F.struct(F.lit(level).alias("level"), F.lit(method).alias("method"), F.round(lo, EDGE_DIGITS).alias("lo"), F.round(hi, EDGE_DIGITS).alias("hi")))
    return F.array(*out)


def score(banded: DataFrame, methods: list[str]) -> DataFrame:
    """A row for each date, slot, level and method: lo, hi, inside, width and excess beyond the nearer edge."""
    keep = [c for c in banded.columns if c not in ("n", "mean", "sd", "q")]
    bands = banded.select(*keep, F.explode(F.concat(*[edges(m) for m in methods])).alias("b")).select(*keep, "b.*")
    err = F.col("err")
    return bands.select(
        "*", ((err >= F.col("lo")) & (err <= F.col("hi"))).alias("inside"), (F.col("hi") - F.col("lo")).alias("width"),
        F.when(err > F.col("hi"), err - F.col("hi")).when(err < F.col("lo"), F.col("lo") - err).otherwise(0.0).alias("excess"),
    )


def scored_panel(panel: DataFrame) -> DataFrame:
    return score(trailing(panel), ["gaussian", "conformal"])


def coverage(scored: DataFrame, *by: str | Column) -> DataFrame:
    return scored.groupBy("level", "method", *by).agg(F.avg(F.col("inside").cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def adverse_spread(err: str = "err", price: str = "da", low: str = "low", high: str = "high") -> Column:
    """What a miss costs a unit: to the highest price if short, to the lowest if long; null if a price is missing."""
    known = F.col(price).isNotNull() & F.col(low).isNotNull() & F.col(high).isNotNull()
    side = F.when(F.col(err) > 0, F.col(high) - F.col(price)).otherwise(F.col(price) - F.col(low))
    return F.when(known, F.greatest(side, F.lit(0.0)))


def flag_expensive(scored: DataFrame, q: float = 0.80) -> DataFrame:
    """Adds expensive: adverse at or over its q-quantile over distinct (date, slot) intervals."""
    limit = scored.dropDuplicates(["date", "slot"]).agg(F.round(F.percentile("adverse", F.lit(q)), EDGE_DIGITS).alias("limit"))
    return scored.crossJoin(F.broadcast(limit)).withColumn("expensive", F.col("adverse") >= F.col("limit")).drop("limit")  # one row


def concentration(scored: DataFrame, *by: str) -> DataFrame:
    """Miss rate of expensive intervals over that of the others; null where the latter is zero."""
    miss = (~F.col("inside")).cast("double")
    rates = scored.groupBy(*by).agg(F.avg(F.when(F.col("expensive"), miss)).alias("expensive_miss"), F.avg(F.when(~F.col("expensive"), miss)).alias("cheap_miss"), F.count(F.when(F.col("expensive"), 1)).alias("n_expensive"))
    return rates.withColumn("concentration", F.try_divide("expensive_miss", "cheap_miss"))


def day_counts(scored: DataFrame) -> DataFrame:
    """By level, method and date: all that coverage and concentration need, so that whole days can be redrawn."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    e, i = F.col("expensive"), F.col("inside")
    return scored.groupBy("level", "method", "date").agg(
        F.count(F.lit(1)).alias("n"), one(i).alias("inside"), one(e).alias("n_exp"), one(e & ~i).alias("miss_exp"), one(~e).alias("n_cheap"), one(~e & ~i).alias("miss_cheap")
    )


def exposure(scored: DataFrame, *by: str, hours: float = 0.25) -> DataFrame:
    """Cost of the excess beyond the band, at the adverse spread."""
    return scored.groupBy(*by).agg(F.sum(F.col("excess") * F.col("adverse") * hours).alias("cost"))


def integrity(panel: DataFrame, *by: str) -> DataFrame:
    """Correlation, OLS line and relative bias of actual on forecast, and whether they pass the gate."""
    both = panel.where("act IS NOT NULL AND fc IS NOT NULL")
    g = both.groupBy(*by).agg(
        F.corr("act", "fc").alias("corr"), F.regr_slope("act", "fc").alias("slope"), F.regr_intercept("act", "fc").alias("intercept"), F.regr_r2("act", "fc").alias("r2"),
        ((F.avg("fc") - F.avg("act")) / F.avg("act")).alias("bias"), F.count(F.lit(1)).alias("n"),
    )
    return g.withColumn("passes", (F.col("corr") >= 0.90) & (F.abs(F.col("slope") - 1) <= 0.15) & (F.abs("bias") <= 0.05))


def two_regressors(df: DataFrame, y: str, a: str, b: str, *by: str) -> DataFrame:
    """Coefficients, intercept and R2 of y on a and b by the normal equations, from one aggregate."""
    full = df.dropna(subset=[y, a, b])
    cov = lambda u, v, name: F.covar_samp(u, v).alias(name)
    m = full.groupBy(*by).agg(cov(y, a, "ya"), cov(y, b, "yb"), cov(a, b, "ab"), cov(a, a, "aa"), cov(b, b, "bb"), cov(y, y, "yy"), F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(b).alias("mb"))
    det = F.expr("aa * bb - ab * ab")
    m = m.withColumns({"coef_a": F.try_divide(F.expr("ya * bb - yb * ab"), det), "coef_b": F.try_divide(F.expr("yb * aa - ya * ab"), det)})
    return m.select(*by, "coef_a", "coef_b", F.expr("my - coef_a * ma - coef_b * mb").alias("intercept"), F.expr("(coef_a * ya + coef_b * yb) / yy").alias("r2"))
