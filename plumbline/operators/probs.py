"""Probability forecasts: calibration error, scores, recalibration, prediction sets and decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordered import rank0, running

EPS = 1e-6


def total(p: str | Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def renormalise(df: DataFrame, p: str = "p") -> DataFrame:
    """Vectors that sum to one; rows whose sum is not over zero go."""
    return df.where(total(p) > 0).withColumn(p, F.transform(p, lambda x: x / total(p)))


def vector_stats(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Adds conf, margin, entropy, p_true and top (the first of equal maxima)."""
    ordered = F.sort_array(p, asc=False)
    entropy = -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return df.withColumns({
        "conf": F.array_max(p), "margin": F.element_at(ordered, 1) - F.element_at(ordered, 2), "entropy": entropy,
        "p_true": F.element_at(p, F.col(y) + 1), "top": (F.array_position(p, F.array_max(p)) - 1).cast("int"),
    })


def equal_mass_bin(rank0: Column, n: Column, bins: int) -> Column:
    """Bin of the 0-based rank when a sorted array of n is cut at int(linspace(0, n, bins + 1))."""
    return F.floor(((rank0 + 1) * bins - 1) / n).cast("int")


def ranked(df: DataFrame, value: str, key: str) -> DataFrame:
    """Adds rank0 and n over the whole table."""
    n = F.broadcast(df.agg(F.count(F.lit(1)).alias("n")))  # one row
    return rank0(df, [value, key]).crossJoin(n)


def reliability(df: DataFrame, conf: str, correct: str, key: str, bins: int = 10) -> DataFrame:
    """bin, n, conf, acc, lo, hi of bins of equal mass; ties keep the key's order."""
    binned = ranked(df, conf, key).withColumn("bin", equal_mass_bin(F.col("rank0"), F.col("n"), bins))
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(conf).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"), F.min(conf).alias("lo"), F.max(conf).alias("hi")
    )


def ece(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def brier(p: str = "p", y: str = "y") -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), F.lit(2)))


def log_score(p: str = "p", y: str = "y") -> Column:
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(p)))
    return F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))


def rps(p: str | Column, y: str | Column, k: int) -> Column:
    """Ranked probability score over k ordered levels, by a running total in one fold."""
    y = F.col(y) if isinstance(y, str) else y
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        cum = a["cum"] + x
        gap = cum - F.when(a["i"] >= y, 1.0).otherwise(0.0)
        return F.struct(cum.alias("cum"), (a["sum"] + gap * gap).alias("sum"), (a["i"] + 1).alias("i"))

    return F.aggregate(p, start, step)["sum"] / (k - 1)


def auroc(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Rank statistic with mean ranks for ties; null with one class.  Counts go by distinct score first."""
    by = df.groupBy(p).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(y).cast("long")).alias("pos"))
    below = running(by, [p], F.col("c") - F.col("pos"), "below")
    neg = F.col("c") - F.col("pos")
    return below.agg(F.sum(F.col("pos") * (F.col("below") + neg / 2)).alias("u"), F.sum("pos").alias("a"), F.sum(neg).alias("b")).select(F.try_divide(F.col("u"), F.col("a") * F.col("b")).alias("auroc"))


def tempered(p: str | Column, t: float | Column) -> Column:
    """softmax(log p / T)."""
    logs = F.transform(p, lambda x: F.log(F.greatest(x, F.lit(EPS))) / t)
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / total(raised))


def temperature_grid(df: DataFrame, temperatures: list[float], p: str = "p", y: str = "y") -> DataFrame:
    """temperature, nll: mean negative log-likelihood on a grid; rows stay in place, each makes one sum a grid point."""
    each = F.array(*[F.struct(F.lit(t).alias("temperature"), (-F.log(F.greatest(F.element_at(tempered(p, t), F.col(y) + 1), F.lit(EPS)))).alias("nll")) for t in temperatures])
    return df.select(F.explode(each).alias("g")).groupBy("g.temperature").agg(F.avg("g.nll").alias("nll"))


def fit_temperature(df: DataFrame, p: str = "p", y: str = "y", rounds: int = 4, points: int = 9) -> float:
    """Log-temperature in [-3, 3] of the lowest likelihood loss: a grid of a few points, refined around its best, a job each."""
    low, high = -3.0, 3.0
    best = 0.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        found = temperature_grid(df, [math.exp(g) for g in grid], p, y).orderBy("nll", "temperature").first()
        best, step = math.log(found["temperature"]), (high - low) / (points - 1)
        low, high = best - step, best + step
    return math.exp(best)


def cumulative(p: str | Column) -> Column:
    """(class, p, cum) in falling order of p, the lower class first among equals."""
    tagged = F.transform(p, lambda x, i: F.struct((-x).alias("m"), i.alias("c")))
    ordered = F.array_sort(tagged)
    start = F.struct(F.lit(0.0).alias("cum"), F.array().cast("array<struct<c:int,p:double,cum:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        cum = a["cum"] - x["m"]
        return F.struct(cum.alias("cum"), F.array_append(a["out"], F.struct(x["c"].alias("c"), (-x["m"]).alias("p"), cum.alias("cum"))).alias("out"))

    return F.aggregate(ordered, start, step)["out"]


def mass_set(p: str | Column, mass: float) -> Column:
    """The fewest classes, from the likeliest on, that reach the mass."""
    c = cumulative(p)
    return F.size(F.filter(c, lambda x: x["cum"] - x["p"] < mass - 1e-9))


def higher_quantile(values: DataFrame, value: str, level: Column) -> DataFrame:
    """NumPy's method 'higher' at a level of n: the value of 1-based rank ceil(level (n - 1)) + 1."""
    n = values.agg(F.count(value).alias("n"))
    ranked_values = rank0(values.where(F.col(value).isNotNull()), [value]).crossJoin(F.broadcast(n))  # one row
    return ranked_values.where(F.col("rank0") == F.ceil(F.round(F.least(F.lit(1.0), level) * (F.col("n") - 1), 9))).select(F.col(value).alias("q"))


def decision_costs(df: DataFrame, thresholds: list[float], miss: float = 10.0, alarm: float = 1.0, p: str = "p", y: str = "y") -> DataFrame:
    """threshold, cost per 1,000 of acting at p >= threshold; each row is counted once a threshold, without a join."""
    each = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    act = F.col(p) >= F.col("threshold")
    cost = F.when(act & (F.col(y) == 0), alarm).when(~act & (F.col(y) == 1), miss).otherwise(0.0)
    return df.select(p, y, each).groupBy("threshold").agg((1000 * F.avg(cost)).alias("cost"), F.sum(act.cast("long")).alias("acts"))
