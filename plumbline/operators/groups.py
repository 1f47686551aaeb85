"""Clustered calibration: conformal radii, held-out folds, change policies, tolerances and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conformal_rank(values: DataFrame, value: str, level: float, *by: str) -> DataFrame:
    """by, radius: the k-th smallest value, k = ceil((n + 1) level); infinite if there aren't so many."""
    w = Window.partitionBy(*by)
    ranked = values.withColumns({"n_": F.count(value).over(w), "r_": F.row_number().over(w.orderBy(value))})
    k = F.ceil(F.round((F.col("n_") + 1) * level, 9))
    return ranked.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("r_") == k, F.col(value))), F.lit(float("inf"))).alias("radius"))


def conformal_higher(values: DataFrame, value: str, alpha: float, *by: str) -> DataFrame:
    """by, radius: NumPy's quantile, method 'higher', at ceil((n + 1)(1 - alpha)) / n: one order statistic above conformal_rank unless it is the last."""
    w = Window.partitionBy(*by)
    ranked = values.withColumns({"n_": F.count(value).over(w), "r_": F.row_number().over(w.orderBy(value))})
    level = F.least(F.lit(1.0), F.ceil(F.round((F.col("n_") + 1) * (1 - alpha), 9)) / F.col("n_"))
    k = F.ceil(F.round(level * (F.col("n_") - 1), 9)) + 1
    return ranked.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("r_") == k, F.col(value))), F.lit(float("inf"))).alias("radius"))


def leave_one_out_line(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """`df` with the prediction of a line fitted to all other groups, and that fit's in-sample sd: from the sums
    of the whole less those of the row's own group, so no fold is ever copied."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(y) * F.col(y)).alias("syy")]
    own = df.groupBy(group).agg(*sums)
    names = ["n", "sx", "sy", "sxx", "sxy", "syy"]
    whole = own.agg(*[F.sum(c).alias(f"{c}_all") for c in names])
    rest = own.crossJoin(F.broadcast(whole)).select(group, *[(F.col(f"{c}_all") - F.col(c)).alias(c) for c in names])  # one row
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in names)
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    fit = rest.withColumn("slope", slope).withColumn("base", (sy - F.col("slope") * sx) / n)
    sse = syy - F.col("base") * sy - F.col("slope") * sxy
    fit = fit.select(group, "slope", "base", F.sqrt(F.greatest(F.lit(0.0), sse) / (n - 2)).alias("sd"))
    return df.join(fit, group).withColumn("pred", F.col("base") + F.col("slope") * F.col(x))


def change_outcomes(tracks: DataFrame, limit: float, rules: dict[str, Column]) -> DataFrame:
    """rule, waste, late, cuts, inert over all tracks (case, cut_index, vb); each rule gives the cut of the change or null.

    A track is summed up once for all rules; a rule sees its first_over, last and triggers as aggregates."""
    over = F.min(F.when(F.col("vb") >= limit, F.col("cut_index"))).alias("first_over")
    per = tracks.groupBy("case").agg(over, F.max("cut_index").alias("last"), *[c.alias(f"change_{i}") for i, c in enumerate(rules.values())])
    out = None
    for i, name in enumerate(rules):
        at, first, last = F.col(f"change_{i}"), F.col("first_over"), F.col("last")
        waste = F.when(at.isNull(), 0).when(first.isNull(), F.greatest(F.lit(0), last - at)).when(at <= first, first - at).otherwise(0)
        late = F.when(at.isNull(), F.when(first.isNull(), 0).otherwise(last - first)).when(first.isNull(), 0).when(at <= first, 0).otherwise(at - first)
        one = F.struct(F.lit(name).alias("rule"), waste.cast("long").alias("waste"), late.cast("long").alias("late"), at.isNull().alias("inert"), last.alias("last"))
        out = [one] if out is None else [*out, one]
    each = per.select(F.explode(F.array(*out)).alias("o")).select("o.*")
    return each.groupBy("rule").agg(F.sum("waste").alias("waste"), F.sum("late").alias("late"), F.sum("last").cast("long").alias("cuts"), F.count(F.when(F.col("inert"), 1)).alias("inert"))


def first_cut(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("cut_index")))


def fixed_change(n: int) -> Column:
    """Change at the n-th cut, if the track gets there."""
    return F.when(F.max("cut_index") >= n, F.lit(n))


def capability(df: DataFrame, group: str, value: str, lower: str, upper: str) -> DataFrame:
    """group, n, mean, sd, outside, share, cpk and the nearest limit in standard deviations."""
    out = (F.col(value) < F.col(lower)) | (F.col(value) > F.col(upper))
    g = df.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(F.when(out, 1)).alias("outside"), F.first(lower).alias("lower"), F.first(upper).alias("upper")
    )
    nearest = F.least(F.col("upper") - F.col("mean"), F.col("mean") - F.col("lower")) / F.col("sd")
    return g.withColumns({"share": F.col("outside") / F.col("n"), "cpk": nearest / 3, "nearest_sd": nearest})


def signal_summary(df: DataFrame, by: str, order: list[str], value: str, least: int = 10) -> DataFrame:
    """A row a signal: mean, sd, rms, peak, p90, kurtosis, skew, slope and clipped share; null under `least` samples, and null moments if it is flat."""
    w = Window.partitionBy(by).orderBy(*order)
    at = df.withColumns({"i": F.row_number().over(w) - 1, "top": F.max(F.abs(value)).over(Window.partitionBy(by))})
    g = at.groupBy(by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(F.abs(value)).alias("peak"),
        F.percentile(F.abs(value), F.lit(0.9)).alias("p90"), F.kurtosis(value).alias("kurtosis"), F.skewness(value).alias("skew"), F.regr_slope(value, "i").alias("slope"),
        F.avg((F.abs(value) >= 0.999 * F.col("top")).cast("double")).alias("clipped"),
    )
    keep = F.col("n") >= least
    flat = F.col("sd") < 1e-12
    return g.select(by, "n", *[F.when(keep & ~(flat & F.lit(c in ("kurtosis", "skew"))), F.col(c)).alias(c) for c in g.columns[2:]])


def envelope(value: str, by: str, order: list[str], width: int = 125) -> Column:
    """Boxcar of |x| in 'same' mode: the ends count as zeros, so the divisor is always the width."""
    half = width // 2
    return F.sum(F.abs(value)).over(Window.partitionBy(by).orderBy(*order).rowsBetween(-half, half)) / width


def plateau(df: DataFrame, by: str, order: list[str], value: str, width: int = 125, least: int = 100, trim: float = 0.1) -> DataFrame:
    """by, first, last (0-based): where the envelope is over half its 95th percentile, or the middle half if that is short; a tenth trimmed at both ends."""
    w = Window.partitionBy(by)
    env = df.select(by, (F.row_number().over(w.orderBy(*order)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"), envelope(value, by, order, width).alias("e"))
    env = env.withColumn("half", 0.5 * F.percentile("e", F.lit(0.95)).over(w))
    ends = env.groupBy(by).agg(F.min(F.when(F.col("e") > F.col("half"), F.col("i"))).alias("a"), F.max(F.when(F.col("e") > F.col("half"), F.col("i"))).alias("b"), F.first("n").alias("n"))
    wide = F.col("b") - F.col("a") + 1 >= least
    a, b = F.when(wide, F.col("a")).otherwise(F.floor(F.col("n") / 4)), F.when(wide, F.col("b")).otherwise(F.floor(3 * F.col("n") / 4))
    cut = F.floor((b - a) * trim)
    return ends.select(by, (a + cut).cast("long").alias("first"), (b - cut).cast("long").alias("last"))


def check_policy(df: DataFrame, thresholds: list[float], score: str, bad: Column) -> DataFrame:
    """threshold, flagged, in_limit_flagged, escaped and caught per 100; flags are strictly over the threshold."""
    each = df.select(score, bad.alias("bad"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    flag = F.col(score) > F.col("threshold")
    share = lambda c: 100 * F.avg(c.cast("double"))
    return each.groupBy("threshold").agg(share(flag).alias("flagged"), share(flag & ~F.col("bad")).alias("in_limit_flagged"), share(~flag & F.col("bad")).alias("escaped"), share(flag & F.col("bad")).alias("caught"))
