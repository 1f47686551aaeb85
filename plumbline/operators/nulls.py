"""Null distributions of the shortfall statistics Z1 and Z2: six nulls, zones, and what changes with the null alone."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRAWS = 2_000
#: Degrees of freedom of the nulls that fix them, the least that a null may have, and the kurtosis from which the moment null is a t.
FIXED_DF, LEAST_DF, LEAST_KURTOSIS = {"t_df5": 5.0, "t_df8": 8.0, "t_df15": 15.0}, 4.5, 0.1
PARAMETRIC = ["gaussian", "t_moment", *FIXED_DF]
NULLS = [*PARAMETRIC, "empirical"]
#: Simulated outcomes that a task holds at a time.
AT_ONCE = 2_000_000
OUT = (
    "method string, alpha double, null string, df double, n long, breaches long, "
    + ", ".join(f"{z} double, {z}_p double, {z}_green double, {z}_yellow double, {z}_zone string" for z in ("z1", "z2"))
)


def outcomes(rng: np.random.Generator, paths: int, mu: np.ndarray, sigma: np.ndarray, df: float | None, pool: np.ndarray | None) -> np.ndarray:
    """paths x days of one null: from a pool of standardised residuals, normal, or t of the days' own variance."""
    shape = (paths, len(mu))
    if pool is not None:
        e = rng.choice(pool, shape)
    elif df is None:
        e = rng.standard_normal(shape)
    else:
        e = rng.standard_t(df, shape) * math.sqrt((df - 2) / df)
    return mu + sigma * e


def statistics(x: np.ndarray, var: np.ndarray, es: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Z1 (nan on a path without a breach) and Z2 of each path."""
    hit = x < var
    total, n = np.where(hit, x / np.maximum(np.abs(es), 1e-12), 0.0).sum(axis=1), hit.sum(axis=1)
    z1 = np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0) + 1
    return z1, total / (x.shape[1] * alpha) + 1


def zoned(seen: float, null: np.ndarray) -> tuple[float, float, float, str | None]:
    """p-value, the thresholds of green and yellow, and the zone."""
    null = null[~np.isnan(null)]
    if math.isnan(seen) or not len(null):
        return math.nan, math.nan, math.nan, None
    green, yellow = np.percentile(null, [5.0, 0.1])
    return float((null <= seen).mean()), float(green), float(yellow), "green" if seen >= green else "yellow" if seen >= yellow else "red"


def df_of(null: str, kurt: np.ndarray) -> float | None:
    """Degrees of freedom of a t null; none for the others, and for the moment null where kurtosis is negligible."""
    if null == "t_moment":
        k = float(np.median(kurt))
        return max(4 + 6 / k, LEAST_DF) if k > LEAST_KURTOSIS else None
    return FIXED_DF.get(null)


def cell(null: str, alpha: float, mu, sigma, kurt, var, es, realized, draws: int = DRAWS, seed: str = "") -> list:
    """Both statistics under one null, on the same paths."""
    rng = np.random.default_rng(int(hashlib.sha256(f"{seed}|{null}|{alpha}".encode()).hexdigest()[:12], 16))
    df, pool = df_of(null, kurt), None
    if null == "empirical":
        pool = (realized - mu)[sigma > 0] / sigma[sigma > 0]
        pool = pool[np.isfinite(pool)]
    z1s, z2s, step = [], [], max(1, AT_ONCE // max(1, len(mu)))
    for at in range(0, draws, step):
        a, b = statistics(outcomes(rng, min(step, draws - at), mu, sigma, df, pool), var, es, alpha)
        z1s.append(a)
        z2s.append(b)
    seen = statistics(realized[None, :], var, es, alpha)
    out = [math.nan if df is None else df, len(mu), int((realized < var).sum())]
    for z, null_z in zip(seen, (z1s, z2s), strict=True):
        out += [float(z[0]), *zoned(float(z[0]), np.concatenate(null_z))]
    return out


def sweep(book: DataFrame, draws: int = DRAWS) -> DataFrame:
    """A row a (method, alpha, null) of `book` (date, method, alpha, var, es, realized, mu, sigma, kurt); a task a cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        method, alpha, null = pdf["method"].iloc[0], float(pdf["alpha"].iloc[0]), pdf["null"].iloc[0]
        arrays = [pdf[c].to_numpy(float) for c in ("mu", "sigma", "kurt", "var", "es", "realized")]
        return pd.DataFrame([[method, alpha, null, *cell(null, alpha, *arrays, draws=draws, seed=method)]], columns=[c.split()[0] for c in OUT.split(", ")])

    rows = book.select("date", "method", "alpha", "var", "es", "realized", "mu", "sigma", F.coalesce("kurt", F.lit(0.0)).alias("kurt"))
    rows = rows.withColumn("null", F.explode(F.array(*[F.lit(n) for n in NULLS])))
    return rows.groupBy("method", "alpha", "null").applyInPandas(run, OUT)


def with_broken(book: DataFrame, base: str) -> DataFrame:
    """`book` and two models made from `base` to fail: all scaled by 0.8, and the normal law with the same VaR."""
    b = book.where(F.col("method") == base)
    scaled = b.withColumns({c: 0.8 * F.col(c) for c in ("var", "es", "mu", "sigma")}).withColumn("method", F.lit("broken_scaled"))
    n, z, es = NormalDist(), F.lit(None).cast("double"), F.lit(None).cast("double")
    for a in (0.01, 0.025, 0.05):
        z = F.when(F.col("alpha") == a, n.inv_cdf(a)).otherwise(z)
        es = F.when(F.col("alpha") == a, n.pdf(n.inv_cdf(a)) / a).otherwise(es)
    s = (F.col("var") - F.col("mu")) / z
    thin = b.withColumns({"es": F.col("mu") - s * es, "sigma": s, "kurt": F.lit(0.0), "method": F.lit("broken_normal")})
    return book.unionByName(scaled).unionByName(thin)


def flips(sweep_rows: DataFrame) -> DataFrame:
    """method, alpha, statistic, zones (distinct ones), zone_changes, pass_changes over the parametric nulls."""
    rows = sweep_rows.where(F.col("null").isin(PARAMETRIC))
    long = rows.select("method", "alpha", F.explode(F.array(*[F.struct(F.lit(z).alias("statistic"), F.col(f"{z}_zone").alias("zone")) for z in ("z1", "z2")])).alias("s")).select("method", "alpha", "s.*")
    green = F.col("zone") == "green"
    g = long.groupBy("method", "alpha", "statistic").agg(F.countDistinct("zone").alias("zones"), F.bool_or(green).alias("some"), F.bool_and(green).alias("each"))
    return g.select("method", "alpha", "statistic", "zones", (F.col("zones") > 1).alias("zone_changes"), (F.col("some") & ~F.col("each")).alias("pass_changes"))


def test_findings(sweep_rows: DataFrame) -> DataFrame:
    """statistic, share_changed (of real models and levels whose zone depends on the null), missed (broken models that are
    green under the moment null; Z1 can't see frequency and isn't asked about the scaled one)."""
    real = flips(sweep_rows.where(~F.col("method").startswith("broken"))).groupBy("statistic").agg(F.avg(F.col("zone_changes").cast("double")).alias("share_changed"))
    controls = sweep_rows.where((F.col("null") == "t_moment") & F.col("method").startswith("broken"))
    asked = F.explode(F.array(F.struct(F.lit("z1").alias("statistic"), F.col("z1_zone").alias("zone")), F.struct(F.lit("z2").alias("statistic"), F.col("z2_zone").alias("zone"))))
    kept = controls.select("method", asked.alias("s")).where("s.statistic = 'z2' OR method = 'broken_normal'")
    missed = kept.groupBy("s.statistic").agg(F.count(F.when(F.col("s.zone") == "green", 1)).alias("missed"))
    return real.join(missed, "statistic")


def process_effects(before: DataFrame, after: DataFrame, method: str = "conformal_pid", alpha: float = 0.01) -> DataFrame:
    """One row: how far the model's change moved Z1 under the old null, how far the null's change moved the threshold, and
    the zone that the model's change alone reaches."""
    at = lambda df, null: df.where((F.col("method") == method) & (F.col("alpha") == alpha) & (F.col("null") == null))
    was = at(before, "gaussian").select(F.col("z1").alias("z_was"))
    alone = at(after, "gaussian").select(F.col("z1").alias("z_now"), F.col("z1_green").alias("old_limit"), F.col("z1_zone").alias("zone_model_alone"))
    both = at(after, "t_moment").select(F.col("z1_green").alias("new_limit"))
    one = was.crossJoin(alone).crossJoin(both)  # one row each
    return one.select((F.col("z_now") - F.col("z_was")).alias("model_effect"), (F.col("new_limit") - F.col("old_limit")).alias("reference_effect"), "zone_model_alone")
