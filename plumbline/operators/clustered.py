"""Interval constructions around a forest when rows come in groups: which split keeps its promise."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.forest import Filler, Forest

ALPHA, Z90, LIMIT, CALIBRATION_CASES, TREES, LEAST_SIGMA, BUCKET = 0.10, 1.645, 0.60, 4, 200, 1e-3, 5
CONSTRUCTIONS = ["G", "G_cal", "C_row", "C_grp", "C_norm", "C_mond"]


def radius(scores: np.ndarray, alpha: float = ALPHA) -> float:
    """NumPy's quantile, method 'higher', at ceil((n + 1)(1 - alpha)) / n; infinite for no scores."""
    n = len(scores)
    if not n:
        return math.inf
    return float(np.quantile(scores, min(1.0, math.ceil(round((n + 1) * (1 - alpha), 9)) / n), method="higher"))


class Model:
    """Medians and a forest."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, leaf: int = 2, features: float | None = 1.0):
        self.fill = Filler(x)
        self.x, self.forest = self.fill(x), Forest(trees, leaf, features)
        self.forest.fit(self.x, y)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.forest.predict(self.fill(x))


def mondrian(residuals: np.ndarray, predicted: np.ndarray, limit: float, pooled: float, least: int = BUCKET) -> tuple[float, float]:
    """Radii below and from the limit on, by predicted value; a bucket with fewer than `least` residuals takes the pooled one."""
    hot = predicted >= limit
    return tuple(radius(residuals[m]) if m.sum() >= least else pooled for m in (~hot, hot))


def fold(x: np.ndarray, y: np.ndarray, case: np.ndarray, held: np.ndarray, cal_cases: np.ndarray, cal_rows: np.ndarray, whole: Model, limit: float = LIMIT, trees: int = TREES) -> dict[str, np.ndarray]:
    """pred, sigma and the six half-widths of the held-out rows.

    cal_cases: the training cases that calibrate by group; cal_rows: the training rows that do so by row; whole: the model of
    all training rows.  sigma is a forest of the out-of-bag residuals of the group-wise fit."""
    test = case == held
    train = np.flatnonzero(~test)
    cal, fit = train[np.isin(case[train], cal_cases)], train[~np.isin(case[train], cal_cases)]
    grouped = Model(x[fit], y[fit], trees)
    mu = grouped(x[cal])
    residual = np.abs(y[cal] - mu)
    spread = Forest(trees, 3).fit(grouped.x, np.abs(y[fit] - grouped.forest.out_of_bag(grouped.x)))
    sigma = lambda rows: np.maximum(spread.predict(grouped.fill(x[rows])), LEAST_SIGMA)
    by_row = np.setdiff1d(train, cal_rows)
    rowed = Model(x[by_row], y[by_row], trees)
    pooled = radius(residual)
    cold, hot = mondrian(residual, mu, limit, pooled)
    pred, about = whole(x[test]), sigma(test)
    ones = np.ones(int(test.sum()))
    return {
        "pred": pred, "sigma": about,
        "G": ones * Z90 * math.sqrt(float(np.mean((y[train] - whole(x[train])) ** 2))),
        "G_cal": ones * Z90 * float(np.std(y[cal] - mu, ddof=1)),
        "C_row": ones * radius(np.abs(y[cal_rows] - rowed(x[cal_rows]))),
        "C_grp": ones * pooled, "C_norm": radius(residual / sigma(cal)) * about, "C_mond": np.where(pred >= limit, hot, cold),
    }


def spread(table: DataFrame, cells: int, *by: str) -> DataFrame:
    """Rows of a cell together, cells dealt to four times as many tasks: by size Spark would merge them all into one task, but
    it is what they cost to fit that counts."""
    return table.repartition(4 * max(1, cells), *by)


def held_out(rows: DataFrame, variants: dict[str, list[str]], seeds: int = 25, limit: float = LIMIT, trees: int = TREES) -> DataFrame:
    """variant, seed, case, id, y, pred, sigma and the half-widths of every row, each held out with its case.

    `rows` (id, case, y and features) is a bounded sample: every task, a variant and held-out case, has all of it.  Of a
    fold's other cases CALIBRATION_CASES calibrate, drawn by the seed, and as many rows drawn at random."""
    names = sorted({c for f in variants.values() for c in f})
    folds = rows.select(F.col("case").cast("string").alias("held")).distinct()
    cells = folds.crossJoin(rows.sparkSession.createDataFrame([(v,) for v in variants], "variant string"))
    table = rows.select("id", "case", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in names])
    out = "variant string, seed int, case string, id long, y double, pred double, sigma double, " + ", ".join(f"{c} double" for c in CONSTRUCTIONS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        variant, held = pdf["variant"].iloc[0], pdf["held"].iloc[0]
        x, y, case = pdf[variants[variant]].to_numpy(float), pdf["y"].to_numpy(float), pdf["case"].astype(str).to_numpy()
        mine, train = case == held, np.flatnonzero(case != held)
        others, whole, parts = np.unique(case[train]), Model(x[train], y[train], trees), []
        for seed in range(seeds):
            rng = np.random.default_rng([1000 + seed, *held.encode()])
            cal_cases = rng.choice(others, min(CALIBRATION_CASES, len(others) - 1), replace=False)
            cal_rows = rng.permutation(train)[: int(np.isin(case[train], cal_cases).sum())]
            got = fold(x, y, case, held, cal_cases, cal_rows, whole, limit, trees)
            parts.append(pd.DataFrame({"variant": variant, "seed": seed, "case": held, "id": pdf["id"].to_numpy()[mine], "y": y[mine], **got}))
        return pd.concat(parts).astype({"seed": "int32"})

    return spread(table.crossJoin(F.broadcast(cells)), cells.count(), "variant", "held").groupBy("variant", "held").applyInPandas(run, out)  # variants x cases cells


def coverage(scored: DataFrame, *by: str, limit: float = LIMIT) -> DataFrame:
    """by, construction: mean over seeds of the seeds' coverage, overall and from the limit on, its 5 and 95 % quantiles over
    seeds, and the mean of the seeds' median widths."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("construction"), F.col(c).alias("q")) for c in CONSTRUCTIONS])).alias("e")
    long = scored.select(*by, "seed", "y", "pred", each).select(*by, "seed", "y", "e.construction", "e.q", (F.abs(F.col("y") - F.col("pred")) <= F.col("e.q")).cast("double").alias("hit"))
    one = long.groupBy(*by, "construction", "seed").agg(F.avg("hit").alias("c"), F.avg(F.when(F.col("y") >= limit, F.col("hit"))).alias("w"), F.percentile(2 * F.col("q"), F.lit(0.5)).alias("m"))
    q = F.percentile("c", F.array(F.lit(0.05), F.lit(0.95)))
    return one.groupBy(*by, "construction").agg(F.avg("c").alias("coverage"), F.element_at(q, 1).alias("lo"), F.element_at(q, 2).alias("hi"), F.avg("w").alias("worn"), F.avg("m").alias("width"))


# Fixed values of the simulated clusters: groups, rows a group, groups to test and to calibrate on, trend, trees.
GROUPS, PER_GROUP, TEST_GROUPS, CAL_GROUPS, TREND, SIM_TREES = 24, 10, 6, 6, 0.05, 150
RHOS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


def clusters(rho: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, group): a trend in time, an effect that rows of a group share so that their correlation is rho, and noise; the
    second feature tells the groups apart."""
    group = np.repeat(np.arange(GROUPS), PER_GROUP)
    t = np.tile(np.arange(1.0, PER_GROUP + 1), GROUPS)
    shared = rng.normal(0, math.sqrt(rho / (1 - rho)) if rho > 0 else 0.0, GROUPS)
    y = TREND * t + shared[group] + rng.normal(0, 1.0, len(t))
    return np.stack((t, rng.uniform(0, 1, GROUPS)[group]), axis=1), y, group


def simulate(rho: float, rng: np.random.Generator, leaks: list[float], trees: int = SIM_TREES) -> list[tuple[str, float, float]]:
    """(split, coverage, width) of one repetition, all on the same unseen groups and predictions: calibrated on whole groups, on
    rows, and on groups of which a fraction of the rows was swapped for rows of the fit."""
    x, y, group = clusters(rho, rng)
    order = rng.permutation(GROUPS)
    test, cal = np.isin(group, order[:TEST_GROUPS]), np.isin(group, order[TEST_GROUPS : TEST_GROUPS + CAL_GROUPS])
    fit = ~test & ~cal
    model = Forest(trees).fit(x[fit], y[fit])
    error = np.abs(y[test] - model.predict(x[test]))
    train = rng.permutation(np.flatnonzero(~test))
    n = int(cal.sum())
    rows = Forest(trees).fit(x[train[n:]], y[train[n:]])
    radii = {"group": radius(np.abs(y[cal] - model.predict(x[cal]))), "row": radius(np.abs(y[train[:n]] - rows.predict(x[train[:n]])))}
    inside, outside = rng.permutation(np.flatnonzero(fit)), rng.permutation(np.flatnonzero(cal))
    for leak in leaks:
        k = round(leak * n)
        mixed = np.concatenate((outside[k:], inside[:k]))
        radii[f"leak {leak:g}"] = radius(np.abs(y[mixed] - model.predict(x[mixed])))
    return [(name, float((error <= q).mean()), 2 * q) for name, q in radii.items()]


def simulation(spark, rhos: list[float] = RHOS, repetitions: int = 200, leaks: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), trees: int = SIM_TREES) -> DataFrame:
    """split, rho: mean coverage, its 5 and 95 % quantiles over the repetitions, and the mean width."""
    cells = spark.createDataFrame([(r, k) for r in rhos for k in range(repetitions)], "rho double, rep int").repartition(len(rhos) * 8)

    def run(batches):
        for pdf in batches:
            rows = [(r, int(k), *one) for r, k in zip(pdf["rho"], pdf["rep"], strict=True) for one in simulate(float(r), np.random.default_rng([20_260_823, round(1000 * r), int(k)]), list(leaks), trees)]
            yield pd.DataFrame(rows, columns=["rho", "rep", "split", "coverage", "width"])

    each = cells.mapInPandas(run, "rho double, rep int, split string, coverage double, width double")
    q = F.percentile("coverage", F.array(F.lit(0.05), F.lit(0.95)))
    return each.groupBy("split", "rho").agg(F.avg("coverage").alias("coverage"), F.element_at(q, 1).alias("lo"), F.element_at(q, 2).alias("hi"), F.avg("width").alias("width"))
