"""The walk-forward of the models that carry a state: GARCH marginals under a copula, and two calibrations of them.

A book is one time series, so one group function walks it; books are as many tasks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from plumbline.functions import dist
from plumbline.operators import controllers as C

FIT, WARM, REFIT, DRAWS, SEED, LEAST_DF = 500, 500, 20, 5_000, 42, 4.0
#: Returns are scaled so that the fit's parameters are of the order of one.
PERCENT = 100.0
ROWS = (
    "date date, method string, alpha double, asset string, var double, es double, realized double, breached boolean,"
    " mu double, sigma double, kurt double, level double, es_scale double"
)


def variances(r: np.ndarray, omega: float, a: float, b: float) -> np.ndarray:
    """Conditional variances of residuals r and of the day after, from their mean square on."""
    v = [max(float(np.mean(r * r)), 1e-12)]
    for x in (r * r).tolist():
        v.append(omega + a * x + b * v[-1])
    return np.array(v)


def loss(r: np.ndarray, omega: float, a: float, b: float, nu: float | None) -> float:
    """Negative log-likelihood; nu: degrees of freedom of unit-variance t innovations, none for normal ones."""
    v = variances(r, omega, a, b)[:-1]
    if nu is None:
        return float(0.5 * np.sum(np.log(2 * np.pi * v) + r * r / v))
    c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    return float(-np.sum(c - 0.5 * np.log(v) - (nu + 1) / 2 * np.log1p(r * r / (v * (nu - 2)))))


@dataclass(frozen=True)
class Garch:
    mu: float
    omega: float
    a: float
    b: float
    nu: float | None

    def next(self, r: float, v: float) -> float:
        return self.omega + self.a * (r - self.mu) ** 2 + self.b * v


def fit_garch(r: np.ndarray, student: bool = True, rounds: int = 60) -> Garch:
    """A constant mean, (omega, a, b) and nu, by a coordinate search whose steps grow on success and shrink on failure,
    over: mean in standard deviations, log of the long-run variance over the sample's, log-odds of persistence and of its
    split, and log(nu - 2.1)."""
    mean, sd = float(r.mean()), max(float(r.std()), 1e-6)
    logistic = lambda x: 1 / (1 + math.exp(-held(x)))
    held = lambda x: min(max(x, -30.0), 30.0)

    def read(x: list[float]) -> Garch:
        keep, share = logistic(x[2]) * 0.9999, logistic(x[3])
        nu = 2.1 + math.exp(min(6.0, x[4])) if student else None
        return Garch(mean + sd * x[0], sd * sd * math.exp(held(x[1])) * (1 - keep), keep * share, keep * (1 - share), nu)

    def cost(x: list[float]) -> float:
        g = read(x)
        return loss(r - g.mu, g.omega, g.a, g.b, g.nu)

    x, step = [0.0, 0.0, 3.0, -2.5, 1.8], [0.05, 0.2, 0.8, 0.8, 0.5]
    best = cost(x)
    for _ in range(rounds):
        for i in range(5 if student else 4):
            for move in (step[i], -step[i]):
                y = [*x[:i], x[i] + move, *x[i + 1 :]]
                if (found := cost(y)) < best - 1e-9:
                    x, best, step[i] = y, found, 1.5 * move
                    break
            else:
                step[i] /= 3
        if max(map(abs, step)) < 2e-3:
            break
    return read(x)


@functools.lru_cache(maxsize=256)
def t_table(nu: float) -> tuple[np.ndarray, np.ndarray]:
    """Angles and the distribution function of t = sqrt(nu) tan(angle) there, by the integral of cos^(nu - 1)."""
    edge = np.linspace(0, np.pi / 2, 8_193)
    y = np.cos(edge[:-1] + (edge[1] - edge[0]) / 2) ** (nu - 1)  # midpoints
    upper = np.concatenate((np.cumsum(y[::-1])[::-1], [0.0]))  # what lies beyond each angle, summed from the tail
    upper *= 0.5 / upper[0]
    return edge, upper


def t_cdf(x: np.ndarray, nu: float) -> np.ndarray:
    edge, upper = t_table(nu)
    beyond = np.interp(np.arctan(np.abs(x) / math.sqrt(nu)), edge, upper)
    return np.where(x > 0, 1 - beyond, beyond)


def t_quantile(p: np.ndarray, nu: float) -> np.ndarray:
    edge, upper = t_table(nu)
    size = math.sqrt(nu) * np.tan(np.interp(-np.minimum(p, 1 - p), -upper, edge))
    return np.where(p < 0.5, -size, size)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x.ravel().tolist()]).reshape(x.shape)


def copula_draws(corr: np.ndarray, nus: list[float], copula_df: float | None, draws: int = DRAWS, seed: int = SEED) -> np.ndarray:
    """draws x assets: t marginals of their own degrees of freedom, joined by a Gaussian copula (copula_df None) or a t one.
    The marginals are the same under both; only what happens together differs."""
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((draws, len(nus))) @ np.linalg.cholesky(corr).T
    if copula_df is None:
        u = normal_cdf(z)
    else:
        u = t_cdf(z / np.sqrt(rng.chisquare(copula_df, (draws, 1)) / copula_df), copula_df)
    return np.stack([t_quantile(u[:, k], nu) for k, nu in enumerate(nus)], axis=1)


@dataclass(frozen=True)
class Joint:
    """A fit of all assets: marginals, correlation of their standardised residuals, copula degrees of freedom, unit draws."""

    marginals: list[Garch]
    corr: np.ndarray
    copula_df: float | None
    draws: np.ndarray


def fit_joint(returns: np.ndarray, copula: str = "t") -> tuple[Joint, np.ndarray]:
    """The fit of a window (days x assets, in percent) and the next day's variances."""
    marginals = [fit_garch(r) for r in returns.T]
    paths = [variances(r - g.mu, g.omega, g.a, g.b) for r, g in zip(returns.T, marginals, strict=True)]
    residuals = np.stack([(r - g.mu) / np.sqrt(v[:-1]) for r, g, v in zip(returns.T, marginals, paths, strict=True)])
    corr = np.corrcoef(residuals) if len(marginals) > 1 else np.ones((1, 1))
    df = max(float(np.mean([g.nu for g in marginals])), LEAST_DF) if copula == "t" else None
    joint = Joint(marginals, corr, df, copula_draws(corr, [g.nu for g in marginals], df))
    return joint, np.array([v[-1] for v in paths])


def excess_kurtosis(x: np.ndarray) -> float:
    d = x - x.mean()
    s2 = float((d * d).mean())
    return float((d**4).mean()) / s2**2 - 3 if len(x) >= 4 and s2 > 0 else 0.0


class Empirical:
    """A distribution given by draws."""

    def __init__(self, draws: np.ndarray):
        self.draws = np.sort(draws)

    def quantile(self, p: float) -> float:
        return C.quantile(self.draws, p)

    def below(self, q: float) -> float:
        few = self.draws[: np.searchsorted(self.draws, q, "right")]
        return float(few.mean()) if len(few) else q


class Student:
    """sigma times t with nu degrees of freedom."""

    def __init__(self, sigma: float, nu: float):
        self.sigma, self.nu = sigma, nu

    def quantile(self, p: float) -> float:
        return self.sigma * _unit_quantile(p, self.nu)

    def below(self, q: float) -> float:
        z = q / self.sigma
        p = dist.t_cdf(z, self.nu)
        return -self.sigma * (self.nu + z * z) / (self.nu - 1) * dist.t_density(z, self.nu) / p if p > 0 else q


@functools.lru_cache(maxsize=100_000)
def _unit_quantile(p: float, nu: float) -> float:
    return dist.t_quantile(p, nu)


def signal(d: Empirical | Student) -> tuple[float, float]:
    """What a calibration sees of a forecast: its median and the width between the 5 and 95 % quantiles."""
    return d.quantile(0.5), d.quantile(0.95) - d.quantile(0.05)


def walk(returns: np.ndarray, weights: np.ndarray, names: list[str], alphas: list[float], fit: int = FIT, warm: int = WARM, refit: int = REFIT, copula: str = "t") -> Iterator[tuple]:
    """(day, method, alpha, asset, var, es, realized, breached, mu, sigma, kurt, level, es_scale) of the days after the warm-up.

    asset is '' for the book.  A day's forecast is made before its outcome is seen; the shortfall's factor moves on what was
    stated, before the quantile's level does."""
    scaled, book = returns * PERCENT, returns @ weights
    targets = ["", *names]
    bands = {(t, a): C.Band(a) for t in targets for a in alphas}
    depths = {a: C.Depth() for a in alphas}
    joint, variance, age = None, None, 0
    for i in range(fit, len(returns)):
        if joint is None or age >= refit:
            (joint, variance), age = fit_joint(scaled[i - fit : i], copula), 0
        else:
            variance = np.array([g.next(r, v) for g, r, v in zip(joint.marginals, scaled[i - 1], variance, strict=True)])
            age += 1
        sigma = np.sqrt(variance) / PERCENT
        draws = (joint.draws * sigma) @ weights
        base = {"": Empirical(draws)} | {n: Student(float(s), g.nu) for n, s, g in zip(names, sigma, joint.marginals, strict=True)}
        outcome = {"": float(book[i])} | dict(zip(names, returns[i].tolist(), strict=True))
        sees = {t: signal(base[t]) for t in targets}
        if i >= fit + warm:
            moments = (float(draws.mean()), float(draws.std()), excess_kurtosis(draws))
            for a in alphas:
                for t in targets:
                    plain, real = base[t].quantile(a), outcome[t]
                    about = moments if t == "" else (0.0, float(base[t].sigma), None)
                    yield i, "distributional", a, t, plain, base[t].below(plain), real, real < plain, *about, None, None
                    var = plain
                    if len(bands[t, a].residuals):
                        var, bands[t, a] = C.stated(bands[t, a], *sees[t])
                    es, level = base[t].below(var), bands[t, a].level
                    yield i, "conformal_pid", a, t, var, es, real, real < var, *about, level, None
                    if t == "":
                        factor, es = depths[a].factor, C.deepened(depths[a], var, es)
                        depths[a] = C.after_breach(depths[a], real, es, real < var)
                        yield i, "conformal_pid_es", a, t, var, es, real, real < var, *about, level, factor
                    else:
                        yield i, "conformal_pid_es", a, t, var, es, real, real < var, *about, level, None
        for t, a in bands:
            bands[t, a] = C.after_outcome(bands[t, a], *sees[t], outcome[t], a)


def walk_books(returns: DataFrame, weights: dict[str, float], alphas: list[float], key: str = "book", **settings) -> DataFrame:
    """`key` and the rows of walk() for returns (key, date, asset, r); days on which an asset is missing are left out."""
    names = list(weights)
    share = np.array([weights[n] for n in names])
    kind = returns.schema[key].dataType.simpleString()
    columns = [c.split()[0] for c in ROWS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="asset", values="r").sort_index().reindex(columns=names).dropna()
        rows = list(walk(wide.to_numpy(float), share, names, alphas, **settings))
        out = pd.DataFrame([(wide.index[r[0]], *r[1:]) for r in rows], columns=columns)
        out.insert(0, key, pdf[key].iloc[0])
        return out.astype({c: "float64" for c in ("mu", "sigma", "kurt", "level", "es_scale")})

    return returns.select(key, "date", "asset", "r").groupBy(key).applyInPandas(run, f"{key} {kind}, {ROWS}")


def garch_path(returns: DataFrame, fit: int = FIT, refit: int = REFIT, student: bool = True) -> DataFrame:
    """asset, date, sigma, nu: one-day-ahead volatility of each asset, refitted after every `refit` steps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable").reset_index(drop=True)
        r = pdf["r"].to_numpy(float) * PERCENT
        g, v, age, out = None, 0.0, 0, []
        for i in range(fit, len(r)):
            if g is None or age >= refit:
                g, age = fit_garch(r[i - fit : i], student), 0
                v = variances(r[i - fit : i] - g.mu, g.omega, g.a, g.b)[-1]
            else:
                v, age = g.next(r[i - 1], v), age + 1
            out.append((i, math.sqrt(v) / PERCENT, g.nu))
        at = [o[0] for o in out]
        return pd.DataFrame({"asset": pdf["asset"].iloc[at], "date": pdf["date"].iloc[at], "sigma": [o[1] for o in out], "nu": [o[2] for o in out]}).astype({"nu": "float64"})

    return returns.select("asset", "date", "r").groupBy("asset").applyInPandas(run, "asset string, date date, sigma double, nu double")
