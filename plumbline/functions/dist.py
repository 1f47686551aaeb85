"""Normal and Student-t quantiles, distribution functions and shortfalls, without SciPy."""

from __future__ import annotations

import math
from statistics import NormalDist

N = NormalDist()


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d if abs(1 + term * d) > 1e-300 else 1e-300)
        c = 1 + term / c if abs(1 + term / c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_cdf(x: float, nu: float) -> float:
    tail = 0.5 * beta_inc(nu / 2, 0.5, nu / (nu + x * x))
    return 1 - tail if x > 0 else tail


def t_quantile(p: float, nu: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, nu) < p else (low, mid)
    return (low + high) / 2


def t_density(x: float, nu: float) -> float:
    return math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - (nu + 1) / 2 * math.log1p(x * x / nu))


def normal_es(p: float) -> float:
    return -N.pdf(N.inv_cdf(p)) / p


def t_es(p: float, nu: float) -> float:
    """Mean below the p-quantile of a t distribution."""
    q = t_quantile(p, nu)
    return -t_density(q, nu) * (nu + q * q) / ((nu - 1) * p)


def table(ps: list[float], nus: list[float | None]) -> list[tuple]:
    """(nu, p, quantile, cdf there, shortfall); nu null: normal; t scaled to unit variance."""
    out = []
    for nu in nus:
        for p in ps:
            if nu is None:
                q = N.inv_cdf(p)
                out.append((None, p, q, N.cdf(q), normal_es(p)))
            else:
                scale, q = math.sqrt((nu - 2) / nu), t_quantile(p, nu)
                out.append((nu, p, scale * q, t_cdf(q, nu), scale * t_es(p, nu)))
    return out
